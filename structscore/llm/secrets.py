"""Secret scan: broad candidates, then a random forest that removes false ones.

Candidates are long runs of key characters wherever they stand, and values of
any length and characters that a name like password is given, or that stand as
password in a URL.

Candidates, features and verdicts are DataFrame expressions; the forest is
Spark's own, trained on a bounded table of labelled findings.  Candidates are
looked up word by word inside each row, so neighbouring words are at hand and
nothing is shuffled.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .quality import words

#: A token of three parts with dots between, whose first begins with eyJ.
TOKEN = "eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}(?:\\.[A-Za-z0-9_-]+)?"
#: Such a token, or a run of characters that keys, tokens and digests are written in, up to one.
CANDIDATE = f"{TOKEN}|(?:(?!{TOKEN})[A-Za-z0-9+/_=-]){{16,}}"

# Words that stand in identifiers, paths and prose rather than in keys.
DICTIONARY = (
    "account address admin api auth base build card change check client code commit config connection content count "
    "create data database date default delete description document email end error event example export false field "
    "file filter first format function get group hash header here home host http https image import index info input "
    "item key label last length line link list local log login main message method mode model module name node null "
    "number object option order output page parameter password path phone placeholder point port private process "
    "profile project property public query read record remote report request resource response result return role "
    "root sample search secret section server service session set size source start state static status storage "
    "string style success system table tag temp test text time title token true type update user value version view "
    "web window with word write your and are the for from this that tion ing der die und que los las con est les des "
    "pour mente ción eau ment ung keit"
).split()

# Words beside a finding that speak for or against it.
FOR_WORDS = "token|secret|passw|pwd|api[_-]?key|apikey|auth|bearer|credential|private|access[_-]?key"
AGAINST_WORDS = "commit|sha1|sha256|md5|digest|checksum|revision|etag|integrity|uuid|guid|version|isbn|order|invoice|phone"

# What stands in place of a value.
FILLER = "^[<$%{(]|[({]|\\*\\*|xxx|\\.\\.\\.|your|example|changeme|placeholder|redacted|^(?:null|none|nil|true|false|undefined|required|optional|string|password|secret|token|basic|bearer)$"

#: A name that speaks for a finding, up to its end; what gives it a value; a value inside a word.
NAME = f"(?:{FOR_WORDS})[\\w.-]*[\"'`\\])]*"
GIVES = "(?::=|=>|->|={1,3}|:)"
VALUE = "(\"[^\"]*(?<!\\\\)\"|'[^']*(?<!\\\\)'|`[^`]*`|.+?(?=[;&,][\"']?[A-Za-z_][\\w.-]*[\"']?[=:]|$))"
#: The password in a URL: user, colon, password, at sign, before the first slash.
URL_PASSWORD = "(?i)[a-z][a-z0-9+.-]*://[^\\s:/@]*:([^\\s/]+)@"

#: Labelled findings that the default forest is trained on.
TRAINING_ROWS = 6_000


def _values(words_: Column, i: Column) -> Column:
    """Values in word i: given to a telling name there or in the two words before, or a URL's password.

    A quoted value may go on over later words; its spaces are then single ones.
    """

    def at(j: Column) -> Column:
        return F.coalesce(F.get(words_, j), F.lit(""))

    def plain(v: Column) -> Column:
        return F.regexp_replace(v, "^[\"'`(\\[{]+|[\"'`,;)\\]}]+$", "")

    def whole(v: Column) -> Column:
        closed = "(?s)^([\"'`])(.*?)(?<!\\\\)\\1"
        on = F.concat_ws(" ", v, F.array_join(F.slice(words_, i + 2, F.size(words_)), " "))
        return F.when(~v.rlike("^[\"'`]"), plain(v)).when(v.rlike(closed), F.regexp_extract(v, closed, 2)).when(on.rlike(closed), F.regexp_extract(on, closed, 2)).otherwise(plain(v))

    word, before = at(i), at(i - 1)
    lead = F.concat_ws(" ", at(i - 3), at(i - 2), before)
    led = lead.rlike(f"(?i){NAME} ?{GIVES}$|{NAME} ?{GIVES} ?(?:bearer|basic)$|(?:^| )--?[\\w-]*(?:{FOR_WORDS})[\\w-]*$")
    split = before.rlike(f"(?i){NAME}$") & word.rlike(f"(?s)^{GIVES}.")
    none = F.array().cast("array<string>")
    only_mark = word.rlike(f"^{GIVES}$")
    first = F.when(led & ~only_mark, F.array(whole(word))).when(split & ~only_mark, F.array(whole(F.regexp_replace(word, f"^{GIVES}", "")))).otherwise(none)
    inside = F.when(word.rlike(f"(?is){NAME}{GIVES}."), F.transform(F.regexp_extract_all(word, F.lit(f"(?is){NAME}{GIVES}{VALUE}"), F.lit(1)), whole)).otherwise(none)
    in_url = F.when(F.contains(word, F.lit("://")) & F.contains(word, F.lit("@")), F.regexp_extract_all(word, F.lit(URL_PASSWORD), F.lit(1))).otherwise(none)
    return F.filter(F.concat(first, inside, F.filter(in_url, lambda v: ~F.array_contains(first, v) & ~F.array_contains(inside, v))), lambda v: v != "")


def _candidates(words_: Column, i: Column) -> Column:
    """Candidates of word i: its long runs, then its values that aren't one of these."""
    word = F.get(words_, i)
    runs = F.when(F.length(word) >= 16, F.regexp_extract_all(word, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    near = F.concat_ws(" ", F.slice(words_, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)) + 1))
    values = F.when(near.rlike(f"(?i){FOR_WORDS}|://"), _values(words_, i)).otherwise(F.array().cast("array<string>"))
    return let(runs, lambda r: let(values, lambda vs: F.concat(r, F.filter(vs, lambda v: ~F.array_contains(r, v)))))


def findings(documents: DataFrame, path: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, word_at, nth, again, candidate, word, before, before2, after, path.

    word_at counts white-space-delimited words from 0, nth the candidates of a
    word, `again` from 1 those of them that are alike.  `path` names the column that says where a row is from (none: empty).
    Null texts have no candidates; repeated rows repeat theirs.
    """
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path and path in documents.columns else F.lit("")
    rows = documents.select("doc_id", where.alias("path"), words(F.coalesce(F.col("text"), F.lit(""))).alias("words"))

    def neighbour(i: Column) -> Column:
        return F.coalesce(F.get("words", i), F.lit(""))

    # most words need no closer look: neither long nor near a telling name nor in a URL
    told = F.transform("words", lambda w: w.rlike(f"(?i){FOR_WORDS}"))
    rows = rows.withColumn("told", F.when(F.exists(told, lambda t: t), told).otherwise(F.array().cast("array<boolean>")))

    def near_name(i: Column) -> Column:
        return F.exists(F.slice("told", F.greatest(i - 2, F.lit(1)), 4), lambda t: t)

    found = F.filter(
        F.transform(
            "words",
            lambda w, i: F.when((F.length(w) >= 16) | F.contains(w, F.lit("://")) | ((F.size("told") > 0) & near_name(i)), F.struct(
                i.alias("word_at"),
                w.alias("word"),
                neighbour(i - 1).alias("before"),
                neighbour(i - 2).alias("before2"),
                neighbour(i + 1).alias("after"),
                _candidates(F.col("words"), i).alias("candidates"),
            )),
        ),
        lambda x: x.isNotNull() & (F.size(x["candidates"]) > 0),
    )
    each = rows.select("doc_id", "path", F.explode(found).alias("f")).select("doc_id", "path", "f.*")
    each = each.select("*", F.posexplode("candidates").alias("nth", "candidate"))
    again = F.size(F.filter(F.slice("candidates", F.lit(1), F.col("nth") + 1), lambda c: c == F.col("candidate")))
    return each.withColumn("again", again).drop("candidates")


def features(rows: DataFrame) -> DataFrame:
    """`rows` with the forest's inputs, all doubles."""
    c, low = F.col("candidate"), F.lower("candidate")
    n = F.length(c).cast("double")
    again = F.col("again") if "again" in rows.columns else F.lit(1)
    front = F.call_function("substring_index", F.col("word"), F.substring_index(c, " ", 1), again)
    near = F.lower(F.concat_ws(" ", "before2", "before", front))
    lead = F.concat_ws(" ", "before", front)

    def share(pattern: str, of: Column = c) -> Column:
        return F.regexp_count(of, F.lit(pattern)) / n

    letters = F.array_distinct(F.split(c, ""))
    entropy = F.aggregate(
        F.filter(letters, lambda x: x != ""),
        F.lit(0.0),
        lambda a, x: a - (n - F.length(F.replace(c, x, F.lit("")))) / n * F.log2((n - F.length(F.replace(c, x, F.lit("")))) / n),
    )
    inputs = {
        "x_length": n,
        "x_digits": share("[0-9]"),
        "x_lower": share("[a-z]"),
        "x_upper": share("[A-Z]"),
        "x_hex": share("[0-9a-fA-F]"),
        "x_marks": share("[+/_=-]"),
        "x_other": share("[^a-zA-Z0-9+/_=-]"),
        "x_userinfo": front.rlike("://[^/@]*:$").cast("double"),
        "x_filler": low.rlike(FILLER).cast("double"),
        "x_turns": share("[a-z](?=[0-9A-Z])|[0-9](?=[a-zA-Z])|[A-Z](?=[0-9a-z])"),
        "x_vowel_turns": share("[aeiou](?=[^aeiou0-9+/_=-])", low),
        "x_repeats": share("(.)(?=\\1)"),
        "x_entropy": entropy,
        "x_dictionary": (n - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), ""))) / n,
        "x_path_depth": F.regexp_count("word", F.lit("/")).cast("double"),
        "x_url": F.col("word").rlike("(?i)https?:|www\\.").cast("double"),
        "x_path_test": F.col("path").rlike("(?i)test|example|sample|fixture|mock").cast("double"),
        "x_for": near.rlike(FOR_WORDS).cast("double"),
        "x_against": near.rlike(AGAINST_WORDS).cast("double"),
        "x_assigned": lead.rlike("[=:]\\s*[\"'(]*$").cast("double"),
        "x_quoted": front.rlike("[\"'`]$").cast("double"),
    }
    return rows.select("*", *[v.alias(k) for k, v in inputs.items()])


INPUTS = [
    "x_length", "x_digits", "x_lower", "x_upper", "x_hex", "x_marks", "x_other", "x_userinfo", "x_filler", "x_turns", "x_vowel_turns", "x_repeats", "x_entropy",
    "x_dictionary", "x_path_depth", "x_url", "x_path_test", "x_for", "x_against", "x_assigned", "x_quoted",
]


def labelled_findings(spark: SparkSession, n: int = TRAINING_ROWS, start: int = 0) -> DataFrame:
    """Findings with label 1 (a secret) or 0, made from templates; other `start`, other rows.

    The forms are public ones: assignments, headers, prefixed keys against
    digests, identifiers, URLs, numbers, placeholders and long words.
    """
    r = spark.range(start, start + n, 1, 1).withColumn("h", F.sha2(F.concat(F.lit("finding "), F.col("id").cast("string")), 256))
    r = r.withColumn("g", F.sha2(F.col("h"), 256)).withColumn("b", F.regexp_replace(F.base64(F.unhex(F.concat("h", "g"))), "=", ""))

    def pick(values: list[str], salt: int) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(len(values))).cast("int"))

    def pick_of(values: list[Column], salt: int) -> Column:
        return F.get(F.array(*values), F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(len(values))).cast("int"))

    def chain(values: list[str], count: int, salt: int, between: str = "") -> Column:
        return F.concat_ws(between, *[pick(values, salt + i) for i in range(count)])

    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve que eau ung sch ment".split()
    names = "get set user config value data file path test name default message request handler service index item list".split()
    prose, prose2, prose3 = chain(syllables, 3, 11), chain(syllables, 2, 21), chain(syllables, 2, 31)
    hex40, hex64, hex32 = F.substring("h", 1, 40), F.col("h"), F.substring("g", 1, 32)
    base = F.regexp_replace("b", "[+/]", "x")
    digits = F.translate(F.expr("substring(h, 1, 16 + cast(pmod(id, 9) AS int))"), "abcdef", "123456")
    uuid = F.concat_ws("-", *[F.substring("h", i, k) for i, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    secret_name = pick("token secret api_key API_KEY password auth_token access_key client_secret TOKEN Token SECRET".split(), 41)
    equals, quote = pick(["=", ":", ":="], 51), pick(['"', "'"], 52)
    tail = pick(["", "", ";", ",", ".", ")"], 53)
    any_hex = pick(["u", "l", "l"], 54)

    def cased(c: Column) -> Column:
        return F.when(any_hex == "u", F.upper(c)).otherwise(c)

    quoted = lambda c: F.concat(quote, c, quote, tail)
    bare = lambda c: F.concat(c, tail)
    shorts = F.translate(F.substring("g", 1, 12), "bdf", "KQz")
    some = pick(["&", "!", "@", "#", ".", "$", "%", "^", "*", "~"], 55)
    mixed = F.concat(F.initcap(pick(syllables, 101)), F.substring("g", 1, 1), pick(syllables, 102), F.substring(digits, 1, 2), some, F.substring(digits, 3, 2))
    leet = F.concat(F.translate(F.concat(pick(syllables, 103), pick(syllables, 104)), "aeio", "@310"), some, F.translate(pick(names, 105), "aeios", "@3105"), F.substring(digits, 1, 4))
    low = F.concat(F.translate(F.concat(pick(syllables, 106), pick(names, 107)), "aeios", "4310s"), F.substring(digits, 5, 3))
    short = pick_of([F.substring(shorts, 1, 8), shorts, mixed, mixed, leet, leet, low], 56)
    person = F.initcap(chain(syllables, 2, 111))
    said = pick_of([pick(syllables, 112), pick(names, 113), person, prose, F.lower(person)], 114)
    filler = pick(["null", "None", "true", "false", "required", "string", "********", "<password>", "${DB_PASSWORD}", "{{token}}", "changeme", "your_password", "os.environ[KEY]", "getpass()", "xxxx"], 115)
    # label, word before the one before, word before, word
    kinds = [
        (1, secret_name, equals, quoted(cased(hex40))),
        (1, secret_name, equals, quoted(cased(hex32))),
        (1, secret_name, equals, quoted(F.substring("b", 1, 40))),
        (1, prose, prose2, F.concat(secret_name, F.lit("="), bare(F.substring("b", 1, 44)))),
        (1, prose, F.concat(secret_name, F.lit(":")), bare(F.substring(base, 1, 24))),
        (1, prose, prose2, F.concat(F.lit("AKIA"), F.upper(F.substring(base, 1, 16)), tail)),
        (1, prose, prose2, F.concat(F.lit("ghp_"), F.substring(base, 1, 36), tail)),
        (1, F.lit("Authorization:"), F.lit("Bearer"), F.concat(F.lit("eyJ"), F.substring(base, 1, 30), F.lit(".eyJ"), F.substring(base, 20, 40), F.lit("."), F.substring(base, 30, 43), tail)),
        (1, prose, prose2, F.concat(F.lit("eyJ"), F.substring(base, 5, 30), F.lit(".eyJ"), F.substring(base, 24, 40), F.lit("."), F.substring(base, 34, 43), tail)),
        (1, secret_name, F.lit("="), quoted(hex64)),
        (1, secret_name, equals, quoted(short)),
        (1, prose, F.concat(secret_name, F.lit(":")), short),
        (1, prose, prose2, F.concat(secret_name, pick(["=", ":"], 57), short)),
        (1, prose, prose2, F.concat(pick("postgres mysql redis amqp https ftp".split(), 58), F.lit("://"), pick(names, 59), F.lit(":"), short, F.lit("@"), pick(names, 60), F.lit(".internal:5432/"), pick(names, 62))),
        (0, secret_name, equals, quoted(filler)),
        (0, prose, F.concat(secret_name, F.lit(":")), said),
        (0, prose, pick(["author:", "Author:", "authors:", "authority:", "tokens:", "passwords:"], 116), said),
        (0, prose, prose2, F.concat(secret_name, pick(["=", ":"], 57), filler)),
        (0, prose, prose2, F.concat(pick(["author=", "tokenizer=", "auth:", "tokens="], 117), said)),
        (0, prose, prose2, bare(digits)),
        (0, prose, prose2, bare(chain(syllables, 8, 61))),
        (0, prose, prose2, F.concat(chain(syllables, 9, 61), pick([".", ",", ";"], 62))),
        (0, prose, prose2, bare(F.initcap(chain(syllables, 9, 61)))),
        (0, prose, prose2, bare(F.upper(chain(syllables, 9, 61)))),
        (0, pick(["commit", "revision", "digest", "checksum"], 63), equals, quoted(hex40)),
        (0, prose, pick(["commit", "sha1", "at"], 64), bare(hex40)),
        (0, prose, prose2, F.concat(F.lit("sha256:"), hex64)),
        (0, prose, F.lit("at"), F.concat(F.lit("https://"), prose, F.lit(".example.com/"), chain(names, 3, 71, "/"), F.lit("/"), hex32)),
        (0, prose, pick(["uuid", "id", "guid", "key"], 65), bare(uuid)),
        (0, prose, prose2, bare(chain(names, 4, 81, "_"))),
        (0, prose, prose2, bare(chain(names, 4, 81, "/"))),
        (0, secret_name, equals, quoted(pick(["xxxxxxxxxxxxxxxxxxxx", "your_api_key_here", "REPLACE_WITH_YOUR_TOKEN", "example_token_value", "0000000000000000"], 91))),
        (0, secret_name, equals, quoted(chain(names, 4, 81, "_"))),
        (0, prose, prose2, pick(["=" * 20, "-" * 32, "_" * 24, "=-" * 12], 92)),
        (0, prose, prose2, F.concat(F.lit("2024-"), F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 2), F.lit("-"), F.substring(digits, 5, 8))),
        (0, prose, prose2, quoted(digits)),
    ]
    kind = F.pmod(F.xxhash64("h", F.lit(7)), F.lit(len(kinds)))
    made = F.array(*[F.struct(F.lit(y).alias("label"), b2.alias("before2"), b.alias("before"), w.alias("word")) for y, b2, b, w in kinds])
    rows = r.select(F.get(made, kind.cast("int")).alias("k"), prose3.alias("after"), pick(["", "README.md", "src/app.py", "docs/guide.md", "config/settings.yml", "tests/test_app.py"], 118).alias("path"))
    return rows.select("k.*", "after", "path", F.explode(_candidates(F.array("k.before2", "k.before", "k.word", "after"), F.lit(2))).alias("candidate"))


def train(labelled: DataFrame, trees: int = 24, depth: int = 9, seed: int = 7) -> PipelineModel:
    """A forest of labelled findings; one partition, so that the sample of each tree is the same everywhere."""
    rows = features(labelled).select(F.col("label").cast("double"), *INPUTS).coalesce(1)
    gather = VectorAssembler(inputCols=INPUTS, outputCol="inputs", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="inputs", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return PipelineModel([gather, forest.fit(gather.transform(rows))])


_MODELS: dict[tuple, PipelineModel] = {}


def default_model(spark: SparkSession, rows: int = TRAINING_ROWS) -> PipelineModel:
    """The forest of `labelled_findings`, trained once in an application."""
    name = spark.sparkContext.applicationId, rows
    if name not in _MODELS:
        _MODELS[name] = train(labelled_findings(spark, rows))
    return _MODELS[name]


def scan(documents: DataFrame, model: PipelineModel | None = None, path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """Every candidate with its score and verdict; false ones stay as rows with is_secret false."""
    model = model or default_model(documents.sparkSession)
    scored = model.transform(features(findings(documents, path)))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select("doc_id", "word_at", "nth", "candidate", score.alias("score"), (score >= threshold).alias("is_secret"))


def secret_report(documents: DataFrame) -> DataFrame:
    """doc_id, word_at, nth, length and digest of each candidate, score and is_secret.

    Null and empty texts have no candidate and no row; repeated rows repeat
    theirs; a text may have any number of them.
    """
    return scan(documents).select(
        "doc_id", "word_at", "nth", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret"
    )

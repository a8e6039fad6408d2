"""Quality rules: a table of thresholds compiled into one projection.

Everything is a DataFrame expression over the row's own text, so there is no
shuffle and no user function.  Words are cut once into an array; word windows
are compared by their 64-bit hashes inside the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

SPACE = "[\\x20\\x09-\\x0D]+"

# Frequent function words of the languages that the corpus holds.
STOP_WORDS = {
    "en": "the be is are was to of and that have has had with in a an it for on by this from as at or not".split(),
    "de": "der die das und ist in zu den mit von im auf für nicht ein eine sich des dem auch er es".split(),
    "fr": "le la les de des du et est un une en que qui dans par pour au aux avec sur il ne se ce pas".split(),
    "es": "el la los las de del y es un una en que por con para se su al lo como no más".split(),
}


@dataclass(frozen=True)
class Rule:
    """A document is kept where least <= numerator / denominator <= most.

    The ratio is compared as products of whole numbers, so there is no rounding;
    a denominator of zero passes.
    """

    name: str
    numerator: str
    denominator: str
    least: tuple[int, int] | None = None
    most: tuple[int, int] | None = None

    def passes(self, measured: dict[str, Column]) -> Column:
        n, d = measured[self.numerator], measured[self.denominator]
        ok = F.lit(True)
        if self.least:
            ok = ok & (n * self.least[1] >= d * self.least[0])
        if self.most:
            ok = ok & (n * self.most[1] <= d * self.most[0])
        return ok


#: The verdict beyond the base: word length, symbols, repeated lines, words said twice in a row, stop words.
RULES = (
    Rule("word_length", "word_chars", "n_words", least=(2, 1), most=(12, 1)),
    Rule("symbols", "n_symbols", "n_words", most=(1, 5)),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=(2, 5)),
    Rule("stutter", "n_stutter", "n_words", most=(1, 4)),
    Rule("stop_words", "n_stop_words", "n_words", least=(1, 50)),
)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _repeated_words(words_: Column, size: int) -> Column:
    """Words inside windows of `size` words that occur twice or more in the row.

    Few rows have such a window: the distinct count of window hashes finds
    them.  Only for those are the hashes sorted with their positions; equal
    neighbours are repeated windows, and the sorted positions of these give the
    words covered, each counted once.
    """
    hashes = F.transform(words_, lambda w: F.xxhash64(w))
    span = 1
    while span < size:  # runs of 1, 2, 4 ... words; the last step overlaps where size is no power of two
        hashes = _let(hashes, _joined(min(span, size - span)))
        span += min(span, size - span)
    hashes = F.slice(hashes, 1, F.size(words_) - (size - 1))

    def marked(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            # the end stands for a window at a position that no window has
            twice = F.filter(
                F.transform(
                    s,
                    lambda x, j: F.when(
                        (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]),
                        x["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            return F.array_sort(twice)

        def covered(p: Column) -> Column:
            gaps = F.transform(p, lambda i, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - i, F.lit(size))))
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

        return _let(pairs, lambda s: _let(positions(s), covered))

    return F.when(
        F.size(words_) > size,
        _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), marked(h)).otherwise(0)),
    ).otherwise(0)


def _joined(by: int):
    """Of hashes of runs: the hashes of each run with the one that starts `by` words on."""
    return lambda h: F.zip_with(h, F.slice(h, by + 1, F.size(h)), lambda x, y: F.xxhash64(x, y))


def _let(value: Column, body) -> Column:
    """`body` of a value that is evaluated once, for higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measures(text: Column, window: int = 8) -> Column:
    """A struct of all whole-number measures of one text (null: no words, no lines)."""
    text = F.coalesce(text, F.lit(""))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of(w: Column) -> Column:
        return _let(
            lines,
            lambda x: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                F.size(x).cast("long").alias("n_lines"),
                _repeated_words(w, window).cast("long").alias("n_repeat_words"),
                F.size(F.filter(w, lambda y: F.lower(y).isin(stop))).cast("long").alias("n_stop_words"),
                F.size(F.filter(F.transform(w, lambda y, i: (i > 0) & (y == F.get(w, i - 1))), lambda y: y)).cast("long").alias("n_stutter"),
            ),
        )

    return _let(words(text), of)


def verdict(measured: dict[str, Column], rules: tuple[Rule, ...] = RULES) -> Column:
    ok = F.lit(True)
    for rule in rules:
        ok = ok & rule.passes(measured)
    return ok


def _with_measures(documents: DataFrame, mark: str) -> DataFrame:
    return documents.withColumn(mark, measures(F.col("text")))


def _judged(mark: str, rules: tuple[Rule, ...], min_words: int) -> tuple[dict[str, Column], Column, Column]:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_stop_words", "n_stutter")
    m = {n: F.col(mark)[n] for n in names}
    failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    return m, failed, ~failed & verdict(m, rules)


def quality_report(documents: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 20) -> DataFrame:
    """Measures and verdict per row; null and empty texts have no words and fail the base."""
    df = _with_measures(documents.select("doc_id", "text"), "measured")
    m, failed, kept = _judged("measured", rules, min_words)
    return df.select("doc_id", *[c.alias(n) for n, c in m.items()], failed.alias("base_failed"), kept.alias("kept"))


def keep_good(documents: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 20) -> DataFrame:
    """The rows of `documents` whose verdict is kept, with the columns they came with."""
    mark = fresh(documents, "_measured")
    df = _with_measures(documents, mark)
    _, _, kept = _judged(mark, rules, min_words)
    return df.filter(kept).drop(mark)

"""The `op*` queries over the driver's tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codes, decontaminate, grammar, language_model, line_dedup, mixing, packing, phrases, quality, repeats, secrets, simhash, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op6_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.ids_report(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(table(spark, sf_dir, "documents"))


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.codes_report(table(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pitman_yor": op1_pitman_yor,
        "op2_packing": op2_packing,
        "op3_line_dedup": op3_line_dedup,
        "op4_warc": op4_warc,
        "op5_quality_rules": op5_quality_rules,
        "op6_repair_ids": op6_repair_ids,
        "op7_decontamination": op7_decontamination,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_repeated_bytes": op9_repeated_bytes,
        "op10_secret_scan": op10_secret_scan,
        "op11_vector_codes": op11_vector_codes,
        "op12_phrases": op12_phrases,
        "op13_source_mix": op13_source_mix,
    }


_STOP = ", ".join("'" + w + "'" for w in sorted({w for ws in quality.STOP_WORDS.values() for w in ws}))

OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
hot AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.line, k.pos, hot.key IS NOT NULL AND k.doc_id <> hot.keeper AS gone
  FROM keyed k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP4_SQL = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(html) >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 1000 AND page_id <> last THEN last END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM pages)
"""

OP5_SQL = rf"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM (
    SELECT doc_id, i, list_slice(words, i, i + 7) AS gram
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM cut WHERE len(words) >= 8))),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM windows, (SELECT unnest(range(8)) AS k) WHERE n > 1 GROUP BY doc_id),
measured AS (
  SELECT c.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda w: lower(w) IN ({_STOP})))::BIGINT AS n_stop_words,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1]))::BIGINT AS n_stutter
  FROM cut c LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 12 * n_words AND 5 * n_symbols <= n_words
          AND 5 * n_dup_lines <= 2 * n_lines AND 4 * n_stutter <= n_words AND 50 * n_stop_words >= n_words AS kept
FROM judged
"""


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item, list_slice(ws, i, i + 12) AS gram
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
lengths AS (SELECT DISTINCT len(gram) AS n FROM windows),
spans AS (
  SELECT doc_id, n, i, list_slice(ws, i, i + n - 1) AS gram
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lengths WHERE len(ws) >= n)),
found AS (SELECT doc_id, n, i, item FROM spans JOIN windows USING (gram)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


OP13_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS pos FROM d GROUP BY source),
w AS (SELECT *, CASE pos % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
r AS (
  SELECT *, sum(source_size) OVER () - 3 * (sum(source_size) OVER o - source_size) AS rest, sum(weight) OVER () - (sum(weight) OVER o - weight) AS rest_weight
  FROM w WINDOW o AS (ORDER BY source_size / weight, pos ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, rest * weight >= 3 * source_size * rest_weight AS stops FROM r),
level AS (SELECT rest::DOUBLE / rest_weight::DOUBLE AS per_weight FROM m WHERE NOT stops ORDER BY source_size / weight, pos LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN stops THEN (3 * source_size)::DOUBLE ELSE weight * (SELECT per_weight FROM level) END AS target FROM m),
lined AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('mix ' || coalesce(doc_id::VARCHAR, '')), doc_id, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d)
SELECT doc_id, size, source_size, target, lined.source,
       CASE WHEN size = 0 THEN 0 ELSE floor(target)::BIGINT // source_size * size
            + greatest(0, least(size, floor(target)::BIGINT % source_size - start)) END::BIGINT AS taken
FROM lined JOIN t ON lined.source IS NOT DISTINCT FROM t.source
"""


def _op11_sql(rounds: int = codes.ROUNDS) -> str:
    """Lloyd's rounds one after another, every part against every entry."""

    def given(k: int) -> str:
        distance = "list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c)"
        return f"a{k} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (SELECT r, p, x, e, {distance} AS d FROM parts JOIN c{k} USING (p)) GROUP BY r, p)"

    def after(k: int) -> str:
        moved = f"SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(y) / count(*)) AS m FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e"
        return f"c{k + 1} AS MATERIALIZED (SELECT c{k}.p, c{k}.e, coalesce(m.c, c{k}.c) AS c FROM c{k} LEFT JOIN ({moved}) m USING (p, e))"

    steps = ", ".join(f"{given(k)}, {after(k)}" for k in range(rounds))
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, (SELECT unnest(range(4)) AS p)),
c0 AS MATERIALIZED (SELECT p, r AS e, x AS c FROM parts WHERE r < 256),
{steps}, {given(rounds)},
book AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS y, unnest(range(len(c))) AS i FROM c{rounds})),
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, label, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r), book
"""


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws
  FROM documents),
grams AS (SELECT lang, k, list_slice(ws, i, i + k - 1) AS g FROM (
  SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k)),
f AS MATERIALIZED (SELECT lang, k, array_to_string(g, ' ') AS phrase, count(*) AS a FROM grams GROUP BY lang, k, g HAVING count(*) >= 100),
langs AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
cuts AS (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS j FROM f WHERE k > 1),
scores AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n, ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score, j
  FROM cuts c JOIN langs USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:], ' ')),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM f WHERE f.lang = b.lang AND f.a >= b.a AND f.phrase <> b.phrase AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_phrases": OP12_SQL, "op11_vector_codes": _op11_sql(), "op13_source_mix": OP13_SQL, "op3_line_dedup": OP3_SQL, "op4_warc": OP4_SQL, "op5_quality_rules": OP5_SQL, "op7_decontamination": OP7_SQL}

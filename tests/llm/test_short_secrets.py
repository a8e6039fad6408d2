"""Secrets that are short or broken up by other characters."""

from __future__ import annotations

import math
import re
from collections import Counter

from structscore.llm import secrets

TEXTS = {
    1: ('say password = "Tr0ub4dor&3" there', "Tr0ub4dor&3"),
    2: ("see postgres://user:pa55word@host/db now", "pa55word"),
    3: ("password: p@ss.w0rd!2024", "p@ss.w0rd!2024"),
    4: ("Server=db;Password=h7!kQ2z;Database=x", "h7!kQ2z"),
    5: ('{"api_key":"a8F#k2","name":"x"}', "a8F#k2"),
    6: ("run --password hu8!nter2 now", "hu8!nter2"),
    7: ('DB_PASSWORD ="z9$Kd31"', "z9$Kd31"),
    8: ("pwd := 'q8-Zt.4w';", "q8-Zt.4w"),
}
OTHER = {20: "author: Smith", 21: "password: required", 22: "password = ${DB_PASSWORD}", 23: "see https://host:8080/path@2x and a.b@c.de", 24: "plain words only"}


def scanned(spark, texts):
    rows = secrets.scan(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), secrets.train(secrets.labelled_findings(spark, 3000)))
    return rows.collect()


def test_short_and_broken_secrets(spark):
    got = scanned(spark, {**{k: t for k, (t, _) in TEXTS.items()}, **OTHER})
    for k, (text, value) in TEXTS.items():
        assert [r.is_secret for r in got if r.doc_id == k and r.candidate == value] == [True], (text, [r for r in got if r.doc_id == k])
    assert not [r for r in got if r.doc_id in OTHER and r.is_secret]


def test_a_quoted_value_of_many_words(spark):
    docs = spark.createDataFrame([(1, 'password = "correct horse battery staple" x'), (2, "say token = \"it's\" and 'so'")], "doc_id bigint, text string")
    assert {(r.doc_id, r.candidate) for r in secrets.findings(docs, None).collect()} == {(1, "correct horse battery staple"), (2, "it's")}


def test_training_forms_are_not_those_of_the_tables(spark):
    made = secrets.labelled_findings(spark, 2000)
    assert made.filter("path rlike '^src[0-9]+$' or word rlike '(###|!!|[$]{3}|%%%)$'").count() == 0


def plain_features(word: str, candidate: str, again: int, before: str, before2: str, path: str) -> dict:
    """The features that plain Python can say in a line."""
    n, at = len(candidate), -1
    for _ in range(again):
        at = word.index(candidate, at + 1)
    front, low = word[:at], candidate.lower()
    share = lambda pattern, text=candidate: len(re.findall(pattern, text)) / n
    times = Counter(candidate)
    left, found = low, 0
    while left:
        hit = max((w for w in secrets.DICTIONARY if left.startswith(w)), key=len, default="")
        found += len(hit)
        left = left[len(hit) or 1 :]
    return {
        "x_length": n,
        "x_digits": share("[0-9]"),
        "x_lower": share("[a-z]"),
        "x_upper": share("[A-Z]"),
        "x_hex": share("[0-9a-fA-F]"),
        "x_marks": share("[+/_=-]"),
        "x_other": share("[^a-zA-Z0-9+/_=-]"),
        "x_turns": share("[a-z](?=[0-9A-Z])|[0-9](?=[a-zA-Z])|[A-Z](?=[0-9a-z])"),
        "x_vowel_turns": share("[aeiou](?=[^aeiou0-9+/_=-])", low),
        "x_repeats": share(r"(.)(?=\1)"),
        "x_entropy": -sum(k / n * math.log2(k / n) for k in times.values()),
        "x_dictionary": found / n,
        "x_path_depth": word.count("/"),
        "x_url": float(bool(re.search("https?:|www[.]", word, re.I))),
        "x_path_test": float(bool(re.search("test|example|sample|fixture|mock", path, re.I))),
        "x_for": float(bool(re.search(secrets.FOR_WORDS, f"{before2} {before} {front}".lower()))),
        "x_against": float(bool(re.search(secrets.AGAINST_WORDS, f"{before2} {before} {front}".lower()))),
        "x_assigned": float(bool(re.search("[=:]\\s*[\"'(]*$", f"{before} {front}"))),
        "x_quoted": float(bool(re.search("[\"'`]$", front))),
    }


def test_runs_and_features_by_brute_force(spark):
    key, hexes = "Ab3dEf6hIj9kLm2nOp5q", "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    texts = [
        f'say token = "{key}" here', f"commit {hexes}", f"{key};{key},sha1:{key}", "aaaaaaaaaaaaaaaaaaaaaaaa", "https://www.example.com/user/config/data/file_path/name", "a text without any",
        f"({hexes.upper()})", "__init__/test-value=name+other==", None, "",
    ]
    docs = spark.createDataFrame([(i, t, "tests/x" if i % 2 else "src") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    rows = secrets.features(secrets.findings(docs)).collect()
    runs = Counter((i, at, c) for i, t in enumerate(texts) for at, w in enumerate((t or "").split()) for c in re.findall(secrets.CANDIDATE, w))
    assert Counter((r.doc_id, r.word_at, r.candidate) for r in rows) == runs
    assert [r.again for r in sorted(rows, key=lambda r: r.nth) if r.doc_id == 2] == [1, 2, 3]
    for r in rows:
        for name, value in plain_features(r.word, r.candidate, r.again, r.before, r.before2, r.path).items():
            assert abs(r[name] - value) < 1e-9, (r.word, name, r[name], value)


def test_tokens_with_dots_are_one_candidate(spark):
    """A token of three parts that no name announces is one finding, and the words around it are none."""
    token = "eyJhbGciOiJIUzI1NiIsInR5cCI6.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6Ikpv.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c"
    docs = spark.createDataFrame([(1, f"see {token}, or"), (2, f"x={token}"), (3, "eyJ is short. So is eyJab.cd"), (4, "a." * 20)], "doc_id bigint, text string")
    found = secrets.scan(docs, path=None).collect()
    assert {(r.doc_id, r.candidate) for r in found} == {(1, token), (2, token)}
    assert all(r.is_secret for r in found if r.candidate == token)


def test_the_default_forest_is_trained_once(spark):
    assert secrets.default_model(spark, 500) is secrets.default_model(spark, 500)

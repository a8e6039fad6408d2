"""The stages of the pipeline on odd rows, each against what its operator must keep."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import plain
from test_operators import frame, odd_rows, unpacked

import corpus_pipeline


def test_stages(spark, tmp_path):
    rows = [(i, t) for i, t in odd_rows()]
    items = [(1, rows[-1][1]), (2, "one TWO")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    read = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = read(kept)
        kept = stage(spark, kept, str(tmp_path))
        if name == "packing":
            assert Counter(unpacked(kept.collect(), 2048)) == Counter((i, tuple(plain.token_ids(t, 1).tolist())) for i, t in before)
            break
        assert kept.columns == columns
        after = read(kept)
        if name == "quality_rules":
            failed = {t for (_, t), r in zip(before, plain.quality(before)) if r[-1]}
            assert after and not failed & {t for _, t in after}
        if name == "line_dedup":
            assert sorted(r[3] for r in plain.line_dedup(before)) == sorted(plain.sha256((t or "").encode()) for _, t in after)
        if name == "simhash_near_dedup":
            assert len(after) == plain.simhash_groups(before)
        if name == "decontamination":
            assert len(after) == sum(not r[5] for r in plain.contamination(before, items))
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")


def test_run_on_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""The stream judges every row by its task."""

from __future__ import annotations

import json

from structscore.streaming import incremental
from test_judging import ROWS


def test_stream_judges_each_task(spark, tmp_path):
    (tmp_path / "in").mkdir()
    said = [json.dumps({"model": "m", "img_path": str(i), "task": t, "prediction": p, "reference": r}) for i, (t, p, r, _, _) in enumerate(ROWS)]
    (tmp_path / "in" / "1.json").write_text("\n".join(said) + "\n")
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    incremental.judge_stream(spark, source, target, marks).awaitTermination()
    got = {int(r.img_path): (r.score.em if r.score else None, r.error) for r in incremental.current(spark, target).collect()}
    assert got == {i: (em, error) for i, (_, _, _, em, error) in enumerate(ROWS)}

"""Asking a model: one client per partition, tries with growing waits, typed outcomes."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.answers import extracted, thinking_and_answer

#: Makes a client where it is used; the client takes (prompt, image URI) and returns text.
Factory = Callable[[], Callable[[str, str], str]]


def ask(rows: DataFrame, factory: Factory, tries: int = 3, wait: float = 2.0, longest: float = 10.0, at_once: int = 64) -> DataFrame:
    """`rows` (with prompt and image) plus reply and error; one of these is null.

    A task keeps up to `at_once` calls of its one client under way.  A failed
    call is tried again after wait * attempt seconds.  Each row stands alone, so
    a lost executor's rows are asked again by the retried task.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[Callable[[str, str], str]] = []
        one = threading.Lock()

        def client() -> Callable[[str, str], str]:
            with one:  # made by the first call that needs it, again if that failed
                if not made:
                    made.append(factory())
                return made[0]

        def call(prompt: str, image: str) -> tuple[str | None, str | None]:
            error = None
            for attempt in range(1, tries + 1):
                try:
                    return client()(prompt, image), None
                except Exception as e:  # whatever a client raises is the row's outcome
                    error = f"{type(e).__name__}: {e}"
                    if attempt < tries:
                        time.sleep(min(wait * attempt, longest))
            return None, error

        with ThreadPoolExecutor(at_once) as calls:
            for batch in batches:
                got = list(calls.map(call, batch.column("prompt").to_pylist(), batch.column("image").to_pylist()))
                replies, errors = ([x[k] for x in got] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def with_extracts(asked: DataFrame) -> DataFrame:
    """thinking, answer, extract and error of replies, by the column task."""
    split = asked.withColumn("_r", thinking_and_answer(F.coalesce("reply", F.lit(""))))
    got = split.withColumns({"thinking": F.col("_r.thinking"), "answer": F.col("_r.answer")}).drop("_r", "reply")
    got = got.withColumn("extract", extracted(F.col("answer"), F.col("task")))
    failed = F.when(F.col("error").isNull() & F.col("extract").isNull(), "no_extract").otherwise(F.col("error"))
    return got.withColumn("error", failed)

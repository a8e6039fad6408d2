"""What the text operators share: shared scratch folders, row keys, Arrow slices."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, else the context's checkpoint folder.

    Only where neither is set and Spark runs in one process (tests) is a local
    temporary folder made and removed at exit; on a cluster this raises.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "base" not in _LOCAL:
            _LOCAL["base"] = tempfile.mkdtemp(prefix="structscore-")
            atexit.register(shutil.rmtree, _LOCAL["base"], ignore_errors=True)
        base = "file://" + _LOCAL["base"]
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; the tables there cut lineage."""
    path = f"{shared_dir(spark).rstrip('/')}/structscore-{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write `df` once to the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables from `stored` that nothing will read again."""
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, name)


def remove_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables that this process made; call it when their results are written."""
    while _MADE:
        _delete(spark, _MADE.pop())


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; a null text is empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def text_hash(name: str = "text") -> Column:
    """With doc_id, names a row: equal rows have equal results, so they may share it."""
    return F.xxhash64(F.coalesce(F.col(name), F.lit("")))



def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have in any case, nor with an ending."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about `most` bytes, one row at least."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if len(sizes) > start:
            yield batch.slice(start)


def vocabulary_file(name: str) -> str:
    """Path of a public tokenizer file, found on the machine that asks."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))

"""A keyed table in versions: a manifest written last names the current one.

Rows lie in buckets by the hash of their keys.  A commit writes only the buckets
that the new rows touch, as one new folder, and then a manifest that lists each
bucket's folder; all other buckets keep theirs.  A run that dies between the two
leaves a folder that no manifest names, and readers go on with the last version.
Manifests are numbered and are never overwritten: of two writers that start from
one version the second fails and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.resume import last_per_key, upserted

BUCKET = "_bucket"


@dataclass(frozen=True)
class Manifest:
    """What a version consists of: its schema, keys, and the folder of each bucket that has rows."""

    number: int
    schema: T.StructType
    keys: list[str]
    buckets: int
    folders: dict[int, str]

    def text(self) -> str:
        return json.dumps({"schema": self.schema.jsonValue(), "keys": self.keys, "buckets": self.buckets, "folders": self.folders})


class Conflict(RuntimeError):
    """Another writer has committed since the version that this one started from."""


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _manifest_path(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/manifests/{number:012d}.json"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, at = _files(spark, f"{path.rstrip('/')}/manifests")
    if not fs.exists(at):
        return []
    return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json"))


def manifest(spark: SparkSession, path: str, number: int | None = None) -> Manifest | None:
    """The manifest of a version, the current one if none is named; null where there is none."""
    numbers = _numbers(spark, path)
    if not numbers or number is not None and number not in numbers:
        return None
    number = numbers[-1] if number is None else number
    read = json.loads("".join(r.value for r in spark.read.text(_manifest_path(path, number), wholetext=True).collect()))  # one row
    return Manifest(number, T.StructType.fromJson(read["schema"]), read["keys"], read["buckets"], {int(k): v for k, v in read["folders"].items()})


def _publish(spark: SparkSession, path: str, new: Manifest) -> None:
    """Write a manifest under its number; it is there whole or not at all."""
    fs, target = _files(spark, _manifest_path(path, new.number))
    fs.mkdirs(target.getParent())
    _, draft = _files(spark, f"{path.rstrip('/')}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(new.text().encode()))
    out.close()
    # a name that exists is not taken over
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise Conflict(f"version {new.number} of {path} is there already")


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _folder(path: str, folder: str, bucket: int) -> str:
    return f"{path.rstrip('/')}/data/{folder}/{BUCKET}={bucket}"


def _rows(spark: SparkSession, path: str, of: Manifest, buckets: set[int] | None = None) -> DataFrame:
    folders = [_folder(path, f, b) for b, f in sorted(of.folders.items()) if buckets is None or b in buckets]
    return spark.read.schema(of.schema).parquet(*folders) if folders else spark.createDataFrame([], of.schema)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of the current version, or of an older one that is still kept."""
    of = manifest(spark, path, number)
    if of is None:
        raise FileNotFoundError(f"no version {'' if number is None else number} of a table in {path}")
    return _rows(spark, path, of)


def write_buckets(spark: SparkSession, path: str, old: Manifest | None, new: DataFrame, keys: list[str], order: list[str], buckets: int) -> Manifest:
    """Write the buckets that `new` touches, with the rows of `old` that stay; the manifest to publish."""
    buckets = old.buckets if old else buckets
    once = last_per_key(new, keys, order)
    touched = {r[0] for r in once.select(_bucket(keys, buckets)).distinct().collect()}  # at most `buckets` numbers
    if old:
        once = once.select(old.schema.fieldNames())
    rows = upserted(_rows(spark, path, old, touched), once, keys) if old else once
    folder = uuid.uuid4().hex
    rows.withColumn(BUCKET, _bucket(keys, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path.rstrip('/')}/data/{folder}")
    folders = {**(old.folders if old else {}), **{b: folder for b in touched}}
    return Manifest(old.number + 1 if old else 0, old.schema if old else rows.schema, keys, buckets, folders)


def upsert(new: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = 64) -> Manifest:
    """Commit `new` into the table at `path`: its rows replace those with the same keys, nothing is deleted.

    Of rows of `new` with equal keys the last by `order` counts.  Null keys are
    equal to each other for `order`, and replace nothing.  `buckets` is taken for
    a new table; one that exists keeps its number.  An empty `new` makes a version
    without changes.  Keys are those that the table was made with.
    """
    spark = new.sparkSession
    old = manifest(spark, path)
    if old and old.keys != keys:
        raise ValueError(f"the table's keys are {', '.join(old.keys)}")
    made = write_buckets(spark, path, old, new, keys, order, buckets)
    _publish(spark, path, made)
    return made


def expire(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete all but the last `keep` versions, and data that none of these names; how many folders went.

    Not to be run beside a writer: what it has written has no manifest yet.
    """
    numbers = _numbers(spark, path)
    kept, gone = numbers[-keep:], numbers[:-keep]
    used = {f for n in kept for f in manifest(spark, path, n).folders.values()}
    for n in gone:
        fs, at = _files(spark, _manifest_path(path, n))
        fs.delete(at, False)
    fs, data = _files(spark, f"{path.rstrip('/')}/data")
    unused = [f.getPath() for f in fs.listStatus(data) if f.getPath().getName() not in used] if fs.exists(data) else []
    for folder in unused:
        fs.delete(folder, True)
    return len(unused)

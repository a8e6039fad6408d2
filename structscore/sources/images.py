"""Images as rows, and as data URIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# First bytes of image files, in hexadecimal, and their types.
TYPES = {"89504e47": "image/png", "ffd8ff": "image/jpeg", "47494638": "image/gif", "424d": "image/bmp", "52494646": "image/webp"}


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of every file; content is only read if it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def image_type(content: Column) -> Column:
    head = F.lower(F.hex(F.substring(content, 1, 4)))
    out = F.lit(None).cast("string")
    for start, name in TYPES.items():
        out = F.when(head.startswith(start), name).otherwise(out)
    return out


def data_uri(content: Column) -> Column:
    """The image inline; unknown types are sent as JPEG."""
    return F.concat(F.lit("data:"), F.coalesce(image_type(content), F.lit("image/jpeg")), F.lit(";base64,"), F.base64(content))


def existing(samples: DataFrame, files: DataFrame, path: str = "img_path") -> DataFrame:
    """Samples whose file is there."""
    names = files.select(F.regexp_replace("path", "^file:/+", "/").alias(path)).distinct()
    return samples.join(names, path, "left_semi")

"""Stored product images (IO5): Spark's image source over an image folder.

``spark.read.format("image")`` decodes files to ``struct<origin, height, width,
nChannels, mode, data>`` (BGR bytes); ``dropInvalid`` drops unreadable files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_images(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    return (spark.read.format("image").option("dropInvalid", True)
            .option("recursiveFileLookup", str(recursive).lower()).load(path))

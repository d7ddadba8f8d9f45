"""Files of a folder as a table, for guards that ask whether a file is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.session import exists


def files_below(spark: SparkSession, path: str) -> DataFrame:
    """name (its path below the folder) and length of every file in a folder, at any depth; contents are not read.

    A folder that is not there has no files; hidden ones, whose names begin with _ or a dot, are left out.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "name string, length long")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.col("path").substr(len(root) + 2, 1 << 16).alias("name"), "length")

"""Tables that cut a plan short, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; without it, and without a cluster, a temporary one of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="gatehouse-"))
    return _LOCAL[0]


def held(df: DataFrame) -> DataFrame:
    """``df`` written once and read from its table: what is read twice is computed once, and plans stay short.

    The driver's JVM deletes the table as it ends.  A frame that is such a table already is returned as it is.
    """
    if getattr(df, "_gatehouse_held", False):
        return df
    spark = df.sparkSession
    path = f"{folder(spark)}/gatehouse-held-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._gatehouse_held = True
    return table


def narrow(source: DataFrame, df: DataFrame) -> DataFrame:
    """``df``, a projection of ``source``: as cheap to read again as that one, so it counts as held if ``source`` does."""
    df._gatehouse_held = getattr(source, "_gatehouse_held", False)
    return df

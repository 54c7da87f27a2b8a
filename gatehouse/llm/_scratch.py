"""Scratch tables in the folder that driver and executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it again, so a lost
executor costs no more than the tasks since the last table.  Only where that setting is absent and the master is a
single process (tests on one machine) a local temporary folder stands in for it; a cluster without it is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names, or a temporary one of this process if it names none and there is no cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="gatehouse-"))
    return _LOCAL[0]


class Scratch:
    """Names tables for one run of an operator; ``drop`` removes those that nothing reads any more.

    Tables that the returned DataFrame still reads stay until the driver's JVM ends, which deletes them as it shuts down.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/gatehouse-{what}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        # the file system itself deletes what is registered with it, whether or not a session is left then
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return it as read from the table."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(schema).parquet(path)
        table._gatehouse_path = path
        return table

    def _delete(self, path: str) -> None:
        jvm, jsc = self.spark._jvm, self.spark._jsc
        if jvm is None or self.spark.sparkContext._jsc is None:
            return
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = getattr(table, "_gatehouse_path", None)
            if path:
                self._delete(path)

    def release(self) -> None:
        """Have the JVM look for garbage now: Spark deletes shuffle files only once their plans are collected."""
        self.spark._jvm.System.gc()

    def close(self) -> None:
        self._delete(self.root)


def small(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``max_rows`` rows (counted now), else leave the join to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def bits(col: Column) -> Column:
    """A 52-bit non-negative integer from the head of a hexadecimal digest column."""
    return F.conv(F.substring(col, 1, 13), 16, 10).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that name a row by id and text, the same on every reading of the table; only equal rows share it.

    The id's length goes first, so no id can take over a piece of the text.
    """
    label = doc_id.cast("string")
    named = F.coalesce(F.concat(F.length(label).cast("string"), F.lit(":"), label), F.lit("-"))
    return F.unhex(F.md5(F.concat(named, F.lit("|"), F.coalesce(text, F.lit("")))))


def meet(rows: DataFrame, keys: DataFrame, on: list[tuple[str, str]], spread: str, how: str = "inner", salts: int = 8) -> DataFrame:
    """Join ``rows`` with the distinct ``keys`` that are found for them, over ``on`` (column of rows, column of keys).

    Every key stands in ``salts`` copies and rows choose one by ``spread``, so the rows of a hot key meet it in as many tasks;
    both sides are shuffled plainly, so adaptive execution can split further.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = keys.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    match = F.col("_salt") == F.col("_copy")
    for left, right in on:
        match = match & (F.col(left) == F.col(right))
    return salted.join(copies, match, how).drop("_salt", "_copy")

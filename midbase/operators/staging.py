"""Tables that are written once and measured, so that a join to k-mers need not trust the optimiser's guess.

The optimiser takes a k-mer table to be about as large as the file that holds its text, some hundred times too small, and
would broadcast it through the driver wherever that file is small. Joins to k-mers are therefore marked: the small side is measured
and broadcast if it is small, otherwise both sides are shuffled; k-mers are never broadcast.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side that such a join broadcasts, in bytes; a row counts as its values, strings as their bytes, and ROW_BYTES.
BROADCAST_BYTES, ROW_BYTES = 8 << 20, 16


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that all executors share: spark.checkpoint.dir, or on one machine a folder among its temporary files; else none."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top and spark.sparkContext.master.partition("[")[0] == "local":
        top = os.path.join(tempfile.gettempdir(), "midbase-files")
    return top.rstrip("/") if top else None


def marked(df: DataFrame, size: int | None) -> DataFrame:
    """df for a join to k-mers: broadcast if its size is known and small, otherwise both sides are shuffled."""
    return F.broadcast(df) if size is not None and size <= BROADCAST_BYTES else df.hint("merge")


@dataclass
class Held:
    """A table that is marked for joins to k-mers; its number of rows and its path, if it could be written."""

    table: DataFrame
    rows: int | None = None
    path: str | None = None

    def per_row(self, df: DataFrame, width: int) -> DataFrame:
        """df, which has at most a row of so many bytes for each row of the table, marked alike."""
        return marked(df, None if self.rows is None else self.rows * width)

    def clear(self) -> None:
        if self.path:
            at = self.table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
            at.getFileSystem(self.table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def hold(df: DataFrame, name: str) -> Held:
    """Write df to the shared folder, measure it and read it from there. Without such a folder it is computed wherever it is used."""
    spark = df.sparkSession
    top = shared_folder(spark)
    if not top:
        return Held(marked(df, None))
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    own = spark.read.schema(df.schema).parquet(path)
    width = sum((F.coalesce(F.octet_length(n), F.lit(0)) if t == "string" else F.lit(8) for n, t in own.dtypes), F.lit(ROW_BYTES)).cast("long")
    rows, size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return Held(marked(own, size), rows, path)

"""Contigs that arrive as Parquet files, encoded as a stream: discovery counts are kept up by appending.

K-mer encoding holds no state, so a stream of contigs becomes a stream of occurrences; `append` keeps them in a table that
the batch operators read, once per contig however often a batch is retried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import kmers
from ..sources.sequences import CONTIGS


def read_contigs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(CONTIGS).parquet(folder)


def append(contigs: DataFrame, table: str, checkpoint: str, k: int) -> StreamingQuery:
    """Append the occurrences of new contigs to a Parquet folder, exactly once, and stop when all files are read."""
    rows = kmers.occurrences(contigs, k)
    writer = rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()

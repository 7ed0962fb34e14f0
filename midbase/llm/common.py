"""What the training-data operators share: reading, shared staging, row keys, text batches."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegralType, MapType, StringType, StructType

LOWER_UPPER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: ASCII letters folded to lower case, digits and every byte of a non-ASCII letter kept, the rest a space.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

#: Largest side that joins may broadcast: bytes of its values plus ROW_BYTES a row.
BROADCAST_BYTES, ROW_BYTES = 8 << 20, 16
PYTHON_ROWS = 1000


class Staging:
    """The tables staged for one result; clearing them leaves those of other results alone."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def drop(self, path: str) -> None:
        self.paths.remove(path)
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def clear(self) -> None:
        for path in list(self.paths):
            self.drop(path)


_owner: ContextVar[Staging | None] = ContextVar("owner", default=None)


def owned(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result owns the tables that it stages, those of operators that it calls included."""

    @functools.wraps(operator)
    def run(*args: object, **kwargs: object) -> DataFrame:
        if _owner.get():
            return operator(*args, **kwargs)
        first = next(a for a in (*args, *kwargs.values()) if isinstance(a, DataFrame | SparkSession))
        own = Staging(first.sparkSession if isinstance(first, DataFrame) else first)
        token = _owner.set(own)
        try:
            out = operator(*args, **kwargs)
        except BaseException:
            own.clear()
            raise
        finally:
            _owner.reset(token)
        object.__setattr__(out, "_staging", own)
        return out

    return run


@contextmanager
def inner() -> Iterator[None]:
    """Within an owned operator: of the tables staged in here only the last outlives it."""
    own = _owner.get()
    before = len(own.paths)
    yield
    for path in own.paths[before:-1]:
        own.drop(path)


def clear(result: DataFrame) -> None:
    """Delete the tables behind an operator's result, once it is written; other results keep theirs."""
    if "_staging" in vars(result):
        result._staging.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on one machine a folder of our own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "midbase-staged")
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which the running operator's result owns."""
    path = f"{shared_dir(spark)}/midbase/{name}-{uuid.uuid4().hex}"
    if _owner.get():
        _owner.get().paths.append(path)
    return path


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for a while; the user's comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def write(df: DataFrame, path: str, codec: str = "zstd", dictionary: bool = True) -> None:
    """Write df and free the shuffle files that made it: nothing reads them again. At most PYTHON_ROWS rows go to Python at once, as
    whole texts are long and both sides hold them. Hashes hardly repeat, so tables of them need no dictionaries."""
    spark, rows = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    fewer = str(min(int(spark.conf.get(rows)), PYTHON_ROWS)) if int(spark.conf.get(rows)) > 0 else str(PYTHON_ROWS)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), setting(spark, rows, fewer):
        df.write.option("compression", codec).option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)


def staged(df: DataFrame, name: str = "t", codec: str = "zstd", dictionary: bool = True) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    write(df, path, codec, dictionary)
    out = spark.read.schema(df.schema).parquet(path)
    object.__setattr__(out, "_path", path)
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables before their time, as all that is made of them is staged too."""
    own = _owner.get()
    for t in tables:
        if own and vars(t).get("_path") in own.paths:
            own.drop(t._path)


def free_name(taken: list[str], name: str) -> str:
    """`name`, with underscores after it until no column is called so."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def row_keyed(docs: DataFrame, id_col: str, text_col: str | None = None) -> DataFrame:
    """(__key, row, [text]): docs' columns packed into a struct, so that none can clash with an operator's own, and a unique long
    key that follows id order.

    Where the ids are whole numbers, that is the id itself (one pass over the id column). Where ids are null, repeat or
    are of another type, rows are numbered in (id, row) order, nulls last, in a staged table.
    """
    text = [F.col(quoted(text_col)).cast("string").alias("text")] if text_col else []
    own = F.col(quoted(id_col))
    packed = [F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), *text]
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        ids = docs.groupBy(own.cast("long").alias("__key")).agg(F.count(F.lit(1)).alias("n"))
        if ids.filter((F.col("n") > 1) | F.col("__key").isNull()).limit(1).count() == 0:
            return docs.select(own.cast("long").alias("__key"), *packed)
    rows = docs.select(own.alias("__id"), *packed).withColumn("__tie", F.monotonically_increasing_id())
    # rows that are alike in all columns differ in the last key, so a third of all rows alike are many ranges
    order = [F.col("__id").asc_nulls_last(), F.xxhash64(F.to_json("row")).asc(), F.col("__tie").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(rows.select(F.monotonically_increasing_id().alias("__key"), "row", *(["text"] if text_col else [])), "keyed")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unpacked(docs_columns: list[str], without: tuple[str, ...] = ()) -> list[Column]:
    """The user's columns out of `row`."""
    return [F.col("row").getField(c).alias(c) for c in docs_columns if c not in without]


def _bytes(name: str, kind: object) -> Column:
    column = F.col(quoted(name))
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(kind, ArrayType) and not isinstance(kind.elementType, StringType | BinaryType | ArrayType | MapType | StructType):
        return 8 * F.greatest(F.size(column), F.lit(0)).cast("long")
    if isinstance(kind, ArrayType | MapType | StructType):
        return 2 * F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)).cast("long")
    return F.lit(8).cast("long")


def small_enough(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether df's values take at most `most` bytes. Where the plan's files alone are larger no row is read."""
    if float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 16 * most:
        return False
    size = sum((_bytes(f.name, f.dataType) for f in df.schema.fields), F.lit(ROW_BYTES).cast("long"))
    return (df.agg(F.sum(size)).first()[0] or 0) <= most


def join_sized(left: DataFrame, right: DataFrame, on: list[str] | Column, how: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """Join to a materialised right side: broadcast up to `most` bytes of it, beyond that a shuffle join."""
    return left.join(F.broadcast(right) if small_enough(right, most) else right.hint("merge"), on, how)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, *LOWER_UPPER)


def fold_words(text: str | None) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and non-ASCII characters, as UTF-8."""
    return text.encode().translate(FOLD).split() if text else []


def parts(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about `most` characters of text each; one long text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

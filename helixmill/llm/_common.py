"""Shared helpers of the training-data operators: durable tables, checked broadcasts, joins with hot keys, vector validity."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows a side may have before it is no longer broadcast.
BROADCAST_BYTES = 48 * 1024 * 1024
#: A key is hot if it holds more than one in HOT_KEYS of all rows: there are fewer than HOT_KEYS such keys at any size.
HOT_KEYS = 1000
#: Rows and bytes of an Arrow batch handed to Python: keeps a batch of long texts or packed blocks within a few tens of MB.
ARROW_ROWS = 512
ARROW_BYTES = 32 * 1024 * 1024
#: A word: a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Read from the session; a local one is made only where it is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("helixmill.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="helixmill-")
        spark.conf.set("helixmill.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{sc.applicationId}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.helixmill_path = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at the path, in whatever store it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def forget(*tables: DataFrame) -> None:
    """Delete durable tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "helixmill_path", None):
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the Arrow batches of the Python operators, by rows and by bytes. The plan reads the settings when it is run, so
    they stay set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _width(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_width(c[f.name], f.dataType) for f in kind), F.lit(16))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(24).cast("long"), lambda n, x: n + _width(x, kind.elementType)), F.lit(8).cast("long"))
    return F.lit(8)


def n_bytes(df: DataFrame) -> int:
    """Bytes of the rows of a table, about; with 32 for each row's place in a hash table."""
    width = sum((_width(F.col(f.name), f.dataType) for f in df.schema), F.lit(32))
    return df.agg(F.sum(width.cast("long"))).first()[0] or 0


def sized(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Broadcast hint if the rows of the (materialised) table take at most `limit` bytes, else a shuffled hash join."""
    return F.broadcast(df) if n_bytes(df) <= (BROADCAST_BYTES if limit is None else limit) else df.hint("shuffle_hash")


def join_hot(rows: DataFrame, table: DataFrame, key: str, of: str, n: str, total: int) -> DataFrame:
    """Inner join of rows with the one row of table for each key (rows.key = table.of); table.n: how many rows have the key.

    A small table is broadcast. Of a larger one the keys with more than one in HOT_KEYS of the `total` rows are fewer than
    HOT_KEYS, so their rows are broadcast, and no task gets all rows of such a key; the others are joined by a shuffle.
    rows and table must be materialised.
    """
    limit = total // HOT_KEYS
    on = F.col(key) == F.col(of)
    if n_bytes(table) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), on)
    hot = table.where(F.col(n) > limit)
    if not hot.limit(1).count():
        return rows.join(table.hint("shuffle_hash"), on)
    rest = rows.join(F.broadcast(hot.select(of)), on, "left_anti").join(table.where(F.col(n) <= limit).hint("shuffle_hash"), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def digest_sample(df: DataFrame, digest: Column, rows: int, *ties: str) -> DataFrame:
    """The `rows` rows of smallest digest (a uniform 64-bit long), ties by columns; whatever the size, tasks send few rows.

    Rows far above the cut-off are left out before the sort: half as many again as asked for are expected to pass.
    """
    total = df.count()
    if total > 2 * rows:
        df = df.where(digest < F.lit(int((1.5 * rows + 100) / total * 2**64) - 2**63).cast("long"))
    return df.orderBy(digest, *ties).limit(rows)


def usable(vector: str | Column) -> Column:
    """True for vectors that take part: not null, not empty, no null or non-finite component, not all zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))

"""What the operators share: the cluster's shared folder, written tables and row-batch bounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Texts reach 100 KB and more, so Spark's 10,000 rows could be a gigabyte in a Python worker.
BATCH_ROWS = 256
#: Bits in one of Spark's bitmaps (a fixed value), the bits for each key of a sieve, and the most bitmaps of 4 KB in one: 32 MB.
BITMAP_BITS, KEY_BITS, BITMAPS = 32_768, 32, 8192

_own_folder: str | None = None
#: The tables that each open scope of scratch() has to delete.
_scopes: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    global _own_folder
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="sunder-")
    return _own_folder


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cuts lineage: writes df as a Parquet table in the shared folder and reads it back.

    Unlike a cache it survives the loss of executors, and its size on disk is known to the planner.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.sunder_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table made by written() that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.sunder_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes on leaving the tables that written() made within, but for those put into the list that it gives; they pass to the scope around, if there is one."""
    kept: list[DataFrame] = []
    _scopes.append([])
    try:
        yield kept
    finally:
        for df in _scopes.pop():
            if all(df is not k for k in kept):
                dropped(df)
            elif _scopes:
                _scopes[-1].append(df)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def flagged(df: DataFrame, column: str, keys: DataFrame, flag: str) -> DataFrame:
    """df with a boolean column `flag`: false only where `column` isn't among `keys`, a table of one column of the same type.

    The keys become hashed bits, KEY_BITS for each, of which at most BITMAPS * 4 KB are broadcast, however many keys there are: up to 8 million keys
    about 3 % of the other rows are flagged, too, beyond that more, so a join of the flagged rows shuffles what it must and no unbounded table is
    broadcast. Null is never flagged.
    """
    (key,) = keys.columns
    size = min(BITMAPS, max(1, -(-KEY_BITS * keys.count() // BITMAP_BITS))) * BITMAP_BITS  # one number to the driver
    place = F.pmod(F.xxhash64(key), F.lit(size))
    at, bucket, bits = (unused(n, df) for n in ("_at", "_bucket", "_bits"))
    maps = keys.where(F.col(key).isNotNull()).select(place.alias("p")).groupBy(F.expr(f"p div {BITMAP_BITS}").alias(bucket)).agg(F.bitmap_construct_agg(F.col("p") % BITMAP_BITS).alias(bits))
    out = df.withColumn(at, F.when(F.col(column).isNotNull(), F.pmod(F.xxhash64(column), F.lit(size))))
    out = out.join(F.broadcast(maps), F.expr(f"`{at}` div {BITMAP_BITS}") == F.col(bucket), "left")
    byte = F.conv(F.hex(F.substring(bits, F.expr(f"CAST(`{at}` % {BITMAP_BITS} div 8 + 1 AS INT)"), F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.expr(f"shiftleft(1, CAST(`{at}` % 8 AS INT))")) != 0
    return out.withColumn(flag, F.coalesce(is_set, F.lit(False))).drop(at, bucket, bits)


def sifted(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of df that flagged() flags: all whose column is among keys, and few others."""
    flag = unused("_flag", df)
    return flagged(df, column, keys, flag).where(flag).drop(flag)


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows in an Arrow batch to BATCH_ROWS, unless a lower bound is set."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by 5. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))

"""Training-order materialisation: token sequences in the order of a keyed permutation, in fixed-stride shards.

Documents are put in order of id, then hash of the text, by range partitions; each task encodes its range. The encoded documents, each followed by the
separator id, make one stream over all ranges, and sequence k is the LENGTH ids from k * LENGTH on, the last one padded with separators. So sequences are
a function of the data and not of how files or tasks are split. A keyed Feistel network permutes the smallest power of two that holds all their
numbers, and cycle-walking (applying it again until the result is a number in use) makes that a permutation of exactly the numbers 0 to
n - 1, so every sequence gets its own slot without a sort or a shared state. Shard k holds the slots from k * SHARD on, in order, as
16-bit little-endian ids, each record followed by a line feed: slot s is at byte (s % SHARD) * STRIDE of shard s // SHARD, so `read_shards` resumes
from any slot, and `unpermuted` tells which sequence stands at a slot. Shards are written by Spark's text sink through its committer, which
copes with retried tasks.

Texts are shuffled once, by range, tokens once, by shard: a task for each shard, the range of slots that it holds. That goes in WAVES, each for a part of the
shards, and Spark deletes the shuffle files of each write when it ends, so that the disk holds the table of tokens, the shards and a wave's shuffle.
All shards but the last have the same size, so no key is hot; rows that share an id and a text are dealt over ranges, too. Documents are cut into pieces
in Arrow batches, where the pieces share the memory of their document, so a long one isn't copied for each of its pieces.

Defined cases: a null or empty text is its separator only; repeated rows are encoded each; an empty table gives no shard; a null id
comes first and is left out of doc_ids; ids must be numbers; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sunder.llm.bpe import _encoding, encode_text, read_ranks
from sunder.llm.common import dropped, shared_folder, small_batches, written

LENGTH, SHARD, SEPARATOR, ROUNDS = 1024, 8192, 50256, 6
STRIDE = 2 * LENGTH + 1
#: Parts of the shards that are shuffled and written one after the other.
WAVES = 2
#: The table of tokens stands beside the shuffle and the shards, so it is packed well: larger pages let zstd find more repeats.
_PACKED = {"compression": "zstd", "parquet.page.size": str(16 << 20)}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes the shuffle files of a query when it ends."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + np.uint64((key * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, bits: int, key: int, backward: bool = False) -> np.ndarray:
    """Permutes the numbers of so many bits; halves of unequal width change places in each round, back again after an even count."""
    widths = [(bits // 2, bits - bits // 2), (bits - bits // 2, bits // 2)]
    for r in reversed(range(ROUNDS)) if backward else range(ROUNDS):
        a, b = widths[r % 2]  # left and right before the round
        if not backward:
            left, right = x >> np.uint64(b), x & np.uint64((1 << b) - 1)
            x = right << np.uint64(a) | (left ^ _mixed(right, key * ROUNDS + r) & np.uint64((1 << a) - 1))
        else:
            right, new = x >> np.uint64(a), x & np.uint64((1 << a) - 1)
            x = (new ^ _mixed(right, key * ROUNDS + r) & np.uint64((1 << a) - 1)) << np.uint64(b) | right
    return x


def permuted(numbers: np.ndarray, n: int, key: int, backward: bool = False) -> np.ndarray:
    """The slots of numbers below n."""
    bits = max(2, int(n - 1).bit_length())
    x = _network(numbers.astype(np.uint64), bits, key, backward)
    while (out := x >= n).any():
        x[out] = _network(x[out], bits, key, backward)
    return x.astype(np.int64)


def unpermuted(slots: np.ndarray, n: int, key: int) -> np.ndarray:
    """The numbers of the sequences at slots."""
    return permuted(slots, n, key, backward=True)


def _narrow(ids: np.ndarray) -> np.ndarray:
    if ids.max() > 65_535:
        raise ValueError(f"id {ids.max()} doesn't fit 16 bits")
    return ids.astype(np.uint16)


def _weights(length: int) -> np.ndarray:
    return (_mixed(np.arange(length, dtype=np.uint64), 1) >> np.uint64(33)).astype(np.int64) + 1


def checksum(ids: np.ndarray, place: int, weights: np.ndarray) -> int:
    """The sum of ids times weights of their places in the sequence; the pieces of a sequence add up to the sequence's. Another id changes it."""
    return int(ids.astype(np.int64) @ weights[place : place + len(ids)])  # below 2 ** 57 for 1024 ids


def token_table(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, start, n, id, tokens): the encoded documents in order, by ranges; start counts the ids before it in its range, tokens are 2 * n bytes. Ids must fit 16 bits."""
    small_batches(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    schema = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("n", pa.int32()), ("id", pa.int64()), ("tokens", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, part, start = _encoding(data.value, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            encoded = [_narrow(np.append(encode_text(encoding, t.as_py()), SEPARATOR)) for t in batch.column(1)]
            n = np.array([len(e) for e in encoded], np.int64)
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            columns = [pa.array([part] * len(n), pa.int32()), pa.array(starts), pa.array(n.astype(np.int32)), batch.column(0), pa.array([e.tobytes() for e in encoded], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    # ranges are told apart by a hash of the text, as samples of the keys go to the driver; the last key only deals equal rows over ranges, where their order doesn't matter
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("copy", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("id", "h", "copy").sortWithinPartitions("id", "h", "text")
    return rows.select("id", "text").mapInArrow(encode, "part int, start long, n int, id long, tokens binary")


def stream(table: DataFrame, bases: DataFrame, ids: int, pad: int) -> DataFrame:
    """(start, id, tokens): the documents with their places in the stream of so many ids, and the padding of the last sequence."""
    rows = table.join(bases, F.col("part") == F.col("_part")).select((F.col("base") + F.col("start")).alias("start"), "id", "tokens")
    if not pad:
        return rows
    padding = bytearray(np.full(pad, SEPARATOR, np.uint16).tobytes())
    return rows.union(table.sparkSession.range(1).select(F.lit(ids).cast("long"), F.lit(None).cast("long"), F.lit(padding)))


def _cut(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The number, the place in the sequence, the row and the tokens of each piece of a batch of stream(). The pieces share the batch's memory."""
    tokens = batch.column(2).cast(pa.binary())
    _, offsets, data = tokens.buffers()
    ends = np.frombuffer(offsets, np.int32)[tokens.offset : tokens.offset + len(tokens) + 1].astype(np.int64)
    start, n = batch.column(0).to_numpy(), np.diff(ends) // 2
    first = start // length
    count = (start + n - 1) // length - first + 1
    row = np.repeat(np.arange(len(count)), count)
    number = first[row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
    low = np.maximum(start[row], number * length)
    cuts = np.append(ends[row] + 2 * (low - start[row]), ends[-1]).astype(np.int32)
    return number, low - number * length, row, pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts), data])


def pieces(rows: DataFrame, n: int, key: int, per_shard: int, first: int, until: int, length: int = LENGTH) -> DataFrame:
    """(slot, shard, at, tokens): the parts of documents in each sequence of the shards from first to before until; rows as of stream(), n sequences."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, at, _, tokens = _cut(batch, length)
                slot = permuted(number, n, key)
                shard = slot // per_shard
                keep = (first <= shard) & (shard < until)
                columns = [pa.array(slot[keep]), pa.array(shard[keep]), pa.array(at[keep].astype(np.int32)), tokens.filter(pa.array(keep))]
                yield pa.RecordBatch.from_arrays(columns, names=["slot", "shard", "at", "tokens"])

    return rows.mapInArrow(cut, "slot long, shard long, at int, tokens binary")


def sums(rows: DataFrame, n: int, key: int, length: int = LENGTH) -> DataFrame:
    """(number, slot, at, id, sum): what the sequences hold of each document, with the checksum of its part; rows as of stream()."""
    weights = _weights(length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, at, row, tokens = _cut(batch, length)
                total = [checksum(np.frombuffer(t.as_buffer(), np.uint16), place, weights) for t, place in zip(tokens, at.tolist(), strict=True)]
                columns = [pa.array(number), pa.array(permuted(number, n, key)), pa.array(at.astype(np.int32)), batch.column(1).take(pa.array(row)), pa.array(total, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["number", "slot", "at", "id", "sum"])

    return rows.mapInArrow(cut, "number long, slot long, at int, id long, sum long")


def write_shards(placed: DataFrame, folder: str, first: int, shards: int, length: int = LENGTH) -> None:
    """placed: slot, shard, at and tokens, the pieces of the sequences of so many shards from the first one on. A task and a file for each shard."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pieces of a slot joined; they come in order."""
        now, parts = None, []
        for batch in batches:
            out = []
            for slot, shard, piece in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if now is not None and now[0] != slot:
                    out.append((*now, b"".join(parts)))
                    parts = []
                now = slot, shard
                parts.append(piece)
            yield made(out)
        if now is not None:
            yield made([(*now, b"".join(parts))])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        if wrong := [r[0] for r in rows if len(r[2]) != 2 * length]:
            raise ValueError(f"slots {wrong[:5]} aren't whole")
        slots, shard, values = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(shard, pa.int64()), pa.array(values, pa.binary())], names=["slot", "shard", "value"])

    rows = placed.repartitionById(shards, (F.col("shard") - first).cast("int")).sortWithinPartitions("shard", "slot", "at")
    rows = rows.select("slot", "shard", "tokens").mapInArrow(records, "slot long, shard long, value binary")
    rows = rows.sortWithinPartitions("shard", "slot").select("shard", F.col("value").cast("string"))
    rows.write.mode("append").partitionBy("shard").option("lineSep", "\n").text(folder)


def _shard_files(spark: SparkSession, folder: str, per_shard: int, first: int) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).where(F.col("shard") >= first // per_shard).select("path", "content")


def _records(batches: Iterator[pa.RecordBatch], length: int, per_shard: int, first: int) -> Iterator[tuple[range, list[memoryview]]]:
    """Slots and their tokens, some at a time."""
    stride = 2 * length + 1
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data, shard = memoryview(content.as_buffer()), int(path.rpartition("/shard=")[2].partition("/")[0])
            if len(data) % stride:
                raise ValueError(f"{path} isn't a whole count of records")
            begin, n = max(0, first - shard * per_shard), len(data) // stride
            for k in range(begin, n, 1024):
                places = range(k, min(n, k + 1024))
                yield range(shard * per_shard + k, shard * per_shard + places.stop), [data[i * stride : (i + 1) * stride - 1] for i in places]


def read_shards(spark: SparkSession, folder: str, length: int = LENGTH, per_shard: int = SHARD, first: int = 0) -> DataFrame:
    """(slot, tokens) of every record from slot `first` on, by stride. Shards before it aren't opened, the records before it in its shard aren't looked at."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slots, records in _records(batches, length, per_shard, first):
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(records, pa.binary())], names=["slot", "tokens"])

    return _shard_files(spark, folder, per_shard, first).mapInArrow(parse, "slot long, tokens binary")


def read_digests(spark: SparkSession, folder: str, length: int = LENGTH, per_shard: int = SHARD) -> DataFrame:
    """(slot, sha256, n_tokens, _sum) of every record as read_shards reads it: the digest, how many ids are others than the separator, and the checksum."""
    weights = _weights(length)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slots, records in _records(batches, length, per_shard, 0):
            ids = [np.frombuffer(r, np.uint16) for r in records]
            columns = [pa.array(slots, pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in records]), pa.array([int((i != SEPARATOR).sum()) for i in ids], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([checksum(i, 0, weights) for i in ids], pa.int64())], names=["slot", "sha256", "n_tokens", "_sum"])

    return _shard_files(spark, folder, per_shard, 0).mapInArrow(parse, "slot long, sha256 string, n_tokens int, _sum long")


def materialised(docs: DataFrame, path: str, pattern: str, key: int, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, per_shard: int = SHARD) -> DataFrame:
    """Writes the shards to the shared folder and reads them back: (slot, shard, position, number, doc_ids, n_tokens, sha256, intact) of every sequence.

    doc_ids are the documents that a sequence holds parts of, in order; sha256 and n_tokens are of the record at the slot, as read back
    (null where there is none), and intact says whether its checksum is that of the pieces before they were shuffled. The join
    that tells shuffles checksums and the doc_ids of a sequence, not its tokens.
    """
    spark = docs.sparkSession
    with _shuffles_deleted(spark):
        table = written(token_table(docs, path, pattern, doc_id, text), "tokens", **_PACKED)
        parts = table.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each range
        bases = written(parts.select(F.col("part").alias("_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"), F.col("n").alias("_n")), "parts")
        ids = bases.agg(F.sum("_n")).first()[0] or 0
        n = -(-ids // length)
        folder, shards = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}", -(-n // per_shard)
        every = stream(table, bases.drop("_n"), ids, n * length - ids)
        own = sums(every, n, key, length).groupBy("number", "slot")
        own = own.agg(F.sum("sum").alias("_own"), F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("at", "id")))).getField("id").alias("doc_ids"))
        own = written(own, "sequences")
        per_wave = max(1, -(-shards // WAVES))
        for first in range(0, shards, per_wave):
            until = min(shards, first + per_wave)
            write_shards(pieces(every, n, key, per_shard, first, until, length), folder, first, until - first, length)
        dropped(table)
    back = read_digests(spark, folder, length, per_shard) if n else spark.createDataFrame([], "slot long, sha256 string, n_tokens int, _sum long")
    names = {"shard": F.expr(f"slot div {per_shard}"), "position": F.col("slot") % per_shard, "intact": F.coalesce(F.col("_sum") == F.col("_own"), F.lit(False))}
    return own.join(back, "slot", "left").withColumns(names).select("slot", "shard", "position", "number", "doc_ids", "n_tokens", "sha256", "intact")

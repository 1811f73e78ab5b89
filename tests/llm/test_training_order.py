import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sunder.llm import bpe, training_order
from sunder.llm import queries as q


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    x = np.arange(n)
    y = training_order.permuted(x, n, 7)
    assert sorted(y.tolist()) == x.tolist()
    assert training_order.unpermuted(y, n, 7).tolist() == x.tolist()
    assert n < 100 or (y != training_order.permuted(x, n, 8)).mean() > 0.9


ROWS = [(1, "one two three " * 9), (2, None), (3, ""), (None, "x"), (None, "w"), (4, "é" * 500), (5, "last"), (5, "last"), (-(2**63), "a b"), (2**63 - 1, "c")]


def _stream():
    """Ids and documents in order, one after the other."""
    enc = bpe._encoding(bpe.read_ranks(public_tokenizers.path(q.RANKS)), public_tokenizers.PATTERN)
    order = sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0])
    return enc, order


@pytest.mark.parametrize("parts", [1, 8])
def test_shards_are_the_permuted_stream(spark, monkeypatch, tmp_path, parts):
    monkeypatch.setattr(training_order, "shared_folder", lambda spark: str(tmp_path))
    path = public_tokenizers.path(q.RANKS)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS slot").repartition(parts)
    enc, order = _stream()
    out = {r["slot"]: r for r in training_order.materialised(docs, path, public_tokenizers.PATTERN, 5, length=16, per_shard=4).collect()}
    (folder,) = tmp_path.glob("shards-*")
    records = {r["slot"]: np.frombuffer(bytes(r["tokens"]), np.uint16).tolist() for r in training_order.read_shards(spark, str(folder), 16, 4).collect()}
    n = len(records)
    by_number = dict(zip(training_order.unpermuted(np.arange(n), n, 5).tolist(), (records[s] for s in range(n)), strict=True))
    stream = [t for k in range(n) for t in by_number[k]]
    encoded = [(i, t) for i, text in order for t in [*enc.encode_ordinary(text or ""), training_order.SEPARATOR]]
    # the null ids' texts come first, in either order
    nulls = len(enc.encode_ordinary("x")) + len(enc.encode_ordinary("w")) + 2
    flat = [(None, t) for t in stream[:nulls]] + encoded
    assert stream[nulls : len(flat)] == [t for _, t in encoded] and set(stream[len(flat) :]) <= {training_order.SEPARATOR} and n == -(-len(flat) // 16)
    assert sorted(out) == list(range(n)) and all(r["intact"] for r in out.values())
    for r in out.values():
        own = flat[16 * r["number"] : 16 * r["number"] + 16]
        assert set(r["doc_ids"]) == {i for i, _ in own if i is not None} and r["slot"] == training_order.permuted(np.array([r["number"]]), n, 5)[0]
        assert r["sha256"] == hashlib.sha256(np.array(records[r["slot"]], np.uint16).tobytes()).hexdigest()
        assert r["n_tokens"] == sum(t != training_order.SEPARATOR for t in records[r["slot"]])
    for first in (0, 3, 4, n - 1):
        rest = {r["slot"]: np.frombuffer(bytes(r["tokens"]), np.uint16).tolist() for r in training_order.read_shards(spark, str(folder), 16, 4, first).collect()}
        assert rest == {s: t for s, t in records.items() if s >= first}
    assert training_order.materialised(docs.limit(0), path, public_tokenizers.PATTERN, 5).count() == 0


def test_order_does_not_depend_on_splits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    args = public_tokenizers.path(q.RANKS), public_tokenizers.PATTERN, 9
    one, eight = ({(r["slot"], r["number"], r["sha256"], tuple(r["doc_ids"])) for r in training_order.materialised(docs.repartition(k), *args, length=64, per_shard=100).collect()} for k in (1, 8))
    assert one == eight and len(one) > 300


def test_query(spark):
    out = q.op4_training_order(spark, "/root/testdata/sf0.001")
    assert out.where(~F.col("intact")).isEmpty()


def test_a_changed_record_is_told(spark, tmp_path):
    rows = [(slot, slot // 4, at, bytes([65 + slot]) * 16) for slot in range(10) for at in (0, 8)]
    placed = spark.createDataFrame(rows, "slot long, shard long, at int, tokens binary")
    folder = str(tmp_path / "shards")
    training_order.write_shards(placed, folder, 0, 3, 16)
    want = {slot: bytes([65 + slot]) * 32 for slot in range(10)}
    read = lambda: {r["slot"]: bytes(r["tokens"]) for r in training_order.read_shards(spark, folder, 16, 4).collect()}
    assert read() == want
    (file,) = (tmp_path / "shards" / "shard=1").glob("part-*")
    data = bytearray(file.read_bytes())
    data[33 + 5] ^= 1  # within the second record, that of slot 5
    file.write_bytes(data)
    for sums in file.parent.glob(".part-*.crc"):
        sums.unlink()
    got = read()
    assert [s for s in want if got[s] != want[s]] == [5]

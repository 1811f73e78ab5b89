"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Every match of the split pattern is merged separately, and no special tokens exist, so ids equal those of
tiktoken's encode_ordinary on the whole text. Texts longer than PIECE_CHARS are cut where a character that isn't
white space meets a blank or line feed: no match of the pattern crosses that place, so encoding the pieces one by one
gives the ids of the whole. Decoding joins raw bytes and never passes through text, so ids that end inside a
character survive.

Defined cases: a null or empty text has no ids; an empty id list decodes to zero bytes, a null one too; an id
outside the vocabulary raises an error, as it does in the library.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunder.llm.common import small_batches

#: Texts are cut at the first safe boundary after so many characters.
PIECE_CHARS = 50_000
#: Between a character that isn't white space and a blank or line feed.
_SAFE = re.compile(r"(?<=\S)[ \n]")


def read_ranks(path: str) -> bytes:
    """The rank file's bytes. They are broadcast: a vocabulary's size doesn't depend on the data; the largest public ones have 4 MB."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{path} is too large for a rank file")
    return data


@functools.lru_cache(maxsize=2)
def _encoding(data: bytes, pattern: str) -> tiktoken.Encoding:
    """One for each Python worker."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def _vocabulary(data: bytes) -> dict[int, bytes]:
    return {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, data.splitlines())}


def pieces(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """Cuts a text at safe boundaries; a stretch without one stays whole."""
    out, begin = [], 0
    while len(text) - begin > limit and (cut := _SAFE.search(text, begin + limit)):
        out.append(text[begin : cut.start()])
        begin = cut.start()
    out.append(text[begin:])
    return out


def encode_text(encoding: tiktoken.Encoding, text: str | None, limit: int = PIECE_CHARS) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint32)
    ids = array("I")  # encode_to_numpy looks for special tokens, too, which takes a fifth longer
    for piece in pieces(text, limit):
        ids.extend(encoding.encode_ordinary(piece))
    return np.frombuffer(ids, np.uint32)


class Codec:
    """Encodes and decodes columns with one vocabulary.

    path: a rank file on the driver; its bytes go to the executors as a broadcast variable.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        small_batches(spark)
        self.pattern, self.data = pattern, spark.sparkContext.broadcast(read_ranks(path))

    def encode(self, text: Column) -> Column:
        """array<int> of token ids of a string column."""
        data, pattern = self.data, self.pattern

        @F.arrow_udf("array<int>")
        def bpe_encode(texts: pa.Array) -> pa.Array:
            encoding = _encoding(data.value, pattern)
            ids = [encode_text(encoding, text.as_py()) for text in texts]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

        return bpe_encode(text)

    def decode(self, ids: Column) -> Column:
        """binary of an array<int> column."""
        data = self.data

        @F.arrow_udf("binary")
        def bpe_decode(lists: pa.Array) -> pa.Array:
            of = _vocabulary(data.value).__getitem__
            return pa.array([b"".join(map(of, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else b"" for x in lists], pa.binary())

        return bpe_decode(ids)


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with token_ids (array<int>) and decoded (binary), in place of columns of those names."""
    codec = Codec(docs.sparkSession, path, pattern)
    return docs.withColumn("token_ids", codec.encode(F.col(text))).withColumn("decoded", codec.decode(F.col("token_ids")))

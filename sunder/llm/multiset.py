"""Homomorphic multiset fingerprints of documents, in DataFrame functions.

A document is the multiset of its paragraphs (lines with a character other than white space). Each paragraph has a
wide vector, and the document's fingerprint is their sum, taken lane by lane modulo powers of two:

* EXACT lanes modulo 2^32, hashed from the whole paragraph: equal sums mean equal multisets but for a chance of 2^-256;
* LANES counters modulo 2^32, each counting how many of the paragraph's word pairs hash to a 1 in that bit.

So the order of paragraphs doesn't matter, adding a paragraph adds its vector and deleting one subtracts it, see
`combined`. A counter c of n pairs gives the signed sum 2c - n, and the cosine of two documents' signed sums estimates
that of their word-pair counts (standard error up to 1/8, as of 64 lanes): the likeness.

Equal texts have equal fingerprints; texts that differ only in blank lines, order of lines, or the white space at a line's end do
too. Defined cases: a null or empty text has the zero fingerprint; two equal fingerprints have likeness 1, a zero one
with another 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunder.llm.common import written

EXACT, LANES, CHUNK = 8, 64, 32_000
_LOW = 0xFFFFFFFF
#: Texts in a bucket of neighbours, on average.
BUCKET_ROWS = 1000


def paragraphs(text: Column) -> Column:
    """array<string>: the lines that aren't blank, without white space at the end."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.rtrim(p, F.lit(" \t\r\f\x0b")))
    return F.filter(lines, lambda p: p != "")


def exact_lanes(paras: Column) -> list[Column]:
    """The EXACT sums modulo 2^32, as longs."""
    def lane(seed: int, shift: int) -> Column:
        hashes = F.transform(paras, lambda p: F.shiftrightunsigned(F.xxhash64(F.lit(seed), p), shift).bitwiseAND(F.lit(_LOW)))
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: (s + h).bitwiseAND(F.lit(_LOW)))

    return [lane(seed, shift) for seed in range(EXACT // 2) for shift in (0, 32)]


def pair_hashes(paras: Column) -> Column:
    """array<bigint>: a hash for each word of each paragraph and the word after it, the last one with none."""
    words = F.transform(paras, lambda p: F.split(p, " "))
    return F.flatten(F.transform(words, lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.xxhash64(a, b))))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """A row for each row of texts: keys and f, a struct of exact (array<bigint>), pairs (bigint) and counters (array<bigint>).

    keys name columns that together are unique; they may have nulls. If texts is partitioned by some of them already, nothing is shuffled.
    Pairs are counted in chunks of CHUNK, four 16-bit counters to a long: 16 sums, few enough that the JVM compiles the
    loop over them (of 32 sums it would not). The chunks of a text are then added up.
    """
    paras = texts.select(*keys, paragraphs(F.col(text)).alias("_paras"))
    # what stands beside an explode is evaluated for each row that it makes, so the lanes are made before
    rows = paras.select(*keys, F.array(*exact_lanes(F.col("_paras"))).alias("_e"), pair_hashes(F.col("_paras")).alias("_hs"))
    rows = rows.select(*keys, "_e", F.posexplode_outer("_hs").alias("_p", "_h"))
    rows = rows.withColumns({"_k": F.coalesce(F.expr(f"_p div {CHUNK}"), F.lit(0)), "_h": F.coalesce("_h", F.lit(0))})
    sums = [F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(0x0001000100010001))).alias(f"_c{k}") for k in range(LANES // 4)]
    part = rows.groupBy(*keys, "_e", "_k").agg(F.count("_p").alias("pairs"), *sums)
    counters = F.array(*(F.shiftrightunsigned(f"_c{k}", 16 * lane).bitwiseAND(F.lit(0xFFFF)) for lane in range(4) for k in range(LANES // 4)))
    out = part.select(*keys, "_e", F.struct("pairs", counters.alias("counters")).alias("_f")).groupBy(*keys, "_e").agg(F.collect_list("_f").alias("_fs"))
    added = F.aggregate(F.slice("_fs", F.lit(2), F.size("_fs")), F.col("_fs")[0], lambda s, f: F.struct((s.pairs + f.pairs).alias("pairs"), F.zip_with(s.counters, f.counters, lambda x, y: (x + y).bitwiseAND(F.lit(_LOW))).alias("counters")))
    return out.select(*keys, "_e", added.alias("_f")).select(*keys, F.struct(F.col("_e").alias("exact"), "_f.pairs", "_f.counters").alias("f"))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The lanes of a multiset after the paragraphs of b are inserted (sign 1) or deleted (-1), for arrays of lanes modulo 2^32."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32)))


def as_text(exact: Column, pairs: Column, counters: Column) -> Column:
    """A fingerprint as lowercase hex: 8 digits for each exact lane, the count of pairs and each counter."""
    return F.lower(F.array_join(F.transform(F.concat(exact, F.array(pairs.bitwiseAND(F.lit(_LOW))), counters), lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: str, b: str) -> Column:
    """0 to 1, of two struct columns with exact, pairs and counters."""
    both = F.zip_with(f"{a}.counters", f"{b}.counters", lambda x, y: F.struct((2 * x - F.col(f"{a}.pairs")).cast("double").alias("x"), (2 * y - F.col(f"{b}.pairs")).cast("double").alias("y")))
    zero = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"))
    sums = F.aggregate(both, zero, lambda s, v: F.struct((s.xy + v.x * v.y).alias("xy"), (s.xx + v.x * v.x).alias("xx"), (s.yy + v.y * v.y).alias("yy")), lambda s: F.when((s.xx > 0) & (s.yy > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), s.xy / F.sqrt(s.xx * s.yy)))).otherwise(0.0))
    same = (F.col(f"{a}.exact") == F.col(f"{b}.exact")) & (F.col(f"{a}.pairs") == F.col(f"{b}.pairs")) & (F.col(f"{a}.counters") == F.col(f"{b}.counters"))
    return F.when(F.col(f"{a}.pairs").isNull() | F.col(f"{b}.pairs").isNull(), None).when(same, 1.0).otherwise(sums)


def _cell(doc_id: str) -> Column:
    """A number that doesn't fall where ids rise: the sign, the count of bits and the four bits after the first; below all others for null."""
    size = F.when(F.col(doc_id) >= 0, F.col(doc_id)).otherwise(F.bitwise_not(F.col(doc_id)))
    bits = F.length(F.bin(size))
    cell = F.when(bits <= 5, size).otherwise((bits - 4) * 16 + F.expr(f"shiftright(CASE WHEN {doc_id} >= 0 THEN {doc_id} ELSE ~{doc_id} END, length(bin(CASE WHEN {doc_id} >= 0 THEN {doc_id} ELSE ~{doc_id} END)) - 5)").bitwiseAND(F.lit(15)))
    return F.when(F.col(doc_id).isNull(), F.lit(-5000)).when(F.col(doc_id) >= 0, cell).otherwise(-1 - cell).cast("long")


def neighboured(docs: DataFrame, doc_id: str, text: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(bucket, place, doc_id, text, next_text, own): rows in descending order of id, partitioned by bucket, next_text being the text after.

    Rows that share an id follow one another by text; null ids come last, in order of a hash of their text. After the last row comes the first. Ids, which must be
    whole numbers that a long holds, are first put into cells by sign, size and four leading bits, about 2,000 however many ids there are; each cell is cut between
    its own least and greatest id into equal ranges of bucket_rows rows on average, so that a few ids far off don't change how the others are
    dealt, and null ids by hash. Texts are shuffled once, by bucket; each bucket also gets a copy of
    the row that follows its last one (own is false), found among the buckets' own ends in two levels, so no task sees all ids.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("cell", _cell("doc_id"))
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    width = F.greatest(F.lit(1.0), F.ceil((F.col("high") - F.col("low") + 1).cast("double") * bucket_rows / F.col("n"))).cast("long")
    cells = cells.withColumn("width", width).withColumn("parts", F.coalesce(F.expr("(high - low) div width + 1"), F.ceil(F.col("n") / bucket_rows)))
    order = Window.orderBy(F.col("cell").desc())
    cells = written(cells.select("cell", "high", "width", "parts", (F.sum("parts").over(order) - F.col("parts")).alias("begin")), "cells")
    inside = F.coalesce(F.expr("(high - doc_id) div width"), F.pmod(F.xxhash64("text"), F.col("parts")))
    rows = rows.join(F.broadcast(cells), "cell").select("doc_id", "text", (F.col("begin") + inside).alias("bucket"))
    # the first row of each bucket in use goes to the bucket in use before it, that of the first to the last
    used = rows.select("bucket").distinct().withColumn("block", F.expr("bucket div 1000"))
    inner = used.withColumn("before", F.lag("bucket").over(Window.partitionBy("block").orderBy("bucket")))
    blocks = used.groupBy("block").agg(F.max("bucket").alias("top"))
    blocks = blocks.select(F.col("block").alias("at"), F.lag("top").over(Window.orderBy("block")).alias("below"), F.max("top").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("end"))
    before = inner.join(F.broadcast(blocks), F.col("block") == F.col("at")).select(F.col("bucket").alias("b"), F.coalesce("before", "below", "end").alias("to"))  # a row for 1000 buckets
    ends = rows.groupBy("bucket").agg(F.max(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("head"))
    # written, so that the planner knows how small this is and broadcasts it while it is below its threshold
    sent = written(ends.join(before, F.col("bucket") == F.col("b")).select(F.col("b").alias("bucket"), "head", "to"), "heads")
    halo = rows.join(sent, "bucket").where(F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("head")).groupBy("to", "doc_id").agg(F.min("text").alias("text"))
    halo = halo.select("doc_id", "text", F.col("to").alias("bucket"), F.lit(False).alias("own"))
    both = rows.select("doc_id", "text", "bucket", F.lit(True).alias("own")).union(halo)
    order = Window.partitionBy("bucket").orderBy(F.col("own").desc(), F.col("doc_id").desc_nulls_last(), "text")
    return both.select("bucket", F.row_number().over(order).alias("place"), "doc_id", "text", F.lead("text").over(order).alias("next_text"), "own")


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last floor(n/2) code points are the first as many of the next text.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row of docs.
    """
    rows = neighboured(docs, doc_id, text, bucket_rows)
    n = F.char_length("text")
    half = F.expr("char_length(text) div 2").cast("int")
    changed = F.concat(F.left("text", (n - half).cast("int")), F.left(F.coalesce("next_text", "text"), half))
    rows = rows.withColumns({"n_chars": n.cast("long"), "changed": changed})
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t"), F.lit(None).cast("binary").alias("sha")), F.struct(F.lit(1).alias("kind"), F.col("changed").alias("t"), F.unhex(F.sha2(F.col("changed").cast("binary"), 256)).alias("sha")))
    keys = ["bucket", "place", "doc_id", "own", "n_chars"]
    each = rows.select(*keys, F.explode(F.when(F.col("own"), kinds).otherwise(F.slice(kinds, 1, 1))).alias("_")).select(*keys, "_.kind", "_.sha", "_.t")
    prints = fingerprints(each, [*keys, "kind", "sha"], "t")
    order = Window.partitionBy("bucket").orderBy("place", "kind")
    # in order of place and kind: a text, its edited text, the next text
    prints = prints.select("bucket", "place", "kind", "doc_id", "own", "n_chars", "f", F.lead("f", 1).over(order).alias("e"), F.lead("sha", 1).over(order).alias("sha"), F.lead("f", 2).over(order).alias("g"))
    out = prints.where("kind = 0 and own")
    text_of = lambda c: as_text(F.col(f"{c}.exact"), F.col(f"{c}.pairs"), F.col(f"{c}.counters"))
    return out.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), text_of("f").alias("fingerprint"), text_of("e").alias("edited_fingerprint"), likeness("f", "e").alias("near_edited"), likeness("f", "g").alias("near_next"))

"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification, components.

A fingerprint has a bit for each of the 64 bits of a shingle's XXH64; it is 1 if set in over half the shingles.
Documents link if their fingerprints differ in at most `distance` bits, and a component is what links join.

Links are sought among distinct fingerprints, so a group of copies counts once however large it is. The 64 bits are
cut into BLOCKS blocks; of two fingerprints that differ in at most `distance` bits, at least BLOCKS - distance blocks
agree, so each fingerprint is keyed by every choice of that many blocks (20 choices of 3 blocks with the defaults,
about 32 bits a key: few unlike fingerprints meet). Keys held by one fingerprint are dropped by a map-side combined
count; those of two are verified as they are; those of up to GROUP are verified within their group, which a
count has bounded before it is gathered; larger ones are linked exactly without pairs, see `_crowded`. Each group gives
the edges of a spanning forest, never all its pairs.

Defined cases: a null or empty text, and one of white space only, has fingerprint zero, which links like any other.
Repeated rows share a fingerprint and thus a component. Null ids don't count for the smallest id; a component of null
ids only has a null component_id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunder.llm import resemblance
from sunder.llm.common import flagged, scratch, small_batches, unused, written
from sunder.llm.components import connected_components

SHINGLE_WORDS, DISTANCE, BLOCKS = 3, 3, 6
#: The largest group of one key that is verified pair by pair in one task: 16 million comparisons, 32 KB of fingerprints.
GROUP = 4096
SEED = 42


def fingerprint_text(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """A-Z lower-cased, words split at ASCII white space, shingles joined by a blank; fewer words are one shingle, none is zero."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    line, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    begins = [0, *(ends[: n - 1] + 1).tolist()]
    ends = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(begins, ends, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        part = hashes[i : i + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint of a string column as a long, its 64 bits in two's complement."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_text(t.as_py(), words) for t in texts], pa.int64())

    return simhash(text)


def block_masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """The kept bits of every choice of blocks, as signed longs."""
    if not 0 <= distance < blocks <= 64:
        raise ValueError("more blocks than differing bits are needed")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(chosen)) for chosen in combinations(block, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(distance: int):
    @F.arrow_udf("array<struct<a:long,b:long>>")
    def forest(groups: pa.Array) -> pa.Array:
        """Of each list of distinct fingerprints, the edges that join what is linked to its component's first."""
        out = []
        for group in groups:
            fps = np.sort(group.values.to_numpy(zero_copy_only=False).view(np.uint64))
            label = np.arange(len(fps))
            todo = set(range(len(fps)))
            while todo:
                root = min(todo)
                todo.discard(root)
                wave = [root]
                while wave and todo:
                    rest = np.fromiter(todo, np.int64, len(todo))
                    fresh = np.zeros(len(rest), bool)
                    for i in wave:
                        fresh |= np.bitwise_count(fps[rest] ^ fps[i]) <= distance
                    wave = rest[fresh].tolist()
                    label[wave] = root
                    todo.difference_update(wave)
            own = fps.view(np.int64)
            out.append([{"a": int(own[i]), "b": int(own[j])} for i, j in enumerate(label) if i != j])
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return forest


def _crowded(keys: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """Edges that join what is linked within keys of any size, without pairs.

    Two fingerprints differ in at most d bits if and only if some word w differs from one in at most d - d//2 bits
    and from the other in at most d//2. So each fingerprint goes to the words around it, changed only in the bits that
    the key leaves free. At a word, all that are within d//2 bits are linked to one another and to all within
    d - d//2: a star from the smallest of the nearer ones. A word has as many neighbours at most as there are changes, however many rows share the key.
    """
    spark, near, far = keys.sparkSession, distance // 2, distance - distance // 2
    changes = []
    for k, mask in enumerate(masks):
        free = [i for i in range(64) if not mask >> i & 1]
        for r in range(far + 1):
            changes += [(k, _signed(sum(1 << i for i in bits)), r <= near) for bits in combinations(free, r)]
    balls = F.broadcast(spark.createDataFrame(changes, "k int, change long, near boolean"))  # fixed by the parameters, about 10,000 rows
    around = keys.join(balls, "k").select("k", "fp", F.expr("fp ^ change").alias("word"), "near")
    hubs = around.where("near").groupBy("k", "word").agg(F.min("fp").alias("hub"))
    return around.join(hubs, ["k", "word"]).where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def links(fingerprints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """Edges (a, b) whose components are those of all links; fingerprints: a column fp of distinct longs."""
    masks = block_masks(distance, blocks)
    keys = fingerprints.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)))).alias("_")).select("fp", "_.k", "_.key")
    shared = written(keys.groupBy("k", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "blocks")
    pairs = shared.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
    sizes = shared.where("n > 2").select("k", "key", "n")
    found = pairs
    top = sizes.agg(F.max("n")).first()[0] or 0  # one number to the driver
    if top > 2:
        members = keys.join(sizes.where(F.col("n") <= group), ["k", "key"])
        lists = members.groupBy("k", "key").agg(F.collect_list("fp").alias("fps"))
        found = found.union(lists.select(F.explode(_near(distance)(F.col("fps"))).alias("_")).select("_.a", "_.b"))
    if top > group:
        found = found.union(_crowded(keys.join(sizes.where(F.col("n") > group), ["k", "key"]).select("k", "fp"), masks, distance))
    return found.distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, distance: int = DISTANCE, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """(doc_id, fp, component_id) of every row: its fingerprint and the smallest id that its links reach."""
    small_batches(docs.sparkSession)
    with scratch() as kept:
        prints = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), words).alias("fp")), "fingerprints")
        distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
        labels = connected_components(links(distinct.select("fp"), distance, blocks, group))
        members = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
        firsts = written(members.groupBy("root").agg(F.min("first_id").alias("component_id")), "firsts")
        kept += [prints, written(members.join(firsts, "root").select("fp", "component_id"), "classes")]
    return prints.join(kept[1], "fp").select("doc_id", "fp", "component_id")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = resemblance.SIMILARITY, words: int = SHINGLE_WORDS, distance: int = DISTANCE, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """(doc_id, node, component_id) of every row, as near_duplicates, but also linked by resemblance, written.

    node stands for a set of five-word shingles. Components join equal fingerprints, fingerprints within `distance`
    bits, equal sets and sets of at least `similarity`. Whole sets are made again, for the first document of each node that is a candidate.
    """
    small_batches(docs.sparkSession)
    with scratch() as kept:
        rows = docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), words).alias("fp"), resemblance.sketched(F.col(text), shingles=False).alias("_"))
        prints = written(rows.select("doc_id", "fp", "_.*"), "sketches")
        pairs = written(prints.groupBy("node", "fp").agg(F.min("doc_id").alias("first_id")), "distinct")
        nodes = written(pairs.groupBy("node").agg(F.min("first_id").alias("first_id")), "nodes")
        hubs = written(pairs.groupBy("fp").agg(F.min("node").alias("hub")), "hubs")
        near = links(hubs.select("fp"), distance, blocks, group)
        near = near.join(hubs.select(F.col("fp").alias("a"), F.col("hub").alias("ha")), "a").join(hubs.select(F.col("fp").alias("b"), F.col("hub").alias("hb")), "b")
        edges = pairs.join(hubs, "fp").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))

        def whole(wanted: DataFrame) -> DataFrame:
            firsts = wanted.join(nodes, "node").select("first_id")
            flag = unused("_flag", docs)
            some = flagged(docs, doc_id, firsts, flag)
            some = some.where(F.col(flag) | F.col(doc_id).isNull()) if firsts.where("first_id is null").limit(1).count() else some.where(flag)
            return some.select(resemblance.shingled(F.col(text)).alias("_")).select("_.node", "_.shingles")

        labels = connected_components(edges.union(near.select("ha", "hb")).union(resemblance.links(prints.select("node", "bands", "marks"), similarity, whole=whole)))
        members = nodes.join(labels, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
        firsts = written(members.groupBy("root").agg(F.min("first_id").alias("component_id")), "firsts")  # written, so that a large component's partition can be split in the join
        found = members.join(firsts, "root").select("node", "component_id")
        kept.append(written(prints.select("doc_id", "node").join(found, "node").select("doc_id", "node", "component_id"), "classes"))
    return kept[0]


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without near-duplicates: of each component of `classes` the row with the smallest id stays, one of them if rows share that id.

    Of rows without an id, one stays for each component that has no other and, within it, for each set of shingles. Only
    rows whose id may be one that goes, or is there more than once, are shuffled with their texts.
    """
    with scratch() as kept:
        found = classes(docs, doc_id, text, **how)
        ids = found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"), F.count("*").alias("n"))
        told = written(ids.where("not stays or n > 1").select("doc_id", "stays"), "told")
        kept.append(told)
        orphans = written(found.where("component_id is null").select("node").distinct(), "orphans")
        kept.append(orphans)
    flag = unused("_flag", docs)
    marked = flagged(docs, doc_id, told.select("doc_id"), flag)
    gone = told.where("not stays").select(F.col("doc_id").alias(unused("_gone", docs)))
    told_apart = marked.where(flag).drop(flag)
    rest = told_apart.join(gone.hint("shuffle_hash"), F.col(doc_id) == gone[gone.columns[0]], "left_anti")  # texts needn't be sorted
    if told.where("stays and doc_id is not null").limit(1).count():  # ids aren't unique: leave one row of each
        rest = rest.dropDuplicates([doc_id])
    out = marked.where(~F.col(flag) & F.col(doc_id).isNotNull()).drop(flag).unionByName(rest)
    if orphans.limit(1).count():
        node = unused("_node", docs)
        lost = docs.where(F.col(doc_id).isNull()).withColumn(node, resemblance.shingled(F.col(text))["node"])
        out = out.unionByName(lost.join(orphans.withColumnRenamed("node", node), node, "left_semi").dropDuplicates([node]).drop(node))
    return out

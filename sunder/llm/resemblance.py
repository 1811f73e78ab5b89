"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash blocks can't find these: such texts differ in 4 to 11 of 64 bits as measured. So each distinct set gets a sketch of
BANDS x ROWS minima; sets that agree in a band of ROWS minima meet (at 0.8 a pair is missed once in about 14,000).
Two sets that meet alone are verified; of a larger meeting a task emits a maximum spanning forest by the sketches'
estimate, of one of over GROUP sets the pairs with its smallest node, at most one edge per member either way. Every edge is
verified by the exact similarity of the whole sets, which are read for the candidates only.

An edge that fails stands for weaker estimates that may hold. So a second pass verifies all pairs that meet, have an
estimate of at least FLOOR and aren't in one component yet. It compares whole sets within tasks, so pairs are never rows. Meetings are cut into chunks of GROUP sets there, so
no list is unbounded, and what the first pass has joined to the meeting's largest component is compared with the rest only. So a family of copies costs about its
size, while the time spent on unlike texts that meet grows with the square of their number, as each pair of them may be a link.

Defined cases: texts of fewer than five words are one shingle; texts without words equal each other and link to nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunder.llm.common import scratch, sifted, written
from sunder.llm.components import connected_components

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 5
#: Sets of one meeting that a task compares at most with as many others: 120 bytes of marks each.
GROUP = 512
#: Estimates below this aren't verified: four standard errors under the similarity.
FLOOR = SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / (BANDS * ROWS)) ** 0.5
_ODD = np.random.default_rng(5).integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.random.default_rng(6).integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted. Words and case are those of simhash.fingerprint_text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    n = max(1, len(tokens) - words + 1)
    acc = np.full(n, len(tokens) if len(tokens) < words else words, np.uint64)
    for j in range(min(words, len(tokens))):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + own[j : j + n]
        acc ^= acc >> np.uint64(29)
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(acc ^ (acc >> np.uint64(32)))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The sketch: for each of BANDS x ROWS scrambles the upper half of the smallest value."""
    best = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        best = np.minimum(best, ((hashes[i : i + 4096] ^ _SALT) * _ODD).min(axis=1))
    return (best >> np.uint64(32)).astype(np.uint32)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sketched(text: Column, shingles: bool = True) -> Column:
    """Struct of node (a hash of the set), bands (a key for each band, none of an empty set), marks (a byte of each minimum) and, if wanted, shingles (the set's sorted upper halves)."""
    fields = [("node", pa.int64()), ("bands", pa.list_(pa.int64())), ("marks", pa.binary())] + [("shingles", pa.binary())] * shingles

    @F.arrow_udf("struct<node:long,bands:array<long>,marks:binary" + ",shingles:binary" * shingles + ">")
    def sketch(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            hashes = shingle_hashes(t.as_py())
            least = minima(hashes)
            bands = [_signed(xxhash.xxh64_intdigest(band.tobytes(), b)) for b, band in enumerate(least.reshape(BANDS, ROWS))] if len(hashes) else []
            rows.append({"node": _node(hashes), "bands": bands, "marks": least.astype(np.uint8).tobytes()} | ({"shingles": _halves(hashes)} if shingles else {}))
        return pa.array(rows, pa.struct(fields))

    return sketch(text)


def _node(hashes: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(hashes.tobytes()))


def _halves(hashes: np.ndarray) -> bytes:
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32)).tobytes()


def shingled(text: Column) -> Column:
    """Struct of node and shingles, as of sketched(), without the minima."""

    @F.arrow_udf("struct<node:long,shingles:binary>")
    def shingle(texts: pa.Array) -> pa.Array:
        sets = [shingle_hashes(t.as_py()) for t in texts]
        return pa.array([{"node": _node(s), "shingles": _halves(s)} for s in sets], pa.struct([("node", pa.int64()), ("shingles", pa.binary())]))

    return shingle(text)


def spanning_forest(sketches: np.ndarray, floor: float = FLOOR) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest by the share of equal minima, of at least floor; one row at a time."""
    n = len(sketches)
    best, parent, out = np.full(n, -1.0), np.zeros(n, np.int64), []
    waiting = np.ones(n, bool)
    i = 0
    for _ in range(n - 1):
        waiting[i] = False
        like = (sketches == sketches[i]).mean(axis=1)
        closer = waiting & (like > best)
        best[closer], parent[closer] = like[closer], i
        i = int(np.where(waiting, best, -2.0).argmax())
        if best[i] >= floor:
            out.append((int(parent[i]), i))
    return out


def _forest(members: Column) -> Column:
    """The edges of each list's maximum spanning forest."""

    @F.arrow_udf("array<struct<a:long,b:long>>")
    def forest(groups: pa.Array) -> pa.Array:
        out = []
        for group in groups:
            members = sorted(group.as_py(), key=lambda m: m["node"])
            table = np.stack([np.frombuffer(m["marks"], np.uint8) for m in members])
            out.append([{"a": members[i]["node"], "b": members[j]["node"]} for i, j in spanning_forest(table)])
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return forest(members)


def _needed(marks: np.ndarray, root: np.ndarray, mine: np.ndarray, band: int, across: bool, i: int) -> tuple[np.ndarray, np.ndarray]:
    """The members after the i-th that it's to be compared with, and their estimates, the highest first: of another root and chunk, of at least FLOOR, and meeting in no band before."""
    rest = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & ((mine[i + 1 :] != mine[i]) if across else True))
    equal = marks[rest] == marks[i]
    like = equal.mean(axis=1)
    good = (like >= FLOOR) & ~equal[:, : band * ROWS].reshape(len(rest), band, ROWS).all(axis=2).any(axis=1)
    order = np.argsort(-like[good], kind="stable")
    return rest[good][order], like[good][order]


def _compared(lists: DataFrame, similarity: float | None = None) -> DataFrame:
    """Of each list of a meeting, (key, i, j, node) of the members that are to be compared with another; with a similarity, whose lists hold shingles, too, verified edges (a, b) that join what isn't joined yet."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, x, y, band, group in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4), strict=True):
                members = group.values
                node, root, mine = (members.field(f).to_numpy() for f in ("node", "root", "mine"))
                marks = np.stack([np.frombuffer(m, np.uint8) for m in members.field("marks").to_pylist()])
                if similarity is None:
                    wanted = np.zeros(len(node), bool)
                    for i in range(len(node) - 1):
                        found, _ = _needed(marks, root, mine, band, x != y, i)
                        wanted[found] = True
                        wanted[i] |= bool(len(found))
                    own = node[wanted]
                    yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(own), pa.int64()), "i": pa.array([x] * len(own), pa.int32()), "j": pa.array([y] * len(own), pa.int32()), "node": pa.array(own, pa.int64())})
                    continue
                sets = [np.frombuffer(s, np.uint32) for s in members.field("shingles").to_pylist()]
                root, edges = root.copy(), []
                for i in range(len(node) - 1):
                    for k in _needed(marks, root, mine, band, x != y, i)[0]:
                        if root[k] != root[i] and _similarity(sets[i], sets[k]) >= similarity:
                            edges.append((int(node[i]), int(node[k])))
                            root[root == root[k]] = root[i]
                yield pa.RecordBatch.from_pydict({"a": pa.array([min(e) for e in edges], pa.int64()), "b": pa.array([max(e) for e in edges], pa.int64())})

    return lists.select("key", "i", "j", "band", "members").mapInArrow(each, "key long, i int, j int, node long" if similarity is None else "a long, b long")


def _similarity(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _alike(x: Column, y: Column) -> Column:
    """The share of equal marks."""

    @F.arrow_udf("double")
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([float((np.frombuffer(x.as_buffer(), np.uint8) == np.frombuffer(y.as_buffer(), np.uint8)).mean()) for x, y in zip(left, right, strict=True)], pa.float64())

    return alike(x, y)


def _verified(whole: Callable[[DataFrame], DataFrame], pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose whole sets have the similarity, written."""
    with scratch() as kept:
        sets = _sets(whole, pairs.select(F.explode(F.array("a", "b")).alias("node")))
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        kept.append(written(pairs.join(left, "a").join(right, "b").where(_jaccard(F.col("x"), F.col("y")) >= similarity).select("a", "b"), "verified"))
    return kept[0]


def _sets(whole: Callable[[DataFrame], DataFrame], nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes, written."""
    wanted = written(nodes.distinct(), "wanted")
    return written(whole(wanted).select("node", "shingles").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "candidate-sets")


def _jaccard(x: Column, y: Column) -> Column:
    """The similarity of two sets of shingles; 0 if both are empty."""

    @F.arrow_udf("double")
    def jaccard(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            out.append(_similarity(*(np.frombuffer(s.as_buffer(), np.uint32) for s in (x, y))))
        return pa.array(out, pa.float64())

    return jaccard(x, y)


def links(sets: DataFrame, similarity: float = SIMILARITY, group: int = GROUP, whole: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Verified edges (a, b) among sets, written: sets is a table of node, bands and marks in which nodes may repeat.

    whole gives (node, shingles) for a table of nodes, once at least for each and of other nodes as it likes; without it sets has a column shingles.
    """
    whole = whole or (lambda wanted: sifted(sets.select("node", "shingles"), "node", wanted))
    with scratch() as kept:
        own = written(sets.groupBy("node").agg(F.first("bands").alias("bands"), F.first("marks").alias("marks")), "sets")
        marks = own.select("node", "marks")
        keys = own.select("node", F.posexplode("bands").alias("band", "key"))
        shared = written(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("n > 1"), "meetings")
        crowds = shared.where("n > 2")
        members = written(sifted(keys, "key", crowds.select("key")).join(crowds.select("key", "n", F.col("a").alias("hub")), "key"), "members")
        pairs = written(shared.where("n = 2").select("a", "b").union(_first_pairs(members, marks, group)).distinct(), "candidates")
        edges = _verified(whole, pairs, similarity)
        kept.append(written(edges.union(_other_edges(members, marks, connected_components(edges), whole, similarity, group)), "links"))
    return kept[0]


def _first_pairs(members: DataFrame, marks: DataFrame, group: int) -> DataFrame:
    """Of each meeting of at most `group` sets a spanning forest, of a larger one the pairs of its smallest node, all by the estimate."""
    lists = members.where(F.col("n") <= group).join(marks, "node").groupBy("key").agg(F.collect_list(F.struct("node", "marks")).alias("members"))
    found = lists.select(F.explode(_forest(F.col("members"))).alias("_")).select("_.a", "_.b")
    stars = members.where((F.col("n") > group) & (F.col("node") != F.col("hub"))).select("node", "hub").distinct()
    hubs = marks.select(F.col("node").alias("hub"), F.col("marks").alias("hub_marks"))
    stars = stars.join(hubs, "hub").join(marks, "node").where(_alike(F.col("marks"), F.col("hub_marks")) >= FLOOR)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(stars.select(F.col("hub").alias("a"), F.col("node").alias("b")))


def _other_edges(members: DataFrame, marks: DataFrame, roots: DataFrame, whole: Callable[[DataFrame], DataFrame], similarity: float, group: int) -> DataFrame:
    """Verified edges between different roots: every pair that meets and reaches FLOOR is verified, unless the edges found before it have joined it.

    In each meeting the sets of its commonest root, the major ones, needn't be compared with one another. The others are cut into c, the major ones into d chunks of `group`; chunks of
    others meet one another and those of major ones. So a member is sent c + d times or, if it is a major one, c times. Marks are sent first; whole
    sets only of members that are to be compared, and to where they are. No pair is a row, only edges are, fewer than a list has members.
    """
    with_root = members.select("node", "key", "band", "n").join(roots, "node", "left").select("key", "band", "node", "n", F.coalesce("root", "node").alias("root"))
    sizes = with_root.groupBy("key", "n", "root").agg(F.count("*").alias("m"))
    sizes = sizes.groupBy("key", "n").agg(F.max(F.struct("m", "root")).alias("_")).where("_.m < n").select("key", F.col("_.root").alias("major"), F.ceil((F.col("n") - F.col("_.m")) / group).cast("int").alias("c"), F.ceil(F.col("_.m") / group).cast("int").alias("d"))
    placed = with_root.join(sizes, "key").withColumn("is_major", F.col("root") == F.col("major"))
    spot = F.xxhash64("node")
    placed = placed.withColumn("mine", F.when(F.col("is_major"), F.col("c") + F.pmod(spot, F.col("d"))).otherwise(F.pmod(spot, F.col("c"))).cast("int"))
    last = F.when(F.col("is_major"), F.col("c")).otherwise(F.col("c") + F.col("d")) - 1
    placed = placed.select("node", "root", "key", "band", "mine", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    placed = placed.select("node", "root", "key", "band", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).join(marks, "node")
    listed = lambda rows, *more: rows.groupBy("key", "i", "j", "band").agg(F.collect_list(F.struct("node", "root", "mine", "marks", *more)).alias("members"))
    wanted = written(_compared(listed(placed)), "compared")
    sets = _sets(whole, wanted.select("node"))
    return _compared(listed(placed.join(wanted, ["key", "i", "j", "node"]).join(sets, "node"), "shingles"), similarity)

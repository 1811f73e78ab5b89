import numpy as np
import pytest
from pyspark.sql import functions as F
from sunder.llm import components, resemblance, simhash


def _sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def _alike(x, y):
    return x == y or 10 * len(x & y) >= 8 * len(x | y)


def _copies(seed, groups, each, words, changed):
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(5000)])
    texts = []
    for _ in range(groups):
        base = rng.choice(vocabulary, words)
        for _ in range(each):
            own = base.copy()
            own[rng.integers(0, words, rng.integers(0, changed + 1))] = "other"
            texts.append(" ".join(own))
    return texts


def test_shingles_are_sets():
    same = resemblance.shingle_hashes("A b\tc d E f"), resemblance.shingle_hashes("a B c\n d e F")
    assert (same[0] == same[1]).all() and len(same[0]) == 2
    assert len(resemblance.shingle_hashes("a b c")) == 1 and len(resemblance.shingle_hashes(" ")) == 0
    assert not (resemblance.shingle_hashes("a b c") == resemblance.shingle_hashes("c b a")).any()


@pytest.mark.parametrize("group", [3, 1024])
def test_near_copies_equal_brute_force(spark, group):
    texts = _copies(1, 6, 12, 200, 4)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = rows.select("doc_id", resemblance.sketched(F.col("text")).alias("_")).select("doc_id", "_.*")
    node = {r["doc_id"]: r["node"] for r in sets.select("doc_id", "node").collect()}
    edges = resemblance.links(sets.select("node", "bands", "marks", "shingles"), group=group)
    label = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    got = [label.get(node[i], node[i]) for i in range(len(texts))]
    own = _sets(texts)
    reach = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if _alike(own[i], own[j]):
                a, b = reach[i], reach[j]
                reach = [min(a, b) if r in (a, b) else r for r in reach]
    assert all((reach[i] == reach[j]) == (got[i] == got[j]) for i in range(len(texts)) for j in range(i))


def test_deduplicated_joins_near_copies(spark):
    texts = [*_copies(2, 2, 3, 300, 3), None, "", " ", "tiny text", "tiny text", "another tiny"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("node", F.lit("clash"))
    kept = simhash.deduplicated(rows)
    assert kept.columns == rows.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 6, 9, 11]
    assert simhash.deduplicated(rows.limit(0)).count() == 0


@pytest.mark.parametrize("group", [40, 1024])
def test_families_around_the_threshold_equal_brute_force(spark, group):
    texts = _copies(7, 2, 90, 404, 14)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = rows.select("doc_id", resemblance.sketched(F.col("text")).alias("_")).select("doc_id", "_.*")
    node = {r["doc_id"]: r["node"] for r in sets.select("doc_id", "node").collect()}
    edges = resemblance.links(sets.select("node", "bands", "marks", "shingles"), group=group)
    label = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    got = [label.get(node[i], node[i]) for i in range(len(texts))]
    own, reach = _sets(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if reach[i] != reach[j] and _alike(own[i], own[j]):
                a, b = reach[i], reach[j]
                reach = [min(a, b) if r in (a, b) else r for r in reach]
    print("components", len(set(reach)), "found", len(set(got)))
    assert len(set(reach)) == len(set(got)) == len(set(zip(reach, got, strict=True)))

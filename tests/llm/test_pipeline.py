import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sunder.llm import bpe
from sunder.llm import queries as q
from tests.llm.test_decontaminate import _brute_force
from tests.llm.test_operators import _fingerprint
from tests.llm.test_resemblance import _alike, _sets

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_near_duplicates_equal_brute_force(spark, docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    sets, fps = _sets([t for _, t in rows]), [_fingerprint(t) for _, t in rows]
    reach = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if reach[i] != reach[j] and (_alike(sets[i], sets[j]) or (fps[i] ^ fps[j]).bit_count() <= 3):
                a, b = sorted((reach[i], reach[j]))
                reach = [a if r == b else r for r in reach]
    kept = STAGES["near_duplicates"](spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [rows[i][0] for i in sorted(set(reach))]


def test_decontamination_equals_brute_force(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    found = {doc for doc, _ in _brute_force(docs.select("doc_id", "text").collect(), bench)}
    kept = {r["doc_id"] for r in STAGES["decontamination"](spark, docs, SF).collect()}
    assert found and kept == {r["doc_id"] for r in docs.collect()} - found


def test_run_is_its_stages_in_order(spark, docs):
    enc = bpe._encoding(bpe.read_ranks(public_tokenizers.path(q.RANKS)), public_tokenizers.PATTERN)
    for stage in list(STAGES.values())[:-1]:
        docs = stage(spark, docs, SF)
    want = {r["doc_id"]: enc.encode_ordinary(r["text"] or "") for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["token_ids"] for r in got} == want and len(got) == len(want) and all(r["round_trip"] for r in got)


def test_odd_rows_pass_every_stage(spark, docs):
    rows = [(1, None), (1, None), (2, ""), (None, "no id here"), (None, "no id here"), (3, "word " * 30_000), (3, "word " * 30_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    odd = docs.limit(0).unionByName(odd, allowMissingColumns=True).withColumns({c: F.lit(1) for c in ("_kept", "_found", "_flag", "_node", "node", "fp")})
    for name, stage in STAGES.items():
        out = stage(spark, odd, SF)
        assert out.columns[: len(odd.columns)] == odd.columns
        assert stage(spark, odd.limit(0), SF).count() == 0
        if name == "near_duplicates":
            assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 3]
        elif name in ("decontamination", "tokens"):
            assert out.count() == len(rows)

import hashlib
import io
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from sunder.llm import bpe, chat, components, decontaminate, multiset, pu_quality, simhash, toxicity, url_filter, warc
from sunder.llm import queries as q

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "é" * 3000), (5, "same same same " * 4000), (5, "same same same " * 4000), (None, "no id"), (6, "x\n\ny <|endoftext|> 12 km")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"score": F.lit(1), "w": F.lit("w"), "fp": F.lit(0), "bucket": F.lit("b")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_bpe_equals_library_and_round_trips(spark, odd, docs):
    ranks = bpe._encoding(bpe.read_ranks(public_tokenizers.path(q.RANKS)), public_tokenizers.PATTERN)
    assert isinstance(ranks, tiktoken.Encoding)
    for df in (odd, docs):
        for r in bpe.encode_decode(df.select("doc_id", "text"), public_tokenizers.path(q.RANKS), public_tokenizers.PATTERN).collect():
            assert r["token_ids"] == ranks.encode_ordinary(r["text"] or "")
            assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_bpe_pieces_are_safe():
    enc = bpe._encoding(bpe.read_ranks(public_tokenizers.path(q.RANKS)), public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a", "Zé", "12", " ", "  ", "\n", "'s", " ", " ", "!", "漢", "\x1c"]) for _ in range(80))
        assert bpe.encode_text(enc, text, 7).tolist() == enc.encode_ordinary(text)
        assert "".join(bpe.pieces(text, 7)) == text


def _fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps, distance=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark, docs, odd):
    out = {r["doc_id"]: r for r in q.op2_simhash(spark, SF).collect()}
    rows = sorted(docs.select("doc_id", "text").collect())
    fps = [_fingerprint(r["text"]) for r in rows]
    roots = _components(fps)
    for r, fp, root in zip(rows, fps, roots, strict=True):
        assert out[r["doc_id"]]["fingerprint"] == f"{fp:016x}"
        assert out[r["doc_id"]]["component_id"] == rows[root]["doc_id"]
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert sorted(r["doc_id"] or 0 for r in simhash.deduplicated(odd).collect()) == [0, 1, 4, 5, 6]


@pytest.mark.parametrize("group", [2, 3, 4096])
def test_links_of_dense_groups(spark, group):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 4, dtype=np.uint64)]
    fps = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) ^ (1 << int(k)) for b in base for i, j, k in rng.integers(0, 64, (25, 3))})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    label = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components.connected_components(simhash.links(df, group=group)).collect()}
    roots = _components(fps)
    mine = [label.get(x, x) for x in fps]
    assert all((roots[i] == roots[j]) == (mine[i] == mine[j]) for i in range(len(fps)) for j in range(i))


def test_components_of_a_long_path(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = components.connected_components(edges).collect()
    assert len(out) == 61 and {r["root"] for r in out} == {0}
    assert components.connected_components(edges.where("a < 0")).count() == 0


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for query, label, least in ((q.op3_quality, "quality", 0.95), (q.op8_toxicity, "toxic", 0.93)):
        rows = query(spark, sf).collect()
        assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
        own = [(r["predicted"], labels[r["doc_id"]][label]) for r in rows if r["held_out"] and r["doc_id"] in labels]
        assert np.mean([a == b for a, b in own]) >= least


def test_classifiers_of_odd_rows(spark, odd, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert pu_quality.scored(odd, labels).count() == len(ODD) == toxicity.scored(odd, labels).count()
    none = labels.limit(0)
    assert {r["score"] for r in pu_quality.scored(docs, none).collect()} == {0.5}
    assert {r["score"] for r in toxicity.scored(docs, none).collect()} == {0.0}


def test_deobfuscation(docs):
    texts = [r["text"] for r in docs.select("text").collect()]
    channel = toxicity.Channel(toxicity.language_model(toxicity.trigrams(texts) + 2000 * toxicity.trigrams(["idiot worthless stupid loser"])))
    for text, word in (("an 1d1ot here", "idiot"), ("you i d i o t.", "idiot"), ("a stuuuupid one", "stupid"), ("w0rthle$s", "worthles"), ("L.0.5.E.R", "loser"), ("plain idiot", "idiot")):
        assert word in channel.words(text), (text, channel.words(text))
    # the likeliest reading is that of all readings
    model = np.array(channel.model)
    for stretch in ("1d10t", "l o s e r", "aa5"):
        best = math.inf
        paths = [("", 0.0)]
        for ways in channel.lattice(stretch):
            paths = [(p + x, c + price) for p, c in paths for x, price in ways if not (x == " " and (not p or p[-1] == " "))] + [(p, c + price) for p, c in paths for x, price in ways if x == " " and (not p or p[-1] == " ")]
        for p, c in paths:
            s = toxicity.symbols(p if p.endswith(" ") else p + " ")[:-2]
            best = min(best, c - sum(model[a << 10 | b << 5 | d] for a, b, d in zip(s, s[1:], s[2:], strict=False)) + 0)
        got = channel.decode(stretch)
        s = toxicity.symbols(got + " ")[:-2]
        cost = min(c for p, c in paths if p.strip() == got) - sum(model[a << 10 | b << 5 | d] for a, b, d in zip(s, s[1:], s[2:], strict=False))
        assert cost <= best + 1e-4


def test_warc_round_trip(spark):
    rows = [(1, "http://a.b/x y", "p" * 200), (2, "http://a.b/2", "p" * 200), (3, None, None), (4, "http://c/\n", "WARC/1.1\r\n\r\n" * 30), (5, "u", "s" * 99), (6, "u", "s" * 99), (None, "n", "p" * 200), (7, "ü", "é" * 60)]
    got = {r["key"]: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), with_payload=True).collect()}
    assert len(got) == len(rows)
    for key, _, html in rows:
        payload, r = (html or "").encode(), got[key]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        repeated = key in (2, None)
        assert (r["record_type"], r["refers_to_key"]) == (("revisit", 1) if repeated else ("response", None))
        assert r["payload"] is None if repeated else bytes(r["payload"]) == payload
        assert r["refers_to"] == (got[1]["record_id"] if repeated else None)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_arc_versions_and_errors():
    for version in (1, 2):
        data = warc.version_block(version, "x.arc", "20010203040506") + warc.arc_header(version, "http://a/", "1.2.3.4", "200102030405", "text/plain", 5) + b"he\nlo\n"
        assert [(r["payload"], r["date"]) for r in warc.parse_arc(io.BytesIO(data))] == [(b"he\nlo", "2001-02-03T04:05:00Z")]
        with pytest.raises(EOFError):
            list(warc.parse_arc(io.BytesIO(data[:-3])))


def test_url_rules(spark):
    cases = {"http://a.net/x": "net/", "https://A.Example.NET/en/1?q": "example.net/en/", "http://example.com/de/#": "example.com/de/", "http://x.org/fr/": "org/fr/", "http://xnet/": None, "http://a.net": None, "nothing": None, None: None}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").withColumn("rule", F.lit("clash"))
    out = {r["url"]: r for r in url_filter.judged(df).collect()}
    assert {u: r["rule"] for u, r in out.items()} == cases
    assert out["https://A.Example.NET/en/1?q"]["host"] == "a.example.net" and out["https://A.Example.NET/en/1?q"]["path"] == "/en/1"
    assert out[None]["host"] == out["nothing"]["path"] == ""
    judge = url_filter.judged(spark.createDataFrame([("http://casino-poker.example.com/en/1",), ("http://www.library.example.com/en/1",)], "url string"))
    assert [r["verdict"] for r in judge.collect()] == ["block", "allow"]


def test_multiset(spark, docs, odd):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in multiset.edited(docs, bucket_rows=7).collect()}
    for i, (k, t) in enumerate(rows):
        after, m = rows[(i + 1) % len(rows)][1], len(t) // 2
        assert got[k]["edited_sha256"] == hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest()
        assert got[k]["n_chars"] == len(t)
    assert multiset.edited(odd).count() == len(ODD)
    assert multiset.edited(odd.limit(0)).count() == 0
    texts = spark.createDataFrame([(1, "a b c\nd e"), (2, "d e\n\na b c"), (3, "a b c"), (4, "d e"), (5, "a b c\nd f")], "k long, text string")
    f = {r["k"]: r["f"] for r in multiset.fingerprints(texts, ["k"]).collect()}
    assert f[1] == f[2] != f[5]
    one = spark.createDataFrame([(f[3]["exact"], f[4]["exact"], f[1]["exact"])], "a array<long>, b array<long>, c array<long>")
    assert one.select(multiset.combined(F.col("a"), F.col("b")) == F.col("c"), multiset.combined(F.col("c"), F.col("b"), -1) == F.col("a")).first() == (True, True)


def test_decontamination(spark, odd):
    item = "A train leaves Berlin at 9 and travels 120 km to reach the city of Hamburg, how fast does it go on average"
    docs = [(1, f"Noise before it. {item} and noise."), (2, "x " + item.replace("120", "75").replace("Berlin", "Paris").replace("Hamburg", "Lyon")), (3, "quite another text about trains and cities without any question in it at all"), (4, None), (5, item + " " + item.replace("Berlin", "Rome").replace("120", "9"))]
    bench = spark.createDataFrame([(1, item), (2, ""), (3, None)], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(frame, bench).collect()}
    assert got.keys() == {(1, 1), (2, 1), (5, 1)}
    assert got[1, 1]["copies"] > 0 and got[2, 1]["consistent"]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(frame, bench).collect()) == [3, 4]
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, None, None), (5, 1, "user", "b"), (5, 0, "user", "b"), (None, 0, "user", "n")]
    got = {r["conv_id"]: r for r in chat.rendered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got.keys() == {1, 4, 5, None} and got[1]["copies"] == 2
    assert got[1]["text"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"


def test_pipeline(spark):
    import corpus_pipeline

    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        columns = columns or docs.columns
        assert kept.columns == columns and kept.exceptAll(docs).isEmpty()
        docs = kept
    out = corpus_pipeline.run(spark, SF)
    assert out.where("not round_trip").isEmpty() and out.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty()

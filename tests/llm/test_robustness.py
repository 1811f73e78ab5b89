"""Odd ids, clashing columns and malformed lines."""

import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from sunder.llm import multiset, training_order, url_filter, warc


@pytest.mark.parametrize("far", [(-(1 << 63), (1 << 63) - 1), (10**15, -(10**12))])
def test_ids_far_off_leave_buckets_even(spark, far):
    rows = [(i, f"text {i}\nmore words") for i in [*range(3000), *far]] + [(None, f"none {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = multiset.neighboured(docs, "doc_id", "text", 100)
    own = near.where("own").orderBy("bucket", "place").collect()
    assert len(own) == len(rows)
    assert near.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 202
    ids = [r["doc_id"] for r in own]
    assert ids == sorted((i for i in ids if i is not None), reverse=True) + [None] * 50
    assert all(a["next_text"] == b["text"] for a, b in zip(own, own[1:] + own[:1], strict=True))


def test_likeness_by_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = sorted(docs, reverse=True)
    got = {r["doc_id"]: r for r in multiset.edited(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}

    def pairs(text):
        out = {}
        for line in (p.rstrip(" \t\r\f\x0b") for p in text.split("\n")):
            words = line.split(" ") if line else []
            for a, b in zip(words, [*words[1:], None], strict=True):
                out[a, b] = out.get((a, b), 0) + 1
        return out

    errors = []
    for i, (k, t) in enumerate(rows):
        after, m = rows[(i + 1) % len(rows)][1], len(t) // 2
        for other, column in ((t[: len(t) - m] + after[:m], "near_edited"), (after, "near_next")):
            x, y = pairs(t), pairs(other)
            size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            errors.append(got[k][column] - (sum(v * y.get(p, 0) for p, v in x.items()) / size if size else float(x == y)))
    assert np.sqrt(np.mean(np.square(errors))) < 0.14


def test_columns_that_clash_with_names_of_the_filter(spark):
    df = spark.createDataFrame([("http://a.net/x", 1, 2, 3, 4)], "url string, _host int, _path int, _rule int, _p int")
    r = url_filter.judged(df).first()
    assert (r["_host"], r["_path"], r["_rule"], r["_p"], r["rule"]) == (1, 2, 3, 4, "net/")
    assert url_filter.judged(df.limit(0)).count() == 0


def test_url_model_knows_held_out_words(spark):
    urls = url_filter.labelled_urls()
    learn, tell = [u for i, u in enumerate(urls) if i % 5], urls[::5]
    model = url_filter.fit(spark.createDataFrame(learn, "url string, label int"))
    df = spark.createDataFrame(tell, "url string, label int")
    p = url_filter.probability(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), model)
    right = df.select(((p >= 0.5).cast("int") == F.col("label")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right >= 0.85


def test_arc_lines_with_blanks():
    for version, rest in ((1, ""), (2, "200 - - 0 x.arc ")):
        lines = [f"http://a/b c 1.2.3.4 20010203040506 text/html; charset=utf-8 {rest}5\n".encode() + b"he\nlo\n"]
        data = warc.version_block(version, "x.arc", "20010203040506") + b"".join(lines)
        (r,) = warc.parse_arc(io.BytesIO(data))
        assert (r["url"], r["kind"], r["payload"]) == ("http://a/b c", "text/html; charset=utf-8", b"he\nlo")
        with pytest.raises(ValueError, match="fields"):
            list(warc.parse_arc(io.BytesIO(data + b"\nno header\n")))


def test_ids_over_16_bits_are_told():
    with pytest.raises(ValueError, match="16 bits"):
        training_order._narrow(np.array([1, 70_000], np.uint32))

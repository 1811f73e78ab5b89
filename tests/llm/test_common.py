import pytest
from pyspark.sql import functions as F
from sunder.llm import common


def test_flags_all_keys_and_few_others(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 10 != 9, F.col("id")).alias("k"), F.lit(1).alias("_at"), F.lit(2).alias("_BITS"))
    keys = spark.range(0, 40_000, 4).select(F.col("id").alias("x"))
    out = common.flagged(df, "k", keys, "hit")
    assert out.columns == ["k", "_at", "_BITS", "hit"]
    counts = out.groupBy("hit", (F.col("k") % 4 == 0).alias("key"), F.col("k").isNull().alias("none")).count().collect()
    n = {(r["hit"], r["key"], r["none"]): r["count"] for r in counts}
    assert (False, True, False) not in n and (True, None, True) not in n
    assert 0 < n[True, False, False] < 0.06 * n[False, False, False]
    assert common.sifted(df, "k", keys.limit(0)).count() == 0


def test_full_sieve_lets_all_keys_through(spark, monkeypatch):
    monkeypatch.setattr(common, "BITMAPS", 1)
    keys = spark.range(0, 100_000, 2).select(F.col("id").alias("x"))
    assert common.sifted(spark.range(100_000), "id", keys).where("id % 2 = 0").count() == 50_000


def test_scratch_tables_go(spark):
    def there(df):
        path = spark._jvm.org.apache.hadoop.fs.Path(df.sunder_path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    with common.scratch():
        with common.scratch() as kept:
            a, b = (common.written(spark.range(3), n) for n in "ab")
            kept.append(b)
        assert not there(a) and b.count() == 3
    assert not there(b)
    with pytest.raises(ZeroDivisionError), common.scratch():
        c = common.written(spark.range(3), "c")
        1 / 0  # noqa: B018
    assert not there(c)

"""URL filters in DataFrame functions: host and path rules, then logistic regression on hashed character n-grams.

The rules come first: one fits its host and all subdomains, if the url's path starts with the rule's; the longest
that fits decides. Every other url is judged by a logistic regression whose features are the character n-grams of
host and path, hashed into BUCKETS weights. It is fitted on a small labelled table; the n-grams of its rows, at most
MAX_LABELLED, are made by the same expression as those of the urls and sent to the driver, where full gradient steps
on the fixed table take well under a second. Scoring is one projection: no shuffle, no join, no Python.

Defined cases: a null url, or one without `://`, has an empty host and path, no rule fits it, and the model judges
it by its bias, as it does an empty host. Repeated rows get equal verdicts; an empty table gives none; columns of other names stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunder.llm.common import unused

BUCKETS, NGRAMS = 4096, (3, 4, 5)
MAX_LABELLED, MAX_RULES = 2000, 1000
THRESHOLD = 0.5

#: The rules of the query, host with path, and verdict.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

#: Words that hosts and paths of unwanted pages are known by, and words of ordinary ones; the labelled table is made of them.
UNWANTED = "casino poker bets betting jackpot lottery pills pharmacy viagra cheap adult xxx porn sex escort spam farm ads track click popup banner loan payday win prize torrent crack warez".split()
ORDINARY = "news blog school university library museum weather sports health science music travel recipes garden history city council forum wiki docs shop mail support research journal art film books maps jobs".split()


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 for unwanted)."""
    rows = []
    for label, words in ((1, UNWANTED), (0, ORDINARY)):
        for i, w in enumerate(words):
            v = words[(i + 7) % len(words)]
            rows += [(f"https://www.{w}-{v}.example.com/en/{37 * i}", label), (f"http://{w}.example.org/de/{91 * i}.html", label), (f"https://m.{w}{v}.example.net/fr/{53 * i}/", label)]
    #: Hosts of no known word are ordinary.
    syllables = "an ben cor dal er fin gol hin it jor kel lor men nor on per ren sol th ur".split()
    for i, a in enumerate(syllables):
        b, c = syllables[(3 * i + 1) % len(syllables)], syllables[(7 * i + 2) % len(syllables)]
        rows += [(f"https://{('www.', 'blog.', 'm.', '')[i % 4]}{a}{b}{c}.example.{('com', 'net', 'org')[i % 3]}/{('en', 'de', 'fr', 'es')[i % 4]}/{i * 401}", 0)]
    return rows


def _after(url: Column) -> Column:
    """What follows the first `://`, else an empty string."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Equally long rules: the first of the list."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules don't fit an expression")
    out = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + rest))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def buckets_of(host: Column, path: Column, buckets: int = BUCKETS, ngrams: tuple[int, ...] = NGRAMS) -> Column:
    """array<int>: the distinct buckets of the n-grams of host and path, ends marked."""
    line = F.concat(F.lit("^"), host, F.lit("$"), path, F.lit("$"))

    def of(n: int) -> Column:
        starts = F.when(F.char_length(line) >= n, F.sequence(F.lit(1), F.char_length(line) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(line, i, F.lit(n))), F.lit(buckets)).cast("int"))

    return F.array_distinct(F.concat(*map(of, ngrams)))


def fit(labelled: DataFrame, url: str = "url", label: str = "label", buckets: int = BUCKETS, steps: int = 300, rate: float = 4.0, decay: float = 1e-3) -> tuple[list[float], float]:
    """Weights by bucket, and the bias. labelled: at most MAX_LABELLED rows; those with a null label are ignored."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = labelled.where(F.col(label).isNotNull()).select(buckets_of(host, path, buckets).alias("b"), F.col(label).cast("double").alias("y")).limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    data = sorted((sorted(r["b"]), r["y"]) for r in rows)
    weights, bias = [0.0] * buckets, 0.0
    for _ in range(steps if data else 0):
        slope, lean = {}, 0.0
        for b, y in data:
            scale = 1 / math.sqrt(len(b) + 1)
            z = (bias + sum(weights[k] for k in b)) * scale
            miss = (1 / (1 + math.exp(-max(-30, min(30, z)))) - y) * scale / len(data)
            lean += miss
            for k in b:
                slope[k] = slope.get(k, 0.0) + miss
        for k, g in slope.items():
            weights[k] -= rate * (g + decay * weights[k] / len(data))
        bias -= rate * lean
    return weights, bias


def probability(host: Column, path: Column, model: tuple[list[float], float]) -> Column:
    """How likely a url is unwanted."""
    weights, bias = model
    found = buckets_of(host, path, len(weights))
    table = F.array(*(F.lit(float(w)) for w in weights)) if len(weights) <= 64 else F.from_json(F.lit("[" + ",".join(map(repr, map(float, weights))) + "]"), "array<double>")
    total = F.aggregate(found, F.lit(float(bias)), lambda s, k: s + F.element_at(table, k + 1))
    z = total / F.sqrt(F.size(found) + 1)
    return 1 / (1 + F.exp(-z))


def judged(pages: DataFrame, url: str = "url", rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """pages with host, path, rule, verdict and unwanted (the model's probability), in place of columns of those names."""
    spark: SparkSession = pages.sparkSession
    model = fit(labelled if labelled is not None else spark.createDataFrame(labelled_urls(), "url string, label int"))
    host, path, rule, p = (unused(n, pages) for n in ("_host", "_path", "_rule", "_p"))
    out = pages.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))})
    out = out.withColumns({rule: rule_of(F.col(host), F.col(path), rules), p: probability(F.col(host), F.col(path), model)})
    names = {"host": F.col(host), "path": F.col(path), "rule": F.col(f"{rule}.rule"), "verdict": F.coalesce(f"{rule}.verdict", F.when(F.col(p) >= threshold, "block").otherwise("allow")), "unwanted": F.col(p)}
    return out.withColumns(names).drop(host, path, rule, p)

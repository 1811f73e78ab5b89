"""Benchmark decontamination by template canonicalisation, in DataFrame functions.

A text is cut at white space. Each token becomes its lower-cased letters and digits, or a typed placeholder: <num> if it
begins with a digit or is a number word, <unit> for a unit of measure right after a number, <name> for a capitalised word within a
sentence. A second template takes the capitalised first words of sentences as names, too; windows of both are matched with both. So a question whose numbers, names or units were exchanged has the same template. Windows of WINDOW template
tokens, fewer if an item is shorter, are hashed, and documents' windows are joined with the benchmark's. A window counts only if at
least LITERALS of its tokens are no placeholders (half the item, if it is shorter than the window), and are not all the same word.

For each document and item that share a window, the slots are compared: the values that the item has in its placeholders must map one to one onto
the values that the document has there. An item is found in a document if some window agrees in all its values (a copy), or if the windows that agree in
their literals only cover at least COVER of the item's windows and their slots map consistently (a re-parameterised question).
Both are judged over the whole document and over each occurrence, the windows that lie as far apart in the document as in the item: a document
may hold a question twice with other values, or one with words put in between. Either is judged by the matches of the first template alone and by all. The columns are those of
the first of these four ways that passes, of occurrences the best.

Documents become arrays of template tokens, then a row for each place and its windows, one pass without a shuffle; what matches is a small part, and only that is shuffled, each match with
the words of its own window. Up to BROADCAST_WINDOWS hashes of the benchmark are broadcast; of more, hashed bits of a bounded size are, which let few others through.
The benchmark's windows are a written table: the planner broadcasts it only while its files are below its threshold.

Defined cases: a null or empty document has no window and is clean; items without a token match nothing; null ids of
documents and of items are kept as such, rows that share one being one document or item; repeated items are found each; empty tables give
no rows; other columns may have any names.
"""

from __future__ import annotations

from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunder.llm.common import flagged, scratch, sifted, unused, written

WINDOW, LITERALS, COVER = 8, 5, 0.5
#: The most benchmark windows whose hashes are broadcast, 8 bytes each.
BROADCAST_WINDOWS = 1_000_000

#: Units of measure, as written after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb ml l s sec min h hr hrs ms hz khz mhz ghz w kw mw j kj cal kcal pa kpa v a ohm mol percent % usd eur gbp dollars euros pounds cents miles meters metres kilometers kilometres feet inches yards seconds minutes hours days weeks months years degrees grams kilograms liters litres gallons".split()
#: Number words.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()


def tokens(text: Column) -> Column:
    """array<string>: what stands between ASCII white space, without empty ones."""
    line = F.trim(text, F.lit(" \t\n\r\f\x0b"))
    return F.when(line != "", F.split(line, "\\s+")).otherwise(F.array().cast("array<string>"))


def bare(token: Column) -> Column:
    """A token without the marks around it."""
    return F.trim(token, F.lit("""'"“”‘’«»()[]{}<>.,;:!?¿¡*#&$|_-—–…"""))


def capitalised(t: Column) -> Column:
    """Whether a bare token is a capital and small letters."""
    capital = ((t >= "A") & (t < "[")) | ((t >= "À") & (t < "ß") & ~t.startswith("×"))
    return capital & (F.lower(F.substr(t, F.lit(2))) == F.substr(t, F.lit(2)))


def _hash(word: str) -> int:
    """Spark's xxhash64 of a string."""
    x = xxhash.xxh64_intdigest(word.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


NUM, NAME, UNIT = map(_hash, ("<num>", "<name>", "<unit>"))
_TYPED = (NUM, NAME, UNIT)


def _marked(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, bares, strict, loose): one row for each text. bares are its bare tokens, the others its templates, as hashes of template tokens; loose takes the first words of sentences as names, too.

    Words become hashes early, as comparing longs is cheap; each step is a column of its own, so that none is evaluated twice.
    """
    out = docs.select(F.col(ident).alias("id"), tokens(F.col(text)).alias("words"))
    before = F.slice(F.concat(F.array(F.lit("")), F.col("words")), F.lit(1), F.size("words"))  # the token in front of each as it stands
    out = out.select("id", F.transform("words", bare).alias("bares"), before.alias("before"))
    # a token that begins with a digit is a number; strings compare by bytes
    hashes = F.transform("bares", lambda t: F.when((t >= "0") & (t < ":"), F.lit(NUM)).otherwise(F.xxhash64(F.lower(t))))
    out = out.select("id", "bares", "before", F.transform("bares", capitalised).alias("capital"), hashes.alias("hashes"))
    ends = lambda b: reduce(lambda x, y: x | y, (F.endswith(b, F.lit(mark)) for mark in ".!?:|"))
    name = F.zip_with("capital", "before", lambda c, b: c & (b != "") & ~ends(b))  # few tokens are capitalised: for others nothing else is evaluated
    out = out.select("id", "bares", "capital", "hashes", name.alias("name"))
    kinds = F.zip_with("hashes", "name", lambda h, n: F.when(h.isin([_hash(x) for x in NUMBERS]), F.lit(NUM)).when(n, F.lit(NAME)).otherwise(h))
    out = out.select("id", "bares", "capital", kinds.alias("kinds"))
    previous = F.slice(F.concat(F.array(F.lit(0).cast("long")), F.col("kinds")), F.lit(1), F.size("kinds"))
    strict = F.zip_with("kinds", previous, lambda k, p: F.when((p == NUM) & k.isin([_hash(x) for x in UNITS]), F.lit(UNIT)).otherwise(k))
    out = out.select("id", "bares", "capital", strict.alias("strict"))
    return out.select("id", "bares", "strict", F.zip_with("strict", "capital", lambda k, c: F.when(c, F.lit(NAME)).otherwise(k)).alias("loose"))


def _window(name: str, at: Column, size: int) -> Column:
    """A hash of the window of `size` entries of an array from place `at` on, null if it doesn't end within; read by element, so that compiled code makes no array."""
    return F.when(at + size <= F.size(name), F.xxhash64(*(F.get(F.col(name), at + k) for k in range(size))))


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(w, item, at, size, loose, item_values, temps, n): the windows that count, n being the item's count of places of them, item_values its words in the window, temps their template, loose whether the first words of sentences are names there."""
    items = _marked(benchmark, item_id, text).withColumn("size", F.least(F.lit(WINDOW), F.size("bares"))).where("size > 0")
    both = F.explode(F.array(*(F.struct(F.lit(k).alias("loose"), F.col(c).alias("temps")) for k, c in enumerate(("strict", "loose")))))
    items = items.select("id", "size", "bares", both.alias("_")).select("id", "size", "bares", "_.*")
    each = items.select("*", F.posexplode("temps").alias("at", "_"))
    hashes = F.coalesce(*(F.when(F.col("size") == s, _window("temps", F.col("at"), s)) for s in range(1, WINDOW + 1)))
    each = each.select("id", "size", "bares", "temps", "loose", "at", hashes.alias("w")).where("w is not null")
    window = F.slice("temps", F.col("at") + 1, F.col("size"))
    literals = F.filter(window, lambda t: ~t.isin(*_TYPED))
    needed = F.least(F.lit(LITERALS), F.ceil(F.col("size") / 2))
    each = each.where((F.size(literals) >= needed) & ((F.size(F.array_distinct(literals)) >= F.least(F.lit(3), F.col("size")))))
    values = F.slice("bares", F.col("at") + 1, F.col("size"))
    each = each.select("w", F.col("id").alias("item"), "at", "size", "loose", values.alias("item_values"), window.alias("temps"))
    each = each.withColumn("twin", F.min("loose").over(Window.partitionBy("item", "at", "w"))).where("loose = twin").drop("twin")  # where both are the same, one
    return each.join(each.where("loose = 0").groupBy("item").agg(F.count("*").alias("n")).withColumnRenamed("item", "_i"), F.col("item").eqNullSafe(F.col("_i"))).drop("_i")


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, windows, copies, covered, slots, consistent): the items found in each document.

    windows counts the item's windows that the document shares, copies those that agree in every value, covered is their
    part of the item's windows, slots the distinct placeholder values, consistent whether these map one to one.
    """
    with scratch() as kept:
        items = written(benchmark_windows(benchmark, item_id, item_text), "items")
        seen = written(_matches(docs, items, doc_id, text), "matches")  # the documents are read once: what matches is written
        kept.append(seen)
    # a place that agrees without names at the beginnings of sentences is taken so
    seen = seen.groupBy("id", "item", "at", "n", "offset").agg(F.min(F.struct("loose", "slots", "same")).alias("_")).select("id", "item", "at", "n", "offset", "_.*")
    strictly, ways = seen.where("not loose"), []
    for rank, (matches, by) in enumerate(((strictly, []), (strictly, ["offset"]), (seen, []), (seen, ["offset"]))):
        ways.append(_judged(matches, *by).withColumn("rank", F.lit(rank)))
    found = reduce(DataFrame.union, ways)
    found = found.groupBy("id", "item").agg(F.min(F.struct("rank", -F.col("windows"), "slots", "copies", "windows", "covered", "consistent")).alias("_"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "_.windows", "_.copies", "_.covered", "_.slots", "_.consistent")


def _matches(docs: DataFrame, items: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, item, at, n, offset, loose, same, slots): a row for each place of a document at which a window of the benchmark stands."""
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most WINDOW numbers
    # a row for each place, in compiled code: only `bares` and the templates' arrays are made by lambdas, and rows refer to them
    spots = _marked(docs, doc_id, text).select("id", "bares", "strict", "loose", F.posexplode_outer("strict").alias("place", "_"))  # the inner form would add a filter that evaluates the arrays again
    spots = spots.select("id", "bares", "place", *(_window(name, F.col("place"), s).alias(f"{name}{s}") for s in sizes for name in ("strict", "loose")))
    # the windows of each size, each with the first words of sentences as names, too, null where that is the same
    every = [w for s in sizes for w in (F.col(f"strict{s}"), F.when(F.col(f"strict{s}") != F.col(f"loose{s}"), F.col(f"loose{s}")))]
    every = F.array(*every) if sizes else F.array().cast("array<bigint>")
    spots = spots.select("id", "bares", "place", F.posexplode_outer(every).alias("pos", "w"))
    wanted = items.select("w").distinct()
    spots = spots.join(F.broadcast(wanted), "w", "left_semi") if items.count() <= BROADCAST_WINDOWS else sifted(spots, "w", wanted)
    size = F.get(F.lit(sizes).cast("array<int>"), F.expr("pos div 2").cast("int"))
    spots = spots.select("id", "w", (F.col("pos") % 2 == 1).alias("named"), size.alias("_size"), "place", F.slice("bares", F.col("place") + 1, size).alias("values"))
    pairs = spots.join(items, "w").where("_size = size")
    low = lambda a: F.transform(a, F.lower)
    slots = F.filter(F.zip_with("temps", F.zip_with(low(F.col("item_values")), low(F.col("values")), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda t, v: F.when(t.isin(*_TYPED), v)), lambda s: s.isNotNull())
    return pairs.select("id", "item", "at", "n", (F.col("place") - F.col("at")).alias("offset"), (F.col("named") | (F.col("loose") > 0)).alias("loose"), (low(F.col("item_values")) == low(F.col("values"))).alias("same"), slots.alias("slots"))


def _judged(seen: DataFrame, *by: str) -> DataFrame:
    """(id, item, windows, copies, covered, slots, consistent) of the items found by the matches of a document, or of each part of it that has the same `by`."""
    keys = ["id", "item", *by]
    by_window = seen.groupBy(*keys, "at", "n").agg(F.max("same").alias("same"))
    counts = by_window.groupBy(*keys, "n").agg(F.count("*").alias("windows"), F.count_if("same").alias("copies"))
    # a document may hold a window often; each way to fill it counts once, so a hot one is combined before the shuffle
    values = seen.select(*keys, F.explode("slots").alias("s")).select(*keys, "s.x", "s.y").distinct()
    maps = values.groupBy(*keys).agg(F.count("*").alias("slots"), F.count_distinct("x").alias("xs"), F.count_distinct("y").alias("ys"))
    maps = maps.select(*(F.col(k).alias(f"_{k}") for k in keys), "slots", ((F.col("slots") == F.col("xs")) & (F.col("slots") == F.col("ys"))).alias("consistent"))
    out = counts.join(maps, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    out = out.select("id", "item", "windows", "copies", (F.col("windows") / F.col("n")).alias("covered"), F.coalesce("slots", F.lit(0)).cast("long").alias("slots"), F.coalesce("consistent", F.lit(True)).alias("consistent"))
    return out.where((F.col("copies") > 0) | (F.col("consistent") & (F.col("covered") >= COVER)))


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that hold an item; rows without an id stay, as they can't be told apart."""
    name = unused("_found", docs)
    with scratch() as kept:
        kept.append(written(contaminated(docs, benchmark, doc_id, text).select(F.col("doc_id").alias(name)).where(F.col(name).isNotNull()).distinct(), "leaks"))
    return _without(docs, doc_id, kept[0])


def _without(docs: DataFrame, doc_id: str, found: DataFrame) -> DataFrame:
    """Only rows whose id may be among those found are shuffled with their texts."""
    flag, (name,) = unused("_flag", docs), found.columns
    marked = flagged(docs, doc_id, found, flag)
    rest = marked.where(flag).drop(flag).join(found.hint("shuffle_hash"), F.col(doc_id) == F.col(name), "left_anti")
    return marked.where(~F.col(flag)).drop(flag).unionByName(rest)

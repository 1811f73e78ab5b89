import collections
import re

import pytest
from sunder.llm import decontaminate as d

ITEM = "A train leaves Berlin at 9 and travels 120 km to reach the city of Hamburg, how fast does it go on average"


def _found(spark, item, *texts):
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in d.contaminated(docs, bench).collect()}


def test_question_twice_with_other_values(spark):
    one = ITEM.replace("120", "75").replace("Berlin", "Paris").replace("Hamburg", "Lyon")
    two = ITEM.replace("120", "80").replace("Berlin", "Rome").replace("Hamburg", "Milan")
    mixed = ITEM.replace("120", "9").replace("Berlin", "Rome").replace("Hamburg", "Rome")
    got = _found(spark, ITEM, f"{one}. And then: {two}", f"{one} {mixed}", mixed, "how fast does it go on average then")
    assert got.keys() == {0, 1} and got[0]["consistent"] and got[0]["covered"] >= 0.5


def test_names_at_the_beginning_of_sentences(spark):
    item = "Tom has 3 apples. Sue has 4 pears. Tom gives Sue 2 of them. Sue eats 1 pear now. Tom asks how many are left."
    swap = lambda t, **names: " ".join(names.get(w, w) for w in t.split())
    other = swap(item, Tom="Ann", Sue="Joe").replace("3", "7").replace("4", "9")
    clash = swap(item, Tom="Ann", Sue="Ann")
    got = _found(spark, item, other, f"And so {other}", clash, item, item.replace("3", "8"), "The pears are ripe. The apples are not. We left them there.")
    assert got.keys() == {0, 1, 3, 4}


def test_number_words_and_units(spark):
    item = "Natalia sold 48 clips to her friends in April and then she sold half as many clips five miles away"
    other = item.replace("Natalia", "Hannah").replace("48", "twenty").replace("April", "June").replace("five", "12")
    assert _found(spark, item, other, "she sold nothing at all in the town this year").keys() == {0}


def _template(words):
    marks = """'"“”‘’«»()[]{}<>.,;:!?¿¡*#&$|_-—–…"""
    bares = [w.strip(marks) for w in words]
    capital = [("A" <= t < "[" or ("À" <= t < "ß" and t[0] != "×")) and t[1:].lower() == t[1:] for t in bares]
    number = lambda t: "0" <= t < ":" or t.lower() in d.NUMBERS
    strict = []
    for i, t in enumerate(bares):
        before = words[i - 1] if i else ""
        name = capital[i] and before and before[-1] not in ".!?:|"
        strict.append("<num>" if number(t) else "<name>" if name else "<unit>" if t.lower() in d.UNITS and number(before) else t.lower())
    return bares, (strict, ["<name>" if c else t for c, t in zip(capital, strict, strict=True)])


def _brute_force(docs, bench):
    """{(doc, item): (windows, copies)} by comparing templates, not hashes."""
    split = lambda text: [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
    own, place = {}, collections.defaultdict(list)
    for item, text in bench:
        bares, both = _template(split(text))
        size = min(8, len(bares))
        for loose, temps in enumerate(both if size else ()):
            for at in range(len(bares) - size + 1):
                window = tuple(temps[at : at + size])
                literals = [t for t in window if t not in ("<num>", "<name>", "<unit>")]
                if len(literals) >= min(5, -(-size // 2)) and len(set(literals)) >= min(3, size) and not (loose and window == tuple(both[0][at : at + size])):
                    own[item] = own.get(item, 0) + (not loose)
                    place[window].append((item, at, loose, [b.lower() for b in bares[at : at + size]]))
    sizes, out = {len(w) for w in place}, {}
    for doc, text in docs:
        bares, both = _template(split(text))
        matches = collections.defaultdict(list)
        for named, temps in enumerate(both):
            for size in sizes:
                for p in range(len(bares) - size + 1):
                    window = tuple(temps[p : p + size])
                    if named and window == tuple(both[0][p : p + size]):
                        continue
                    values = [b.lower() for b in bares[p : p + size]]
                    for item, at, loose, mine in place.get(window, ()):
                        slots = [(x, y) for t, x, y in zip(window, mine, values, strict=True) if t in ("<num>", "<name>", "<unit>")]
                        matches[item, at, p - at].append((bool(named or loose), slots, mine == values))
        seen = collections.defaultdict(list)
        for (item, at, offset), found in matches.items():
            seen[item].append((at, offset, *min(found)))
        for item, rows in seen.items():
            n = own[item]
            for rank in range(4):
                groups = collections.defaultdict(list)
                for at, offset, loose, slots, same in rows:
                    if rank >= 2 or not loose:
                        groups[offset if rank % 2 else 0].append((at, slots, same))
                passed = []
                for group in groups.values():
                    windows, copies = len({at for at, _, _ in group}), len({at for at, _, same in group if same})
                    pairs = {p for _, slots, _ in group for p in slots}
                    one_to_one = len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})
                    if copies or (one_to_one and windows / n >= d.COVER):
                        passed.append((-windows, len(pairs), copies))
                if passed:
                    windows, _, copies = min(passed)
                    out[doc, item] = -windows, copies
                    break
    return out


@pytest.mark.parametrize("most", [d.BROADCAST_WINDOWS, 0])
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", most)
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]): (r["windows"], r["copies"]) for r in d.contaminated(docs, bench).collect()}
    want = _brute_force(docs.select("doc_id", "text").collect(), bench.select("item_id", "text").collect())
    assert want and got == want


def test_odd_rows_and_clashing_names(spark):
    bench = spark.createDataFrame([(1, ITEM), (None, ITEM), (None, "")], "item_id long, text string")
    rows = [(1, ITEM), (None, ITEM), (2, None), (3, ""), (3, ""), (4, "word " * 50_000 + ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _found", "2 AS _flag", "3 AS hashes", "4 AS id")
    assert {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, bench).collect()} == {(a, b) for a in (1, None, 4) for b in (1, None)}
    kept = d.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 2, 3, 3]
    assert d.decontaminated(docs.limit(0), bench).count() == 0 and d.decontaminated(docs, bench.limit(0)).count() == len(rows)

"""Toxicity with noisy-channel deobfuscation.

Hidden words are restored first. What was written is taken as what a noisy channel made of what was meant: letters
exchanged for look-alikes, set apart by blanks or marks, or repeated. Compatibility forms (full-width letters and such) are folded by NFKC, and invisible
characters and combining marks left out, before. Look-alikes of other scripts are read as themselves and as Latin letters, where no other letter tells that the word is of that script. Each suspicious stretch becomes a lattice of the characters
it may stand for, and Viterbi decoding finds the reading that is likeliest under a character trigram model, exactly,
as a state is the last two characters. The trigrams are counted over all documents: each task sums a table of 32^3
cells, so what is gathered grows with the input and what reaches the driver doesn't. Words of letters only have one reading and pass as they are.

The restored text is then scored. Features are its distinct words, with letters said twice written once, and that one, two, three or four of them share a
beginning of 4 to 7 letters. A feature's toxic share among the labelled texts must reach LEAST_SHARE, and by the Chernoff bound be no accident among all
features tried. A text is toxic unless all its telling words are innocent: 1 - prod(1 - share) over its distinct
words, the best feature of each. Without one the score is the toxic share of such texts.

Fitting takes at most FIT_ROWS labelled texts, those of the smallest hashed ids; of those whose five-word
shingles have the same first band of minima, as most near copies do and unlike texts don't, one of each label counts.

Defined cases: a null, empty or wordless text is scored as one without telling words; without labelled texts the score is 0;
stretches of over LONGEST characters are decoded as others, but not remembered; numbers are read as words, too; repeated rows get equal scores.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunder.llm import resemblance
from sunder.llm.common import held_out, small_batches, written

FIT_ROWS, THRESHOLD, LONGEST = 10_000, 0.5, 40
#: A feature that tells less is left to chance: several weak ones together would condemn clean texts.
LEAST_SHARE = 0.9
PREFIXES, SHARED = (4, 5, 6, 7), (1, 2, 3, 4)

#: The letters that a character may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "h", "€": "e", "£": "l", "¡": "i",
}
#: Cyrillic, Greek and Armenian letters and the Latin ones they look like.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "ѵ": "v", "ѡ": "w", "х": "x", "у": "y", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "օ": "o", "ո": "n", "ս": "u"}
_FOREIGN = re.compile(f"[{''.join(HOMOGLYPHS)}]")
#: Soft hyphen, combining marks, invisible characters, letter-like symbols, circled, full-width and mathematical letters.
_ODD = re.compile("[\u00ad\u0300-\u036f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u2100-\u214f\u24b6-\u24e9\ufe00-\ufe0f\ufeff\uff01-\uff5e\U0001d400-\U0001d7ff]")
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¿¡«»“”‘’…–—€£"
_SEPARATORS = " .-_*~'/,"
_PARTS = re.compile(r"[^\W\d_]+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_TWICE = re.compile(r"([^\W\d_])\1+")
_PIECES = re.compile(rf"(?:[^\W_]|[{re.escape(''.join(c for c in LOOKS_LIKE if not c.isdigit()))}])+")
#: Two characters that may be letters.
_LETTERS = re.compile(rf"(?:[^\W\d_]|[{re.escape(''.join(LOOKS_LIKE))}]).*?(?:[^\W\d_]|[{re.escape(''.join(LOOKS_LIKE))}])")
_SPACED = re.compile(r"(?<!\w)(?:[^\W_]|[@$!|+])(?:[ .\-_*~'/,]{1,2}(?:[^\W_]|[@$!|+])){2,}(?!\w)")

_BASE = {"à": "a", "á": "a", "â": "a", "ã": "a", "ä": "a", "å": "a", "ç": "c", "è": "e", "é": "e", "ê": "e", "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i", "ñ": "n", "ò": "o", "ó": "o", "ô": "o", "õ": "o", "ö": "o", "ù": "u", "ú": "u", "û": "u", "ü": "u", "ý": "y", "ÿ": "y"}
#: Symbols: 0 between words, 1 to 26 a to z, 27 any other letter.
_SYMBOL = bytes(ord(c) - 96 if "a" <= (c := _BASE.get(chr(i), chr(i))) <= "z" else 27 if chr(i).isalpha() else 0 for i in range(256))


_GAP = np.array([chr(i).isspace() or chr(i) in _SEPARATORS for i in range(256)])


def folded(text: str) -> str:
    """Lower-cased, compatibility forms folded, without invisible characters and marks that combine with no letter of their own."""
    if not text.isascii() and _ODD.search(text):
        text = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) not in ("Cf", "Mn"))
    return text.lower()


def _disguised(word: str) -> bool:
    """Whether a word has look-alikes of other scripts and no other letter of them."""
    return bool(_FOREIGN.search(word)) and all(c in HOMOGLYPHS or c < "\u0250" for c in word)


def symbols(text: str) -> np.ndarray:
    """A word boundary, the text's symbols, two boundaries."""
    return np.frombuffer(b"\0\0" + text.lower().encode("latin-1", "replace").translate(_SYMBOL) + b"\0\0", np.uint8).astype(np.int32)


def trigrams(texts: Iterator[str | None]) -> np.ndarray:
    """Counts of symbol trigrams, in a table of 32^3."""
    out = np.zeros(32**3, np.int64)
    for text in texts:
        if text:
            s = symbols(text)
            out += np.bincount(s[:-2] << 10 | s[1:-1] << 5 | s[2:], minlength=32**3)
    return out


def corpus_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Over all texts; each task emits the cells that it has counts in."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(32**3, np.int64)
        for batch in batches:
            total += trigrams(t.as_py() for t in batch.column(0))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int32()), "n": pa.array(total[cells], pa.int64())})

    cells = docs.select(F.col(text).alias("t")).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(32**3, np.int64)
    out[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), interpolated with bigrams and letters: a table of 32^3 of which 28 symbols are used."""
    c = counts.reshape(32, 32, 32).astype(float)
    one = c.sum((0, 1)) + 1.0
    one[28:] = 0
    one /= one.sum()
    two = c.sum(0)
    two = (two + 20 * one) / (two.sum(1, keepdims=True) + 20)
    three = (c + 5 * two[None]) / (c.sum(2, keepdims=True) + 5)
    return np.log(np.maximum(three, 1e-9)).astype(np.float32).reshape(-1)


def _suspicions(text: str) -> tuple[bool, bool]:
    """Whether a letter stands three times in a row, and whether three characters stand alone near each other; sees all such places."""
    data = text.encode("latin-1", "replace")
    raw, gap = np.frombuffer(data, np.uint8), np.frombuffer(b" " + data + b" ", np.uint8)
    same = raw[1:] == raw[:-1]
    letter = (raw >= 97) & (raw <= 122) | (raw >= 192) | (raw == 63)  # 63: outside Latin-1
    tripled = bool((same[1:] & same[:-1] & letter[2:]).any())
    gap = _GAP[gap]
    alone = np.concatenate([~gap[1:-1] & gap[:-2] & gap[2:], np.zeros(6, bool)])
    two = alone[:-3] & (alone[2:-1] | alone[3:])
    return tripled, bool((alone[: len(two) - 3] & (two[2:-1] | two[3:])).any())


class Channel:
    """Decodes stretches under a language model."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self._cached = functools.lru_cache(maxsize=100_000)(self._decode)

    def decode(self, stretch: str) -> str:
        return self._cached(stretch) if len(stretch) <= LONGEST else self._decode(stretch)

    @staticmethod
    def lattice(stretch: str) -> list[list[tuple[str, float]]]:
        """For each character what it may stand for, with the channel's cost. "" is left out; " " parts words."""
        out, before = [], ""
        for i, c in enumerate(stretch):
            if c.isalpha():
                twice = c == before
                ways = [(c, 0.7), ("", 0.7)] if twice else [(c, 0.0)]
                out.append(ways + [(HOMOGLYPHS[c], 0.7 if twice else 0.5)] if c in HOMOGLYPHS else ways)
            elif c in LOOKS_LIKE:
                ways = [(x, 0.5 + math.log(len(LOOKS_LIKE[c]))) for x in LOOKS_LIKE[c]]
                if c == before:
                    ways.append(("", 0.7))
                if not c.isdigit():
                    ways += [(" ", 3.0), ("", 3.0)]
                elif i in (0, len(stretch) - 1) or stretch[i - 1].isdigit() or stretch[i + 1].isdigit():
                    ways.append((" ", 4.0))
                out.append(ways)
            elif c in _SEPARATORS:
                out.append([("", 0.7), (" ", 2.0)])
            else:
                out.append([(" ", 0.0)])
            before = c
        return out

    def _decode(self, stretch: str) -> str:
        """The likeliest reading. Equal ones: the first in the lattice's order."""
        states = {(0, 0): (0.0, None)}  # a path is its last symbol and the path before, so a long stretch costs its length
        for ways in [*self.lattice(stretch), [(" ", 0.0)]]:
            fresh: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                for x, price in ways:
                    if x == "" or (x == " " and b == 0):
                        key, total, to = (a, b), cost + price, path
                    else:
                        s = 0 if x == " " else _SYMBOL[o] if (o := ord(x)) < 256 else 27
                        key, total, to = (b, s), cost + price - self.model[a << 10 | b << 5 | s], (path, x)
                    if key not in fresh or total < fresh[key][0]:
                        fresh[key] = total, to
            states = fresh
        path, out = min(states.values(), key=lambda s: s[0])[1], []
        while path:
            path, x = path
            out.append(x)
        return "".join(reversed(out)).strip()

    def words(self, text: str | None) -> set[str]:
        """The distinct words of the restored text, letters said twice written once."""
        if not text:
            return set()
        text = folded(text)
        found: set[str] = set()
        tripled, spaced = _suspicions(text)
        foreign = not text.isascii() and _FOREIGN.search(text)
        for token in set(text.split()):
            word, token = token.strip(_MARKS), token.strip(_OPENING)
            if word.isalpha():
                found.add(self.decode(word) if tripled and _TRIPLE.search(word) else word)
                if foreign and _disguised(word):
                    found.update(self.decode(word).split())
                if word != token:  # a look-alike at an end: read with it, too
                    found.update(self.decode(token).split())
                continue
            found.update(_PARTS.findall(token))
            pieces = [token, *_PIECES.findall(token)]  # as a whole and, where marks part it, piece by piece
            for stretch in {p for piece in pieces for p in (piece, piece.strip(_MARKS))}:  # with the look-alikes at its ends and without
                if not stretch.isalpha() and _LETTERS.search(stretch):
                    found.update(self.decode(stretch).split())
        if spaced:
            for stretch in _SPACED.findall(text):
                found.update(self.decode(stretch).split())
        return {_TWICE.sub(r"\1", w) for w in found}


_OPENING = "".join(c for c in _MARKS if c not in LOOKS_LIKE)


def features(words: set[str], only: dict | None = None) -> dict[str, list[str]]:
    """Each word's features in a text of these words: itself, and that so many of them begin alike."""
    words = {w for w in words if len(w) > 1}
    alike = Counter(w[:n] for w in words for n in PREFIXES if len(w) > n and (only is None or w[:n] in only))
    return {w: [w, *(f"{k}^{w[:n]}" for n in PREFIXES if len(w) > n for k in SHARED if k <= alike[w[:n]])] for w in words}


class Model:
    """The language model, each telling feature's toxic share, and the score of a text without one."""

    def __init__(self, language: np.ndarray, shares: dict[str, float], base: float):
        self.language, self.shares, self.base = language, shares, base
        self.beginnings = dict.fromkeys(f.partition("^")[2] for f in shares)
        self.stems = {b[: PREFIXES[0]] for b in self.beginnings if b}
        self._channel = None

    def __getstate__(self):
        return self.language, self.shares, self.base

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def channel(self) -> Channel:
        if self._channel is None:
            self._channel = Channel(self.language)
        return self._channel

    def score(self, text: str | None) -> float:
        shares, stems, stem, innocent = self.shares, self.stems, PREFIXES[0], 1.0
        get = shares.get
        telling = {w for w in self.channel.words(text) if w[:stem] in stems or w in shares}  # no other word has a feature with a share
        for _, own in sorted(features(telling, self.beginnings).items()):
            if (share := max(get(f, 0.0) for f in own)) > 0:
                innocent *= 1 - share
        return 1 - innocent * (1 - self.base)


def _signature(text: str | None) -> int:
    return xxhash.xxh64_intdigest(resemblance.minima(resemblance.shingle_hashes(text))[: resemblance.ROWS].tobytes()) >> 1


def _counted(rows: DataFrame, channel: Channel, only: set[str] | None) -> Counter:
    """How many of the rows have each feature, of those in `only`. rows are at most FIT_ROWS."""
    language = np.array(channel.model, np.float32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = Channel(language), Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update({f for fs in features(own.words(text.as_py())).values() for f in fs if only is None or f in only})
        yield pa.RecordBatch.from_pydict({"f": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

    got = rows.select("_text").mapInArrow(count, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    if only is None:
        got = got.where(F.col("n") >= 3)
    return Counter({r["f"]: r["n"] for r in got.collect()})


def telling(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> dict[str, float]:
    """The shares of the features whose toxic share is over half and no accident."""
    prior = n_toxic / (n_toxic + n_clean)
    out = {}
    for f, a in toxic.items():
        n = a + clean[f]
        share = a / n
        if share < max(LEAST_SHARE, prior):
            continue
        above = share * math.log(share / prior) + ((1 - share) * math.log((1 - share) / (1 - prior)) if share < 1 else 0)
        if n * above >= math.log(len(toxic)) + 2:
            out[f] = (a + 0.5) / (n + 1)
    return out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    small_batches(docs.sparkSession)
    language = language_model(counts := corpus_trigrams(docs, text))
    known = labels.where(~held_out(F.col(doc_id)) & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)

    @F.arrow_udf("long")
    def signature(texts: pa.Array) -> pa.Array:
        return pa.array([_signature(t.as_py()) for t in texts], pa.int64())

    some = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")  # `rows` ids at most
    some = written(some.select("y", "_text", signature(F.col("_text")).alias("sig")).groupBy("sig", "y").agg(F.min("_text").alias("_text")).repartition(16, "sig"), "labelled")
    n = dict(some.groupBy("y").count().collect())
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(language, {}, float(n_toxic > 0))
    channel = Channel(language)
    toxic = _counted(some.where("y = 1"), channel, None)
    clean = _counted(some.where("y = 0"), channel, set(toxic))
    shares = telling(toxic, clean, n_toxic, n_clean)
    # the words looked for are part of the language: a hundredth of its trigrams
    own = trigrams(f.rpartition("^")[2] for f in shares)
    if own.sum():
        language = language_model(counts + own * (counts.sum() / 100 / own.sum()))
    return Model(language, shares, _base(some, Model(language, shares, 0.0)))


def _base(some: DataFrame, model: Model) -> float:
    """The toxic share of the labelled texts without a telling word, below one half."""
    rest = dict(some.where(score(F.col("_text"), model) <= 0).groupBy("y").count().collect())
    return min(0.45, (rest.get(1, 0) + 0.5) / (sum(rest.values()) + 1))


def score(text: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def toxicity_score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return toxicity_score(text)


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    model = fit(docs, labels, doc_id, text, label, **how)
    out = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), score(F.col(text), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

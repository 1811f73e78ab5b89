import pyarrow.parquet as pq
import pytest
from sunder.llm import toxicity


@pytest.fixture(scope="module")
def channel():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    return toxicity.Channel(toxicity.language_model(toxicity.trigrams(texts) + 2000 * toxicity.trigrams(["idiot worthless stupid loser asshole clown"])))


def _missed(channel, cases):
    return [(text, channel.words(text)) for text, word in cases if word not in channel.words(text)]


def test_look_alikes_at_the_ends_of_words(channel):
    cases = [("you $tupid one", "stupid"), ("an @sshole", "ashole"), ("(lown", "clown"), ("an idio+", "idiot"), ("1dio+.", "idiot"), ('"$tup1d"', "stupid")]
    assert not _missed(channel, cases)
    assert not _missed(channel, [("stupid!", "stupid"), ("(idiot)", "idiot"), ("*loser*", "loser"), ("+1diot+", "idiot")])


def test_words_without_letters_and_in_long_runs(channel):
    run = ",".join(["plain"] * 12)
    cases = [("an 1d!07 here", "idiot"), ("10$3r", "loser"), ("you 4$$h0!3", "ashole"), (f"{run},1d10t,{run}", "idiot"), ("/".join(["word"] * 20 + ["l0ser"]), "loser"), ("aaa;$tupid;bbb", "stupid")]
    assert not _missed(channel, cases)
    assert "idiot" in channel.words("x1" * 50_000 + "/1d10t")


@pytest.mark.parametrize("gap", [" ", "  "])
def test_long_spelt_out_texts(channel, gap):
    words = [[*("loser asshole clown " * 4)[k:].split(), "idiot", "worthless", "stupid"] for k in range(40)]
    assert not _missed(channel, [(gap.join(map(" ".join, own)), "worthles") for own in words])


def test_only_near_copies_are_merged():
    texts = [" ".join(["shared", *(f"w{i}x{j}" for j in range(300))]) for i in range(40)]
    least = min({w for t in texts for w in t.split()}, key=lambda w: toxicity.xxhash.xxh64_intdigest(w))
    own = [toxicity._signature(f"{t} {least}") for t in texts]
    assert len(set(own)) == len(texts)
    near = [toxicity._signature(f"{t} {least} end") for t in texts]
    assert sum(a == b for a, b in zip(own, near, strict=True)) >= 0.8 * len(texts)


def test_other_scripts_and_invisible_characters(channel):
    cases = [("an іdiоt", "idiot"), ("lоsеr", "loser"), ("st​up­id one", "stupid"), ("ｓｔｕｐｉｄ", "stupid"), ("i̶d̶i̶o̶t̶", "idiot"), ("𝐥𝐨𝐬𝐞𝐫", "loser"), ("lοs3r", "loser"), ("s​ t u​ p i d", "stupid")]
    assert not _missed(channel, cases)
    assert "привет" in channel.words("привет мир")  # a Cyrillic word stays


def test_words_of_over_forty_characters(channel):
    assert not _missed(channel, [("x" * 41 + " 1d1ot", "idiot"), ("an_1d1ot_" + "and_" * 20, "idiot"), ("_".join(["plain"] * 30 + ["l0ser"]), "loser")])

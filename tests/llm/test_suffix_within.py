import random

import pytest

from creditloom.llm import suffix


def by_hand(rows, least):
    """The first place keeps a window and what overlaps it in that document; every other place is removed."""
    windows, out = {}, set()
    for doc, text in rows:
        words = (text or "").split()
        for i in range(len(words) - least + 1):
            windows.setdefault(tuple(words[i : i + least]), []).append((doc, i))
    kinds = {}
    for places in windows.values():
        holder = min(places)
        later = {(d, i) for d, i in places if d > holder[0] or i >= holder[1] + least}
        for d, i in places if later else ():
            kinds.setdefault((d, (d, i) in later), []).append(i)
    for (doc, removed), places in kinds.items():
        out |= {(doc, at, n, removed) for at, n in suffix._spans(suffix.np.array(sorted(places)), least)}
    return out


@pytest.mark.parametrize("seed", range(2))
def test_crossing_repeats_within_and_between(spark, seed):
    rng = random.Random(seed)
    phrases = [[rng.choice("abc") for _ in range(rng.randint(3, 14))] for _ in range(8)]
    rows = [(doc, " ".join(w for _ in range(rng.randint(0, 8)) for w in rng.choice(phrases))) for doc in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in suffix.repeats(docs, least=9, seed=4, within=True).collect()} == by_hand(rows, 9)


def test_passage_twice_in_one_document(spark):
    passage = " ".join(f"s{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"a {passage} b {passage} c"), (2, "clean text")], "doc_id long, text string")
    assert {tuple(r) for r in suffix.repeats(docs, within=True).collect()} == {(1, 1, 60, False), (1, 62, 60, True)}
    got = {r.doc_id: r.text for r in suffix.deduplicated(docs, within=True).collect()}
    assert got == {1: f"a {passage} b c", 2: "clean text"}

import random
import re
from collections import Counter

import pytest

from creditloom.llm import phrases
from creditloom.llm.queries import SQL, op11_phrase_collocations


def by_hand(rows, support, longest, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        cands = {p: a for p, a in own.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in cands.items():
            if any(100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items() if len(q) > len(p)):
                continue
            score, k = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, le, ri) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, le, ri, n[lang], -score))
    return sorted(out)


def found(docs, **more):
    return sorted(tuple(r) for r in phrases.collocations(docs, **more).collect())


def test_whole_table(spark):
    from compare import difference, engine

    folder = "/root/testdata/sf0.01"
    query = op11_phrase_collocations(spark, folder)
    assert query.count() > 200
    assert difference(engine(folder), query, SQL["op11_phrase_collocations"]) is None


@pytest.mark.parametrize("seed", range(3))
def test_many_blocks_and_shards(spark, seed):
    """Few distinct words; small blocks, so that all ten shards and many ranges take part."""
    rng = random.Random(seed)
    glue = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "; ", "\x0b", "!?"]
    rows = []
    for _ in range(150):
        words = [rng.choice(["a", "b", "C", "dé", "É", "x\x00y", "new york city", "of the"]) + rng.choice(glue) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "en", "de", None]), "".join(words)))
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = by_hand(rows, 12, 4, 40)
    assert len(want) > 40
    assert found(docs, support=12, top=40, block=500, entries=200) == want
    assert found(docs, support=12, top=40) == want


def test_odd_documents(spark, odd_documents, no_documents):
    rows = [(r.lang, r.text) for r in odd_documents.select("lang", "text").collect()]
    want = by_hand(rows, 3, 4, 2000)
    assert want and found(odd_documents, support=3) == want
    assert found(no_documents) == []


def test_long_texts_are_cut_between_pieces_only():
    data = phrases.folded(b"One two. three, four\n\nfive six\tseven " * 50)
    cut = list(phrases.parts(data, 40))
    assert b"\n".join(cut) == data and max(map(len, cut)) <= 40
    assert list(phrases.parts(b"a " * 100, 40)) == [b"a " * 100]
    assert list(phrases.parts(b"", 40)) == []

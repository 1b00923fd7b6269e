"""Spaced-seed decontamination against comparing every alignment."""

import random
import re
from itertools import combinations

import pytest

from ledgerlens.llm import decontaminate as d
from ledgerlens.llm.tokens import PIECE, pieces, word_hashes


def words_of(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())


def brute(doc, item):
    a, b = words_of(doc), words_of(item)
    if not b:
        return None
    w, least = d.needed(len(b))
    best = None
    for off in range(1 - len(b), len(a)):
        places = [k for k in range(len(b)) if 0 <= off + k < len(a)]
        same = {k: a[off + k] == b[k] for k in places}
        good = [k for k in places if k + w - 1 in same and sum(same[j] for j in range(k, k + w)) >= least]
        if good:
            n = sum(same[j] for j in range(good[0], good[-1] + w))
            best = max(best or (-1,), (n, -(off + good[0]), off + good[-1] + w - 1, good[0]))
    return best


@pytest.mark.parametrize("n", range(1, d.WINDOW + 1))
def test_masks_find_every_window(n):
    """Whatever words of a window are substituted, as long as it qualifies, some mask lies on unchanged words."""
    w, least = d.needed(n)
    for changed in combinations(range(w), w - least):
        ok = [i not in changed for i in range(w)]
        masks = d.masks_for(n)
        assert any(all(ok[s + k] for k, c in enumerate(m) if c == "1") for m in masks for s in range(w - len(m) + 1)), (n, changed)


def test_word_hashes_in_pieces():
    text = ("Größe a1 " * 400_000).encode()
    assert len(text) > 2 * PIECE and b"".join(pieces(text)) == text
    hashes, begins = word_hashes([b"A1 gr\xc3\xb6\xc3\x9fe", text, b""])
    assert begins.tolist() == [0, 2, 800_002, 800_002]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[2] and len(set(hashes.tolist())) == 2


def test_overlaps(spark, nothing, odd):
    rng = random.Random(3)
    vocabulary = ["the", "of", "and", "über", *(f"w{i}" for i in range(60))]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([40, 25, 16, 13, 9, 5, 4, 3, 1, 0])] + [(20, None), (None, " ".join(say(20)))]
    docs = [(100, None), (101, ""), (102, " ".join(say(3000)))]
    for i, (_, text) in enumerate(items):
        for share in (0, 0.1, 0.2, 0.3):
            own = [("x" if rng.random() < share else w) for w in (text or "").split()]
            cut = own[rng.randrange(0, 3) :]
            docs.append((200 + 10 * i + int(share * 10), " ".join(say(rng.randrange(30)) + cut + say(rng.randrange(30))).upper()))
    docs += [(None, items[0][1]), (400, items[0][1]), (400, items[0][1])]
    got = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = []
    for i, text in docs:
        for k, item in items:
            if hit := brute(text, item):
                want.append((i, k, hit[0], len(words_of(item)), -hit[1], hit[2], hit[3]))
    order = lambda rows: sorted(rows, key=str)
    assert order(map(tuple, got.collect())) == order(want)
    blocks = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=200)
    assert order(map(tuple, blocks.collect())) == order(want)
    table = spark.createDataFrame(items, "item_id long, text string")
    clean = d.decontaminate(spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id long, text string, h long, bad string"), table)
    bad = {i for i, *_ in want}
    assert clean.columns == ["doc_id", "text", "h", "bad"]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in docs if i not in bad)
    assert d.contaminated(nothing, table).collect() == [] and d.decontaminate(nothing, table).collect() == []
    assert d.contaminated(odd, table.limit(0)).collect() == []

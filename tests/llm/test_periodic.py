"""Decontamination of texts and items of repeated words: bounded work, and what comparing every alignment finds."""

import random
import time

from ledgerlens.llm import decontaminate as d
from ledgerlens.llm.tokens import word_hashes

from .test_decontaminate import brute


def test_repeated_words_meet_once():
    words, begins = word_hashes([b"the " * 20_000])
    index = d.build_index([(1, "the " * 1_000)])
    began = time.process_time()
    assert d.best_overlaps(index, words, begins) == {(0, 0): (1000, 0, 999, 0)}
    assert time.process_time() - began < 10


def test_few_words_as_by_brute_force(monkeypatch):
    rng = random.Random(1)
    for k in range(150):
        monkeypatch.setattr(d, "PAIRS", 1 << rng.randrange(4, 20))
        words = ["a", "b"] if k % 3 else ["x"]
        items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(3)]
        texts = [" ".join(rng.choice(words + ["z"] * (k % 4)) for _ in range(rng.randrange(0, 60))) for _ in range(4)]
        hashes, begins = word_hashes([t.encode() for t in texts])
        want = {(x, i): hit for x, t in enumerate(texts) for i, (_, item) in enumerate(items) if (hit := brute(t, item))}
        assert d.best_overlaps(d.build_index(items), hashes, begins) == want

"""Values that words spell exactly are found for a whole batch of pages, without a Page of their own."""

import random
from difflib import SequenceMatcher

import pyarrow as pa

from ledgerlens.functions.similarity import ratio
from ledgerlens.operators import confidence


def run(pages, alike=True):
    fields = pa.array([[{"field": f, "value": v} for f, v in fs] for fs, _ in pages], pa.list_(pa.struct([("field", pa.string()), ("value", pa.string())])))
    words = pa.array([None if ws is None else [{"text": t, "confidence": c} for t, c in ws] for _, ws in pages], pa.list_(pa.struct([("text", pa.string()), ("confidence", pa.float64())])))
    return confidence._found(alike).func(fields, words).to_pylist()


def test_exact_values_need_no_page(spark, monkeypatch):
    monkeypatch.delattr(confidence, "Page")
    pages = [([("VAT", "1-2"), ("VAT", "3 4 5 6"), ("VAT", ""), ("VAT", None)], [("no", 9.0), ("12", 40.0), ("é", 1.0), ("3", 10.0), ("x", -1.0), ("45", 20.0), ("6", None)]), ([], None), ([("VAT", "12")], None)]
    found = [[(x["mean"], x["one_word"]) for x in row] for row in run(pages)]
    assert found == [[(40.0, True), (130 / 3, False), (None, False), (None, False)], [], [(None, False)]]


def test_small_chunks_find_the_same(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("AB1-") for _ in range(rng.randrange(n)))
    pages = [([("VAT", text(12)) for _ in range(rng.randrange(5))], [(text(6), float(rng.randrange(-1, 100))) for _ in range(rng.randrange(30))]) for _ in range(200)]
    want = run(pages)
    for (fields, words), row in zip(pages, want, strict=True):
        ready = [(confidence.token(t), c) for t, c in words if confidence.token(t) and c >= 0]
        for (field, value), x in zip(fields, row, strict=True):
            spots = confidence.matched(value, [t for t, _ in ready], confidence._labels(field, [t for t, _ in ready]))
            assert x["mean"] == confidence._mean(spots, [c for _, c in ready])
    monkeypatch.setattr(confidence, "PAIRS", 64)
    assert run(pages) == want


def test_ratio_of_a_text_within_the_other():
    for a, b in [("AB", "XABY"), ("XABY", "AB"), ("", "A"), ("AAB", "AA"), ("A" * 50, "A" * 300), ("A" * 300, "A" * 199)]:
        assert ratio(a, b) == SequenceMatcher(None, a, b).ratio()

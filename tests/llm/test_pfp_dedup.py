"""Suffix-array dedup against marking every 50-byte string by brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import pfp_dedup as p


def brute(rows):
    """rows (doc_id, text) -> for each (doc_id, n_bytes, n_removed, n_spans, sha256)."""
    key = lambda i: (i is None, i or 0)
    least: dict[bytes, tuple] = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, t in raw:
        for a in range(len(t) - p.LENGTH + 1):
            w = t[a : a + p.LENGTH]
            least[w] = min(least.get(w, key(i)), key(i))
    out = []
    for i, t in raw:
        gone = bytearray(len(t))
        for a in range(len(t) - p.LENGTH + 1):
            if least[t[a : a + p.LENGTH]] < key(i):
                gone[a : a + p.LENGTH] = b"\1" * p.LENGTH
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed, n=70):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "anerth", "über", "x", "reti", "on"])
    say = lambda k: " ".join(word() for _ in range(k))
    shared = [say(rng.randrange(8, 60)) for _ in range(6)] + ["a" * 130, "ab" * 60, say(9)[:49], say(30)[:50], say(30)[:51]]
    out = []
    for i in range(n):
        parts = [rng.choice([lambda: say(rng.randrange(40)), lambda: rng.choice(shared)])() for _ in range(rng.randrange(5))]
        out.append((rng.randrange(-5, n), " ".join(parts)))
    long_one = say(700)
    out += [(i, long_one) for i in range(200, 215)] + [(220 + i, long_one[:1000] + str(i) + long_one[1000:]) for i in range(15)]
    out += [(None, long_one), (None, shared[0]), (300, None), (301, ""), (302, "y" * 49), (303, "y" * 50), (304, "y" * 400)]
    rng.shuffle(out)
    return out


def test_blocks_are_sparks(spark):
    ids = [0, 1, -1, 5, p.NONE, -(1 << 63), 123456789012]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select(F.pmod(F.xxhash64("i"), F.lit(97)).alias("b")).collect()
    assert [r.b for r in got] == p.blocks_of(np.array(ids), 97).tolist()


@pytest.mark.parametrize("chunk", [64, 1000, 1 << 20])
def test_each_string_is_in_one_phrase(chunk):
    some = [(t or "").encode() for _, t in texts(1)]
    parse = p.Parse(some, chunk=chunk)
    seen = sorted((o, a + k) for o, a, n in zip(parse.owner, parse.at, parse.n, strict=True) for k in range(n))
    assert seen == [(i, a) for i, t in enumerate(some) for a in range(len(t) - p.LENGTH + 1)]
    assert parse.n.max() <= p.LENGTH - p.K + 1
    triggers: dict = {}
    for o, a, n, t, h in zip(parse.owner, parse.at, parse.n, parse.trigger, parse.hash, strict=True):
        for k in range(n):
            assert triggers.setdefault(some[o][a + k : a + k + p.LENGTH], t) == t
        assert triggers.setdefault((int(h), "bytes"), some[o][a : a + n + p.LENGTH - 1]) == some[o][a : a + n + p.LENGTH - 1]


def test_pack():
    a, b = np.array([1, 2, 3], np.uint64), np.array([-1, 5, 9], np.int32)
    assert [x.tolist() for x in p.unpack(p.pack(a, b), "u8", "i4")] == [[1, 2, 3], [-1, 5, 9]]
    assert p.unpack(p.pack(a[:0], b[:0]), "u8", "i4")[1].tolist() == []


def test_suffix_minima():
    rng = np.random.default_rng(2)
    codes = rng.integers(97, 99, 4000, dtype=np.uint8)
    codes[1000:1500] = codes[200:700]
    places = np.arange(len(codes) - p.LENGTH + 1)
    value = rng.integers(0, 1000, len(places))
    want: dict[bytes, int] = {}
    for a, v in zip(places, value, strict=True):
        w = codes[a : a + p.LENGTH].tobytes()
        want[w] = min(want.get(w, 1000), v)
    assert p.suffix_minima(codes, places, value).tolist() == [want[codes[a : a + p.LENGTH].tobytes()] for a in places]


@pytest.mark.parametrize(("seed", "hot"), [(1, p.HOT), (2, 2)])
def test_removal(spark, seed, hot):
    rows = texts(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block long, data string").repartition(5)
    got = p.remove_repeats(df, hot=hot, block_bytes=3000, bucket_bytes=5000)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute(rows)


def test_odd_rows(spark, odd, nothing):
    got = p.remove_repeats(odd).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute([(r.doc_id, r.text) for r in odd.collect()])
    for r in got:
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)) == r.n_removed and len(r.spans) == 2 * r.n_spans
    assert p.remove_repeats(nothing).collect() == []

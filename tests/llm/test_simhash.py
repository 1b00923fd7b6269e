"""SimHash near-dedup against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: list[int], radius=2) -> list[int]:
    """For each position the least position that it is connected to."""
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_fingerprints_and_spark_hash(spark, odd):
    texts = [r.text for r in odd.collect()]
    assert [simhash.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).head()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_groups(odd):
    got = simhash.near_groups(odd.withColumns({"fp": F.lit(1), "tile": F.lit(2)})).collect()
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    prints = [brute_print(r.text) for r in rows]
    want = [(r.doc_id, p, rows[c].doc_id) for r, p, c in zip(rows, prints, brute_components(prints), strict=True)]
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == Counter(want)


def chained(rng, n):
    out = {rng.getrandbits(64) for _ in range(n)}
    for start in list(out)[: n // 4]:
        x = start
        for _ in range(rng.randrange(1, 8)):
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("segments", "chunk"), [(2, 1 << 16), (4, 3), (2, 5)])
def test_edges_connect_what_links_connect(spark, segments, chunk):
    prints = chained(random.Random(segments + chunk), 300)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    edges = simhash.link_edges(df, len(prints), segments, chunk).collect()
    at = {int(np.uint64(p).view(np.int64)): i for i, p in enumerate(prints)}
    labels = np.arange(len(prints))
    simhash.unite(labels, np.array([at[e.a] for e in edges]), np.array([at[e.b] for e in edges]))
    assert labels.tolist() == brute_components(prints)


def test_components_of_a_long_chain(spark):
    order = random.Random(1).sample(range(400), 400)
    rows = [(order[i], order[i + 1]) for i in range(399) if i % 50 != 49]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    for k in range(0, 400, 50):
        part = order[k : k + 50]
        assert {got.get(x, x) for x in part} == {min(part)}


def test_near_dedup_keeps_one_each(spark, odd, nothing):
    docs = odd.withColumns({"keep": F.lit("x"), "id": F.lit(1), "h": F.lit(0)})
    out = simhash.near_dedup(docs)
    assert out.columns == docs.columns
    groups = {r.component_id for r in simhash.near_groups(odd).collect()}
    assert sorted(r.doc_id for r in out.filter("doc_id is not null").collect()) == sorted(g for g in groups if g is not None)
    assert simhash.near_dedup(nothing).collect() == [] and simhash.near_groups(nothing).collect() == []

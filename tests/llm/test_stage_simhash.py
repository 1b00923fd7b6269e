"""The pipeline's near-dedup goes by SimHash fingerprints, which decide together with the likeness of the texts."""

import random

import numpy as np

import corpus_pipeline
from ledgerlens.llm import similar, simhash
from ledgerlens.llm.common import documents

from .test_similar import DOCS, brute_kept, edited_copies


def stage(spark, rows):
    return corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()


def test_fingerprints_too_far_apart_are_no_link(spark, monkeypatch):
    rows = edited_copies()
    got = stage(spark, rows)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == brute_kept(rows) and len(got) < len(rows) - 60
    monkeypatch.setattr(similar, "REACH", -1)
    assert len(stage(spark, rows)) == len({r[1] for r in rows})


def test_alike_texts_are_within_reach(spark, sf):
    """Linked pairs of the smallest tables and of sets of 5 to 400 members at the very edge."""
    apart = lambda a, b: (simhash.bit_majority(a) ^ simhash.bit_majority(b)).bit_count()
    sets = similar.shingle_sets([t.encode() for t in sorted({r.text or "" for r in documents(spark, sf).collect()})])
    linked = [apart(a, b) for i, a in enumerate(sets) for b in sets[:i] if 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and similar.alike(len(np.intersect1d(a, b)), len(a), len(b))]
    rng = random.Random(1)
    for _ in range(3000):
        own = np.array([rng.getrandbits(64) for _ in range(rng.randrange(5, 400))], np.uint64)
        linked.append(apart(own, own[: -(-len(own) * 4 // 5)]))
    assert max(linked) <= similar.REACH and max(linked) > simhash.RADIUS

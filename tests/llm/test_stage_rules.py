"""The stages from near-dedup on, each against plain Python on its own input.

near_dedup takes five words and a similarity of 0.8, the rule of stages on word shingles. test_pipeline.test_stages
asserts op5's radius for it, which is that query's contract, and so stops there.
"""

from collections import Counter

import corpus_pipeline
from ledgerlens.llm import decontaminate, mixing
from ledgerlens.llm.common import documents, written

from .test_decontaminate import brute as overlap
from .test_similar import brute_kept


def test_stages_by_their_rules(spark, sf):
    stages = dict(corpus_pipeline.STAGES)
    docs = documents(spark, sf)
    columns, rows = docs.columns, docs.collect()

    near = written(stages["near_dedup"](spark, docs, sf), "test-near")
    got = near.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == brute_kept([(r.doc_id, r.text) for r in rows]) and len(got) < len(rows)
    whole = {(r.doc_id, r.text): r for r in rows}
    assert near.columns == columns and all(r == whole[r.doc_id, r.text] for r in got)

    clean = written(stages["decontamination"](spark, near, sf), "test-clean")
    items = [(i.text, set(decontaminate.word_hashes([i.text.encode()])[0].tolist())) for i in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = set()
    for r in got:
        own = set(decontaminate.word_hashes([r.text.encode()])[0].tolist())
        if any(len(own & words) >= 0.8 * min(len(words), 13) and overlap(r.text, text) for text, words in items):
            bad.add(r.doc_id)
    kept = clean.collect()
    assert bad and clean.columns == columns and Counter(r.doc_id for r in kept) == Counter(r.doc_id for r in got if r.doc_id not in bad)

    mixed = written(stages["mixing"](spark, clean, sf), "test-mixed")
    plan = mixing.mix_plan(clean.select("doc_id", "source", mixing.n_words(clean.text).alias("size"))).collect()
    taken = mixed.collect()
    assert mixed.columns == columns and Counter(r.doc_id for r in taken) == Counter({r.doc_id: r.copies for r in plan if r.copies})

    out = stages["sharding"](spark, mixed, sf)
    shards = out.collect()
    n = Counter(r.shard for r in shards)
    assert out.columns == [*columns, "shard", "slot"] and Counter(r.doc_id for r in shards) == Counter(r.doc_id for r in taken)
    assert max(n.values()) - min(n[k] for k in range(24)) <= 1

"""The pipeline's stages, each against plain Python on its own input."""

from collections import Counter

import corpus_pipeline
from ledgerlens.llm import decontaminate, mixing, toxicity
from ledgerlens.llm.common import documents, written

from .test_decontaminate import brute as overlap
from .test_simhash import brute_components, brute_print

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, sf):
    docs = documents(spark, sf)
    columns = docs.columns
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf), f"test-{name}")
        got = out.collect()
        ids = Counter(r.doc_id for r in got)
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            scores = toxicity.score_texts(model, [r.text.encode() for r in rows])
            assert ids == Counter(r.doc_id for r, s in zip(rows, scores, strict=True) if s < 0.5)
        elif name == "near_dedup":
            rows.sort(key=lambda r: r.doc_id)
            roots = brute_components([brute_print(r.text) for r in rows])
            assert ids == Counter(rows[i].doc_id for i in set(roots))
        elif name == "decontamination":
            items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
            firsts = [decontaminate.word_hashes([i.text.encode()])[0] for i in items]
            bad = set()
            for r in rows:  # brute force where any words are shared at all
                own = set(decontaminate.word_hashes([r.text.encode()])[0].tolist())
                if any(len(own & set(f.tolist())) >= 0.8 * min(len(f), 13) and overlap(r.text, i.text) for f, i in zip(firsts, items, strict=True)):
                    bad.add(r.doc_id)
            assert ids == Counter(r.doc_id for r in rows if r.doc_id not in bad) and bad
        elif name == "mixing":
            plan = mixing.mix_plan(docs.select("doc_id", "source", mixing.n_words(docs.text).alias("size")))
            assert ids == Counter({r.doc_id: r.copies for r in plan.collect() if r.copies})
        else:
            assert ids == Counter(r.doc_id for r in rows) and out.columns == [*columns, "shard", "slot"]
            n = Counter(r.shard for r in got)
            assert max(n.values()) - min(n[k] for k in range(24)) <= 1
            continue
        assert out.columns == columns
        whole = {r.doc_id: r for r in rows}
        assert all(r == whole[r.doc_id] for r in got)
        docs, rows = out, got


def test_odd_rows_run_through(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.shard for r in out} <= set(range(24))
    spark.createDataFrame([], DOCS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_reruns_agree(spark, sf):
    key = lambda df: Counter((r.doc_id, r.shard) for r in df.collect())
    a, b = corpus_pipeline.run(spark, sf), corpus_pipeline.run(spark, sf)
    assert key(a) == key(b)

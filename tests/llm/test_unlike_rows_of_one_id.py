"""Different texts under one doc_id, and rows without one: each row is judged by its own text."""

import random

import duckdb

from ledgerlens.llm import exact_dedup, line_dedup, mixing, pfp_dedup, sharding, similar
from ledgerlens.llm.common import whole

from .test_oracle import frame

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(7)
    line = lambda: " ".join(rng.choice(["a", "of", "mit", "license", "General", "public", "ß", "the"]) for _ in range(rng.randrange(0, 8)))
    shared = ["\n".join(line() for _ in range(rng.randrange(1, 9))) for _ in range(6)]
    out = []
    for i in range(150):
        text = "\n".join(rng.choice([line, lambda: rng.choice(shared)])() for _ in range(rng.randrange(0, 10))) if i % 11 else None
        out.append((None if i % 7 == 0 else i // 3, text, "en", "s", 1))
    return out + out[:20]


def test_against_sql(spark, tmp_path):
    spark.createDataFrame(rows(), DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for query, sql in ((line_dedup.op2_line_dedup, line_dedup.OP2_SQL), (pfp_dedup.op1_suffix_array_dedup, pfp_dedup.OP1_SQL), (exact_dedup.op4_exact_dedup, exact_dedup.OP4_SQL)):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert frame(tuple(r) for r in query(spark, str(tmp_path)).select(*columns).collect()) == frame(want.fetchall())


def test_lines_that_stand_once_stay(spark):
    text = lambda of: "\n".join(f"{of} line {k} of its own text" for k in range(20))
    docs = spark.createDataFrame([(1, text("a")), (7, text("a")), (7, text("b")), (None, text("c")), (None, text("a"))], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed > 0, r.text) for r in line_dedup.line_dedup(docs).collect()}
    assert {(1, False, text("a")), (7, False, text("b")), (None, False, text("c"))} < got and len(got) == 5
    assert sum(gone for _, gone, _ in got) == 2


def test_stages_keep_rows_apart(spark):
    table = spark.createDataFrame(rows(), DOCS)
    texts = {(r.text or "") for r in table.collect()}
    kept = similar.near_dedup(table).collect()
    assert len({r.text or "" for r in kept}) == len(kept) <= len(texts)
    assert mixing.mix_documents(table).columns == table.columns
    shards = sharding.proportional_shards(table, 5).collect()
    assert len(shards) == table.count() and sorted((r.shard, r.slot) for r in shards) == [(k, i) for k in range(5) for i in range(len([r for r in shards if r.shard == k]))]
    assert table.select(whole(table.text)).count() == len(shards)

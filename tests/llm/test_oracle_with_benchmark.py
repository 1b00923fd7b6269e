"""Decontamination against DuckDB, on the small tables and on rows of one id with planted and damaged items."""

import random

import duckdb
import pytest

from ledgerlens.llm import queries

from .test_oracle import frame


def planted():
    rng = random.Random(8)
    say = lambda n: [rng.choice(["the", "of", "über", *(f"w{i}" for i in range(50))]) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([40, 25, 13, 9, 5, 3, 1, 0])] + [(20, None), (None, "the " * 30), (3, " ".join(say(20)))]
    docs = [(None, None), (1, ""), (1, " ".join(say(900))), (2, "The " * 70)]
    for i, (_, text) in enumerate(items):
        for share in (0, 0.1, 0.2, 0.3):
            own = [("x" if rng.random() < share else w) for w in (text or "").split()]
            docs.append((i // 2 if i % 3 else None, " ".join(say(rng.randrange(20)) + own[rng.randrange(0, 3) :] + say(rng.randrange(20))).title()))
    return docs, items


@pytest.mark.parametrize("table", ["planted", "sf0.001"])
def test_decontamination(spark, sf, tmp_path, table):
    where = sf
    if table == "planted":
        where = str(tmp_path)
        docs, items = planted()
        spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{where}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{where}/{name}.parquet{'/*.parquet' if table == 'planted' else ''}')")
    want = con.execute(queries.ORACLE_WITH_BENCHMARK["op7_decontamination"])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES["op7_decontamination"](spark, where)
    assert sorted(got.columns) == sorted(columns)
    rows = frame(tuple(r) for r in got.select(*columns).collect())
    assert rows and rows == frame(want.fetchall())

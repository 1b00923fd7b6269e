"""Queries that SQL can express, held against DuckDB on odd rows and on a small table."""

import os
import random

import duckdb
import pandas as pd
import pytest

from ledgerlens.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def passages(rng):
    """Documents that share multi-line passages, license notices and half-copied ones."""
    line = lambda: " ".join(rng.choice(["a", "of", "mit", "license", "General", "public", "apache", "ß", "the"]) for _ in range(rng.randrange(0, 8)))
    shared = ["\n".join(line() for _ in range(rng.randrange(1, 9))) for _ in range(6)]
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this {}software and associated documentation files"
    extra = [notice.format(""), notice.format("fine "), "Licensed under CC BY-NC 4.0.", "mit license mit license", "MİT LICENSE", "GENERAL Public  License!", "all rights reserved", "\n\n\n\n", "x\r\n", "This program is free software: you can redistribute it and/or modify"]
    out = []
    for i in range(120):
        parts = [rng.choice([line, lambda: rng.choice(shared), lambda: rng.choice(extra)])() for _ in range(rng.randrange(0, 12))]
        out.append((i * 3 - 50, "\n".join(parts), "en", "s", 1))
    return out


def frame(rows):
    return sorted((tuple(None if x is None or x != x else x for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
@pytest.mark.parametrize("table", ["odd", "passages", "empty", "sf0.001"])
def test_oracle(spark, odd, tmp_path, sf, name, table):
    if table == "sf0.001":
        where = sf
    else:
        where = str(tmp_path)
        df = odd if table == "odd" else spark.createDataFrame(passages(random.Random(4)) if table == "passages" else [], DOCS)
        df.coalesce(1).write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").coalesce(1).write.parquet(f"{where}/benchmark.parquet")
    got = queries.QUERIES[name](spark, where)
    con = duckdb.connect()
    files = f"{where}/documents.parquet" + ("/*.parquet" if os.path.isdir(f"{where}/documents.parquet") else "")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{files}')")
    want = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert frame(rows) == frame(want.fetchall())
    assert pd.DataFrame(rows, columns=columns).shape[1] == len(columns)

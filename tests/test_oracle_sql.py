"""Oracles are SQL, and nothing else."""

import __spark_entry__


def test_every_oracle_is_text():
    assert all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())

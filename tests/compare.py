"""Spark rows against DuckDB rows, whatever their order."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(_plain(r[i]) for i in at) for r in got.fetchall()), key=repr)


def assert_same(df, sql: str, sf_dir: str) -> None:
    names, expected = duck_rows(sql, sf_dir)
    assert sorted(df.columns) == names
    got = sorted((tuple(_plain(v) for v in r) for r in df.select(*names).collect()), key=repr)
    assert got == expected

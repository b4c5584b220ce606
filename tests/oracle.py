"""Runs a query and its SQL side by side and compares rows, columns by name, order aside."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = query(spark, sf_dir)
    have = con.execute(sql)
    want = rows([c[0] for c in have.description], have.fetchall())
    mine = rows(got.columns, [tuple(r) for r in got.collect()])
    assert sorted(got.columns) == sorted(c[0] for c in have.description), (sorted(got.columns), sorted(c[0] for c in have.description))
    bad = [(a, b) for a, b in zip(mine, want) if a != b]
    assert len(mine) == len(want) and not bad, f"{name}: {len(mine)} and {len(want)} rows; first differences {bad[:3]}"
    return len(mine)

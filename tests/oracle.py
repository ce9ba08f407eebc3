"""Spark queries beside their SQL, over tables of one folder."""

import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple("" if v[k] is None else str(v[k]) for k in order) for v in values))


def same(spark, sf_dir, function, sql):
    found = function(spark, sf_dir)
    result = tables(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(found.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, result.fetchall())

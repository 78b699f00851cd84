"""A query's rows and those of its DuckDB SQL, in one form."""

import os

import duckdb


def both(spark, sf_dir, query, sql):
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect()), sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())

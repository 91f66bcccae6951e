"""Compare a query with its SQL, run by DuckDB over the same files."""

import os


def tables(folder):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(folder):
        p = f"{folder}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(columns, found):
    def plain(v):
        return round(v, 7) if isinstance(v, float) else list(v) if isinstance(v, (list, tuple)) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


def same(spark, folder, query, sql):
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    r = tables(folder).execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, r.fetchall())

"""Comparison of a Spark result with the same SQL run by DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(rows, columns):
    """Rows as sorted texts, columns by name, -0.0 as 0.0."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    show = lambda v: f"{v + 0.0:.6g}" if isinstance(v, float) else str(v)
    return sorted("|".join(show(row[k]) for k in order) for row in rows)


def same(df, con, sql):
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(found.fetchall(), found.columns)

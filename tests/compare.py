"""Row sets of a Spark result and of DuckDB's, made comparable."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows_of(columns, rows):
    return sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [r.asDict(True) for r in df.collect()])


def sql_rows(sql, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = c.execute(sql)
    columns = [d[0] for d in found.description]
    return sorted(columns), rows_of(columns, [dict(zip(columns, r)) for r in found.fetchall()])

"""Run a registered query in Spark and its oracle in DuckDB and compare them."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(data_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{data_dir}/{name}.parquet')")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return repr(round(x, 9) + 0.0)
    return str(x)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


FAMILIES = {"BIGINT": "int", "INTEGER": "int", "SMALLINT": "int", "TINYINT": "int", "HUGEINT": "huge",
            "VARCHAR": "string", "DOUBLE": "double", "FLOAT": "float", "BOOLEAN": "bool"}
SPARK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN", "float": "FLOAT"}


def compare(df, con, sql):
    """None when equal, else a description of the difference."""
    out = con.execute(sql)
    cols = [d[0] for d in out.description]
    types = {d[0]: str(d[1]) for d in out.description}
    want = out.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    diff = [(c, SPARK.get(t, t), types[c]) for c, t in df.dtypes if SPARK.get(t, t) != types[c]]
    if diff:
        return f"types {diff}"
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    exp = rows(cols, want)
    if len(got) != len(exp):
        return f"rows {len(got)} != {len(exp)}"
    if got != exp:
        bad = [(g, e) for g, e in zip(got, exp) if g != e]
        return f"values {len(bad)} differ, first {str(bad[0])[:600]}"
    if not exp:
        return "empty"
    return None

"""Run registered queries next to their SQL and report the differences."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is not None, str(v)) for v in row)


def differences(con, spark_df, sql: str, limit: int = 3) -> list[str]:
    rel = con.sql(sql)
    names = sorted(rel.columns)
    if sorted(spark_df.columns) != names:
        return [f"columns {sorted(spark_df.columns)} != {names}"]
    want = sorted(rel.select(*(duckdb.ColumnExpression(n) for n in names)).fetchall(), key=_key)
    got = sorted((tuple(r) for r in spark_df.select(*(f"`{n}`" for n in names)).collect()), key=_key)
    if len(want) != len(got):
        return [f"rows {len(got)} != {len(want)}"]
    out = []
    for g, w in zip(got, want):
        for n, a, b in zip(names, g, w):
            same = a == b or (
                isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b)
            )
            if not same or type(a) is not type(b):
                out.append(f"{n}: {a!r} != {b!r}")
                if len(out) >= limit:
                    return out
    return out


def main(sf_dir: str, names: list[str]) -> int:
    from contract import queries as registered
    from daytide.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    todo, sql, bad = registered.queries(), registered.oracle_sql(), 0
    for name in names or todo:
        begin = time.time()
        try:
            df = todo[name](spark, sf_dir)
            diff = differences(con, df, sql[name]) if name in sql else []
            note = "ok" if name in sql else f"rows only: {df.count()}"
        except Exception as error:  # report and go on with the next query
            diff = [str(error).replace("\n", " ")[:600]]
        bad += bool(diff)
        print(f"{name:28s} {time.time() - begin:6.1f}s  {diff or note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))

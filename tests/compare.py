"""Run a registered query in Spark and its SQL in DuckDB and compare all values."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x: object) -> object:
    if x is None or (isinstance(x, float) and x != x):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list):
        return tuple(_cell(y) for y in x)
    return x


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str, limit: int = 4) -> list[str]:
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = _rows(columns, cursor.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    out = []
    if sorted(columns) != sorted(df.columns):
        out.append(f"columns {sorted(df.columns)} != {sorted(columns)}")
    if len(got) != len(expected):
        out.append(f"{len(got)} rows, expected {len(expected)}")
    for a, b in zip(got, expected):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            out.append(f"{a} != {b}")
            if len(out) > limit:
                break
    return out


def main() -> None:
    import __spark_entry__ as e
    from agentlog.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sql = e.oracle_sql()
    bad = 0
    for name, run in e.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, sf)
            diff = differences(df, con, sql[name]) if name in sql else []
            note = "ok" if name in sql else f"rows {df.count()}"
        except Exception as exc:  # report and go on
            diff, note = [f"{type(exc).__name__}: {str(exc)[:600]}"], ""
        took = time.time() - start
        bad += bool(diff)
        print(f"{'FAIL' if diff else note:>10} {took:6.1f}s {name}", flush=True)
        for line in diff:
            print("     ", line[:700], flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()

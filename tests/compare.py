"""Run registered queries and their SQL on the same tables and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime) and value.tzinfo is not None:
        return value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, call, sql, sf_dir):
    started = time.time()
    df = call(spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    if sql is None:
        return len(got_rows), None, seconds, ""
    found = con.sql(sql)
    want_columns, want_raw = found.columns, found.fetchall()
    if sorted(df.columns) != sorted(want_columns):
        return len(got_rows), False, seconds, f"columns {sorted(df.columns)} vs {sorted(want_columns)}"
    got, want = rows_of(df.columns, got_rows), rows_of(want_columns, want_raw)
    if got == want:
        return len(got), True, seconds, ""
    missing = [w for w in want if w not in set(got)][:3]
    extra = [g for g in got if g not in set(want)][:3]
    return len(got), False, seconds, f"rows {len(got)} vs {len(want)}\n   missing {missing}\n   extra {extra}"


def main():
    import __spark_entry__ as entry_point
    from tallyward.session import build_session
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    calls, sqls = entry_point.queries(), entry_point.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name, call in calls.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            n, ok, seconds, note = compare(spark, con, name, call, sqls.get(name), sf_dir)
        except Exception as error:  # report and go on
            n, ok, seconds, note = -1, False, 0.0, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += ok is False
        print(f"{'ok  ' if ok else 'rows' if ok is None else 'BAD '} {name} rows={n} {seconds:.1f}s {note}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

"""Run queries on Spark and their SQL on DuckDB over the same tables and compare all values."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stayline.plans.catalog import QUERIES  # noqa: E402
from stayline.plans.oracle import ORACLE  # noqa: E402
from stayline.session import local_session  # noqa: E402
from stayline.sources.tables import TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    return value


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if mine == theirs:
        return None
    only_mine, only_theirs = list((mine - theirs).items())[:2], list((theirs - mine).items())[:2]
    return f"rows {sum(mine.values())} / {sum(theirs.values())}; only Spark {only_mine}; only SQL {only_theirs}"


if __name__ == "__main__":
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/{sys.argv[1]}"
    database = connect(folder)
    bad = 0
    for query in sys.argv[2:] or ORACLE:
        start = time.time()
        try:
            difference = compare(session, database, folder, query)
        except Exception as error:  # noqa: BLE001
            difference = f"{type(error).__name__}: {str(error)[:500]}"
        bad += difference is not None
        print(f"{'ok  ' if difference is None else 'DIFF'} {query} {time.time() - start:.1f}s {difference or ''}"[:1500], flush=True)
    print(f"{bad} of {len(sys.argv[2:] or ORACLE)} differ; without SQL: {sorted(set(QUERIES) - set(ORACLE))}")

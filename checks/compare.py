"""Run every registered query and its SQL side by side.

    python -m checks.compare [table folder] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
import traceback

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES
from reviewgate.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
KINDS = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def sortable(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def differences(spark, db, name: str, folder: str) -> tuple[int, list[str]]:
    frame = QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    got = sorted(
        (tuple(plain(row[x]) for x in columns) for row in frame.collect()), key=sortable
    )
    if name not in ORACLE:
        return len(got), []
    relation = db.execute(ORACLE[name])
    names = [d[0] for d in relation.description]
    kinds = {d[0]: str(d[1]) for d in relation.description}
    order = [names.index(x) for x in sorted(names)]
    want = sorted(
        (tuple(plain(row[i]) for i in order) for row in relation.fetchall()), key=sortable
    )
    notes = []
    if columns != sorted(names):
        notes.append(f"columns {columns} / {sorted(names)}")
    for column, kind in frame.dtypes:
        if column in kinds and KINDS.get(kind, kind) != kinds[column]:
            notes.append(f"type of {column}: {kind} / {kinds[column]}")
    if len(got) != len(want):
        notes.append(f"{len(got)} rows / {len(want)}")
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    if wrong:
        a, b = wrong[0]
        cells = [f"{x}: {u!r} / {v!r}"[:400] for x, u, v in zip(columns, a, b) if u != v]
        notes.append(f"{len(wrong)} rows differ, first: {cells}")
    return len(got), notes


def connect(folder: str):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return db


def main(folder: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark = local_session(8)
    db = connect(folder)
    failed = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            rows, notes = differences(spark, db, name, folder)
        except Exception as error:
            rows, notes = 0, [f"{type(error).__name__}: {str(error)[:1500]}"]
            if names:
                traceback.print_exc()
        failed += bool(notes)
        state = "DIFF" if notes else ("ok" if name in ORACLE else "rows")
        print(f"{name:26s} {state:5s} {rows:7d} rows {time.time() - start:6.2f}s", *notes)
    print(f"{failed} of {len(names or QUERIES)} queries differ")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)

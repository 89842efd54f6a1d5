"""Compare queries with their SQL: ``python -m tests.oracle_check [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
        return "∅"
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)
    return sorted(tuple(_cell(v) for v in r) for r in df[cols].itertuples(index=False, name=None))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    kinds = [
        (c, str(got[c].dtype), str(want[c].dtype))
        for c in got.columns
        if got[c].dtype.kind != want[c].dtype.kind and len(got)
    ]
    if kinds:
        return f"types {kinds}"
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {str(bad[0])[:600]}" if bad else None


#: Whole numbers stay whole numbers where there are nulls among them.
_WHOLE = {pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}


def frame(table: pa.Table) -> pd.DataFrame:
    return table.to_pandas(types_mapper=_WHOLE.get)


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:] or list(queries())
    spark, con, failed = make_session(), connect(sf), 0
    sqls = oracle_sql()
    for name in wanted:
        start = time.time()
        try:
            got = frame(queries()[name](spark, sf).toArrow())
            spent = time.time() - start
            if name in sqls:
                note = difference(got, frame(con.execute(sqls[name]).to_arrow_table()))
            else:
                note = None if len(got) else "no rows"
        except Exception as e:
            spent, note = time.time() - start, f"{type(e).__name__}: {str(e)[:900]}"
        failed += note is not None
        kind = "sql" if name in sqls else "rows"
        print(f"{'FAIL' if note else 'ok  '} {name:28s} {kind} {len(got) if note is None else '-':>7} rows {spent:6.2f}s {note or ''}", flush=True)
    print(f"{len(wanted)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

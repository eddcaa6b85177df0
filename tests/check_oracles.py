"""Run every registered query next to its SQL: ``python tests/check_oracles.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def _rows(table, names):
    columns = [[_plain(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns), key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None when equal, otherwise what differs."""
    got = queries()[name](spark, sf_dir).toArrow()
    want = con.sql(oracle_sql()[name]).to_arrow_table()
    names = sorted(got.column_names)
    if names != sorted(want.column_names):
        return f"columns {names} != {sorted(want.column_names)}"
    kinds = [(n, str(got.schema.field(n).type), str(want.schema.field(n).type)) for n in names]
    odd = [k for k in kinds if k[1] != k[2]]
    if got.num_rows != want.num_rows:
        return f"rows {got.num_rows} != {want.num_rows}"
    if got.num_rows == 0:
        return "no rows"
    a, b = _rows(got, names), _rows(want, names)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ, first {str(bad[0])[:600]} types {odd}"
    return f"types {odd}" if odd else None


if __name__ == "__main__":
    from sectorscope.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(queries())
    session = local_session(scratch=tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    db = connect(sf)
    for q in chosen:
        start = time.time()
        try:
            if q in oracle_sql():
                problem = compare(session, db, sf, q)
            else:
                problem = None if queries()[q](session, sf).count() else "no rows"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {q} {problem or ''}", flush=True)

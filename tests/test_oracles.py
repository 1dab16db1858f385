"""Every query against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()
OWN = [n for n in QUERIES if n.startswith("q_")]


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, bool):
        return int(x)
    return float(x) if hasattr(x, "as_tuple") else str(x) if hasattr(x, "year") else float(x) if isinstance(x, int) else x


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    place = lambda x: round(x, 5) if isinstance(x, float) else x if x is not None else 0
    return sorted((tuple(plain(r[k]) for k in at) for r in rows), key=lambda r: tuple((x is None, str(type(x)), place(x)) for x in r))


def near(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(1, abs(a))


def run_sql(name, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(SQL[name])
    return [c[0] for c in got.description], got.fetchall()


@pytest.mark.parametrize("name", [n for n in OWN if n in SQL])
def test_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    columns, rows = run_sql(name, sf)
    assert sorted(df.columns) == sorted(columns)
    mine, theirs = ordered(df.columns, [tuple(r) for r in df.collect()]), ordered(columns, rows)
    assert len(mine) == len(theirs)
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if not all(map(near, a, b))]
    assert not bad, (len(bad), bad[:3])


def test_all_others_have_value_tests():
    tests = "".join((Path(__file__).parent / f"test_{t}.py").read_text() for t in ("values", "variants", "studies"))
    assert not {n for n in OWN if n not in SQL and f'"{n}"' not in tests}


def test_entry(spark):
    assert entry_module.entry(spark).count() == 1

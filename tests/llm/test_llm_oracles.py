"""The corpus queries' SQL against the queries."""

from pathlib import Path

import duckdb
import pytest

from chronoloom.llm.oracles import oracle_sql
from chronoloom.llm.queries import queries


@pytest.mark.parametrize("name", oracle_sql())
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(oracle_sql()[name])
    columns = sorted(c[0] for c in got.description)
    theirs = got.df()[columns].astype(object).where(lambda x: x.notna(), None)
    df = queries()[name](spark, sf)
    assert sorted(df.columns) == columns
    mine = df.select(*columns).collect()
    key = lambda r: tuple(str(x) for x in r)
    plain = lambda r: tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)
    assert sorted(map(plain, mine), key=key) == sorted(map(plain, theirs.itertuples(index=False)), key=key)

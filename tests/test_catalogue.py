"""Every query runs, and those with SQL give the SQL's rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from modeloom.plans import catalogue, decompositions, measures

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
assert decompositions.EXACT and measures.IMAGES  # importing them registers their queries


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(rows):
    def cell(x):
        return "nan" if isinstance(x, float) and math.isnan(x) else round(x, 5) + 0.0 if isinstance(x, float) else x

    return sorted((tuple(cell(x) for x in r) for r in rows), key=str)


def quoted(name):
    return f'"{name}"'


def near(a, b):
    return len(a) == len(b) and all(math.isclose(x, y, abs_tol=2e-5, rel_tol=1e-9) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(q for q in catalogue.QUERIES if not q.startswith("recovers_")))  # those: test_recovery.py
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = canon(df.select(*columns).collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == columns
    want = canon(duck.sql(f"SELECT {', '.join(map(quoted, columns))} FROM ({catalogue.ORACLES[name]})").fetchall())
    assert len(got) == len(want)
    assert all(near(a, b) for a, b in zip(got, want, strict=True))


def test_entry(spark):
    assert entry_points.entry(spark).count() == 5


def test_chunks_do_not_change_results(spark, monkeypatch):
    from modeloom.operators import frames, smoothing
    from modeloom.sources import signals

    s = signals.events_hourly(spark, SF)
    for name, smooth in smoothing.SMOOTHERS.items():
        whole = canon(smooth(s).select("series_id", "t", "smoothed").collect())
        monkeypatch.setattr(frames.halo, "__defaults__", (37,))
        monkeypatch.setattr(frames.local, "__defaults__", (37,))
        cut = canon(smooth(s).select("series_id", "t", "smoothed").collect())
        monkeypatch.undo()
        assert all(near(a, b) for a, b in zip(whole, cut, strict=True)), name

"""Every registered query of the engine against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from matchloom.plans import queries as resolution

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=2e-6)
    return a == b


def key(row):
    return tuple((x is None, "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)) for x in row)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(resolution.queries()))
def test_query(spark, sf, duck, name):
    df = resolution.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    if name not in resolution.oracle_sql():
        assert got
        return
    result = duck.execute(resolution.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(map(close, a, b)), (a, b)


@pytest.mark.parametrize("name", ["er_importances", "er_model_scores"])
def test_models_train_with_the_operators_settings(spark, sf, monkeypatch, name):
    seen = []

    class Trees:
        def __init__(self, **settings):
            seen.append(settings)
            raise StopIteration

    monkeypatch.setattr(resolution.models, "GBTClassifier", Trees)
    with pytest.raises(StopIteration):
        resolution.queries()[name](spark, sf)
    assert resolution.models.STAGE1.items() <= seen[0].items()

import importlib.util

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalogue


def test_every_query_has_known_names():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known)
    if importlib.util.find_spec("tidemark.llm") is not None:
        assert {"p1_found", "p8_found"} <= set(known)


@pytest.mark.parametrize("name", ["normalise_text", "containment_scores", "jaccard_pairs", "nb_predictions", "metrics_overall", "calibration"])
def test_queries_equal_their_sql(spark, folder, name):
    db = duckdb.connect()
    for t in ("records", "split_members", "predictions", "chapters"):
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = catalogue.queries()[name](spark, folder)
    cols = sorted(df.columns)
    show = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(show(v) for v in r) for r in df.select(*cols).collect()), key=str)
    want = db.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({catalogue.oracle_sql()[name]})").fetchall()
    assert got == sorted((tuple(show(v) for v in r) for r in want), key=str)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0

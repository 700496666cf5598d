"""Every core query against its SQL on the smallest data, and some against what must hold."""

import math

import duckdb
import pytest

from casegrain.plans import catalog

DIR = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings cases ingested_files extraction_results page_quality observations conflict_hits search_results mix_targets".split()

@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def _plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda v: "-" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, con, name):
    got = _plain(catalog.queries()[name](spark, DIR).toPandas())
    want = _plain(con.execute(catalog.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got)
    assert got.equals(want)


def test_context_fits_its_budget_and_cites_lines(spark):
    rows = catalog.queries()["context_budget"](spark, DIR).collect()
    lines = {(str(r["extraction_id"]), r["line"]): r["text"] for r in catalog.queries()["lines_explode"](spark, DIR).collect()}
    spent = {}
    for r in rows:
        assert lines[(r["source"], r["line"])] == r["text"]
        spent[r["case_id"]] = spent.get(r["case_id"], 0) + r["chars"] + 8
    assert rows and max(spent.values()) <= 24_000


def test_clarity_and_dashboard_are_sums_of_the_records(spark):
    r = catalog.queries()["pattern_clarity"](spark, DIR).collect()
    c = catalog.queries()["case_dashboard"](spark, DIR).collect()
    assert sum(x["float_points"] for x in r) == sum(x["float_points"] for x in c) and abs(sum(x["total_pressure"] for x in r) - sum(x["total_pressure"] for x in c)) < 0.1
    assert len({x["pattern_signature"] for x in r}) > 300


def test_markup_round_trip_holds_every_text(spark):
    want = {r["extraction_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/extraction_results.parquet").where("text is not null").collect()}
    got = {r["extraction_id"]: r["text"] for r in catalog.queries()["html_text"](spark, DIR).collect()}
    assert got == want and any("<<<PAGE" in t for t in got.values()) and any("&" in t for t in got.values())

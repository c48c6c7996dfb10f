"""Every query with an SQL twin gives the rows that DuckDB gives."""

import duckdb
import pytest

from recordloom.plans import catalogue

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return con


def plain(frame):
    names = sorted(frame.columns)
    show = lambda v: "NULL" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return names, sorted(tuple(map(show, r)) for r in frame[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_twin(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, ROOT).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert plain(got) == plain(want)


def test_script_cards_of_any_key(spark, tmp_path):
    """Keys whose last four digits read as print of the card, the free call above all."""
    keys = [k + n for k in (0, 1001, 1800, 1947, 5678, 9012, 9999) for n in (0, 10_000, 6_000_000_000)]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    got, want = catalogue.QUERIES["script_cards"](spark, str(tmp_path)).toPandas(), con.execute(catalogue.SQL["script_cards"]).df()
    assert plain(got) == plain(want)


def test_flagship(spark):
    rows = catalogue.flagship(spark, ROOT).collect()
    assert sum(r.documents for r in rows) == 470 and sum(r.documents for r in rows if r.ready) > 300


def test_ranking_hands_python_only_what_it_uses(spark):
    """Scores and lists of fields made up most of what went to Python and back, and nothing read them."""
    plan = catalogue.QUERIES["rank_candidates"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    given = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert len(given) == 2 and not any(c in line for line in given for c in ("scores#", "matched#", "missing#", "seconds#", "family#"))

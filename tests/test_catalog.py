"""Every registered query against its SQL, value by value."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
import oracle
from fareloom.plans.catalog import catalog

CATALOG = catalog()
WITH_SQL = [n for n, q in CATALOG.items() if q.sql is not None]
WITHOUT_SQL = [n for n, q in CATALOG.items() if q.sql is None]


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_oracle(spark, sf_dir, duck, name):
    query = CATALOG[name]
    assert oracle.compare(query.run(spark, sf_dir), duck, query.sql) == []


def test_inventory_is_complete():
    counts = {}
    for name in CATALOG:
        counts[name.split("_")[0][0]] = counts.get(name.split("_")[0][0], 0) + 1
    assert counts == {"q": 22, "b": 11, "a": 25, "e": 18, "v": 11, "s": 1, "r": 10}


def test_every_query_has_sql():
    assert WITHOUT_SQL == []


def test_contract(spark):
    assert contract.entry(spark).count() == 10
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_approximate_percentile_is_close(spark, sf_dir):
    exact = {
        (r["VendorID"], r["trip_month"]): r["p90_dist"]
        for r in CATALOG["q07_p90_distance"].run(spark, sf_dir).collect()
    }
    approx = CATALOG["q07b_p90_distance_approx"].run(spark, sf_dir).collect()
    assert len(approx) == len(exact)
    for row in approx:
        assert abs(row["p90_dist"] - exact[row["VendorID"], row["trip_month"]]) <= 1.0


def test_suggested_layout(spark, sf_dir):
    rows = {r["layout"]: r for r in CATALOG["e_suggest_partitioning"].run(spark, sf_dir).collect()}
    assert rows["year"]["partitions"] == 7 and rows["year,month"]["partitions"] == 83
    assert [n for n, r in rows.items() if r["suggested"]] == ["year,month,day"]

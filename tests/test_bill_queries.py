"""Every query over bills against its oracle."""

import pytest

from quillmill.plans import damaged_queries, picture_queries, saved_queries  # noqa: F401  add their queries
from quillmill.plans.bill_queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(compare, name):
    compare(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_imports_and_names_queries():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def long_bills(sf_dir, tmp_path_factory):
    """Tables where some bills have five times their items, over 16 of them."""
    import duckdb

    out = tmp_path_factory.mktemp("long")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    few = f"SELECT o_orderkey FROM '{sf_dir}/orders.parquet' ORDER BY 1 LIMIT 40"
    con.sql(f"COPY (SELECT l.* REPLACE (l_linenumber + i * 100 AS l_linenumber) FROM '{sf_dir}/lineitem.parquet' l, (VALUES (0), (1), (2), (3), (4)) v(i) WHERE l_orderkey IN ({few})) TO '{out}/lineitem.parquet'")
    for name in ("orders", "customer", "part"):
        con.sql(f"COPY (SELECT * FROM '{sf_dir}/{name}.parquet') TO '{out}/{name}.parquet'")
    for name in ("lineitem", "orders", "customer", "part"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{out}/{name}.parquet'")
    return str(out), con


def test_zones_of_long_bills_have_the_label_of_the_heading(spark, long_bills):
    """A heading "Sl No" in the top 28 % of a page is a label too: the SQL had taken it for none."""
    from tests.conftest import rows_of

    path, con = long_bills
    df = QUERIES["spatial_zones"](spark, path)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = con.sql(ORACLES["spatial_zones"])
    assert got == rows_of(want.columns, want.fetchall())
    assert df.filter("bill_id >= 0 AND zone = 'bill_no'").count() > 0


@pytest.mark.parametrize("name", ["word_bands", "spatial_table_rows", "anchors", "text_of_words"])
def test_words_of_long_bills(spark, long_bills, name):
    """The place and number of each word, which are counted in the text before it."""
    from tests.conftest import rows_of

    path, con = long_bills
    df = QUERIES[name](spark, path)
    want = con.sql(ORACLES[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want.columns, want.fetchall())


def test_words_are_not_sorted_or_ranked(spark, sf_dir):
    from quillmill.sources import rendered as R

    plan = R.bills_words(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1  # the numbers of the items

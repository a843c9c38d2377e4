"""The driver's contract."""

import __spark_entry__ as entry

from attesta.queries.fixtures import table


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 130


def test_the_flagship_runs_and_scopes_hold(spark):
    rows = entry.entry(spark).collect()
    asked = {r.item_id for r in table(spark, entry.SMOKE_DIR, "benchmark").select("item_id").collect()}
    seen = {r.query_id for r in rows}
    assert seen and seen <= asked
    assert not any(q % 4 == 0 and q % 8 != 0 for q in seen)  # an empty scope finds nothing

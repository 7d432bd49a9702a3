"""The scheme features over the months: all eight columns, equal to SQL."""

import __spark_entry__ as entry
from conftest import SF_DIR
from shelfwise.operators import baskets as B


def test_all_features_of_a_scheme(spark, con):
    import check

    name = "l09_scheme_features_over_months"
    ok, message, _, _ = check.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert ok, message
    assert set(entry.queries()[name](spark, SF_DIR).columns) == {"ym", "user_id", "item_id", *B.FEATURES}

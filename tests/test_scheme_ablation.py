"""The ablation over all schemes, alphas and months, equal to SQL."""

import __spark_entry__ as entry
from conftest import SF_DIR
from shelfwise.operators import baskets as B


def test_ablation_has_every_scheme(spark, con):
    import check

    name = "r10_all_schemes_ablation"
    ok, message, _, rows = check.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert ok, message
    assert rows == len(B.SCHEMES)

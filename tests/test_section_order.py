"""Log order of sections whose states others name too."""

import datetime

from boughline.operators.changefeed import section_order

SECTION = "section_id bigint, chain_id string, base_id binary, new_id binary, arrived_at timestamp_ntz"


def positions(spark, rows):
    """Positions of sections given as (section, chain, base, new) in the order of arrival."""
    start = datetime.datetime(2024, 1, 1)
    full = [(i, c, b and b.encode(), n.encode(), start + datetime.timedelta(hours=k)) for k, (i, c, b, n) in enumerate(rows)]
    return {r["section_id"]: r["lsn"] for r in section_order(spark.createDataFrame(full, SECTION)).collect()}


def test_unreachable_section_ousts_none(spark):
    rows = [(9, "c", "nowhere", "1"), (8, "c", "nowhere", "2"), (7, "c", "loop", "loop"), (3, "c", "2", "3"), (2, "c", "1", "2"), (1, "c", None, "1"), (5, "d", "1", "2"), (4, "d", None, "1")]
    assert positions(spark, rows) == {1: 1, 2: 2, 3: 3, 4: 1, 5: 2}


def test_chain_returns_to_earlier_state(spark):
    rows = [(3, "c", "2", "1"), (2, "c", "1", "2"), (4, "c", "1", "3"), (1, "c", None, "1"), (5, "c", "3", "4")]
    assert positions(spark, rows) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}

"""Stored listings that are nested deeply, or that contain themselves."""

import pytest

from boughline.operators import navigate
from boughline.schema import build

LISTING = "listing_id binary, name string, file_type string, perm int, ts timestamp_ntz, size bigint, content_id binary"


def key(i):
    return i.to_bytes(2, "big")


def test_listings_deeper_than_64_levels(spark):
    depth = 66
    df = build(spark, [{"path": "d/", "content_id": key(0)}])
    listings = spark.createDataFrame([(key(i), "d/" if i < depth else "x", None, None, None, None, key(i + 1)) for i in range(depth + 1)], LISTING)
    got = navigate.expand_listings(df, listings.coalesce(1)).select("path").collect()
    assert {r["path"] for r in got} == {"d/" * n for n in range(1, depth + 2)} | {"d/" * (depth + 1) + "x"}


def test_listing_that_contains_itself(spark):
    df = build(spark, [{"path": "d/", "content_id": key(0)}])
    listings = spark.createDataFrame([(key(0), "d/", None, None, None, None, key(0))], LISTING)
    with pytest.raises(ValueError, match="contains itself"):
        navigate.expand_listings(df, listings.coalesce(1))

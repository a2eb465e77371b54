import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.errors import InvalidRange
from weftline.operators.partition import FixedPartition, KeyRange
from weftline.schemas import MAX_ID, NIL_ID


def test_known_bounds():
    assert KeyRange.full(4).bounds[1:4] == ["40000000-0000-0000-0000-000000000000", "80000000-0000-0000-0000-000000000000", "c0000000-0000-0000-0000-000000000000"]
    assert KeyRange.full(10).bounds[1:3] == ["19999999-9999-9999-9999-999999999999", "33333333-3333-3333-3333-333333333332"]
    assert KeyRange.full(11).bounds[1:3] == ["1745d174-5d17-45d1-745d-1745d1745d17", "2e8ba2e8-ba2e-8ba2-e8ba-2e8ba2e8ba2e"]
    assert KeyRange.full(1).extents(0) == (NIL_ID, MAX_ID)
    assert FixedPartition(1, 4).extents()[0].startswith("4")


@pytest.mark.parametrize("start, end, parts", [(NIL_ID, MAX_ID, 0), (MAX_ID, NIL_ID, 2), (NIL_ID, NIL_ID, 2)])
def test_invalid(start, end, parts):
    with pytest.raises(InvalidRange):
        KeyRange(start, end, parts)
    with pytest.raises(InvalidRange):
        KeyRange.full(3).extents(3)


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 1000))
def test_ranges_cover_once(n):
    bounds = KeyRange.full(n).bounds
    assert len(bounds) == n + 1 and bounds == sorted(bounds) and len(set(bounds)) == n + 1


def test_part_of(spark):
    ids = spark.createDataFrame([(NIL_ID,), ("80000000-0000-0000-0000-000000000000",), (MAX_ID,)], "id string")
    assert [r[0] for r in ids.select(KeyRange.full(2).part_of(F.col("id"))).collect()] == [0, 1, None]

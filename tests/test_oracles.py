"""Every query that has a DuckDB statement agrees with it on the smallest tables."""

import pytest
from conftest import SF
from verify import compare

from tidewater.plans import evaluation, lending, messages, profiles, quality

NAMES = [n for plan in (lending, quality, profiles, messages, evaluation) for n in plan.QUERIES]


@pytest.mark.parametrize("name", NAMES)
def test_agrees(spark, name):
    assert compare(spark, SF, name).startswith("ok")

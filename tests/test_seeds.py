"""Checks that sound models pass find the faults seeded into them."""

import __spark_entry__ as entry
from tidewater.plans.quality import SEEDED_CHECKS


def test_every_check_finds_its_seeds(spark):
    found = {r["check"]: r["count"] for r in entry.queries()["dq_seeded_violations"](spark, "/root/testdata/sf0.01").groupBy("check").count().collect()}
    assert set(found) == set(SEEDED_CHECKS) and all(found.values())

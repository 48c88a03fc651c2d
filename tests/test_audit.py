"""Stored failing rows are whole, and every check of a run is told, also those that pass."""

import datetime as dt

from conftest import SF

from tidewater.operators import quality as Q
from tidewater.plans import quality


def test_times_are_kept_to_the_microsecond(spark):
    sink = Q.AuditSink(spark)
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 2, 3, 4, 5, 123456), dt.datetime(2024, 1, 2, 3, 4, 5, 678)), (2, None, None)], "id long, at timestamp, local timestamp_ntz")
    sink.write("run", {"late": ("error", rows)})
    assert sorted(sink.rows("run", "late", rows.schema).collect()) == sorted(rows.collect())


def test_checks_that_pass_stand_in_their_run(spark):
    sink = Q.AuditSink(spark)
    one = spark.range(3)
    sink.write("a", {"bad": ("error", one), "odd": ("warn", one.where("id = 1")), "good": ("error", one.where("false"))})
    sink.write("b", {"bad": ("error", one.where("false"))})
    assert sorted(map(tuple, sink.checks().collect())) == [("a", "bad", "error", 3, "error"), ("a", "good", "error", 0, "pass"), ("a", "odd", "warn", 1, "warn"), ("b", "bad", "error", 0, "pass")]
    sink.write("a", {})
    assert sink.checks("a").count() == 0 and sink.read("a").count() == 0


def test_every_check_stores_its_whole_rows(spark, monkeypatch):
    stored, write = [], Q.AuditSink.write
    monkeypatch.setattr(Q.AuditSink, "write", lambda self, run, failing: stored.append(failing) or write(self, run, failing))
    got = quality.QUERIES["dq_audit_rows"](spark, SF).collect()
    assert len(stored) == 1 and set(stored[0]) == set(quality.CHECKS) == {r["check"] for r in got}
    for check in quality.CHECKS:
        rows = [r for r in got if r["check"] == check]
        whole = [r["failing"] for r in rows if r["failing"] is not None]
        assert {r["failures"] for r in rows} == {len(whole)} and (whole or [r["status"] for r in rows] == ["pass"])
    assert all(r["failing"].count("|") == 4 for r in got if r["check"] == "dq_loan_matches_application" and r["failing"])

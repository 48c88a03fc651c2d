"""Exact deduplication of a stream over any span of time."""

from types import SimpleNamespace

from tidewater.plans import evaluation


def test_stream_exact_dedup_over_more_than_1000_days(spark):
    rows = [(i, f"message text {i % 200}", f"{1990 + i % 30}-01-{1 + i % 28:02d} 00:00:00") for i in range(800)]
    model = SimpleNamespace(spark=spark, fx_messages=spark.createDataFrame(rows, "id long, text string, received_at_utc string"))
    found = evaluation.MADE["stream_exact_dedup"][0](model).collect()
    assert len(found) == 200 and {r["n"] for r in found} == {1}
    model.fx_messages = model.fx_messages.where("false")
    assert evaluation.MADE["stream_exact_dedup"][0](model).count() == 0

"""The plans that queries are meant to have."""

import re


from flowframe import schema
from flowframe.operators import filters, temporal, timing
from flowframe.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"\bExchange (?:hash|range|Single)", text))


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(QUERIES["filter_pred"](spark, sf))
    assert re.search(r"PushedFilters: \[IsNotNull\(l_", text) and exchanges(text) == 0
    read = re.search(r"FileScan parquet \[([^\]]*)\]", text)[1]
    assert "l_quantity" in read and "l_extendedprice" not in read and "l_returnflag" not in read


def test_duplicates_deal_digests_with_partial_minima(spark, sf):
    docs = schema.from_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    text = plan(filters.drop_duplicates(docs).select("sequence"))
    assert "partial_min" in text
    assert not re.search(r"hashpartitioning\(payload", text)


def test_one_shuffle_for_as_of_and_timing(spark, sf):
    e = schema.from_events(spark.read.parquet(f"{sf}/events.parquet")).select("stream_id", "sequence", "pts", "value", "event_type")
    a, b = e.where("event_type = 'view'"), e.where("event_type = 'purchase'")
    assert exchanges(plan(temporal.asof(a, b, "pts", ["sequence"], ("stream_id",)))) == 1
    assert exchanges(plan(timing.rate_limit(e, 10))) == 1
    assert exchanges(plan(timing.throttle(e, 10))) == 1
    pairs = plan(temporal.tolerance_pairs(a, b, "pts", 1000, ("stream_id",)))
    assert "NestedLoop" not in pairs and "Cartesian" not in pairs


def test_first_rows_are_limited_before_the_shuffle(spark, sf):
    e = schema.from_events(spark.read.parquet(f"{sf}/events.parquet"))
    text = plan(filters.first_n(e.select("stream_id", "sequence"), 3))
    assert text.count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan(QUERIES["take_n"](spark, sf))


def test_no_python_outside_scans_and_kernels(spark, sf):
    for name in ("map_project", "batch_count", "chunk_bytes", "debounce", "timeout_gaps", "tjoin_nearest", "mux_slots", "jitter_reorder", "rtp_loss"):
        assert not re.search("Arrow|Python|Pandas", plan(QUERIES[name](spark, sf))), name



"""Sequential operators against plain loops on random input."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowframe import schema
from flowframe.operators import rtp, temporal, timing
from flowframe.plans import scan
from flowframe.plans.scan import annotate, annotate_spread, stream_index, with_index


def frame(spark, rows, columns):
    return schema.complete(spark.createDataFrame(rows, columns))


def test_greedy_matching(spark):
    rng = random.Random(3)
    rows = {side: sorted((rng.randrange(400), i) for i in range(60)) for side in "lr"}
    left, right = (spark.createDataFrame([(t, i) for t, i in rows[s]], "pts bigint, sequence bigint") for s in "lr")
    for nearest, f in ((False, temporal.tolerance), (True, temporal.nearest)):
        free, expected = list(rows["r"]), []
        for t, i in rows["l"]:
            fits = [r for r in free if abs(r[0] - t) <= 9]
            if fits:
                best = min(fits, key=lambda r: abs(r[0] - t)) if nearest else fits[0]
                free.remove(best)
                expected.append((i, best[1]))
        found = f(left, right, "pts", 9).collect()
        assert sorted((r["left"]["sequence"], r["right"]["sequence"]) for r in found) == sorted(expected)


def plain_matches(lefts, rights, tolerance, nearest):
    free, expected = list(rights), []
    for n, t in enumerate(lefts):
        fits = [(u, k) for u, k in free if abs(u - t) <= tolerance]
        if fits:
            best = min(fits, key=lambda r: abs(r[0] - t)) if nearest else fits[0]
            free.remove(best)
            expected.append((n, best[1]))
    return expected


def test_greedy_steps():
    rng = random.Random(4)
    for case in range(60):
        n, span, tolerance = rng.choice((0, 1, 30, 400)), rng.choice((5, 300, 4000)), rng.choice((0, 3, 40))
        lefts, rights = (sorted(rng.randrange(span) for _ in range(rng.choice((0, n, 2 * n)))) for _ in "lr")
        rows = sorted([(t, 0) for t in lefts] + [(t, 1) for t in rights])
        for nearest in (False, True):
            step = temporal._greedy(tolerance, nearest)()
            found = [p for i, (t, side) in enumerate(rows) for p in step(t, side, i == len(rows) - 1)[0]]
            assert [(p["l"], p["r"]) for p in found] == plain_matches(lefts, [(t, k) for k, t in enumerate(rights)], tolerance, nearest), (case, nearest)


def test_greedy_scans_once(spark):
    left, right = (spark.createDataFrame([(None, 1, t, i) for i, t in enumerate((5, 9, None))], "k int, _n int, pts bigint, sequence bigint") for _ in "lr")
    out = temporal.nearest(left, right, "pts", 1, ["k"])
    assert sorted((r["left"]["pts"], r["right"]["pts"]) for r in out.collect()) == [(5, 5), (9, 9)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_throttle_many_streams(spark):
    rng = random.Random(5)
    rows = [(s, i, t) for s in range(5) for i, t in enumerate(sorted(rng.randrange(1000) for _ in range(80)))]
    expected = set()
    for s in range(5):
        last = None
        for _, i, t in (r for r in rows if r[0] == s):
            if last is None or t - last >= 30:
                last = t
                expected.add((s, i))
    out = timing.throttle(frame(spark, rows, "stream_id int, sequence bigint, pts bigint").repartition(7), 30)
    assert {(r["stream_id"], r["sequence"]) for r in out.collect()} == expected


def test_scan_without_rows_and_null_keys(spark):
    def make():
        n = 0

        def step() -> tuple:
            nonlocal n
            n += 1
            return (n,)

        return step

    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "stream_id int, sequence bigint")
    assert sorted(r["n"] for r in annotate(df, make, [], "n int").collect()) == [1, 1, 2]
    assert annotate(df.where("sequence > 9"), make, [], "n int").collect() == []


def test_with_index(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 as v").repartition(8)
    assert all(r["v"] == r["index"] for r in with_index(df, ["v"]).collect())


def test_stream_index_spread(spark):
    rng = random.Random(6)
    rows = [(s, i) for s in (None, 1, 1, 1, 1, 2) for i in rng.sample(range(10_000), 120)]
    rows = list({(s, i) for s, i in rows})
    df = spark.createDataFrame(rows, "stream_id int, sequence bigint").repartition(5)
    plain = {tuple(r) for r in stream_index(df, ["stream_id"], ["sequence"]).collect()}
    assert {tuple(r) for r in stream_index(df, ["stream_id"], ["sequence"], spread=True).collect()} == plain


def plain_extended(numbers, bits):
    circle, highest, out = 1 << bits, None, []
    for x in numbers:
        if x is None:
            out.append(None)
            continue
        highest = x if highest is None else highest
        ahead = (x - highest) % circle
        highest += ahead if ahead < circle // 2 else 0
        out.append(highest - (highest - x) % circle)
        out[-1] += circle if out[-1] < 0 else 0
    return out


def numbers(rng, n, bits):
    """Numbers in order, disordered, going back, or jumping by half a circle."""
    circle, x, out = 1 << bits, rng.randrange(1 << bits), []
    steps = rng.choice((range(max(2, circle // 8)), range(-max(1, circle // 16), max(2, circle // 8)), range(-2, 1), (0, 1, circle // 2 - 1, circle // 2, circle // 2 + 1), range(circle)))
    for _ in range(n):
        x = (x + rng.choice(steps)) % circle
        out.append(x if rng.random() < 0.95 else None)
    return out


def test_extension_from_summaries():
    rng = random.Random(8)
    for case in range(800):
        bits, n = rng.choice((2, 3, 4, 6, 16, 32)), rng.choice((1, 5, 60, 300))
        values = numbers(rng, n, bits)
        cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(rng.randrange(8)))})
        extended, state, found = rtp.Extended(bits, "x"), None, []
        for a, b in zip(cuts, cuts[1:]):
            middle, summary, inside = rng.randrange(a, b), None, state
            for c, d in ((a, middle), (middle, b)):
                block = [pa.array(values[c:d], pa.int64())]
                summary = extended.summarise(block, summary)
                out, inside = extended.run(block, inside)
                found += out[0].to_pylist()
            state = extended.carry(state, summary)
            assert state == inside, case
        assert found == plain_extended(values, bits), case


def test_lift_for_every_state():
    rng = random.Random(9)
    for _ in range(500):
        bits = rng.choice((1, 2, 3, 4, 5))
        values = [rng.randrange(1 << bits) for _ in range(rng.randrange(1, 8))]
        lift = rtp.Lift(bits)
        lift.add(np.array(values))
        for start in range(3 << bits):
            highest = start
            for x in values:
                ahead = (x - highest) % (1 << bits)
                highest += ahead if ahead < 1 << bits - 1 else 0
            assert lift.after(start) == highest


def spread_rows(spark, f):
    """What ``f`` gives, and in how many partitions rows of stream 1 are; small partitions are left as they are."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        rows = f().withColumn("_at", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset(name)
    return rows, len({r["_at"] for r in rows if r["stream_id"] == 1})


def test_annotate_spread(spark):
    rng = random.Random(10)
    streams = {s: numbers(rng, n, 32) for s, n in ((None, 3), (0, 2), (1, 4000), (2, 1), (3, 500))}
    rows = [(s, i, x) for s, values in streams.items() for i, x in enumerate(values)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "stream_id int, sequence bigint, n bigint").repartition(7)
    found, tasks = spread_rows(spark, lambda: annotate_spread(df, rtp.Extended(32, "x"), [F.col("n")]))
    expected = {(s, i, x) for s, values in streams.items() for i, x in enumerate(plain_extended(values, 32))}
    assert len(found) == len(rows) and {(r["stream_id"], r["sequence"], r["x"]) for r in found} == expected
    assert tasks > 1
    assert annotate_spread(df.where("sequence < 0"), rtp.Extended(32, "x"), [F.col("n")]).collect() == []


def test_long_stream_of_numbers_is_shared(spark):
    rng = random.Random(11)
    streams = {1: numbers(rng, 6000, 16), 2: numbers(rng, 30, 16), None: numbers(rng, 7, 16)}
    rows = [(s, i, x) for s, values in streams.items() for i, x in enumerate(values)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "stream_id int, sequence bigint, seq int").repartition(5)

    def falls(values):
        out, last, cycles = [], None, 0
        for x in values:
            cycles += None not in (last, x) and last - x > 0x8000
            out.append(None if x is None else cycles * 65536 + x)
            last = x
        return out

    for extend, plain in ((rtp.extend_sequence, lambda v: plain_extended(v, 16)), (rtp.extend_sequence_in_order, falls)):
        found, tasks = spread_rows(spark, lambda: extend(df))
        expected = {(s, i, x) for s, values in streams.items() for i, x in enumerate(plain(values))}
        assert len(found) == len(rows) and {(r["stream_id"], r["sequence"], r["ext_seq"]) for r in found} == expected
        assert tasks > 1


def test_long_stream_is_reordered_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK_BITS", 5)
    rng = random.Random(12)
    streams = {s: [None if rng.random() < 0.01 else i * 2 + rng.randrange(-40, 40) for i in range(n)] for s, n in ((1, 5000), (2, 40), (None, 9))}
    rows = [(s, i, x) for s, values in streams.items() for i, x in enumerate(values)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "stream_id int, sequence bigint, ext_seq bigint").repartition(5)
    for drop_late in (False, True):
        expected = set()
        for s, values in streams.items():
            high, seen, kept = None, set(), []
            for i, x in enumerate(values):
                late = None not in (high, x) and high - x > 30
                if x not in seen and not (late and drop_late):
                    seen.add(x)
                    kept.append((x, i, None not in (high, x) and x < high, late))
                high = x if high is None else high if x is None else max(high, x)
            before = None
            for x, i, reordered, late in sorted(kept, key=lambda r: (r[0] is not None, r[0])):
                expected.add((s, i, x, reordered, late, 0 if None in (x, before) else x - before - 1))
                before = x
        found, tasks = spread_rows(spark, lambda: rtp.reorder(df, drop_late=drop_late, window=30))
        assert {(r["stream_id"], r["sequence"], r["ext_seq"], r["reordered"], r["late"], r["lost_before"]) for r in found} == expected
        assert len(found) == len(expected) and tasks > 1

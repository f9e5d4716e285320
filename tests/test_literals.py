"""Small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from flowframe import schema
from flowframe.functions import caps, clock, tags
from flowframe.functions import media as sizes
from flowframe.operators import filters, flow, media, meta, payload, rtp, segment, temporal, timing, typed
from flowframe.queries import QUERIES
from flowframe.sources import generators

MS = 1_000_000


def values(df, column="value"):
    return [r[column] for r in df.collect()]


def numbers(spark, first, last):
    return typed.range_(spark, first, last + 1)


def buffers(spark, rows, columns="payload string, sequence bigint"):
    df = spark.createDataFrame(rows, columns)
    if "payload" in df.columns:
        df = df.withColumn("payload", F.col("payload").cast("binary"))
    df = schema.complete(df)
    return df.withColumn("stream_id", F.coalesce("stream_id", F.lit(0)))


def payloads(df, order="sequence"):
    return [bytes(r["payload"]).decode() for r in df.orderBy(order).collect()]


def test_map_filter_chain(spark):
    v = F.col("value")
    assert values(typed.map_(numbers(spark, 1, 5), (v * v).alias("value"))) == [1, 4, 9, 16, 25]
    assert values(typed.filter_(numbers(spark, 1, 10), v % 3 == 0)) == [3, 6, 9]
    halves = typed.filter_(numbers(spark, 1, 20), v % 2 == 0).select((v / 2).cast("int").alias("value"))
    assert values(typed.filter_(halves, v > 5)) == [6, 7, 8, 9, 10]
    assert values(typed.filter_(numbers(spark, 1, 5), v % 2 == 0).select((v * 10).alias("value"))) == [20, 40]


def test_take_skip(spark):
    assert values(typed.take(numbers(spark, 1, 100), 5, "value")) == [1, 2, 3, 4, 5]
    assert sorted(values(typed.skip(numbers(spark, 1, 10), 7, "value"))) == [8, 9, 10]
    assert sorted(values(typed.skip(numbers(spark, 1, 3), 0, "value"))) == [1, 2, 3]
    assert values(typed.skip(numbers(spark, 1, 3), 9, "value")) == []


def test_filter_map(spark):
    df = typed.from_iter(spark, [("1",), ("two",), ("3",), ("four",), ("5",)], "s string")
    assert values(typed.filter_map(df, s=F.expr("try_cast(s as int)")), "s") == [1, 3, 5]


def test_merge_zip_join(spark):
    odd, even = (typed.from_iter(spark, [(x,) for x in v], "value int") for v in ((1, 3, 5), (2, 4, 6)))
    assert values(typed.merge(odd, even, "value").orderBy("position")) == [1, 2, 3, 4, 5, 6]
    longer = typed.from_iter(spark, [(x,) for x in (1, 3, 5, 7)], "value int")
    assert values(typed.merge(longer, even.limit(1), "value").orderBy("position")) == [1, 2, 3, 5, 7]
    letters = typed.from_iter(spark, [("a",), ("b",), ("c",)], "letter string")
    pairs = typed.zip_(letters, numbers(spark, 1, 3), ["letter"], ["value"])
    assert sorted((r["letter"], r["value"]) for r in pairs.collect()) == [("a", 1), ("b", 2), ("c", 3)]
    assert typed.zip_(numbers(spark, 1, 5), letters.limit(2), ["value"], ["letter"]).count() == 2
    users = typed.from_iter(spark, [(1, "Alice"), (2, "Bob")], "id int, name string")
    orders = typed.from_iter(spark, [(2, 100), (1, 50)], "user_id int, amount int")
    joined = typed.join(users, orders, "id", "user_id")
    assert sorted((r["name"], r["amount"]) for r in joined.collect()) == [("Alice", 50), ("Bob", 100)]


def timed(spark, rows):
    return spark.createDataFrame([(t * MS, v, i) for i, (t, v) in enumerate(rows)], "pts bigint, v string, sequence bigint")


def pairs(df):
    return sorted((r["left"]["v"], r["right"]["v"]) for r in df.collect())


def test_temporal_joins(spark):
    a = timed(spark, [(100, "A"), (200, "B"), (300, "C")])
    assert pairs(temporal.temporal_join(a, timed(spark, [(100, "1"), (200, "2"), (300, "3")]), "pts", 10 * MS)) == [("A", "1"), ("B", "2"), ("C", "3")]
    assert pairs(temporal.tolerance(a, timed(spark, [(95, "1"), (210, "2")]), "pts", 15 * MS)) == [("A", "1"), ("B", "2")]
    both = temporal.exact(timed(spark, [(100, "1"), (150, "x")]), timed(spark, [(100, "10")]), "pts", "sequence", "sequence")
    assert sorted(r["outcome"] for r in both.collect()) == ["left_only", "matched"]
    near = timed(spark, [(92, "far"), (99, "near")])
    assert pairs(temporal.tolerance(a.limit(1), near, "pts", 10 * MS)) == [("A", "far")]
    assert pairs(temporal.nearest(a.limit(1), near, "pts", 10 * MS)) == [("A", "near")]
    b = spark.createDataFrame([(0, 0.0), (400 * MS, 4.0)], "pts bigint, value double")
    assert [r["interpolated_value"] for r in temporal.interpolate(a, b, "pts", "value").orderBy("pts").collect()] == [1.0, 2.0, 3.0]


def test_segments(spark):
    s = 1_000_000_000

    def cuts(rows):
        df = buffers(spark, [(int(t * s), int(k), i) for i, (t, k) in enumerate(rows)], "pts bigint, flags int, sequence bigint")
        return [r["cut"] for r in segment.cut_segments(df).orderBy("sequence").collect()]

    assert cuts([(0, True), (3, True), (5.5, True)]) == [False, False, True]
    assert cuts([(0, True), (13, False)]) == [False, True]
    text = segment.playlist([{"segment": 4, "duration": 6 * s}, {"segment": 5, "duration": 5_500_000_000}], 6)
    assert "#EXT-X-MEDIA-SEQUENCE:4" in text and "#EXTINF:5.500," in text and text.endswith("#EXT-X-ENDLIST\n")


def test_filters(spark):
    df = buffers(spark, [("hello", 0), ("world", 1), ("hello", 2)])
    assert payloads(filters.drop_duplicates(df)) == ["hello", "world"]
    assert payloads(filters.every_nth(df, 0)) == ["hello", "world", "hello"]
    assert payloads(filters.every_nth(df, 2)) == ["hello", "hello"]
    assert payloads(filters.by_regex(df, "^w")) == ["world"]
    assert payloads(filters.by_regex(df, "^w", inverted=True)) == ["hello", "hello"]
    assert payloads(filters.by_size(df, 6)) == []
    assert payloads(filters.valve(df, False)) == []
    for bad in ("(", "(?=a)", r"(a)\1"):
        with pytest.raises(ValueError):
            filters.by_regex(df, bad)


def test_exact_sample(spark):
    df = buffers(spark, [("x", i) for i in range(300)])
    state, kept = 0x853C49E6748FEA9B, []
    for i in range(300):
        state ^= (state << 13) % 2**64
        state ^= state >> 7
        state ^= (state << 17) % 2**64
        if state % 100 < 40:
            kept.append(i)
    assert values(filters.random_percent_exact(df, 40).orderBy("sequence"), "sequence") == kept


def test_payloads(spark):
    df = buffers(spark, [("hello world", 0), ("abc", 1), ("", 2)])
    assert payloads(payload.trim(df, 5)) == ["hello", "abc", ""]
    assert payloads(payload.slice_(df, 4, 3)) == ["o w", "", ""]
    assert payloads(payload.slice_(df, 4, 3, skip_short=True)) == ["o w"]
    assert payloads(payload.pad(df, 4, ord("."))) == ["hello world", "abc.", "...."]
    assert payloads(payload.split(df, " ")) == ["hello", "world", "abc"]
    assert payloads(payload.split(df, " ", True)) == ["hello ", "world", "abc"]
    assert payloads(payload.split(df, "")) == ["hello world", "abc", ""]
    assert payloads(payload.join_with(df, "-"), "batch") == ["hello world-abc-"]
    assert payloads(payload.chunk(df, 4)) == ["hell", "o wo", "rlda", "bc"]
    assert payloads(payload.chunk(df, 4, flush_tail=False)) == ["hell", "o wo", "rlda"]
    assert payloads(payload.batch(df, bytes_=5), "batch") == ["hello world", "abc"]
    assert payloads(payload.concat_by_size(buffers(spark, [(x, i) for i, x in enumerate(("aa", "bbb", "c", "dddddd", "e"))]), 4), "batch") == ["aa", "bbbc", "dddddd", "e"]
    parts = payload.unbatch(df, 4).orderBy("payload").collect()
    assert sorted((bytes(r["payload"]).decode(), r["sequence"]) for r in parts) == [("abc", 0), ("hell", 0), ("o wo", 1), ("rld", 2)]


def test_metadata(spark):
    df = buffers(spark, [("a", 999), ("b", 888), ("c", 777)])
    assert sorted(values(meta.sequence_number(df), "sequence")) == [0, 1, 2]
    assert meta.timestamper(df, "preserve").where("pts is not null").count() == 0
    assert meta.timestamper(df, "pts_only").where("pts is not null and dts is null").count() == 3
    rows = [(0, 0), (1, 10), (2, 20), (3, 15), (4, 100), (5, None)]
    marked = meta.timestamp_debug(buffers(spark, rows, "sequence bigint, pts bigint")).orderBy("sequence")
    assert values(marked, "status") == ["OK", "OK", "OK", "BACKWARDS_PTS", "DISCONTINUITY", "MISSING_PTS"]


def test_timing(spark):
    df = buffers(spark, [(i, t) for i, t in enumerate((0, 1, 5, 6, 30))], "sequence bigint, pts bigint")
    assert sorted(values(timing.throttle(df, 5), "pts")) == [0, 5, 30]
    assert sorted(values(timing.debounce(df, 4), "pts")) == [1, 6, 30]
    assert sorted(values(timing.timeout(df, 8), "pts")) == [14, 22]
    assert values(timing.rate_limit(df, 4).orderBy("sequence"), "departure") == [0, 4, 8, 12, 30]
    assert values(timing.delay(df, 4).orderBy("sequence"), "departure") == [4, 8, 12, 16, 34]
    held = timing.queue(buffers(spark, [(i, 0) for i in range(5)], "sequence bigint, pts bigint"), 2, 100)
    assert [r["outcome"] for r in held.orderBy("sequence").collect()].count("dropped") == 2
    full = buffers(spark, [("abcd", 0, 0), ("ef", 1, 0), ("gh", 2, 0), ("ijk", 3, 0), ("l", 4, 0)], "payload string, sequence bigint, pts bigint")
    by_bytes = timing.queue(full, 10, 100, "downstream", most_bytes=4).orderBy("sequence").collect()
    assert [(r["depth"], r["all_evicted"]) for r in by_bytes] == [(1, []), (1, []), (2, []), (2, [1]), (2, [2])]
    waits = timing.queue(full, 1, 100, "none").orderBy("sequence").collect()
    assert [(r["outcome"], r["entered"]) for r in waits] == [("queued", t) for t in (0, 0, 100, 200, 300)]
    sized = buffers(spark, [("x" * 600, 0), ("y" * 600, 1)]).withColumn("pts", F.lit(0).cast("bigint"))
    assert values(timing.rate_limit_bytes(sized, 1000).orderBy("sequence"), "departure") == [0, 200_000_000]


def test_rtp(spark):
    one = spark.range(1).select(rtp.timestamp_to_clock(F.lit(90000)).alias("ns"), rtp.clock_to_timestamp(F.lit(1_000_000_000)).alias("ts"), rtp.next_seq(F.lit(65535)).alias("n"))
    assert one.first() == (1_000_000_000, 90000, 0)
    seqs = [65533, 65535, 65534, 0, 2, 1, 1]
    df = buffers(spark, list(enumerate(seqs)), "sequence bigint, seq int")
    extended = rtp.extend_sequence(df).orderBy("sequence")
    assert values(extended, "ext_seq") == [65533, 65535, 65534, 65536, 65538, 65537, 65537]
    ordered = rtp.reorder(rtp.extend_sequence(df)).orderBy("ext_seq")
    assert values(ordered, "ext_seq") == [65533, 65534, 65535, 65536, 65537, 65538]
    info = rtp.loss_info(rtp.extend_sequence(df)).first()
    assert (info["expected"], info["received"], info["lost"]) == (6, 7, 0)


def test_rtp_header_wraps(spark, tmp_path):
    rows = [(65536 + 7, (1 << 32) + 3000, -1, 96, True), (7, 3000, 5, 127, False)]
    fields = spark.createDataFrame([(r, b"ab") for r in rows], "rtp struct<seq:int,ts:bigint,ssrc:bigint,pt:int,marker:boolean>, payload binary")
    packets = rtp.build_packet(fields).select(F.col("packet").alias("payload"))
    back = rtp.parse_header(packets).orderBy("rtp.ssrc").collect()
    assert [(tuple(r["rtp"]), bytes(r["payload"])) for r in back] == [((7, 3000, 5, 127, False), b"ab"), ((7, 3000, (1 << 32) - 1, 96, True), b"ab")]

    # two wraps of the time; the query's SQL says event_id * 3000
    spark.range(0, 4_000_000, 400_000).selectExpr("id as event_id", "timestamp'2024-01-01' as ts", "id % 3 as user_id", "'view' as event_type", "1.0 as value", "'{}' as props").write.parquet(str(tmp_path / "events.parquet"))
    found = QUERIES["rtp_header"](spark, str(tmp_path)).collect()
    assert len(found) == 10 and all(r["rts"] == r["sequence"] * 3000 for r in found)


def test_clock_scalars_and_attitude(spark):
    ns, none = F.lit(7).cast("bigint"), F.lit(None).cast("bigint")
    row = spark.range(1).select(
        clock.saturating_mul(ns, 3), clock.saturating_mul(ns, clock.MAX), clock.saturating_mul(none, 3), clock.checked_div(ns, 2), clock.checked_div(ns, 0), clock.checked_div(none, 2), clock.saturating_sub(none, ns)
    )
    assert tuple(row.first()) == (21, clock.MAX, None, 3, None, None, None)
    degrees = spark.createDataFrame([(-1000.0,), (0.0,), (45.0,), (20000.0,), (None,)], "x double")
    found = degrees.select(sizes.altitude(F.col("x")), sizes.heading(F.col("x")), sizes.pitch(F.col("x")), sizes.roll(F.col("x")), sizes.latitude(F.col("x")).isNull()).collect()
    # 900 / 19,900, 945 / 19,900 of 65,535; 45 / 360 of 65,535; 45 / 90 of 32,767
    assert [tuple(r) for r in found] == [
        (0, 0, -32767, -32767, False), (2964, 0, 0, 0, False), (3112, 8192, 16384, 16384, False), (65535, 65535, 32767, 32767, False), (None, None, None, None, True)
    ]


def test_clock_caps_tags(spark):
    row = spark.range(1).select(clock.display(F.lit(1_500_000_000).cast("bigint")), clock.saturating_sub(F.lit(1), F.lit(2)), clock.checked_sub(F.lit(1), F.lit(2))).first()
    assert tuple(row) == ("1.500s", 0, None)
    a, b = caps.list_("I420", "Rgb24"), caps.list_("Rgb24", "I420")
    assert a.intersect(b).options == ("I420", "Rgb24")
    assert caps.range_(1, 10).intersect(caps.range_(5, 20)).fixate() == 5
    assert caps.fixed(3).intersect(caps.range_(4, 9)) is None and caps.ANY.fixate() is None
    video = caps.Caps("video", {"format": a, "width": caps.range_(1, 4096)})
    assert caps.negotiate([video], [caps.Caps("audio"), caps.Caps("video", {"width": caps.fixed(640)})]).fixate() == {"media": "video", "format": "I420", "width": 640}
    assert caps.cheapest_path("a", "c", {("a", "b"): ("x", 3), ("b", "c"): ("y", 5), ("a", "c"): ("z", 20)}) == (["x", "y"], 8)
    old, new = F.create_map(F.lit("t"), F.lit("old"), F.lit("a"), F.lit("x")), F.create_map(F.lit("t"), F.lit("new"), F.lit("l"), F.lit("en"))
    for mode, expected in {"replace": {"t": "new", "l": "en"}, "append": {"a": "x", "t": "new", "l": "en"}, "keep": {"t": "old", "a": "x", "l": "en"}, "replace_matching": {"a": "x", "t": "new"}}.items():
        assert spark.range(1).select(tags.merge(old, new, mode)).first()[0] == expected


def test_media_kernels():
    import numpy as np

    x = media.decode(np.array([0, 16384, -32768], "<i2").tobytes(), "S16LE")
    assert x.tolist() == [0.0, 0.5, -1.0]
    assert np.frombuffer(media.encode(np.array([2.0, -2.0]), "S16LE"), "<i2").tolist() == [32767, -32767]
    assert media.mix(np.array([1.0, 0.0]), 2, 1).tolist() == [0.5]
    assert media.resample(np.array([0.0, 1.0]), 1, 2).tolist() == [0.0, 0.5, 1.0, 1.0]
    grey = np.full((4, 4, 3), 128, np.uint8)
    assert np.abs(media.i420_to_rgb(media.rgb_to_i420(grey), 4, 4).astype(int) - 128).max() <= 1
    assert media.scale(grey, 2, 2).shape == (2, 2, 3)
    assert [media.ber_length(n).hex() for n in (5, 128, 300)] == ["05", "8180", "82012c"]
    packed = media.klv(b"k" * 16, b"v" * 200) + media.klv(b"m" * 16, b"")
    assert list(media.read_klv(packed)) == [(b"k" * 16, b"v" * 200), (b"m" * 16, b"")]
    units = b"\0\0\0\1abc\0\0\1de"
    assert media.annexb_units(media.avcc_to_annexb(media.annexb_to_avcc(units))) == [b"abc", b"de"]


def test_file_source(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"0123456789")
    (tmp_path / "b.bin").write_bytes(b"xyz")
    rows = generators.file_source(spark, str(tmp_path), 4).orderBy("stream_id", "sequence").collect()
    assert [(r["stream_id"], r["offset"], bytes(r["payload"])) for r in rows] == [(0, 0, b"0123"), (0, 4, b"4567"), (0, 8, b"89"), (1, 0, b"xyz")]


def test_mux(spark):
    video = buffers(spark, [(i, t * MS) for i, t in enumerate((0, 40, 80, 120))], "sequence bigint, pts bigint")
    audio = buffers(spark, [(i, t * MS) for i, t in enumerate((10, 45))], "sequence bigint, pts bigint")
    muxed = flow.mux({"video": video, "audio": audio}, 40 * MS)
    assert [(r["pad"], r["slot"]) for r in muxed.orderBy("slot", "pts").collect()] == [("video", 0), ("audio", 1), ("video", 1), ("audio", 2), ("video", 2), ("video", 3)]

    def slots(*how, **more):
        return sorted(r["slot"] for r in flow.ready_slots(muxed, *how, **more).collect())

    both = ["video", "audio"]
    assert slots(both) == slots(both, "timed") == slots(both, "loose", video="video") == [0, 1, 2, 3]
    assert slots(both, ended=[]) == [0, 1, 2] and slots(both, ended=["audio"]) == [0, 1, 2, 3]
    assert slots(["video", "text"], ended=[]) == [] and slots(both, "loose", video="audio") == [1, 2]


def test_bytes_that_are_no_text(spark):
    from flowframe.operators import filters, payload

    raw = [b"a\xff,b\xfe", b"\xc3\xa9\\E,x", b"\x00\xff"]
    df = spark.createDataFrame([(0, k, bytearray(x)) for k, x in enumerate(raw)], "stream_id int, sequence long, payload binary")
    found = [bytes(r["payload"]) for r in payload.split(df, ",").orderBy("sequence").collect()]
    assert found == [b"a\xff", b"b\xfe", b"\xc3\xa9\\E", b"x", b"\x00\xff"]
    found = [bytes(r["payload"]) for r in payload.split(df, b"\xff", True).orderBy("sequence").collect()]
    assert found == [b"a\xff", b",b\xfe", b"\xc3\xa9\\E,x", b"\x00\xff"]
    assert [bytes(r["payload"]) for r in payload.split(df, "\\E").orderBy("sequence").collect()][1:3] == [b"\xc3\xa9", b",x"]
    assert [r["sequence"] for r in filters.by_regex(df, "^a\ufffd,").collect()] == [0]
    assert [r["sequence"] for r in filters.by_regex(df, "\u00e9").collect()] == [1]


def test_duplicates_within_streams(spark):
    from flowframe.operators import filters

    rows = [(1, 1, b"x"), (1, 2, b"x"), (2, 2, b"x"), (2, 3, b"x"), (None, 2, b"x"), (None, 5, b"y"), (3, 1, b"x"), (3, None, None), (4, 9, None)]
    df = spark.createDataFrame([(s, q, None if p is None else bytearray(p)) for s, q, p in rows], "stream_id int, sequence long, payload binary")
    keep = lambda d: sorted(((r["stream_id"], r["sequence"]) for r in d.collect()), key=str)
    found = keep(filters.drop_duplicates(df, partition_by=("stream_id",)))
    assert found == sorted([(1, 1), (2, 2), (None, 2), (None, 5), (3, 1), (3, None), (4, 9)], key=str)
    assert keep(filters.drop_duplicates(df)) == sorted([(1, 1), (None, 5), (3, None)], key=str)

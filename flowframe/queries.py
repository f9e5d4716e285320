"""Queries over the test tables, one or more for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowframe import schema
from flowframe.functions import clock, flags, media, tags, timerange
from flowframe.operators import filters, flow, meta, payload, rtp, segment, temporal, timing, typed
from flowframe.operators import media as kernels
from flowframe.plans.builder import Pipeline
from flowframe.sources import generators
from flowframe.streaming import operators as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

MINUTE, HOUR = 60_000_000_000, 3_600_000_000_000
#: Events as buffers, in SQL.
E = """e as (select cast(user_id as int) as stream_id, event_id as sequence, epoch_us(ts) * 1000 as pts,
  case when event_type = 'purchase' then 1 else 0 end as flags, props as payload, event_type, value, ts from events)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return schema.from_events(table(spark, sf, "events"))


def text(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns with the payload as text."""
    return df.select(*(F.col(c).cast("string").alias(c) if c == "payload" else F.col(c) for c in columns))


# --- sources, sinks, folds


@query("select cast(range as bigint) as value from range(10, 1000)")
def source_range(spark, sf):
    return typed.range_(spark, 10, 1000)


@query("select 7 as number, 'only' as word")
def source_once(spark, sf):
    return typed.once(spark, number=7, word="only")


@query("select cast(range * range as bigint) as value from range(0, 100) where range * range < 2500")
def source_repeat_with(spark, sf):
    return typed.repeat_with(spark, 100, lambda i: F.when(i * i < 2500, i * i))


@query("select * from (values (1, 'a'), (2, 'b'), (3, 'c')) t(number, word)")
def source_from_iter(spark, sf):
    return typed.from_iter(spark, [(1, "a"), (2, "b"), (3, "c")], "number int, word string")


@query("select user_id, cast(list_reduce(list_prepend(cast(7 as bigint), list(event_id order by ts, event_id)), lambda a, x: (a * 31 + x) % 1000003) as bigint) as folded from events group by user_id")
def fold_ordered(spark, sf):
    return typed.fold(table(spark, sf, "events"), F.col("event_id"), F.lit(7).cast("long"), lambda a, x: (a * 31 + x) % 1000003, ("ts", "event_id"), ("user_id",))


def _hashing():
    state = 7

    def step(x: int) -> int:
        nonlocal state
        state = (state * 31 + x) % 1000003
        return state

    return step


@query(ORACLE_SQL["fold_ordered"])
def fold_stream(spark, sf):
    return typed.fold_stream(table(spark, sf, "events"), F.col("event_id"), _hashing, "bigint", ("ts", "event_id"), ("user_id",))


@query("select event_type, count(*) as n, round(sum(value), 4) as total, min(value) as least, max(value) as most from events group by event_type")
def fold_sum(spark, sf):
    e = table(spark, sf, "events")
    return typed.summarise(e, ("event_type",), n=F.count("*"), total=F.round(F.sum("value"), 4), least=F.min("value"), most=F.max("value"))


@query("select 'all' as what, count(*) as n_buffers, cast(sum(strlen(props)) as bigint) as n_bytes from events")
def identity_stats(spark, sf):
    return events(spark, sf).agg(F.count("*").alias("n_buffers"), F.sum(filters.size()).alias("n_bytes")).select(F.lit("all").alias("what"), "n_buffers", "n_bytes")


# --- map, filter, take


@query("select event_id, round(value * value, 6) as squared, upper(event_type) as kind from events")
def map_project(spark, sf):
    return typed.map_(table(spark, sf, "events"), "event_id", F.round(F.col("value") * F.col("value"), 6).alias("squared"), F.upper("event_type").alias("kind"))


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_shipdate >= timestamp '1996-01-01' and l_discount between 0.03 and 0.07 and l_quantity < 24")
def filter_pred(spark, sf):
    kept = typed.filter_(table(spark, sf, "lineitem"), (F.col("l_shipdate") >= "1996-01-01") & F.col("l_discount").between(0.03, 0.07) & (F.col("l_quantity") < 24))
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query("select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events where try_cast(json_extract_string(props, '$.k') as int) is not null")
def filter_map_cast(spark, sf):
    e = table(spark, sf, "events")
    return typed.filter_map(e, k=F.expr("try_cast(get_json_object(props, '$.k') as int)")).select("event_id", "k")


@query("select event_id / 2 as half from events where event_id % 2 = 0 and event_id / 2 > 5")
def chain_even_half(spark, sf):
    e = typed.filter_(table(spark, sf, "events"), F.col("event_id") % 2 == 0)
    return typed.filter_(e.select((F.col("event_id") / 2).alias("half")), F.col("half") > 5)


@query("select event_id, event_type from events order by event_id limit 25")
def take_n(spark, sf):
    return typed.take(table(spark, sf, "events"), 25, "event_id").select("event_id", "event_type")


@query("select event_id, event_type from events order by event_id offset 40")
def skip_n(spark, sf):
    return typed.skip(table(spark, sf, "events"), 40, "event_id").select("event_id", "event_type")


@query(f"with {E}, r as (select *, row_number() over (partition by stream_id order by sequence) - 1 as i from e) select stream_id, sequence from r where i % 3 = 0")
def sample_every_nth(spark, sf):
    return filters.every_nth(events(spark, sf), 3).select("stream_id", "sequence")


@query(f"with {E}, r as (select *, row_number() over (partition by stream_id order by sequence) as i from e) select stream_id, sequence from r where i <= 5")
def sample_first_n(spark, sf):
    return filters.first_n(events(spark, sf), 5).select("stream_id", "sequence")


@query(f"with {E}, r as (select *, row_number() over (partition by stream_id order by sequence) as i from e) select stream_id, sequence from r where i > 5")
def sample_skip_first(spark, sf):
    return filters.skip_first(events(spark, sf), 5).select("stream_id", "sequence")


@query(f"""with recursive {E}, n as (select *, row_number() over (partition by stream_id order by sequence) as i from e), steps as (select max(i) as last from n),
d as (select 0 as i, {filters.XORSHIFT_SEED}::hugeint as state
union all select i + 1, xor(c, (c * 131072) % 18446744073709551616::hugeint) from (select i, xor(b, b // 128) as c from (select i, xor(state, (state * 8192) % 18446744073709551616::hugeint) as b from d)) where i < (select last from steps))
select stream_id, sequence from n join d using (i) where state % 100 < 30""")
def sample_random_exact(spark, sf):
    return filters.random_percent_exact(events(spark, sf), 30).select("stream_id", "sequence")


@query()
def sample_random(spark, sf):
    return filters.random_percent(events(spark, sf), 30).select("stream_id", "sequence")


@query("select cast(user_id as int) as stream_id, event_id as sequence from events where user_id = 3 and event_id between 10 and 900")
def metadata_filter(spark, sf):
    return filters.by_metadata(events(spark, sf), 3, 10, 900).select("stream_id", "sequence")


@query("select doc_id as sequence, cast(strlen(text) as int) as size from documents where strlen(text) between 300 and 2000")
def range_size(spark, sf):
    return filters.by_size(schema.from_documents(table(spark, sf, "documents")), 300, 2000).select("sequence", filters.size().alias("size"))


@query("select event_id as sequence from events where event_id between 100 and 300")
def range_sequence(spark, sf):
    return filters.by_sequence(events(spark, sf), 100, 300).select("sequence")


PATTERN = "[Tt]h(e|at) (an|in)[a-z]+"


@query(f"select doc_id as sequence from documents where regexp_matches(text, '{PATTERN}')")
def regex_match(spark, sf):
    return filters.by_regex(schema.from_documents(table(spark, sf, "documents")), PATTERN).select("sequence")


@query(f"select doc_id as sequence from documents where not regexp_matches(text, '{PATTERN}')")
def regex_invert(spark, sf):
    return filters.by_regex(schema.from_documents(table(spark, sf, "documents")), PATTERN, inverted=True).select("sequence")


@query("select doc_id as sequence from documents qualify row_number() over (partition by text order by doc_id) = 1")
def dedup_keep_first(spark, sf):
    return filters.drop_duplicates(schema.from_documents(table(spark, sf, "documents"))).select("sequence")


@query(f"with {E} select stream_id, sequence from e where ts < timestamp '2024-01-05' or (ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20')")
def valve_log(spark, sf):
    at = [(schema_ns("2024-01-05"), False), (schema_ns("2024-01-10"), True), (schema_ns("2024-01-20"), False)]
    log = spark.createDataFrame(at, "at bigint, open boolean")
    return filters.valve_log(events(spark, sf), log).select("stream_id", "sequence")


def schema_ns(day: str) -> int:
    from datetime import UTC, datetime

    return int(datetime.fromisoformat(day).replace(tzinfo=UTC).timestamp()) * 1_000_000_000


@query("select doc_id as sequence, upper(left(url, 12)) as payload from (select page_id as doc_id, url from pages) where url like 'https%'")
def filter_map_bytes(spark, sf):
    out = payload.filter_map_bytes(pages(spark, sf), lambda p: F.when(p.cast("string").startswith("https"), F.upper(F.substring(p.cast("string"), 1, 12)).cast("binary")))
    return text(out, "sequence", "payload")


def pages(spark, sf) -> DataFrame:
    p = table(spark, sf, "pages")
    return schema.complete(p.select(F.lit(0).alias("stream_id"), F.col("page_id").alias("sequence"), (F.col("page_id") * 1000).alias("pts"), F.lit(0).cast("long").alias("offset"), F.col("url").cast("binary").alias("payload")))


# --- payloads


@query("select page_id as sequence, left(url, 20) as payload from pages")
def trim(spark, sf):
    return text(payload.trim(pages(spark, sf), 20), "sequence", "payload")


@query("select page_id as sequence, substr(url, 11, 8) as payload, case when strlen(url) > 10 then cast(10 as bigint) else 0 end as \"offset\" from pages")
def slice_bytes(spark, sf):
    return text(payload.slice_(pages(spark, sf), 10, 8), "sequence", "payload", "offset")


@query("select page_id as sequence, substr(url, 36) as payload from pages where strlen(url) > 35")
def slice_skip_short(spark, sf):
    return text(payload.slice_(pages(spark, sf), 35, None, True), "sequence", "payload")


@query("select page_id as sequence, case when strlen(url) < 40 then rpad(url, 40, '.') else url end as payload from pages")
def pad(spark, sf):
    return text(payload.pad(pages(spark, sf), 40, ord(".")), "sequence", "payload")


@query("""with p as (select page_id, unnest(string_split(url, '/')) as part, generate_subscripts(string_split(url, '/'), 1) as k from pages)
select row_number() over (order by page_id, k) - 1 as sequence, part as payload from p where part <> ''""")
def split_delimiter(spark, sf):
    return text(payload.split(pages(spark, sf), "/"), "sequence", "payload")


@query("""with p as (select page_id, unnest(range(0, strlen(url), 16)) as b, url from pages)
select page_id as pts, b // 16 as sequence, substr(url, b + 1, 16) as payload, b as "offset" from p""")
def unbatch_chunks(spark, sf):
    out = payload.unbatch(pages(spark, sf), 16).withColumn("pts", (F.col("pts") / 1000).cast("long"))
    return text(out, "pts", "sequence", "payload", "offset")


BUCKETED = f"""with {E}, r as (select *, (row_number() over (partition by stream_id order by sequence) - 1) // %d as batch from e)
select stream_id, batch, string_agg(payload, '%s' order by sequence) as payload, count(*) as n_buffers from r group by stream_id, batch"""


@query(BUCKETED % (4, "|"))
def join_with_delim(spark, sf):
    return text(payload.join_with(events(spark, sf), "|", 4), "stream_id", "batch", "payload", "n_buffers")


@query(BUCKETED % (7, ""))
def batch_count(spark, sf):
    return text(payload.batch_by_count(events(spark, sf), 7), "stream_id", "batch", "payload", "n_buffers")


@query(BUCKETED % (5, "") + " having count(*) = 5")
def concat_count(spark, sf):
    return text(payload.concat_by_count(events(spark, sf), 5, flush_tail=False), "stream_id", "batch", "payload", "n_buffers")


STEPPED = f"""with recursive {E}, x as (select stream_id, sequence, pts, strlen(payload) as l, payload, row_number() over (partition by stream_id order by sequence) as i from e),
t(stream_id, i, b, acc, c, began) as (select stream_id, i, cast(0 as bigint), cast(l as bigint), cast(1 as bigint), pts from x where i = 1
 union all select x.stream_id, x.i, case when %(full)s then t.b + 1 else t.b end, case when %(full)s then x.l else t.acc + x.l end,
  case when %(full)s then 1 else t.c + 1 end, case when %(full)s then x.pts else t.began end from t join x on x.stream_id = t.stream_id and x.i = t.i + 1)
select stream_id, b as batch, string_agg(payload, '' order by sequence) as payload, count(*) as n_buffers from x join t using (stream_id, i) group by stream_id, b"""


@query(STEPPED % {"full": "t.acc >= 40"})
def batch_size(spark, sf):
    return text(payload.batch(events(spark, sf), bytes_=40), "stream_id", "batch", "payload", "n_buffers")


@query(STEPPED % {"full": "(t.acc >= 64 or t.c >= 5)"})
def batch_limits(spark, sf):
    return text(payload.batch(events(spark, sf), 5, 64), "stream_id", "batch", "payload", "n_buffers")


@query(STEPPED % {"full": f"x.pts - t.began >= {12 * HOUR}"})
def batch_timeout(spark, sf):
    return text(payload.batch(events(spark, sf), timeout=12 * HOUR), "stream_id", "batch", "payload", "n_buffers")


@query(STEPPED % {"full": "(t.acc >= 45 or t.acc + x.l > 45)"})
def concat_size(spark, sf):
    return text(payload.concat_by_size(events(spark, sf), 45), "stream_id", "batch", "payload", "n_buffers")


@query(f"""with {E}, s as (select stream_id, string_agg(payload, '' order by sequence) as whole from e group by stream_id),
c as (select stream_id, unnest(range(0, strlen(whole), 50)) as b, whole from s) select stream_id, b // 50 as sequence, substr(whole, b + 1, 50) as payload from c""")
def chunk_bytes(spark, sf):
    return text(payload.chunk(events(spark, sf), 50), "stream_id", "sequence", "payload")


# --- metadata


@query(f"with {E} select stream_id, pts, 100 + 5 * (row_number() over (partition by stream_id order by sequence) - 1) as sequence from e")
def sequence_number(spark, sf):
    return meta.sequence_number(events(spark, sf), 100, 5).select("stream_id", "pts", "sequence")


@query("select 9 as stream_id, event_id as sequence, cast(40000000 as bigint) as duration, cast(128 as bigint) as \"offset\" from events")
def metadata_inject(spark, sf):
    return meta.inject(events(spark, sf), stream_id=9, duration=40_000_000, offset=128).select("stream_id", "sequence", "duration", "offset")


@query(f"with {E} select stream_id, sequence, pts, flags, cast(strlen(payload) as int) as size from e")
def metadata_extract(spark, sf):
    return meta.extract(events(spark, sf)).select("stream_id", "sequence", "pts", "flags", "size")


SHUFFLED = "(sequence + (sequence % 5) * 3)"


@query(f"""with {E}, o as (select *, lag(pts) over (partition by stream_id order by {SHUFFLED}, sequence) as before from e)
select stream_id, count(*) as n_buffers, count(*) filter (where pts < before) as n_backwards, min(pts) as min_pts, max(pts) as max_pts from o group by stream_id""")
def ts_debug_backwards(spark, sf):
    e = events(spark, sf).withColumn("arrival", F.col("sequence") + (F.col("sequence") % 5) * 3)
    return meta.timestamp_summary(e, order_by=("arrival", "sequence")).select("stream_id", "n_buffers", "n_backwards", "min_pts", "max_pts")


@query(f"""with recursive {E}, x as (select stream_id, sequence, pts, row_number() over (partition by stream_id order by {SHUFFLED}, sequence) as i from e),
t(stream_id, i, last, mean, status, gap) as (select stream_id, i, pts, cast(null as double), 'OK', cast(null as bigint) from x where i = 1
 union all select x.stream_id, x.i, x.pts, case when t.mean is null then cast(greatest(x.pts - t.last, 0) as double) else t.mean + (greatest(x.pts - t.last, 0) - t.mean) / x.i end,
  case when t.mean is not null and greatest(x.pts - t.last, 0) > 2 * t.mean then 'DISCONTINUITY' when x.pts < t.last then 'BACKWARDS_PTS' else 'OK' end, x.pts - t.last
 from t join x on x.stream_id = t.stream_id and x.i = t.i + 1)
select stream_id, sequence, status, gap from x join t using (stream_id, i)""")
def ts_debug(spark, sf):
    e = events(spark, sf).withColumn("arrival", F.col("sequence") + (F.col("sequence") % 5) * 3)
    return meta.timestamp_debug(e, order_by=("arrival", "sequence")).select("stream_id", "sequence", "status", "gap")


@query(f"""with {E} select sequence, printf('%02d:%02d:%02d.%03d', pts // 3600000000000, pts // 60000000000 % 60, pts // 1000000000 % 60, pts // 1000000 % 1000) as line from e""")
def timestamp_format(spark, sf):
    return events(spark, sf).select("sequence", meta.clock_format(F.col("pts")).alias("line"))


@query("select page_id as sequence, lower(hex(left(url, 24))) as line from pages")
def console_hex(spark, sf):
    return meta.console_text(pages(spark, sf), "hex", 24).select("sequence", "line")


# --- several inputs


def kind(spark, sf, name: str) -> DataFrame:
    return events(spark, sf).where(F.col("event_type") == name)


@query(f"""with {E}, a as (select sequence, row_number() over (order by sequence) - 1 as i from e where event_type = 'view'),
b as (select sequence, row_number() over (order by sequence) - 1 as i from e where event_type = 'purchase'),
n as (select least((select count(*) from a), (select count(*) from b)) as k)
select sequence, case when i < k then 2 * i else i + k end as position from a, n union all select sequence, case when i < k then 2 * i + 1 else i + k end from b, n""")
def merge(spark, sf):
    return typed.merge(kind(spark, sf, "view").select("sequence"), kind(spark, sf, "purchase").select("sequence"), "sequence").select("sequence", "position")


@query("""with a as (select c_custkey, row_number() over (order by c_custkey) - 1 as i from customer), b as (select s_suppkey, row_number() over (order by s_suppkey) - 1 as i from supplier)
select i as "index", c_custkey, s_suppkey from a join b using (i)""")
def zip_pairs(spark, sf):
    return typed.zip_(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "supplier").select("s_suppkey"), ["c_custkey"], ["s_suppkey"])


@query("select o_orderkey, o_totalprice, c_name from orders join customer on o_custkey = c_custkey")
def join_unique_key(spark, sf):
    joined = typed.join(table(spark, sf, "orders"), table(spark, sf, "customer"), "o_custkey", "c_custkey")
    return joined.select("o_orderkey", "o_totalprice", "c_name")


@query("""with a as (select *, row_number() over (partition by user_id order by event_id) as k from events where event_type = 'view'), b as (select *, row_number() over (partition by user_id order by event_id) as k from events where event_type = 'purchase')
select a.user_id, k as pair, a.event_id as viewed, b.event_id as bought from a join b using (user_id, k)""")
def join_pairing(spark, sf):
    e = table(spark, sf, "events")
    a, b = (e.where(F.col("event_type") == k).select("user_id", F.col("event_id").alias(n)) for k, n in (("view", "viewed"), ("purchase", "bought")))
    return typed.join_pairing(a, b, "user_id", "viewed", "bought").select("user_id", "pair", "viewed", "bought").withColumn("pair", F.col("pair").cast("long"))


@query(f"with {E} select sequence, 0 as input from e where event_type = 'view' union all select sequence, 1 from e where event_type = 'purchase' union all select sequence, 2 from e where event_type = 'login'")
def funnel(spark, sf):
    return flow.funnel(*(kind(spark, sf, k) for k in ("view", "purchase", "login"))).select("sequence", "input")


@query(f"with {E} select sequence, 1 as input from e where event_type = 'purchase' union all select sequence, 2 from e where event_type = 'login'")
def concat_streams(spark, sf):
    return flow.concat(*(kind(spark, sf, k) for k in ("view", "purchase", "login")), skip_to=1).select("sequence", "input")


@query(f"with {E} select sequence from e where event_type = case when ts < timestamp '2024-01-12' then 'view' else 'purchase' end")
def input_selector(spark, sf):
    log = spark.createDataFrame([(schema_ns("2024-01-12"), 1)], "at bigint, active int")
    return flow.select_input_log([kind(spark, sf, "view"), kind(spark, sf, "purchase")], log).select("sequence")


@query(f"with {E} select sequence, 1 as output from e where sequence % 3 = 1")
def output_selector(spark, sf):
    return flow.select_output(events(spark, sf), 3, F.col("sequence") % 3)[1].select("sequence", F.lit(1).alias("output"))


@query("select event_id % 4 as output, count(*) as n from events group by 1")
def demux_count(spark, sf):
    outputs = flow.demux_by_sequence(events(spark, sf), 4)
    return flow.funnel(*(df.select(F.lit(k).cast("long").alias("output")) for k, df in outputs.items())).groupBy("output").agg(F.count("*").alias("n"))


@query("select 'a' as branch, count(*) as n_buffers, cast(sum(strlen(props)) as bigint) as n_bytes from events union all select 'b', count(*), cast(sum(strlen(props)) as bigint) from events where event_type = 'view'")
def tee_stats(spark, sf):
    a, b = flow.tee(events(spark, sf), 2)
    count = (F.count("*").alias("n_buffers"), F.sum(filters.size()).alias("n_bytes"))
    return a.agg(*count).withColumn("branch", F.lit("a")).unionByName(b.where("event_type = 'view'").agg(*count).withColumn("branch", F.lit("b")))


@query(f"""with {E}, m as (select *, min(pts) over () as first from e where event_type in ('view', 'purchase'))
select event_type as pad, sequence, cast(greatest(0, ceil((pts - first) / {float(HOUR)})) as bigint) as slot from m""")
def mux_slots(spark, sf):
    muxed = flow.mux({k: kind(spark, sf, k) for k in ("view", "purchase")}, HOUR)
    return muxed.select("pad", "sequence", "slot")


# --- temporal joins


def sided(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf).select("stream_id", "sequence", "pts", "value", "event_type")
    return e.where("event_type = 'view'"), e.where("event_type = 'purchase'")


AB = E + ", a as (select * from e where event_type = 'view'), b as (select * from e where event_type = 'purchase')"


@query(f"""with {E}, h as (select stream_id, sequence, pts // {24 * HOUR} as day, event_type from e),
a as (select *, row_number() over (partition by stream_id, day order by sequence) as k from h where event_type = 'view'), b as (select *, row_number() over (partition by stream_id, day order by sequence) as k from h where event_type = 'purchase')
select coalesce(a.stream_id, b.stream_id) as stream_id, coalesce(a.day, b.day) as day, a.sequence as l, b.sequence as r,
case when b.sequence is null then 'left_only' when a.sequence is null then 'right_only' else 'matched' end as outcome from a full join b on a.stream_id = b.stream_id and a.day = b.day and a.k = b.k""")
def tjoin_exact(spark, sf):
    a, b = (df.withColumn("day", schema.floor_div(F.col("pts"), 24 * HOUR)) for df in sided(spark, sf))
    out = temporal.exact(a, b, "day", "sequence", "sequence", ("stream_id",))
    return out.select("stream_id", "day", F.col("left.sequence").alias("l"), F.col("right.sequence").alias("r"), "outcome")


@query(f"with {AB} select a.sequence as l, b.sequence as r from a join b on a.stream_id = b.stream_id and abs(a.pts - b.pts) <= {6 * HOUR}")
def tjoin_tolerance_pairs(spark, sf):
    a, b = sided(spark, sf)
    out = temporal.tolerance_pairs(a, b, "pts", 6 * HOUR, ("stream_id",))
    return out.select(F.col("left.sequence").alias("l"), F.col("right.sequence").alias("r"))


@query(f"with {AB} select a.sequence, b.pts as right_time, b.sequence as right_sequence from a asof left join b on a.stream_id = b.stream_id and a.pts >= b.pts")
def tjoin_asof_backward(spark, sf):
    a, b = sided(spark, sf)
    return temporal.asof(a, b, "pts", ["sequence"], ("stream_id",)).select("sequence", "right_time", "right_sequence")


@query(f"with {AB} select a.sequence, b.pts as right_time, b.sequence as right_sequence from a asof left join b on a.stream_id = b.stream_id and a.pts <= b.pts")
def tjoin_asof_forward(spark, sf):
    a, b = sided(spark, sf)
    return temporal.asof(a, b, "pts", ["sequence"], ("stream_id",), "forward").select("sequence", "right_time", "right_sequence")


AROUND = f"""with {AB}, p as (select a.stream_id, a.sequence, a.pts, b.pts as t0, b.value as v0, b.sequence as s0 from a asof left join b on a.stream_id = b.stream_id and a.pts >= b.pts),
q as (select p.*, b.pts as t1, b.value as v1, b.sequence as s1 from p asof left join b on p.stream_id = b.stream_id and p.pts <= b.pts)"""


@query(AROUND + " select sequence, case when t1 is null then s0 when t0 is null then s1 when t1 - pts < pts - t0 then s1 else s0 end as right_sequence from q")
def tjoin_nearest(spark, sf):
    a, b = sided(spark, sf)
    return temporal.asof(a, b, "pts", ["sequence"], ("stream_id",), "nearest").select("sequence", "right_sequence")


@query(AROUND + " select sequence, round(case when t1 = t0 then v0 else v0 + (v1 - v0) * (pts - t0) / (t1 - t0) end, 6) as interpolated_value from q")
def tjoin_interpolate(spark, sf):
    a, b = sided(spark, sf)
    return temporal.interpolate(a, b, "pts", "value", ("stream_id",)).select("sequence", F.round("interpolated_value", 6).alias("interpolated_value"))


@query()
def tjoin_tolerance_greedy(spark, sf):
    a, b = sided(spark, sf)
    out = temporal.tolerance(a, b, "pts", 6 * HOUR, ("stream_id",))
    return out.select("stream_id", F.col("left.sequence").alias("l"), F.col("right.sequence").alias("r"))


@query()
def tjoin_nearest_greedy(spark, sf):
    a, b = sided(spark, sf)
    out = temporal.nearest(a, b, "pts", 6 * HOUR, ("stream_id",))
    return out.select("stream_id", F.col("left.sequence").alias("l"), F.col("right.sequence").alias("r"))


@query(f"""with {E}, u as (select stream_id, sequence, pts - (sequence % 7) * {HOUR} as pts, event_type from e where event_type in ('view', 'purchase')),
m as (select *, max(pts) over (partition by stream_id order by sequence) - {3 * HOUR} as watermark from u) select sequence, watermark, pts < watermark as late from m""")
def watermark_late(spark, sf):
    a, b = (df.withColumn("pts", F.col("pts") - (F.col("sequence") % 7) * HOUR) for df in sided(spark, sf))
    out = temporal.late_rows(a, b, "pts", 3 * HOUR, ("stream_id",))
    return out.select(F.coalesce("left.sequence", "right.sequence").alias("sequence"), "watermark", "late")


# --- timing


@query(f"""with recursive {E}, x as (select stream_id, sequence, pts, row_number() over (partition by stream_id order by sequence) as i from e),
t(stream_id, i, last, keep) as (select stream_id, i, pts, 1 from x where i = 1 union all select x.stream_id, x.i, case when x.pts - t.last >= {6 * HOUR} then x.pts else t.last end, case when x.pts - t.last >= {6 * HOUR} then 1 else 0 end
 from t join x on x.stream_id = t.stream_id and x.i = t.i + 1) select stream_id, sequence from x join t using (stream_id, i) where keep = 1""")
def throttle(spark, sf):
    return timing.throttle(events(spark, sf), 6 * HOUR).select("stream_id", "sequence")


@query(f"with {E}, g as (select *, lead(pts) over (partition by stream_id order by sequence) - pts as gap from e) select stream_id, sequence from g where gap is null or gap >= {6 * HOUR}")
def debounce(spark, sf):
    return timing.debounce(events(spark, sf), 6 * HOUR).select("stream_id", "sequence")


@query(f"""with {E}, g as (select *, lead(pts) over (partition by stream_id order by sequence) as following from e), r as (select stream_id, unnest(range(pts + {12 * HOUR}, following, {12 * HOUR})) as pts from g where following - pts > {12 * HOUR})
select stream_id, pts, 128 as flags from r""")
def timeout_gaps(spark, sf):
    return timing.timeout(events(spark, sf), 12 * HOUR).select("stream_id", "pts", "flags")


@query(f"with {E}, x as (select *, row_number() over (partition by stream_id order by sequence) as i from e) select stream_id, sequence, i * {10 * HOUR} + max(pts - i * {10 * HOUR}) over (partition by stream_id order by i) as departure from x")
def rate_limit(spark, sf):
    return timing.rate_limit(events(spark, sf), 10 * HOUR).select("stream_id", "sequence", "departure")


@query(f"with {E}, x as (select *, row_number() over (partition by stream_id order by sequence) as i from e) select stream_id, sequence, (i + 1) * {5 * HOUR} + max(pts - i * {5 * HOUR}) over (partition by stream_id order by i) as departure from x")
def delay(spark, sf):
    return timing.delay(events(spark, sf), 5 * HOUR).select("stream_id", "sequence", "departure")


@query("""with recursive x as (select user_id as stream_id, event_id as sequence, event_id * 1000000 as t, strlen(props) as n, row_number() over (partition by user_id order by event_id) as i from events),
r as (select stream_id, sequence, i, case when n > 500 then t + (n - 500) * 1000000000 // 500 else t end as clock, case when n > 500 then t + (n - 500) * 1000000000 // 500 else t end as began, n as sent from x where i = 1
union all
select stream_id, sequence, i, case when s + n > 500 then now + (s + n - 500) * 1000000000 // 500 else now end, case when s + n > 500 then now + (s + n - 500) * 1000000000 // 500 else b end, case when s + n > 500 then n else s + n end
from (select x.stream_id, x.sequence, x.i, x.n, greatest(x.t, r.clock) as now, case when greatest(x.t, r.clock) - r.began >= 1000000000 then greatest(x.t, r.clock) else r.began end as b,
case when greatest(x.t, r.clock) - r.began >= 1000000000 then 0 else r.sent end as s from r join x on x.stream_id = r.stream_id and x.i = r.i + 1))
select stream_id, sequence, clock as departure from r""")
def rate_limit_bytes(spark, sf):
    e = events(spark, sf).withColumn("pts", F.col("sequence") * 1_000_000)
    return timing.rate_limit_bytes(e, 500).select("stream_id", "sequence", "departure")


@query()
def queue_simulated(spark, sf):
    return timing.queue(events(spark, sf), 3, 20 * HOUR).select("stream_id", "sequence", "depth", "outcome")


@query(f"""with {E}, m as (select *, case when value >= 80 then true when value <= 20 then false end as edge from e)
select sequence, coalesce(last_value(edge ignore nulls) over (partition by stream_id order by sequence rows between unbounded preceding and current row), false) as busy from m""")
def hysteresis(spark, sf):
    return timing.hysteresis(events(spark, sf), "value", 100).select("sequence", "busy")


@query(f"with {E} select sequence, pts - min(pts) over (partition by stream_id) as running from e")
def running_time(spark, sf):
    return timing.running_time(events(spark, sf)).select("sequence", "running")


# --- packets


def packets(spark, sf) -> DataFrame:
    """Events as packets out of order, with losses and repeats, and 16-bit numbers that wrap often."""
    e = events(spark, sf).where("sequence % 17 <> 0")
    e = e.unionByName(e.where("sequence % 13 = 0").withColumn("flags", F.lit(64)))
    arrival = F.col("sequence") + (F.col("sequence") % 5) * 3
    return e.withColumns({"stream_id": F.lit(0), "arrival": arrival, "seq": (F.col("sequence") * 37 % 65536).cast("int"), "ext": F.col("sequence")})


PACKETS = E + """, k as (select *, sequence + (sequence % 5) * 3 as arrival from (select * from e where sequence % 17 <> 0 union all select stream_id, sequence, pts, 64, payload, event_type, value, ts from e where sequence % 17 <> 0 and sequence % 13 = 0))"""


@query(f"with {E} select sequence, sequence * 37 as ext_seq from e")
def rtp_ext_seq(spark, sf):
    e = events(spark, sf).withColumns({"stream_id": F.lit(0), "seq": (F.col("sequence") * 37 % 65536).cast("int")})
    return rtp.extend_sequence(e.select("stream_id", "sequence", "seq")).select("sequence", "ext_seq")


@query(f"with {E} select sequence, sequence * 37 as ext_seq from e")
def rtp_ext_seq_window(spark, sf):
    e = events(spark, sf).withColumns({"stream_id": F.lit(0), "seq": (F.col("sequence") * 37 % 65536).cast("int")})
    return rtp.extend_sequence_in_order(e.select("stream_id", "sequence", "seq")).select("sequence", "ext_seq")


@query(f"""with {PACKETS}, h as (select *, max(sequence) over (order by arrival, sequence, flags rows between unbounded preceding and 1 preceding) as high from k),
f as (select *, row_number() over (partition by sequence order by arrival, flags) as nth from h)
select sequence as ext, coalesce(sequence < high, false) as reordered, coalesce(sequence - lag(sequence) over (order by sequence) - 1, 0) as lost_before from f where nth = 1""")
def jitter_reorder(spark, sf):
    e = packets(spark, sf).select("stream_id", "arrival", "sequence", "flags", "ext")
    out = rtp.reorder(e, "ext", order_by=("arrival", "sequence", "flags"))
    return out.select("ext", "reordered", "lost_before")


@query(f"""with {PACKETS}, s as (select max(sequence) - arg_min(sequence, arrival * 1000000 + sequence) + 1 as expected, count(*) as received from k)
select expected, received, greatest(0, expected - received) as lost, cast(least(255, floor(greatest(0, expected - received) * 256.0 / expected)) as int) as fraction_lost from s""")
def rtp_loss(spark, sf):
    return rtp.loss_info(packets(spark, sf), "ext", order_by=("arrival", "sequence", "flags")).drop("stream_id")


@query(f"""with recursive {E}, x as (select stream_id, sequence, cast(pts as double) * 90000 / 1e9 - sequence * 3000 as transit, row_number() over (partition by stream_id order by sequence) as i from e),
t(stream_id, i, last, j) as (select stream_id, i, transit, cast(0 as double) from x where i = 1 union all select x.stream_id, x.i, x.transit, t.j + (abs(x.transit - t.last) - t.j) / 16 from t join x on x.stream_id = t.stream_id and x.i = t.i + 1)
select sequence, round(j / 1e6, 2) as jitter from x join t using (stream_id, i)""")
def rtp_jitter(spark, sf):
    e = events(spark, sf).withColumn("rtp_ts", F.col("sequence") * 3000)
    return rtp.interarrival_jitter(e).select("sequence", F.round(F.col("jitter") / 1e6, 2).alias("jitter"))


@query("select cast(user_id as int) as stream_id, count(*) as packets, cast(sum(strlen(props)) as bigint) as octets from events group by 1")
def sender_stats(spark, sf):
    return rtp.sender_stats(events(spark, sf), "stream_id")


@query(f"with {E} select stream_id, pts // {24 * HOUR} as \"interval\", count(*) as packets, cast(sum(strlen(payload)) as bigint) as octets from e group by 1, 2")
def rtcp_intervals(spark, sf):
    return rtp.report_intervals(events(spark, sf), 24 * HOUR)


@query("select event_id as sequence, cast(event_id * 37 % 65536 as int) as seq, event_id * 3000 as rts, user_id as ssrc, props as payload from events")
def rtp_header(spark, sf):
    e = events(spark, sf)
    header = F.struct((F.col("sequence") * 37 % 65536).cast("int").alias("seq"), (F.col("sequence") * 3000).alias("ts"), F.col("stream_id").cast("long").alias("ssrc"), F.lit(96).alias("pt"), F.lit(True).alias("marker"))
    back = rtp.parse_header(rtp.build_packet(e.withColumn("rtp", header)).withColumn("payload", F.col("packet")))
    fields = back.select("sequence", F.col("rtp.seq").alias("seq"), F.col("rtp.ts").alias("ts"), F.col("rtp.ssrc").alias("ssrc"), F.col("payload").cast("string").alias("payload"))
    # the header has 32 bits of the time, of a clock that all senders share
    return rtp.extend_timestamp(fields, "ts", partition_by=()).select("sequence", "seq", F.col("ext_ts").alias("rts"), "ssrc", "payload")


# --- segments


SEGMENTS = f"""with recursive {E}, x as (select stream_id, sequence, pts, flags, payload, row_number() over (partition by stream_id order by sequence) as i from e),
t(stream_id, i, began, cut, segment) as (select stream_id, i, pts, false, cast(0 as bigint) from x where i = 1
 union all select x.stream_id, x.i, case when %(cut)s then x.pts else t.began end, %(cut)s, case when %(cut)s then t.segment + 1 else t.segment end from t join x on x.stream_id = t.stream_id and x.i = t.i + 1),
s as (select stream_id, sequence, pts, payload, cut, segment from x join t using (stream_id, i))""" % {
    "cut": f"(x.pts - t.began >= {96 * HOUR} or (x.flags % 2 = 1 and x.pts - t.began >= {24 * HOUR} and x.pts - t.began >= {0.9 * 48 * HOUR}))"
}


@query(SEGMENTS + " select stream_id, sequence, cut, segment from s")
def segment_cut(spark, sf):
    return segment.cut_segments(events(spark, sf), 48 * HOUR).select("stream_id", "sequence", "cut", "segment")


@query(SEGMENTS + """, g as (select stream_id, segment, min(pts) as start_pts, max(pts) as last_pts, count(*) as n_buffers from s group by 1, 2)
select stream_id, segment, start_pts, n_buffers, coalesce(lead(start_pts) over (partition by stream_id order by segment), last_pts) - start_pts as duration from g qualify row_number() over (partition by stream_id order by segment desc) <= 3""")
def segment_manifest_retained(spark, sf):
    rows = segment.manifest(segment.cut_segments(events(spark, sf), 48 * HOUR))
    return segment.retain(rows, 3).select("stream_id", "segment", "start_pts", "n_buffers", "duration")


# --- functions


@query(f"""with {E} select sequence, pts // 1000000 as ms, greatest(0, pts - {schema_ns('2024-01-15')}) as since, abs(pts - {schema_ns('2024-01-15')}) as apart,
abs(pts - {schema_ns('2024-01-15')}) <= {24 * HOUR} as near, printf('%d.%03ds', pts // 1000000000, pts // 1000000 % 1000) as shown from e""")
def clock_functions(spark, sf):
    mid = F.lit(schema_ns("2024-01-15"))
    pts = F.col("pts")
    return events(spark, sf).select("sequence", clock.to(pts, "ms").alias("ms"), clock.saturating_sub(pts, mid).alias("since"), clock.abs_diff(pts, mid).alias("apart"), clock.within_tolerance(pts, mid, 24 * HOUR).alias("near"), clock.display(pts).alias("shown"))


@query("""with f as (select event_id as sequence, cast(event_id % 256 as int) as flags from events) select sequence, (flags & 1) = 1 as sync, flags | 8 as inserted, flags & 247 as removed, xor(flags, 16) as toggled, (flags & 1) = 1 and (flags & 16) = 0 as keyframe from f""")
def flag_functions(spark, sf):
    f = table(spark, sf, "events").select(F.col("event_id").alias("sequence"), (F.col("event_id") % 256).cast("int").alias("flags"))
    x = F.col("flags")
    return f.select("sequence", flags.contains(x, 1).alias("sync"), flags.insert(x, 8).alias("inserted"), flags.remove(x, 8).alias("removed"), flags.toggle(x, 16).alias("toggled"), flags.is_keyframe(x).alias("keyframe"))


RANGES = "(select l_orderkey, l_linenumber, epoch_us(l_shipdate) as s, epoch_us(l_shipdate) + cast(l_quantity as bigint) * 86400000000 as t from lineitem)"


@query(f"""with r as {RANGES} select a.l_orderkey, a.l_linenumber as l, b.l_linenumber as r, greatest(a.s, b.s) as start, least(a.t, b.t) as stop from r a join r b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber and a.s < b.t and b.s < a.t""")
def timerange_overlap(spark, sf):
    start = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", timerange.make(start, start + F.col("l_quantity").cast("long") * 86_400_000_000).alias("span"))
    a, b = r.select("l_orderkey", F.col("l_linenumber").alias("l"), F.col("span").alias("x")), r.select("l_orderkey", F.col("l_linenumber").alias("r"), F.col("span").alias("y"))
    both = timerange.intersection(F.col("x"), F.col("y"))
    joined = a.join(b, "l_orderkey").where("l < r").where(timerange.overlaps(F.col("x"), F.col("y")))
    return joined.select("l_orderkey", "l", "r", both["start"].alias("start"), both["end"].alias("stop"))


@query("""select event_id, 'new' || event_id as title, user_id % 3 = 0 as has_lang, case when event_id % 2 = 0 then 'e' else 'x' end as artist from events""")
def tag_merge(spark, sf):
    e = table(spark, sf, "events")
    old = F.map_from_arrays(F.array(F.lit("title"), F.lit("artist")), F.array(F.lit("old"), F.when(F.col("event_id") % 2 == 0, "e").otherwise("x")))
    new = F.when(F.col("user_id") % 3 == 0, F.create_map(F.lit("title"), F.concat(F.lit("new"), "event_id"), F.lit("lang"), F.lit("en"))).otherwise(F.create_map(F.lit("title"), F.concat(F.lit("new"), "event_id")))
    merged = tags.merge(old, new, "append")
    return e.select("event_id", merged["title"].alias("title"), F.map_contains_key(merged, "lang").alias("has_lang"), merged["artist"].alias("artist"))


@query("""select event_id, mode, case when mode = 'keep' then 'old' else 'new' || event_id end as title, case when mode <> 'replace' then case when event_id % 2 = 0 then 'e' else 'x' end end as artist,
case when mode <> 'replace_matching' and user_id % 3 = 0 then 'en' end as lang from events, (select unnest(['replace', 'append', 'keep', 'replace_matching']) as mode)""")
def tag_merge_modes(spark, sf):
    old = F.create_map(F.lit("title"), F.lit("old"), F.lit("artist"), F.when(F.col("event_id") % 2 == 0, "e").otherwise("x"))
    title = (F.lit("title"), F.concat(F.lit("new"), "event_id"))
    new = F.when(F.col("user_id") % 3 == 0, F.create_map(*title, F.lit("lang"), F.lit("en"))).otherwise(F.create_map(*title))
    modes = ("replace", "append", "keep", "replace_matching")
    merged = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), tags.merge(old, new, m).alias("tags")) for m in modes)))
    found = table(spark, sf, "events").select("event_id", merged.alias("m"))
    return found.select("event_id", "m.mode", *(F.try_element_at("m.tags", F.lit(k)).alias(k) for k in ("title", "artist", "lang")))


@query("""select p_partkey, cast(p_size * 16 as bigint) * 9 as rgb, p_size * 3 * 3 + 2 * cast(ceil(p_size * 3 / 2.0) * ceil(3 / 2.0) as bigint) as i420, cast(ceil(p_size * 3 / 64.0) * 64 as bigint) as stride, cast(round(greatest(least(p_retailprice / 20, 90), -90) / 90 * 2147483647) as bigint) as lat from part""")
def media_functions(spark, sf):
    w = F.col("p_size") * 3
    return table(spark, sf, "part").select(
        "p_partkey", media.video_frame_size(F.col("p_size") * 16, F.lit(3), "Rgb24").alias("rgb"), media.video_frame_size(w, F.lit(3), "I420").alias("i420"), media.padded_stride(w, 64).alias("stride"), media.latitude(F.col("p_retailprice") / 20).alias("lat")
    )


# --- sources, payload functions, pipelines


@query("select range as sequence, repeat('00', 24) as hex from range(0, 50)")
def source_null(spark, sf):
    return generators.null_source(spark, 50, 24).select("sequence", F.hex("payload").alias("hex"))


@query("select range as sequence, repeat('55AA', 5) as hex from range(0, 20)")
def source_alternating(spark, sf):
    return generators.pattern_source(spark, "alternating", 20, 10).select("sequence", F.hex("payload").alias("hex"))


@query("select s as sequence, string_agg(printf('%02X', (s * 20 + i) % 256), '' order by i) as hex from (select range as s from range(0, 40)), (select range as i from range(0, 20)) group by s")
def source_counter(spark, sf):
    return generators.pattern_source(spark, "counter", 40, 20).select("sequence", F.hex("payload").alias("hex"))


@query("select s as sequence, substr('the quick brown fox', (s % 4) * 5 + 1, 5) as payload from (select range as s from range(0, 12))")
def source_data(spark, sf):
    return text(generators.data_source(spark, b"the quick brown fox", 5, 2), "sequence", "payload")


@query()
def source_random(spark, sf):
    return generators.pattern_source(spark, "random", 20, 32).select("sequence", F.hex("payload").alias("hex"))


@query()
def source_video(spark, sf):
    frames = generators.video_test_source(spark, "bars", 64, 32, 10)
    return frames.select("sequence", "pts", F.octet_length("payload").alias("size"), F.crc32("payload").alias("crc"))


@query("select page_id as sequence, upper(url) || '!' as payload from pages")
def map_bytes(spark, sf):
    return text(payload.map_bytes(pages(spark, sf), lambda p: F.concat(F.upper(p.cast("string")), F.lit("!")).cast("binary")), "sequence", "payload")


@query("with p as (select page_id, unnest([left(url, 4), right(url, 4)]) as part, unnest([0, 1]) as k from pages) select row_number() over (order by page_id, k) - 1 as sequence, part as payload from p")
def flat_map_bytes(spark, sf):
    ends = payload.flat_map_bytes(pages(spark, sf), lambda p: F.array(F.left(p.cast("string"), F.lit(4)).cast("binary"), F.right(p.cast("string"), F.lit(4)).cast("binary")))
    return text(ends, "sequence", "payload")


@query("""with p as (select page_id, unnest(string_split(url, '.')) as part, generate_subscripts(string_split(url, '.'), 1) as k, len(string_split(url, '.')) as n from pages), q as (select page_id, k, case when k < n then part || '.' else part end as part from p)
select row_number() over (order by page_id, k) - 1 as sequence, part as payload from q where part <> ''""")
def split_keep_delimiter(spark, sf):
    return text(payload.split(pages(spark, sf), ".", True), "sequence", "payload")


@query("select event_id as sequence from events where event_type in ('view', 'login') and value > 10")
def filter_predicate(spark, sf):
    kept = filters.predicate(events(spark, sf), F.col("event_type").isin("view", "login") & (F.col("value") > 10), Observation())
    return kept.select("sequence")


@query(f"with {E} select stream_id, string_agg(payload, ';' order by sequence) as payload, count(*) as n_buffers from e group by stream_id")
def join_whole_stream(spark, sf):
    return text(payload.join_with(events(spark, sf), ";"), "stream_id", "payload", "n_buffers")


@query(f"with {E}, r as (select *, row_number() over (partition by stream_id order by sequence) - 1 as s from e where event_type = 'purchase') select stream_id, s // 10 as sequence, string_agg(payload, '' order by s) as payload from r group by 1, 2")
def pipeline_parsed(spark, sf):
    description = f"parquetsrc path={sf} table=events ! filter expr=\"meta['event_type'] = 'purchase'\" ! sequence ! batch count=10 ! collect"
    return text(Pipeline.parse(description).run(spark), "stream_id", "sequence", "payload")


@query("select count(*) as n_buffers, cast(sum(strlen(props)) as bigint) as n_bytes from events where event_type in ('view', 'purchase')")
def pipeline_graph(spark, sf):
    graph = Pipeline().source(lambda s: events(s, sf), "events")
    graph.then(lambda df: df.where("event_type = 'view'"), "views", "events").then(lambda df: df.where("event_type = 'purchase'"), "purchases", "events")
    both = [n for n in graph.nodes if n.startswith(("views", "purchases"))]
    graph.then(flow.funnel, "funnel", both).sink(lambda df: df.agg(F.count("*").alias("n_buffers"), F.sum(F.octet_length("payload")).alias("n_bytes")))
    return graph.run(spark)


@query("select event_id as sequence, event_id * 3000 as ticks, cast(event_id * 3000 * 1000000000 // 90000 as bigint) as ns, (event_id * 37 % 65536 + 1) % 65536 as following from events")
def rtp_clock(spark, sf):
    ticks, seq = F.col("sequence") * 3000, F.col("sequence") * 37 % 65536
    return events(spark, sf).select("sequence", ticks.alias("ticks"), rtp.timestamp_to_clock(ticks).alias("ns"), rtp.next_seq(seq).alias("following"))


#: The BER length of ``n`` in SQL.
BER = "case when n < 128 then printf('%02X', n) when n < 256 then printf('81%02X', n) when n < 65536 then printf('82%04X', n) when n < 16777216 then printf('83%06X', n) else printf('84%08X', n) end"


@query(f"select sequence, '060E2B34' || {BER} || hex(props) as hex from (select event_id as sequence, props, strlen(props) as n from events)")
def klv_packets(spark, sf):
    e = events(spark, sf).select("sequence", "payload")
    return kernels.klv_packets(e, bytes.fromhex("060E2B34")).select("sequence", F.hex("payload").alias("hex"))


@query(f"select sequence, '060E2B34' || {BER} || hex(text) as hex from (select doc_id as sequence, text, strlen(text) as n from documents)")
def klv_long_packets(spark, sf):
    e = schema.from_documents(table(spark, sf, "documents")).select("sequence", "payload")
    return kernels.klv_packets(e, bytes.fromhex("060E2B34")).select("sequence", F.hex("payload").alias("hex"))


@query()
def audio_convert(spark, sf):
    samples = generators.pattern_source(spark, "random", 20, 64)
    return kernels.convert_audio(samples, "S16LE", "F32LE", 2, 1).select("sequence", F.hex("payload").alias("hex"))


@query()
def audio_resample(spark, sf):
    samples = generators.pattern_source(spark, "counter", 20, 96)
    return kernels.resample_audio(samples, "U8", 48000, 44100, quality="cubic").select("sequence", F.hex("payload").alias("hex"))


@query()
def video_convert(spark, sf):
    frames = generators.video_test_source(spark, "bars", 64, 32, 5)
    return kernels.convert_video(frames, "Rgb24", "I420", 64, 32).select("sequence", F.crc32("payload").alias("crc"))


@query()
def video_scale(spark, sf):
    frames = generators.video_test_source(spark, "gradient", 64, 32, 5)
    return kernels.scale_video(frames, 64, 32, 32, 16).select("sequence", F.octet_length("payload").alias("size"), F.crc32("payload").alias("crc"))


# --- streams


def event_stream(spark, sf) -> DataFrame:
    """The events table as a stream of files."""
    kind = spark.read.parquet(f"{sf}/events.parquet").schema
    return schema.from_events(spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{sf}/events*.parquet"))


@query(f"with {E} select stream_id, epoch_us(time_bucket(interval 1 day, ts)) as slot, count(*) as n_buffers, cast(sum(strlen(payload)) as bigint) as n_bytes from e group by 1, 2")
def stream_slots(spark, sf):
    out = streaming.run_once(streaming.slots(event_stream(spark, sf), "1 day"), "complete")
    return out.select("stream_id", F.unix_micros("slot").alias("slot"), "n_buffers", "n_bytes")


@query(ORACLE_SQL["throttle"])
def stream_throttle(spark, sf):
    return streaming.run_once(streaming.throttle(event_stream(spark, sf), 6 * HOUR)).select("stream_id", "sequence")


@query(f"with {E}, r as (select *, (row_number() over (partition by stream_id order by sequence) - 1) // 7 as batch from e) select stream_id, batch, string_agg(payload, '' order by sequence) as payload from r group by stream_id, batch having count(*) = 7")
def stream_batch_count(spark, sf):
    return text(streaming.run_once(streaming.batch_by_count(event_stream(spark, sf), 7)), "stream_id", "batch", "payload")


@query("select event_id as sequence, upper(event_type) as kind from events where value > 50")
def stream_stateless(spark, sf):
    return streaming.run_once(event_stream(spark, sf).where("value > 50").select("sequence", F.upper("event_type").alias("kind")))


@query("select a.event_id as l, b.event_id as r from events a join events b on a.user_id = b.user_id and a.event_type = 'view' and b.event_type = 'purchase' and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 21600000000")
def stream_interval_join(spark, sf):
    a, b = (event_stream(spark, sf).where(F.col("event_type") == k).select("stream_id", "sequence", "ts") for k in ("view", "purchase"))
    out = streaming.run_once(streaming.interval_join(a, b, "stream_id", "6 hours", "40 days"))
    return out.select(F.col("left.sequence").alias("l"), F.col("right.sequence").alias("r"))


@query("select distinct props as payload from events")
def stream_dedup(spark, sf):
    return text(streaming.run_once(streaming.drop_duplicates(event_stream(spark, sf), delay="40 days").select("payload")), "payload")

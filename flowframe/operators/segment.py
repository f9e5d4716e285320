"""Segments at keyframes, playlists, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowframe.plans.scan import annotate
from flowframe.schema import ORDER, STREAM, SYNC_POINT

TARGET = 6_000_000_000


def _cuts(target: int, least: int):
    def make():
        began, number = None, 0

        def step(pts: int, keyframe: bool) -> tuple:
            nonlocal began, number
            if began is None:
                began = pts
                return (False, number)
            length = pts - began
            cut = length >= 2 * target or bool(keyframe and length >= least and length >= 0.9 * target)
            if cut:
                began, number = pts, number + 1
            return (cut, number)

        return step

    return make


def cut_segments(df: DataFrame, target: int = TARGET, least: int | None = None, keyframe: Column | None = None, partition_by=STREAM, order_by=ORDER) -> DataFrame:
    """``cut`` before each row that begins a new segment, and its ``segment`` number.

    A cut comes at a keyframe once the segment has its least length (half the target) and nine tenths of the
    target, and at any row at twice the target.
    """
    key = keyframe if keyframe is not None else F.col("flags").bitwiseAND(SYNC_POINT) != 0
    return annotate(df, _cuts(target, target // 2 if least is None else least), [F.col("pts"), key], "cut boolean, segment bigint", partition_by, order_by)


def manifest(segmented: DataFrame, partition_by=STREAM) -> DataFrame:
    """A row for each segment: its first pts, its length to the next segment's first pts, its rows and bytes."""
    per = segmented.groupBy(*partition_by, "segment").agg(F.min("pts").alias("start_pts"), F.max("pts").alias("last_pts"), F.count("*").alias("n_buffers"), F.sum(F.octet_length("payload")).alias("n_bytes"))
    following = F.lead("start_pts").over(W.partitionBy(*partition_by).orderBy("segment"))
    return per.withColumn("duration", F.coalesce(following, F.col("last_pts")) - F.col("start_pts"))


def retain(segments: DataFrame, keep: int, partition_by=STREAM, name: str = "segment") -> DataFrame:
    """The last ``keep`` segments of each stream by ``name``."""
    nth = F.row_number().over(W.partitionBy(*partition_by).orderBy(F.desc(name)))
    return segments.withColumn("_nth", nth).where(F.col("_nth") <= keep).drop("_nth")


def playlist(rows: list, target_seconds: float, ended: bool = True) -> str:
    """An HLS media playlist from manifest rows of one stream (``segment``, ``duration`` in ns), in order."""
    first = rows[0]["segment"] if rows else 0
    lines = ["#EXTM3U", "#EXT-X-VERSION:3", f"#EXT-X-TARGETDURATION:{-(-int(target_seconds * 1000) // 1000)}", f"#EXT-X-MEDIA-SEQUENCE:{first}"]
    for r in rows:
        lines += [f"#EXTINF:{r['duration'] / 1e9:.3f},", f"segment{r['segment']:05d}.ts"]
    return "\n".join([*lines, *(["#EXT-X-ENDLIST"] if ended else [])]) + "\n"


def write_segments(segmented: DataFrame, path: str) -> None:
    """A folder for each stream and segment."""
    segmented.write.partitionBy("stream_id", "segment").parquet(path)


def dash_manifest(rows: list, stream: str = "0", timescale: int = 1000) -> str:
    """A static DASH manifest with a segment timeline from manifest rows of one stream, in order."""
    ms = [round(r["duration"] * timescale / 1e9) for r in rows]
    entries = "".join(f'<S t="{sum(ms[:k])}" d="{d}"/>' for k, d in enumerate(ms))
    number = rows[0]["segment"] if rows else 0
    return (
        '<?xml version="1.0" encoding="UTF-8"?>\n'
        f'<MPD xmlns="urn:mpeg:dash:schema:mpd:2011" type="static" mediaPresentationDuration="PT{sum(ms) / timescale:.3f}S">'
        f'<Period><AdaptationSet><Representation id="{stream}">'
        f'<SegmentTemplate timescale="{timescale}" media="segment$Number%05d$.m4s" startNumber="{number}"><SegmentTimeline>{entries}</SegmentTimeline></SegmentTemplate>'
        "</Representation></AdaptationSet></Period></MPD>\n"
    )

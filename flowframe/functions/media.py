"""Sizes and arithmetic of raw media formats, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes for each sample, and bits for each pixel by pixel format (fixed values).
SAMPLE_BYTES = {"U8": 1, "S16": 2, "S32": 4, "F32": 4, "F64": 8}
PIXEL_BITS = {"Gray8": 8, "I420": 12, "NV12": 12, "Yuyv": 16, "Uyvy": 16, "Rgb24": 24, "Bgr24": 24, "Rgba": 32, "Bgra": 32, "Argb": 32, "Abgr": 32}


def video_frame_size(width: Column, height: Column, pixel_format: str) -> Column:
    """Bytes of a frame; the chroma planes of 4:2:0 formats are rounded up to whole samples."""
    if pixel_format in ("I420", "NV12"):
        half = F.ceil(width / 2) * F.ceil(height / 2)
        return (width * height + 2 * half).cast("long")
    return (width * height * (PIXEL_BITS[pixel_format] // 8)).cast("long")


def audio_frame_size(channels: Column, sample_format: str) -> Column:
    return (channels * SAMPLE_BYTES[sample_format]).cast("long")


def padded_stride(width_bytes: Column, alignment: int) -> Column:
    """``width_bytes`` up to the next multiple of ``alignment``."""
    return (F.ceil(width_bytes / alignment) * alignment).cast("long")


def plane_size(width_bytes: Column, height: Column, alignment: int) -> Column:
    return padded_stride(width_bytes, alignment) * height


def clamped(x: Column, low: float, high: float) -> Column:
    """``x`` from ``low`` to ``high``; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def scaled(x: Column, most: float, steps: int) -> Column:
    """``x`` clamped to -most..most as a whole number of ``steps`` either side, rounded half away from zero."""
    return F.round(clamped(x, -most, most) / most * steps).cast("long")


def latitude(degrees: Column) -> Column:
    return scaled(degrees, 90.0, 2147483647)


def longitude(degrees: Column) -> Column:
    return scaled(degrees, 180.0, 2147483647)


def altitude(metres: Column) -> Column:
    """-900 to 19,000 metres in 65,535 steps."""
    return F.round((clamped(metres, -900.0, 19000.0) + 900) / 19900 * 65535).cast("int")


def heading(degrees: Column) -> Column:
    """0 to 360 degrees in 65,535 steps."""
    return F.round(clamped(degrees, 0.0, 360.0) / 360 * 65535).cast("int")


def pitch(degrees: Column) -> Column:
    return scaled(degrees, 90.0, 32767).cast("int")


def roll(degrees: Column) -> Column:
    return scaled(degrees, 90.0, 32767).cast("int")

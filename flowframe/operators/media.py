"""Media kernels on payloads: samples, channels, rates, picture sizes, colours, KLV. They run in numpy by batch."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowframe import runtime

#: numpy types of samples (fixed values); BE for big-endian.
SAMPLES = {"U8": "u1", "S16LE": "<i2", "S16BE": ">i2", "S32LE": "<i4", "S32BE": ">i4", "F32LE": "<f4", "F32BE": ">f4", "F64LE": "<f8", "F64BE": ">f8"}


def map_payload(df: DataFrame, f: Callable[[bytes], bytes]) -> DataFrame:
    """``payload`` through a function on bytes; null stays null."""
    runtime.ship(df.sparkSession)
    runtime.small_arrow_batches(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([None if x is None else f(x) for x in batch.column("payload").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([made if c == "payload" else batch.column(c) for c in names], names=names)

    return df.mapInArrow(run, T.StructType(df.schema.fields))


def decode(data: bytes, kind: str) -> np.ndarray:
    """Samples as numbers from -1 to 1."""
    x = np.frombuffer(data[: len(data) // np.dtype(SAMPLES[kind]).itemsize * np.dtype(SAMPLES[kind]).itemsize], SAMPLES[kind]).astype(np.float64)
    if kind == "U8":
        return (x - 128) / 128
    return x / {"S16": 32768.0, "S32": 2147483648.0}[kind[:3]] if kind[0] == "S" else x


def encode(x: np.ndarray, kind: str) -> bytes:
    """Numbers as samples, clamped to -1..1; whole numbers are cut towards zero."""
    if kind[0] == "F":
        return x.astype(SAMPLES[kind]).tobytes()
    x = np.clip(x, -1.0, 1.0)
    if kind == "U8":
        return (x * 127 + 128).astype(np.uint8).tobytes()
    return (x * {"S16": 32767.0, "S32": 2147483647.0}[kind[:3]]).astype(SAMPLES[kind]).tobytes()


def mix(x: np.ndarray, channels: int, to: int) -> np.ndarray:
    """Interleaved samples from mono to stereo or back; no other change is known."""
    if channels == to:
        return x
    if (channels, to) == (1, 2):
        return np.repeat(x, 2)
    if (channels, to) == (2, 1):
        return x[: len(x) // 2 * 2].reshape(-1, 2).mean(1)
    raise ValueError(f"no mix from {channels} to {to} channels")


def convert_audio(df: DataFrame, kind: str, to: str, channels: int = 1, to_channels: int | None = None) -> DataFrame:
    return map_payload(df, lambda data: encode(mix(decode(data, kind), channels, to_channels or channels), to))


def resample(x: np.ndarray, rate: int, to: int, quality: str = "linear") -> np.ndarray:
    """One channel at another rate, by linear or cubic (Catmull-Rom) interpolation; ends repeat."""
    if rate == to or not len(x):
        return x
    n = len(x) * to // rate
    at = np.arange(n) * (rate / to)
    i = np.floor(at).astype(np.int64)
    t = at - i

    def get(k):
        return x[np.clip(i + k, 0, len(x) - 1)]

    if quality == "linear":
        return get(0) + (get(1) - get(0)) * t
    a, b, c, d = get(-1), get(0), get(1), get(2)
    return b + 0.5 * t * (c - a + t * (2 * a - 5 * b + 4 * c - d + t * (3 * (b - c) + d - a)))


def resample_audio(df: DataFrame, kind: str, rate: int, to: int, channels: int = 1, quality: str = "linear") -> DataFrame:
    """Each payload on its own."""

    def run(data: bytes) -> bytes:
        x = decode(data, kind)
        parts = [resample(x[c::channels], rate, to, quality) for c in range(channels)]
        return encode(np.stack(parts, 1).reshape(-1) if len(x) else x, kind)

    return map_payload(df, run)


def scale(frame: np.ndarray, height: int, width: int, method: str = "bilinear") -> np.ndarray:
    """A (rows, columns, planes) picture at another size."""
    h, w = frame.shape[:2]
    if method == "nearest":
        return frame[(np.arange(height) * h // height)[:, None], np.arange(width) * w // width]
    y, x = np.maximum((np.arange(height) + 0.5) * h / height - 0.5, 0), np.maximum((np.arange(width) + 0.5) * w / width - 0.5, 0)
    y0, x0 = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    f = frame.astype(np.float64)
    top, bottom = f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx, f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx
    return np.clip(np.floor(top * (1 - fy) + bottom * fy + 0.5), 0, 255).astype(np.uint8)


def scale_video(df: DataFrame, width: int, height: int, to_width: int, to_height: int, planes: int = 3, method: str = "bilinear") -> DataFrame:
    return map_payload(df, lambda data: scale(np.frombuffer(data, np.uint8).reshape(height, width, planes), to_height, to_width, method).tobytes())


#: Weights of red, green and blue in luma (fixed values), by standard.
LUMA = {"bt601": (0.299, 0.587, 0.114), "bt709": (0.2126, 0.7152, 0.0722)}


def rgb_to_i420(rgb: np.ndarray, standard: str = "bt601") -> bytes:
    """A (rows, columns, 3) picture as planes Y, U and V of the limited range; chroma is the mean of each two by two."""
    kr, kg, kb = LUMA[standard]
    r, g, b = (rgb[..., k].astype(np.float64) for k in range(3))
    y = kr * r + kg * g + kb * b
    u, v = (b - y) / (2 * (1 - kb)), (r - y) / (2 * (1 - kr))

    def halved(p):
        p = np.pad(p, ((0, p.shape[0] % 2), (0, p.shape[1] % 2)), "edge")
        return p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean((1, 3))

    planes = (16 + y * 219 / 255, 128 + halved(u) * 224 / 255, 128 + halved(v) * 224 / 255)
    return b"".join(np.clip(np.floor(p + 0.5), 0, 255).astype(np.uint8).tobytes() for p in planes)


def i420_to_rgb(data: bytes, width: int, height: int, standard: str = "bt601") -> np.ndarray:
    kr, kg, kb = LUMA[standard]
    cw, ch = -(-width // 2), -(-height // 2)
    raw = np.frombuffer(data, np.uint8).astype(np.float64)
    y = (raw[: width * height].reshape(height, width) - 16) * 255 / 219
    u, v = ((raw[width * height + k * cw * ch :][: cw * ch].reshape(ch, cw) - 128) * 255 / 224 for k in (0, 1))
    u, v = (np.repeat(np.repeat(p, 2, 0), 2, 1)[:height, :width] for p in (u, v))
    r, b = y + 2 * (1 - kr) * v, y + 2 * (1 - kb) * u
    g = (y - kr * r - kb * b) / kg
    return np.clip(np.floor(np.stack([r, g, b], 2) + 0.5), 0, 255).astype(np.uint8)


def convert_video(df: DataFrame, kind: str, to: str, width: int, height: int, standard: str = "bt601") -> DataFrame:
    """Between Rgb24, Bgr24, Rgba, Gray8 and I420."""

    def run(data: bytes) -> bytes:
        if kind == "I420":
            rgb = i420_to_rgb(data, width, height, standard)
        else:
            planes = {"Rgb24": 3, "Bgr24": 3, "Rgba": 4, "Gray8": 1}[kind]
            rgb = np.frombuffer(data, np.uint8).reshape(height, width, planes)
            rgb = np.repeat(rgb, 3, 2) if planes == 1 else rgb[..., 2::-1] if kind == "Bgr24" else rgb[..., :3]
        if to == "I420":
            return rgb_to_i420(rgb, standard)
        if to == "Gray8":
            return np.clip(np.floor(rgb @ np.array(LUMA[standard]) + 0.5), 0, 255).astype(np.uint8).tobytes()
        if to == "Rgba":
            rgb = np.concatenate([rgb, np.full((height, width, 1), 255, np.uint8)], 2)
        return np.ascontiguousarray(rgb[..., ::-1] if to == "Bgr24" else rgb).tobytes()

    return map_payload(df, run)


def ber_length(n: int) -> bytes:
    """A BER length: one byte below 128, else a byte that says how many follow."""
    if n < 128:
        return bytes([n])
    raw = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([0x80 | len(raw)]) + raw


def read_ber_length(data: bytes) -> tuple[int, int]:
    """(length, bytes read)."""
    if data[0] < 128:
        return data[0], 1
    k = data[0] & 0x7F
    return int.from_bytes(data[1 : 1 + k], "big"), 1 + k


def klv(key: bytes, value: bytes) -> bytes:
    return key + ber_length(len(value)) + value


def read_klv(data: bytes, key_size: int = 16) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(data):
        n, used = read_ber_length(data[at + key_size :])
        begin = at + key_size + used
        yield data[at : at + key_size], data[begin : begin + n]
        at = begin + n


def checksum16(data: bytes) -> int:
    """The running 16-bit sum of big-endian words, an odd last byte being the high one."""
    padded = data + b"\0" * (len(data) % 2)
    return sum(struct.unpack(f">{len(padded) // 2}H", padded)) & 0xFFFF


def klv_packets(df: DataFrame, key: bytes) -> DataFrame:
    """Each payload as the value of a KLV packet."""
    return map_payload(df, lambda data: klv(key, data))


def annexb_units(data: bytes) -> list[bytes]:
    """Units between start codes 0 0 1 (or 0 0 0 1)."""
    import re

    return [x for x in re.split(rb"\x00?\x00\x00\x01", data) if x]


def annexb_to_avcc(data: bytes) -> bytes:
    """Units with four-byte lengths instead of start codes."""
    return b"".join(len(x).to_bytes(4, "big") + x for x in annexb_units(data))


def avcc_to_annexb(data: bytes) -> bytes:
    out, at = [], 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        out.append(b"\x00\x00\x00\x01" + data[at + 4 : at + 4 + n])
        at += 4 + n
    return b"".join(out)


def parameter_sets(data: bytes) -> dict[str, list[bytes]]:
    """The sequence and picture parameter sets among H.264 units (types 7 and 8)."""
    found: dict[str, list[bytes]] = {"sps": [], "pps": []}
    for unit in annexb_units(data):
        if kind := {7: "sps", 8: "pps"}.get(unit[0] & 0x1F):
            found[kind].append(unit)
    return found

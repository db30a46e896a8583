"""PNG cells as arrays, by zlib alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNATURE = b"\x89PNG\r\n\x1a\n"
KIND = T.StructType([T.StructField(n, T.IntegerType()) for n in "hwc"] + [T.StructField("data", T.ArrayType(T.IntegerType())), T.StructField("error", T.StringType())])


def decode_png(raw: bytes) -> np.ndarray:
    """(h, w, channels) of a non-interlaced 8- or 16-bit grey, RGB, grey-alpha or RGBA PNG; ValueError for anything else."""
    if not raw.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, data, head = 8, [], None
    while at + 8 <= len(raw):
        (size,), kind = struct.unpack(">I", raw[at : at + 4]), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("broken chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    else:
        raise ValueError("no end")
    if head is None:
        raise ValueError("no header")
    w, h, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if channels is None or depth not in (8, 16) or interlace:
        raise ValueError(f"depth {depth}, colour {colour}, interlace {interlace}")
    bpp = channels * depth // 8
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, w * bpp + 1)
    out, above = np.zeros((h, w * bpp), np.uint8), np.zeros(w * bpp, np.int64)
    for y in range(h):
        how, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        if how == 1:
            line = line.reshape(w, bpp).cumsum(0).ravel() & 255
        elif how == 2:
            line = (line + above) & 255
        elif how in (3, 4):
            line = _from_left(line, above, bpp, how)
        elif how:
            raise ValueError(f"filter {how}")
        out[y], above = line, line
    return (out if depth == 8 else out.reshape(h, -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)).reshape(h, w, channels)


def _from_left(line: np.ndarray, above: np.ndarray, bpp: int, how: int) -> np.ndarray:
    """A row of the filters that look left: each byte needs the one before it, so plain integers run fastest."""
    got, up = [0] * bpp, [0] * bpp + above.tolist()
    for x, v in enumerate(line.tolist()):
        a, b = got[x], up[x + bpp]
        if how == 3:
            near = (a + b) >> 1
        else:
            c = up[x]
            da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            near = a if da <= db and da <= dc else b if db <= dc else c
        got.append((v + near) & 255)
    return np.array(got[bpp:], np.int64)


def encode_png(a: np.ndarray) -> bytes:
    """An unfiltered PNG of an (h, w) or (h, w, 3) array of uint8 or uint16."""
    a = a[..., None] if a.ndim == 2 else a
    h, w, c = a.shape
    body = a.astype(">u2" if a.dtype == np.uint16 else np.uint8).tobytes()
    step = len(body) // h
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = struct.pack(">IIBBBBB", w, h, 16 if a.dtype == np.uint16 else 8, {1: 0, 3: 2}[c], 0, 0, 0)
    rows = b"".join(b"\0" + body[i * step : (i + 1) * step] for i in range(h))
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@F.pandas_udf(KIND)
def png_cells(raw: pd.Series) -> pd.DataFrame:
    """h, w, c and data of PNG bytes, or the error; null bytes are an error as well."""
    rows = []
    for b in raw:
        try:
            a = decode_png(bytes(b or b""))
            rows.append((*a.shape, a.ravel().tolist(), None))
        except (ValueError, zlib.error, struct.error) as e:
            rows.append((None, None, None, None, str(e) or "broken"))
    out = pd.DataFrame(rows, columns=["h", "w", "c", "data", "error"])
    return out.astype({"h": "Int32", "w": "Int32", "c": "Int32"})

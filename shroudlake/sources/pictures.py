"""Pictures as numbers: PNG bytes to pixels, and whether boxes of a picture are painted over."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.regions import EXPANSION, EXPANSIONS

#: The bytes a PNG begins with, and samples of a pixel by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """The lines of a picture without the filters they were packed with; step: bytes of a pixel."""
    lines = np.frombuffer(raw, np.uint8, count=height * (stride + 1)).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = lines[y, 0], lines[y, 1:]
        if kind == 1:  # each byte adds to the pixel before
            own = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).reshape(-1)
        elif kind == 2:
            own = line + above
        elif kind in (3, 4):
            own, up, left, corner = bytearray(line.tobytes()), above.tobytes(), bytes(step), bytes(step)
            for x in range(0, stride, step):
                for k in range(min(step, stride - x)):
                    a, b, c = left[k], up[x + k], corner[k]
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        p = a + b - c
                        pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                        guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                    own[x + k] = (own[x + k] + guess) & 255
                left, corner = bytes(own[x : x + step]), up[x : x + step]
            own = np.frombuffer(bytes(own), np.uint8)
        elif kind == 0:
            own = line
        else:
            raise ValueError("unknown filter")
        out[y] = above = own
    return out


def pixels(content: bytes | None) -> np.ndarray | None:
    """(height, width, 4) of a PNG with eight bits a sample, not interlaced: red, green, blue, opacity; None for anything else, or if it is broken."""
    if not content or content[:8] != SIGNATURE:
        return None
    at, packed, palette, clear, head = 8, [], None, None, None
    try:
        while at + 8 <= len(content):
            size, kind = struct.unpack(">I4s", content[at : at + 8])
            body = content[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"tRNS":
                clear = body
            elif kind == b"IDAT":
                packed.append(body)
            elif kind == b"IEND":
                break
            at += 12 + size
        if head is None or head[2] != 8 or head[3] not in SAMPLES or head[6] != 0:
            return None
        width, height, _, colour = head[:4]
        n = SAMPLES[colour]
        lines = unfiltered(zlib.decompress(b"".join(packed)), height, width * n, n).reshape(height, width, n)
        out = np.full((height, width, 4), 255, np.uint8)
        if colour == 3:
            if palette is None:
                return None
            out[..., :3] = palette[lines[..., 0]]
            if clear:
                out[..., 3] = np.array([*clear, *[255] * (256 - len(clear))], np.uint8)[lines[..., 0]]
        elif colour in (0, 4):
            out[..., :3] = lines[..., :1]
        else:
            out[..., :3] = lines[..., :3]
        if colour in (4, 6):
            out[..., 3] = lines[..., -1]
        return out
    except (ValueError, struct.error, zlib.error, IndexError):
        return None


def grown(b: tuple[int, int, int, int], width: int, height: int) -> tuple[int, int, int, int]:
    """A box a quarter larger within the picture, as regions.grown() makes it."""
    near = lambda v: int(np.floor(v + 0.5))
    x, y = max(0, near(b[0] - b[2] * (EXPANSION / 2))), max(0, near(b[1] - b[3] * (EXPANSION / 2)))
    return x, y, min(width - x, near(b[2] * (1 + EXPANSION))), min(height - y, near(b[3] * (1 + EXPANSION)))


def clean_flags(content: Column, boxes: Column) -> Column:
    """array<array<boolean>>: for each box (array of struct x, y, width, height) of a PNG, whether all it covers is opaque black, as it is and after each time it grows; regions.verified() reads a box's flags.

    A picture that cannot be read gives no flags for its boxes, which then do not pass. Boxes reach into the picture only as far as it goes; what covers nothing is clean.
    """

    def flags(image: np.ndarray, b: dict) -> list[bool]:
        height, width = image.shape[:2]
        x, y = max(0, min(b["x"], width - 1)), max(0, min(b["y"], height - 1))
        at, out = (x, y, min(b["width"], width - x), min(b["height"], height - y)), []
        for _ in range(EXPANSIONS + 1):
            part = image[at[1] : at[1] + max(0, at[3]), at[0] : at[0] + max(0, at[2])]
            out.append(bool((part[..., :3] == 0).all() and (part[..., 3] == 255).all()))
            at = grown(at, width, height)
        return out

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contents, places in batches:
            out = []
            for data, own in zip(contents, places):
                image = pixels(None if data is None else bytes(data))
                out.append([flags(image, b) if image is not None and b is not None else [] for b in (own if own is not None else [])])
            yield pd.Series(out)

    return F.pandas_udf("array<array<boolean>>")(run)(content, boxes)

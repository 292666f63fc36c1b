"""Page boxes and rotation of one document, as rows for Spark or for a single file."""

from __future__ import annotations

import math
from typing import Any

import numpy as np

from .document import MAX_HOPS, Document
from .objects import FolioError

f32 = np.float32
#: A4 in points, the size of a page without a usable box.
A4 = (f32(210 * 72 / 25.4), f32(297 * 72 / 25.4))
TINY = f32(2**-12)


def rectangle(d: Document, v: Any) -> tuple | None:
    v = d.resolve(v)
    if not isinstance(v, list) or len(v) < 4:
        return None
    n = [d.resolve(x) for x in v[:4]]
    if any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in n):
        return None
    with np.errstate(over="ignore"):
        a, b, c, e = (f32(x) for x in n)
    return min(a, c), min(b, e), max(a, c), max(b, e)


def rotation(v: Any) -> int | None:
    if isinstance(v, bool) or not isinstance(v, (int, float)) or isinstance(v, float) and not math.isfinite(v):
        return None
    return int(v)


def inherited(d: Document, num: int, keys: dict) -> dict:
    """The nearest usable value of each key on the way up; damage ends the climb."""
    out, seen = {}, set()
    for _ in range(MAX_HOPS):
        if num in seen:
            break
        seen.add(num)
        try:
            v = d.get(num)
            if not isinstance(v, dict):
                break
            for k, read in keys.items():
                if k not in out and (x := read(v.get(k))) is not None:
                    out[k] = x
            p = v.get("Parent")
            if len(out) == len(keys) or not hasattr(p, "num"):
                break
            num = p.num
        except FolioError:
            break
    return out


def page_size(media: tuple | None, crop: tuple | None, turn: int | None) -> tuple[float, float, int]:
    """Width, height and rotation as shown. The same steps are written as columns in ``functions.geometry``."""
    if media is None:
        media = (f32(0), f32(0), *A4)
    c = crop or media
    x0, y0, x1, y1 = max(media[0], c[0]), max(media[1], c[1]), min(media[2], c[2]), min(media[3], c[3])
    with np.errstate(over="ignore", invalid="ignore"):
        w, h = f32(x1 - x0), f32(y1 - y0)
    if not (np.isfinite(w) and np.isfinite(h)) or w <= TINY or h <= TINY:
        w, h = A4
    else:
        w, h = max(w, f32(1)), max(h, f32(1))
    r = (turn or 0) % 360
    r = r if r in (90, 180, 270) else 0
    return (h, w, r) if r in (90, 270) else (w, h, r)


def page_boxes(d: Document, num: int) -> tuple[tuple | None, tuple | None, int | None]:
    got = inherited(d, num, {"MediaBox": lambda v: rectangle(d, v), "CropBox": lambda v: rectangle(d, v), "Rotate": lambda v: rotation(d.resolve(v))})
    return got.get("MediaBox"), got.get("CropBox"), got.get("Rotate")


def dimensions(d: Document) -> list[tuple[float, float, int]]:
    out = []
    for n in d.pages():
        w, h, r = page_size(*page_boxes(d, n))
        out.append((float(w), float(h), r))
    return out

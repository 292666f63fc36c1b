"""Drawing a page: filled and stroked paths, rectangles clips, uncoloured and coloured tilings, plain images.

Glyphs are drawn where a TrueType program is embedded, and those of Type 3 fonts. Not drawn: other glyphs (the standard
fonts are not part of this package), shadings, blend modes, soft masks, image codecs other than Flate, LZW, RunLength and
ASCII.
"""

from __future__ import annotations

import struct
import zlib
from typing import Any

import numpy as np

from . import content
from .document import Document
from .geometry import inherited
from .objects import FolioError, Name, Stream
from .text import NEW_TEXT, Interpreter, Position, apply, laid_out, mul, page_transform, text_operator

MAX_PIXELS = 65_535
MAX_FORM_DEPTH = 32
#: Cells drawn one by one, at most; beyond that one cell is drawn and looked up. Cells over each other then, each way.
MAX_CELLS = 10_000
MAX_OVERLAP = 8
SUB = 4  # samples a pixel in each direction


def pixels(length: float, dpi: float) -> int:
    f = np.float32
    return int(np.floor(f(f(length) * (f(dpi) / f(72)))))


def png(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    raw = np.zeros((h, 1 + 3 * w), dtype=np.uint8)
    raw[:, 1:] = rgb.reshape(h, 3 * w)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw.tobytes(), 6)) + part(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """The pixels of an image that :func:`png` wrote."""
    w, h = struct.unpack(">II", data[16:24])
    n = struct.unpack(">I", data[33:37])[0]
    return np.frombuffer(zlib.decompress(data[41 : 41 + n]), dtype=np.uint8).reshape(h, 1 + 3 * w)[:, 1:].reshape(h, w, 3)


def coverage(polys: list[np.ndarray], width: int, height: int, even_odd: bool) -> tuple[np.ndarray, int, int] | None:
    """Share of each pixel inside the polygons, over their bounding box within the page; and the box's corner."""
    pts = np.concatenate(polys) if polys else np.zeros((0, 2))
    pts = pts[np.isfinite(pts).all(axis=1)]
    if not len(pts):
        return None
    x0, y0 = max(0, int(np.floor(pts[:, 0].min()))), max(0, int(np.floor(pts[:, 1].min())))
    x1, y1 = min(width, int(np.ceil(pts[:, 0].max()))), min(height, int(np.ceil(pts[:, 1].max())))
    if x0 >= x1 or y0 >= y1:
        return None
    a = np.concatenate(polys)
    b = np.concatenate([np.roll(p, -1, axis=0) for p in polys])
    keep = (a[:, 1] != b[:, 1]) & np.isfinite(a).all(axis=1) & np.isfinite(b).all(axis=1)
    a, b = a[keep], b[keep]
    out = np.zeros((y1 - y0, x1 - x0), dtype=np.float32)
    xs = x0 + (np.arange((x1 - x0) * SUB) + 0.5) / SUB
    for row in range(y0, y1):
        acc = np.zeros(x1 - x0, dtype=np.float32)
        for s in range(SUB):
            y = row + (s + 0.5) / SUB
            hit = (np.minimum(a[:, 1], b[:, 1]) <= y) & (y < np.maximum(a[:, 1], b[:, 1]))
            if not hit.any():
                continue
            p, q = a[hit], b[hit]
            x = p[:, 0] + (y - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1])
            wind = np.where(q[:, 1] > p[:, 1], 1, -1)
            by = np.argsort(x)
            x, wind = x[by], np.cumsum(wind[by])
            k = np.searchsorted(x, xs, side="right")
            state = np.r_[0, np.arange(1, len(x) + 1) % 2] if even_odd else np.r_[0, wind]
            acc += (state[k] != 0).reshape(-1, SUB).sum(axis=1)
        out[row - y0] = acc / (SUB * SUB)
    return out, x0, y0


def _curve(p: tuple, c1: tuple, c2: tuple, q: tuple) -> list[tuple]:
    t = np.linspace(0, 1, 17)[1:, None]
    p, c1, c2, q = (np.array(v, dtype=float) for v in (p, c1, c2, q))
    return [tuple(v) for v in (1 - t) ** 3 * p + 3 * (1 - t) ** 2 * t * c1 + 3 * (1 - t) * t**2 * c2 + t**3 * q]


def _widened(line: list[tuple], closed: bool, width: float) -> list[np.ndarray]:
    out, pts = [], line + line[:1] if closed else line
    for p, q in zip(pts, pts[1:]):
        dx, dy = q[0] - p[0], q[1] - p[1]
        n = float(np.hypot(dx, dy))
        if n:
            ox, oy = -dy / n * width / 2, dx / n * width / 2
            quad = np.array([(p[0] + ox, p[1] + oy), (q[0] + ox, q[1] + oy), (q[0] - ox, q[1] - oy), (p[0] - ox, p[1] - oy)])
            out.append(quad)
    return out


def _rgb(space: str, v: list[float]) -> tuple:
    v = [min(1.0, max(0.0, x)) for x in v]
    if len(v) == 1:
        return v[0], v[0], v[0]
    if len(v) == 3:
        return tuple(v)
    if len(v) == 4:
        return tuple((1 - x) * (1 - v[3]) for x in v[:3])
    return 0.0, 0.0, 0.0


class Canvas:
    def __init__(self, d: Document, width: int, height: int, words: Interpreter | None = None):
        self.d, self.w, self.h = d, width, height
        self.words = words or Interpreter(d)
        self.img = np.full((height, width, 3), 255, dtype=np.uint8)

    def show(self, s: bytes, st: dict, tm: tuple, res: dict, depth: int) -> tuple:
        """Glyphs with outlines of their own (TrueType, and Type 3 by its procedures); others only take their room."""
        f = st["font"]
        if f is None:
            f = st["font"] = self.words.font({})
        laid, move = laid_out(f, s, st)
        for moved, code, text, _ in laid:
            m = mul((st["size"] * st["scale"], 0, 0, st["size"], 0, st["rise"]), mul((1, 0, 0, 1, 0, moved) if f.vertical else (1, 0, 0, 1, moved, 0), mul(tm, st["ctm"])))
            proc = f.procs.get(code)
            if isinstance(proc, Stream) and depth < MAX_FORM_DEPTH:
                own = f.resources if isinstance(f.resources, dict) else res
                self.run(self.d.decoded(proc), own, mul(tuple(f.matrix), m), st["clip"], depth + 1, st["fill"])
            elif st["mode"] in (0, 2, 4, 6) and (shape := f.outline(code, text)):
                self.fill([p @ np.array([[m[0], m[1]], [m[2], m[3]]]) + np.array(m[4:]) for p in shape], False, st)
        return mul(move, tm)

    def paint(self, cover: tuple | None, color: tuple, clip: np.ndarray | None) -> None:
        if cover is None:
            return
        c, x0, y0 = cover
        if clip is not None:
            c = c * clip[y0 : y0 + c.shape[0], x0 : x0 + c.shape[1]]
        area = self.img[y0 : y0 + c.shape[0], x0 : x0 + c.shape[1]]
        area[:] = np.rint(area * (1 - c[..., None]) + np.array(color) * 255 * c[..., None]).astype(np.uint8)

    def fill(self, polys: list, even_odd: bool, st: dict) -> None:
        polys = [np.array(p, dtype=float) for p in polys if len(p) > 1]
        if not polys:
            return
        cover = coverage(polys, self.w, self.h, even_odd)
        if st["pattern"] is not None:
            self.tile(st["pattern"], cover, st)
        else:
            self.paint(cover, st["fill"], st["clip"])

    def tile(self, pattern: Any, cover: tuple | None, st: dict) -> None:
        """Cells of a tiling that meet the area, each drawn through the area as its clip."""
        if cover is None or not isinstance(pattern, Stream) or self.d.resolve(pattern.dict.get("PatternType")) != 1:
            return
        d = self.d
        num = lambda k, n: [float(d.resolve(x)) for x in d.resolve(pattern.dict.get(k)) or n]
        box = num("BBox", [0, 0, 0, 0])
        xs, ys = (float(d.resolve(pattern.dict.get(k)) or 0) for k in ("XStep", "YStep"))
        m = mul(tuple(num("Matrix", [1, 0, 0, 1, 0, 0])), st["base"])
        if not xs or not ys or abs(m[0] * m[3] - m[1] * m[2]) < 1e-12:
            return
        xs, ys = abs(xs), abs(ys)
        c, x0, y0 = cover
        clip = np.zeros((self.h, self.w), dtype=np.float32)
        clip[y0 : y0 + c.shape[0], x0 : x0 + c.shape[1]] = c
        if st["clip"] is not None:
            clip *= st["clip"]
        det = m[0] * m[3] - m[1] * m[2]
        inv = (m[3] / det, -m[1] / det, -m[2] / det, m[0] / det, (m[2] * m[5] - m[3] * m[4]) / det, (m[1] * m[4] - m[0] * m[5]) / det)
        corners = [apply(inv, x, y) for x in (x0, x0 + c.shape[1]) for y in (y0, y0 + c.shape[0])]
        lo_x, hi_x = min(p[0] for p in corners), max(p[0] for p in corners)
        lo_y, hi_y = min(p[1] for p in corners), max(p[1] for p in corners)
        first_i, last_i = int(np.floor((lo_x - box[2]) / xs)), int(np.ceil((hi_x - box[0]) / xs))
        first_j, last_j = int(np.floor((lo_y - box[3]) / ys)), int(np.ceil((hi_y - box[1]) / ys))
        own = d.resolve(pattern.dict.get("Resources")) or {}
        data = d.decoded(pattern)
        if (last_i - first_i + 1) * (last_j - first_j + 1) > MAX_CELLS:
            self.repeat(data, own, box, xs, ys, m, inv, clip, (x0, y0, *c.shape), st)
            return
        for i in range(first_i, last_i + 1):
            for j in range(first_j, last_j + 1):
                ctm = mul((1, 0, 0, 1, i * xs, j * ys), m)
                rect = coverage([np.array([apply(ctm, *p) for p in ((box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3]))])], self.w, self.h, False)
                if rect is None:
                    continue
                r, rx, ry = rect
                cell = np.zeros_like(clip)
                cell[ry : ry + r.shape[0], rx : rx + r.shape[1]] = r
                self.run(data, own, ctm, cell * clip, 1, st["fill"])

    def repeat(self, data: bytes, own: dict, box: list, xs: float, ys: float, m: tuple, inv: tuple, clip: np.ndarray, area: tuple, st: dict) -> None:
        """Very many cells: one is drawn, on white and on black to learn its opacity, and every pixel looks up its place in it."""
        wide, high = box[2] - box[0], box[3] - box[1]
        if wide <= 0 or high <= 0:
            return
        w = int(min(self.w, max(1, np.ceil(wide * np.hypot(m[0], m[1])))))
        h = int(min(self.h, max(1, np.ceil(high * np.hypot(m[2], m[3])))))
        shots = []
        for ground in (255, 0):
            cell = Canvas(self.d, w, h, self.words)
            cell.img[:] = ground
            cell.run(data, own, (w / wide, 0, 0, h / high, -box[0] * w / wide, -box[1] * h / high), None, 1, st["fill"])
            shots.append(cell.img.astype(np.float32))
        alpha = 1 - (shots[0] - shots[1]).mean(axis=2) / 255
        color = shots[1] / np.maximum(alpha, 1e-6)[..., None]
        x0, y0, rows, cols = area
        yy, xx = np.mgrid[y0 : y0 + rows, x0 : x0 + cols] + 0.5
        px, py = inv[0] * xx + inv[2] * yy + inv[4] - box[0], inv[1] * xx + inv[3] * yy + inv[5] - box[1]
        part = self.img[y0 : y0 + rows, x0 : x0 + cols]
        # cells that overlap a place are those that begin up to a cell's width before it; the last begins nearest
        for i in range(min(MAX_OVERLAP, int(np.ceil(wide / xs))) - 1, -1, -1):
            for j in range(min(MAX_OVERLAP, int(np.ceil(high / ys))) - 1, -1, -1):
                u, v = px % xs + i * xs, py % ys + j * ys
                inside = (u < wide) & (v < high)
                at = np.clip((v / high * h).astype(int), 0, h - 1), np.clip((u / wide * w).astype(int), 0, w - 1)
                a = (alpha[at] * inside * clip[y0 : y0 + rows, x0 : x0 + cols])[..., None]
                part[:] = np.clip(np.rint(part * (1 - a) + color[at] * a), 0, 255).astype(np.uint8)

    def image(self, s: Stream, st: dict) -> None:
        d, g = self.d, lambda k: self.d.resolve(s.dict.get(k))
        w, h, bits = g("Width"), g("Height"), g("BitsPerComponent") or 8
        space = g("ColorSpace")
        n = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4}.get(str(space), 0)
        if bits != 8 or not n or not isinstance(w, int) or not isinstance(h, int) or w < 1 or h < 1:
            return
        a = np.frombuffer(d.decoded(s)[: w * h * n], dtype=np.uint8)
        if len(a) < w * h * n:
            return
        a = a.reshape(h, w, n).astype(np.float32)
        rgb = np.repeat(a, 3, axis=2) if n == 1 else a if n == 3 else (255 - a[..., :3]) * (255 - a[..., 3:]) / 255
        m = st["ctm"]
        det = m[0] * m[3] - m[1] * m[2]
        if abs(det) < 1e-12:
            return
        cover = coverage([np.array([apply(m, *p) for p in ((0, 0), (1, 0), (1, 1), (0, 1))])], self.w, self.h, False)
        if cover is None:
            return
        c, x0, y0 = cover
        if st["clip"] is not None:
            c = c * st["clip"][y0 : y0 + c.shape[0], x0 : x0 + c.shape[1]]
        yy, xx = np.mgrid[y0 : y0 + c.shape[0], x0 : x0 + c.shape[1]] + 0.5
        u = (m[3] * (xx - m[4]) - m[2] * (yy - m[5])) / det
        v = (-m[1] * (xx - m[4]) + m[0] * (yy - m[5])) / det
        px = rgb[np.clip(((1 - v) * h).astype(int), 0, h - 1), np.clip((u * w).astype(int), 0, w - 1)]
        area = self.img[y0 : y0 + c.shape[0], x0 : x0 + c.shape[1]]
        area[:] = np.rint(area * (1 - c[..., None]) + px * c[..., None]).astype(np.uint8)

    def run(self, data: bytes, res: dict, ctm: tuple, clip: np.ndarray | None, depth: int, ink: tuple = (0.0, 0.0, 0.0)) -> None:
        d = self.d
        st = {"ctm": ctm, "fill": ink, "stroke": ink, "pattern": None, "width": 1.0, "clip": clip, "base": ctm, **NEW_TEXT}
        at, font = Position(), self.words.named_font(res)
        show = lambda s, st, tm: self.show(s, st, tm, res, depth)
        saved, paths, cur, closed, want_clip = [], [], [], [], None
        for op, a in content.operators(data, lenient=True):
            try:
                m = st["ctm"]
                if op == "q":
                    saved.append(dict(st))
                elif op == "Q":
                    st = saved.pop() if saved else st
                elif op == "cm":
                    st["ctm"] = mul(tuple(float(x) for x in a), m)
                elif text_operator(op, a, st, at, font, show):
                    continue
                elif op == "w":
                    st["width"] = float(a[0])
                elif op == "m":
                    cur = [apply(m, a[0], a[1])]
                    paths.append(cur), closed.append(False)
                elif op == "l":
                    cur.append(apply(m, a[0], a[1]))
                elif op in ("c", "v", "y"):
                    p = [apply(m, x, y) for x, y in zip(a[::2], a[1::2])]
                    if op == "v":
                        p = [cur[-1], *p]
                    elif op == "y":
                        p = [*p, p[-1]]
                    cur += _curve(cur[-1], *p)
                elif op == "h":
                    closed[-1] = True
                elif op == "re":
                    x, y, w, h = a
                    cur = [apply(m, *p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
                    paths.append(cur), closed.append(True)
                elif op in ("W", "W*"):
                    want_clip = op
                elif op in ("f", "F", "f*", "S", "s", "B", "B*", "b", "b*", "n"):
                    if op[0] in "fFBb":
                        self.fill(paths, op.endswith("*"), st)
                    if op[0] in "SsBb":
                        width = max(1.0, st["width"] * float(np.sqrt(abs(m[0] * m[3] - m[1] * m[2]))))
                        quads = [q for p, c in zip(paths, closed) for q in _widened(p, c or op in ("s", "b", "b*"), width)]
                        if quads:
                            self.paint(coverage(quads, self.w, self.h, False), st["stroke"], st["clip"])
                    if want_clip:
                        full = np.zeros((self.h, self.w), dtype=np.float32)
                        got = coverage([np.array(p) for p in paths if len(p) > 1], self.w, self.h, want_clip == "W*")
                        if got is not None:
                            c, x0, y0 = got
                            full[y0 : y0 + c.shape[0], x0 : x0 + c.shape[1]] = c
                        st["clip"] = full if st["clip"] is None else st["clip"] * full
                    paths, closed, cur, want_clip = [], [], [], None
                elif op in ("g", "rg", "k"):
                    st["fill"], st["pattern"] = _rgb("", [float(x) for x in a]), None
                elif op in ("G", "RG", "K"):
                    st["stroke"] = _rgb("", [float(x) for x in a])
                elif op in ("sc", "scn"):
                    if a and isinstance(a[-1], Name):
                        st["pattern"] = d.resolve((d.resolve(res.get("Pattern")) or {}).get(a[-1]))
                        if len(a) > 1:
                            st["fill"] = _rgb("", [float(x) for x in a[:-1]])
                    else:
                        st["fill"], st["pattern"] = _rgb("", [float(x) for x in a]), None
                elif op in ("SC", "SCN") and a and not isinstance(a[-1], Name):
                    st["stroke"] = _rgb("", [float(x) for x in a])
                elif op == "Do":
                    x = d.resolve((d.resolve(res.get("XObject")) or {}).get(a[0]))
                    if isinstance(x, Stream) and x.dict.get("Subtype") == "Image":
                        self.image(x, st)
                    elif isinstance(x, Stream) and x.dict.get("Subtype") == "Form" and depth < MAX_FORM_DEPTH:
                        f = d.resolve(x.dict.get("Matrix"))
                        f = tuple(float(d.resolve(v)) for v in f) if isinstance(f, list) and len(f) == 6 else (1, 0, 0, 1, 0, 0)
                        own = d.resolve(x.dict.get("Resources"))
                        self.run(d.decoded(x), own if isinstance(own, dict) else res, mul(f, m), st["clip"], depth + 1, st["fill"])
            except (IndexError, TypeError, ValueError, KeyError, FolioError):
                continue


def page_png(d: Document, num: int, dpi: float) -> tuple[int, int, bytes]:
    m, w, h = page_transform(d, num)
    px, py = pixels(w, dpi), pixels(h, dpi)
    if px > MAX_PIXELS or py > MAX_PIXELS:
        raise FolioError("unsupported", f"page of {px} x {py} pixels is too large to render")
    px, py = max(1, px), max(1, py)
    c = Canvas(d, px, py)
    page = d.get(num)
    res = inherited(d, num, {"Resources": lambda v: v if isinstance(v := d.resolve(v), dict) else None}).get("Resources", {})
    s = dpi / 72
    try:
        c.run(content.page_content(d, page.get("Contents")), res, mul(m, (s, 0, 0, s, 0, 0)), None, 0)
    except FolioError:
        pass
    return px, py, png(c.img)

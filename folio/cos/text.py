"""Text of a page as positioned runs."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any, NamedTuple

import numpy as np

from . import content
from .document import Document
from .fonts import Font
from .geometry import inherited, page_boxes, page_size
from .objects import FolioError, Name, Ref, Stream

MAX_ANNOTATIONS = 4096
MAX_FORM_DEPTH = 32

# How runs are told apart, in ems unless said otherwise. Fixed values.
SIZE_TOLERANCE, SAME_WAY = 0.02, 0.99
ASIDE, BACK, WORD_GAP, RUN_GAP = 0.15, -0.25, 0.1, 0.6
BACK_BLIND, GAP_BLIND = -0.05, 1.6
ASCENT, BLIND_ADVANCE = 0.8, 0.5


class Glyph(NamedTuple):
    text: str | None
    origin: tuple[float, float]
    right: tuple[float, float]  # the em's vector along the line
    up: tuple[float, float]
    advance: tuple[float, float] | None
    stroke: bool


class Run(NamedTuple):
    text: str
    x: float
    y: float
    width: float
    height: float
    font_size: float


class PageText(NamedTuple):
    page: int
    width: float
    height: float
    degraded: bool
    runs: list[Run]


def mul(a: tuple, b: tuple) -> tuple:
    """First ``a``, then ``b``."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def apply(m: tuple, x: float, y: float) -> tuple[float, float]:
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def page_transform(d: Document, num: int) -> tuple[tuple, float, float]:
    """From page space to the page as shown, its origin at the top left, and the shown size."""
    media, crop, turn = page_boxes(d, num)
    w, h, r = page_size(media, crop, turn)
    if media is None:
        x0 = y0 = 0.0
    else:
        c = crop or media
        x0, y0 = float(max(media[0], c[0])), float(max(media[1], c[1]))
    pw, ph = (float(h), float(w)) if r in (90, 270) else (float(w), float(h))
    m = {0: (1, 0, 0, -1, -x0, ph + y0), 90: (0, 1, 1, 0, -y0, -x0), 180: (-1, 0, 0, 1, pw + x0, -y0), 270: (0, -1, -1, 0, ph + y0, pw + x0)}[r]
    return m, float(w), float(h)


NEW_TEXT = {"font": None, "size": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0, "mode": 0}
UNIT = (1, 0, 0, 1, 0, 0)


class Position:
    """The text matrix and that of the line."""

    def __init__(self) -> None:
        self.tm = self.line = UNIT

    def move(self, m: tuple) -> None:
        self.tm = self.line = m


def numbers(a: list) -> list[float]:
    return [float(x) if isinstance(x, (int, float)) else 0.0 for x in a]


def text_operator(op: str, args: list, st: dict, at: Position, font: Callable[[Any], Font], show: Callable[[bytes, dict, tuple], tuple]) -> bool:
    """Carry out a text operator on the state and the position; whether it was one. ``show`` gives the matrix after a string."""
    if op == "BT":
        at.move(UNIT)
    elif op == "Tf":
        st["font"], st["size"] = font(args[0]), float(args[1])
    elif op in ("Tc", "Tw", "TL", "Ts"):
        st[{"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise"}[op]] = numbers(args)[0]
    elif op == "Tz":
        st["scale"] = numbers(args)[0] / 100
    elif op == "Tr":
        st["mode"] = int(args[0])
    elif op in ("Td", "TD"):
        x, y = numbers(args[:2])
        if op == "TD":
            st["lead"] = -y
        at.move(mul((1, 0, 0, 1, x, y), at.line))
    elif op == "Tm":
        at.move(tuple(numbers(args[:6])))
    elif op == "T*":
        at.move(mul((1, 0, 0, 1, 0, -st["lead"]), at.line))
    elif op in ("Tj", "TJ", "'", '"'):
        if op == '"':
            st["word"], st["char"] = numbers(args[:2])
        if op in ("'", '"'):
            at.move(mul((1, 0, 0, 1, 0, -st["lead"]), at.line))
        for part in args[-1] if op == "TJ" else [args[-1]]:
            if isinstance(part, bytes):
                at.tm = show(part, st, at.tm)
            elif isinstance(part, (int, float)):
                step = -part / 1000 * st["size"]
                vertical = st["font"] is not None and st["font"].vertical
                at.tm = mul((1, 0, 0, 1, 0, step) if vertical else (1, 0, 0, 1, step * st["scale"], 0), at.tm)
    else:
        return False
    return True


def laid_out(f: Font, s: bytes, st: dict) -> tuple[list[tuple[float, int, str | None, float | None]], tuple]:
    """How far along its line each code of ``s`` stands, with its text and width; and the move to the end."""
    unit = f.matrix[0] if f.kind == "Type3" else 0.001
    out, moved, size = [], 0.0, st["size"]
    for code, text, w, space in f.codes(s):
        out.append((moved, code, text, w))
        extra = st["char"] + (st["word"] if space else 0.0)
        moved += extra - size if f.vertical else ((500.0 if w is None else w) * unit * size + extra) * st["scale"]
    return out, (1, 0, 0, 1, 0, moved) if f.vertical else (1, 0, 0, 1, moved, 0)


class Interpreter:
    """Walks content and collects glyphs."""

    def __init__(self, d: Document):
        self.d = d
        self.fonts: dict[Any, Font] = {}
        self.glyphs: list[Glyph] = []
        self.bad_font = self.too_deep = False

    def font(self, ref: Any) -> Font:
        key = ref.num if isinstance(ref, Ref) else id(ref)
        if key not in self.fonts:
            self.fonts[key] = Font(self.d, self.d.resolve(ref))
        f = self.fonts[key]
        self.bad_font |= not f.supported
        return f

    def named_font(self, resources: dict) -> Callable[[Any], Font]:
        def of(name: Any) -> Font:
            table = self.d.resolve(resources.get("Font")) or {}
            return self.font(table[name]) if name in table else self.font({})

        return of

    def run(self, data: bytes, resources: dict, ctm: tuple, depth: int = 0) -> None:
        d, saved, at = self.d, [], Position()
        state = {"ctm": ctm, **NEW_TEXT}
        font = self.named_font(resources)
        for op, args in content.operators(data, lenient=True):
            try:
                if op == "q":
                    saved.append(dict(state))
                elif op == "Q":
                    state = saved.pop() if saved else state
                elif op == "cm":
                    state["ctm"] = mul(tuple(numbers(args[:6])), state["ctm"])
                elif text_operator(op, args, state, at, font, self.show):
                    continue
                elif op == "Do":
                    form = d.resolve((d.resolve(resources.get("XObject")) or {}).get(args[0]))
                    self.form(form, resources, state["ctm"], depth)
                elif op == "gs":
                    g = d.resolve((d.resolve(resources.get("ExtGState")) or {}).get(args[0]))
                    f = d.resolve(g.get("Font")) if isinstance(g, dict) else None
                    if isinstance(f, list) and len(f) == 2:
                        state["font"], state["size"] = self.font(f[0]), float(d.resolve(f[1]))
            except (IndexError, TypeError, ValueError, KeyError, FolioError):
                continue  # an operator with unusable operands draws nothing

    def form(self, form: Any, resources: dict, ctm: tuple, depth: int) -> None:
        if not isinstance(form, Stream) or form.dict.get("Subtype") != "Form":
            return
        if depth >= MAX_FORM_DEPTH:
            self.too_deep = True
            return
        d = self.d
        m = d.resolve(form.dict.get("Matrix"))
        m = tuple(float(d.resolve(x)) for x in m) if isinstance(m, list) and len(m) == 6 else (1, 0, 0, 1, 0, 0)
        own = d.resolve(form.dict.get("Resources"))
        self.run(d.decoded(form), own if isinstance(own, dict) else resources, mul(m, ctm), depth + 1)

    def show(self, s: bytes, st: dict, tm: tuple) -> tuple:
        f, size = st["font"], st["size"]
        if f is None:
            f = st["font"] = self.font({})
        # the line's directions hold for the whole string; only the origin moves
        line = mul(tm, st["ctm"])
        place = mul((size * st["scale"], 0, 0, size, 0, st["rise"]), line)
        em = [1000 * x for x in f.matrix[:4]] if f.kind == "Type3" else None
        shape = mul((*em, 0, 0), place) if em else place
        right, up = (shape[0], shape[1]), (shape[2], shape[3])
        unit = f.matrix[0] if em else 0.001
        stroke, both = st["mode"] in (1, 5), st["mode"] in (2, 6)
        step = (line[2], line[3]) if f.vertical else (line[0], line[1])
        x0, y0, add = place[4], place[5], self.glyphs.append
        laid, move = laid_out(f, s, st)
        for moved, _, text, w in laid:
            adv = (place[0] * w * unit, place[1] * w * unit) if w is not None and not em else None
            g = Glyph(text, (x0 + moved * step[0], y0 + moved * step[1]), right, up, adv, stroke)
            add(g)
            if both:
                add(g._replace(stroke=True))
        return mul(move, tm)


class Columns:
    """Glyphs as columns, without those that cannot be placed and without outlines drawn over a filled glyph.

    ``far`` is where a glyph ends, ``step`` how far each begins from the end of the one before (from its origin where
    its width is unknown, which ``blind`` marks).
    """

    def __init__(self, glyphs: list[Glyph]):
        xy = lambda f: np.array([f(g) for g in glyphs], dtype=float).reshape(-1, 2)
        none = (np.nan, np.nan)
        at, right, up, adv = xy(lambda g: g.origin), xy(lambda g: g.right), xy(lambda g: g.up), xy(lambda g: g.advance or none)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            size, along = np.hypot(*up.T), np.hypot(*right.T)
            keep = np.isfinite(at).all(axis=1) & np.isfinite(size) & np.isfinite(along) & (size > 0) & (along > 0)
        stroke = np.array([g.stroke for g in glyphs], dtype=bool)
        # the last filled glyph up to each one; -1 where there is none
        filled = np.maximum.accumulate(np.where(keep & ~stroke, np.arange(len(glyphs)), -1)) if len(glyphs) else np.zeros(0, dtype=int)
        keep &= ~(stroke & (filled >= 0) & (at == at[filled]).all(axis=1))
        k = np.flatnonzero(keep)
        self.texts = [glyphs[i].text for i in k.tolist()]
        self.at, self.size = at[k], size[k]
        self.way, self.up = right[k] / along[k, None], up[k] / size[k, None]
        far = self.at + adv[k]
        blind = np.isnan(far).any(axis=1)
        self.far = np.where(blind[:, None], self.at + self.way * (BLIND_ADVANCE * self.size)[:, None], far)
        self.blind = np.r_[False, blind[:-1]]
        self.step = self.at - np.vstack([self.at[:1], np.where(blind[:, None], self.at, far)[:-1]])

    def against(self, lo: int, hi: int, style: int) -> tuple[np.ndarray, np.ndarray]:
        """Of glyphs ``lo .. hi``: which go on with the glyph before in a run that began with ``style``, and which after a space."""
        size, way, up = self.size[style], self.way[style], self.up[style]
        gap, aside = self.step[lo:hi] @ way / size, self.step[lo:hi] @ up / size
        blind = self.blind[lo:hi]
        alike = (np.abs(self.size[lo:hi] - size) <= SIZE_TOLERANCE * size) & (self.way[lo:hi] @ way >= SAME_WAY) & (self.up[lo:hi] @ up >= SAME_WAY)
        near = (gap >= np.where(blind, BACK_BLIND, BACK)) & (gap <= np.where(blind, GAP_BLIND, RUN_GAP))
        return alike & near & (np.abs(aside) <= ASIDE), ~blind & (gap >= WORD_GAP)


def run_starts(c: Columns) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the glyphs that begin a run and of those that a space comes before.

    A run is told by the style of its first glyph. Glyphs of one style in a row are looked at together: first against the
    run they may go on with, and from where that ends against their own style.
    """
    n = len(c.size)
    begins, spaced = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    shape = np.column_stack([c.size, c.way, c.up])
    edges = np.r_[0, 1 + np.flatnonzero((shape[1:] != shape[:-1]).any(axis=1)), n] if n else np.zeros(1, dtype=int)
    style = None
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if style is not None:
            goes_on, gap = c.against(lo, hi, style)
            stop = int(np.argmin(goes_on)) if not goes_on.all() else hi - lo
            spaced[lo : lo + stop] = gap[:stop]
            lo += stop
        if lo < hi:
            goes_on, gap = c.against(lo, hi, lo)
            goes_on[0] = False
            begins[lo:hi], spaced[lo:hi] = ~goes_on, gap & goes_on
            style = lo + int(np.flatnonzero(~goes_on)[-1])
    return begins, spaced


def fold(glyphs: list[Glyph]) -> tuple[list[Run], bool]:
    """Glyphs in drawing order to runs, and whether any glyph's text is unknown."""
    c = Columns(glyphs)
    begins, spaced = run_starts(c)
    first = np.flatnonzero(begins)
    last = np.r_[first[1:], len(begins)] - 1
    # the line's ascent and descent at both ends
    size, up = c.size[first, None], c.up[first]
    corners = np.stack([end + up * k * size for end in (c.at[first], c.far[last]) for k in (ASCENT, ASCENT - 1)]) if len(first) else np.zeros((4, 0, 2))
    low, extent = corners.min(axis=0).astype(np.float32), np.ptp(corners, axis=0).astype(np.float32)
    runs = []
    for k, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
        text = ""
        for t, gap in zip(c.texts[a : b + 1], spaced[a : b + 1].tolist()):
            t = "\ufffd" if t is None else t
            text += " " + t if gap and not text[-1:].isspace() and not t[:1].isspace() else t
        if text.strip():
            runs.append(Run(text, *low[k].tolist(), *extent[k].tolist(), float(np.float32(c.size[a]))))
    return runs, None in c.texts


def annotations(d: Document, page: dict, it: Interpreter, ctm: tuple) -> bool:
    """Appearance streams of the page's annotations; whether there are too many to look at."""
    annots = d.resolve(page.get("Annots"))
    if not isinstance(annots, list):
        return False
    if len(annots) > MAX_ANNOTATIONS:
        return True
    for a in annots:
        a = d.resolve(a)
        if not isinstance(a, dict):
            continue
        flags = d.resolve(a.get("F")) or 0
        if isinstance(flags, int) and flags & 2:
            continue
        ap = d.resolve(a.get("AP"))
        n = d.resolve(ap.get("N")) if isinstance(ap, dict) else None
        if isinstance(n, dict):
            n = d.resolve(n.get(d.resolve(a.get("AS"))))
        rect = [d.resolve(x) for x in d.resolve(a.get("Rect")) or []]
        if not isinstance(n, Stream) or len(rect) < 4 or any(not isinstance(x, (int, float)) for x in rect[:4]):
            continue
        box = [float(d.resolve(x)) for x in d.resolve(n.dict.get("BBox")) or [0, 0, 1, 1]][:4]
        m = d.resolve(n.dict.get("Matrix"))
        m = tuple(float(d.resolve(x)) for x in m) if isinstance(m, list) and len(m) == 6 else (1, 0, 0, 1, 0, 0)
        pts = [apply(m, x, y) for x in box[::2] for y in box[1::2]]
        bx0, by0 = min(p[0] for p in pts), min(p[1] for p in pts)
        bw, bh = max(p[0] for p in pts) - bx0, max(p[1] for p in pts) - by0
        rx0, ry0, rx1, ry1 = min(rect[0], rect[2]), min(rect[1], rect[3]), max(rect[0], rect[2]), max(rect[1], rect[3])
        sx, sy = (rx1 - rx0) / bw if bw else 1.0, (ry1 - ry0) / bh if bh else 1.0
        it.form(Stream(n.dict | {Name("Subtype"): Name("Form")}, n.raw), {}, mul((sx, 0, 0, sy, rx0 - bx0 * sx, ry0 - by0 * sy), ctm), 0)
    return False


def page_text(d: Document, num: int, number: int, with_annotations: bool = True) -> PageText:
    m, w, h = page_transform(d, num)
    page = d.get(num)
    res = inherited(d, num, {"Resources": lambda v: v if isinstance(v := d.resolve(v), dict) else None}).get("Resources", {})
    it = Interpreter(d)
    failed = False
    try:
        it.run(content.page_content(d, page.get("Contents")), res, m)
    except FolioError:
        failed = True
    flood = annotations(d, page, it, m) if with_annotations else False
    runs, missing = fold(it.glyphs)
    return PageText(number, w, h, missing or it.bad_font or it.too_deep or flood or failed, runs)


# --- JSON


def json_number(v: float) -> str:
    """Three decimals, halves away from zero, whole numbers without a fraction; what is not finite is 0."""
    if not math.isfinite(v):
        return "0"
    r = math.copysign(math.floor(abs(v) * 1000 + 0.5) / 1000, v)
    return str(int(r)) if r == int(r) and abs(r) < 1e15 else repr(r)


def json_string(s: str) -> str:
    esc = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return '"' + "".join(esc.get(c) or (f"\\u{ord(c):04x}" if ord(c) < 32 else c) for c in s) + '"'


def pages_json(pages: list[PageText]) -> str:
    n = json_number
    run = lambda r: f'{{"text":{json_string(r.text)},"x":{n(r.x)},"y":{n(r.y)},"width":{n(r.width)},"height":{n(r.height)},"font_size":{n(r.font_size)}}}'
    page = lambda p: f'{{"page":{p.page},"page_width":{n(p.width)},"page_height":{n(p.height)},"degraded":{str(p.degraded).lower()},"runs":[{",".join(map(run, p.runs))}]}}'
    return "[" + ",".join(map(page, pages)) + "]"

"""What embedded font programs say about their codes: TrueType and OpenType, Type 1, and CFF.

Which character a code or a glyph stands for, and the outlines of TrueType glyphs. Damaged programs say nothing.
"""

from __future__ import annotations

import re
import struct

import numpy as np

from .lexer import SPACE


def _u16(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 2], "big")


def _u32(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4], "big")


def sfnt_tables(data: bytes) -> dict[str, bytes]:
    """The tables of a TrueType or OpenType program."""
    n = _u16(data, 4)
    out = {}
    for k in range(n):
        tag, _, at, size = struct.unpack_from(">4sIII", data, 12 + 16 * k)
        out[tag.decode("latin-1")] = data[at : at + size]
    return out


def _cmap(table: bytes) -> dict[int, int]:
    """Code -> glyph of one subtable of format 0, 4, 6 or 12."""
    kind = _u16(table, 0)
    if kind == 0:
        return {c: g for c, g in enumerate(table[6:262]) if g}
    if kind == 6:
        first, n = _u16(table, 6), _u16(table, 8)
        return {first + k: g for k in range(n) if (g := _u16(table, 10 + 2 * k))}
    if kind == 12:
        out = {}
        for k in range(min(_u32(table, 12), len(table) // 12)):
            a, b, g = struct.unpack_from(">III", table, 16 + 12 * k)
            out |= {c: g + c - a for c in range(a, min(b, a + 0xFFFF) + 1)}
        return out
    if kind != 4:
        return {}
    n = _u16(table, 6) // 2
    ends, starts, deltas, offsets = (14 + 2 * n * k + (2 if k else 0) for k in range(4))
    out = {}
    for k in range(n):
        a, b = _u16(table, starts + 2 * k), _u16(table, ends + 2 * k)
        delta, far = _u16(table, deltas + 2 * k), _u16(table, offsets + 2 * k)
        for c in range(a, min(b, 0xFFFE) + 1):
            g = c if not far else _u16(table, offsets + 2 * k + far + 2 * (c - a))
            if g or not far:
                g = (g + delta) & 0xFFFF
                if g:
                    out[c] = g
    return out


def _contours(g: bytes, n: int) -> list[np.ndarray]:
    """Polygons of a simple glyph; curves become eight lines each."""
    ends = struct.unpack_from(f">{n}H", g, 10)
    total = ends[-1] + 1 if n else 0
    at = 10 + 2 * n
    at += 2 + _u16(g, at)
    flags: list[int] = []
    while len(flags) < total:
        f = g[at]
        at += 1
        flags.append(f)
        if f & 8:
            flags += [f] * g[at]
            at += 1
    axes = []
    for short, same in ((2, 16), (4, 32)):
        v, line = 0, []
        for f in flags[:total]:
            if f & short:
                v += g[at] if f & same else -g[at]
                at += 1
            elif not f & same:
                v += int.from_bytes(g[at : at + 2], "big", signed=True)
                at += 2
            line.append(v)
        axes.append(line)
    pts, on = np.array(axes, dtype=float).T, np.array(flags[:total], dtype=int) & 1
    out, begin = [], 0
    t = (np.arange(1, 9) / 8)[:, None]
    for end in ends:
        p, o = pts[begin : end + 1], on[begin : end + 1]
        begin = end + 1
        if len(p) < 2:
            continue
        # a point on the curve lies between two that are not
        full = []
        for k in range(len(p)):
            full.append((p[k], bool(o[k])))
            if not o[k] and not o[(k + 1) % len(p)]:
                full.append(((p[k] + p[(k + 1) % len(p)]) / 2, True))
        first = next((k for k, (_, is_on) in enumerate(full) if is_on), 0)
        full = full[first:] + full[:first] + [full[first]]
        poly, k = [full[0][0]], 1
        while k < len(full):
            if full[k][1]:
                poly.append(full[k][0])
                k += 1
            else:
                a, c, b = poly[-1], full[k][0], full[k + 1][0]
                poly += list((1 - t) ** 2 * a + 2 * (1 - t) * t * c + t**2 * b)
                k += 2
        out.append(np.array(poly))
    return out


class TrueType:
    """``glyph(code)`` of a simple font without an encoding of its own, and ``text(glyph)``."""

    def __init__(self, data: bytes):
        t = sfnt_tables(data)
        self.tables = t
        self.maps: dict[tuple[int, int], dict[int, int]] = {}
        c = t.get("cmap", b"")
        for k in range(_u16(c, 2) if c else 0):
            platform, way, at = struct.unpack_from(">HHI", c, 4 + 8 * k)
            self.maps[platform, way] = _cmap(c[at:])
        self.chars: dict[int, str] = {}
        for key in ((3, 10), (0, 4), (3, 1), (0, 3), (0, 1), (0, 0)):
            for code, g in self.maps.get(key, {}).items():
                self.chars.setdefault(g, chr(code))
        self.names = self._post(t.get("post", b""))
        self._by_char: dict[str, int] = {}

    @staticmethod
    def _post(post: bytes) -> dict[int, str]:
        """Glyph names of their own, from a table of version 2; the standard ones are left to the character map."""
        if len(post) < 34 or _u32(post, 0) != 0x20000:
            return {}
        n = _u16(post, 32)
        own, at = [], 34 + 2 * n
        while at < len(post):
            own.append(post[at + 1 : at + 1 + post[at]].decode("latin-1"))
            at += 1 + post[at]
        index = [_u16(post, 34 + 2 * g) for g in range(n)]
        return {g: own[i - 258] for g, i in enumerate(index) if i >= 258 and i - 258 < len(own)}

    def by_char(self) -> dict[str, int]:
        if not self._by_char:
            self._by_char = {c: g for g, c in self.chars.items()}
        return self._by_char

    def outline(self, glyph: int, depth: int = 0) -> list[np.ndarray]:
        """The contours of a glyph as polygons, in ems."""
        head, loca, glyf = (self.tables.get(k, b"") for k in ("head", "loca", "glyf"))
        if len(head) < 54 or glyph < 0 or depth > 8:
            return []
        size = 4 if _u16(head, 50) else 2
        if len(loca) < size * (glyph + 2):
            return []
        at, end = (int.from_bytes(loca[size * k : size * (k + 1)], "big") * (1 if size == 4 else 2) for k in (glyph, glyph + 1))
        g = glyf[at:end]
        if len(g) < 10:
            return []
        n = int.from_bytes(g[:2], "big", signed=True)
        em = _u16(head, 18) or 1000
        return [c / em for c in _contours(g, n)] if n >= 0 else self._parts(g, em, depth)

    def _parts(self, g: bytes, em: int, depth: int) -> list[np.ndarray]:
        """A glyph made of others, each moved and scaled."""
        out, at, more = [], 10, True
        while more:
            flags, part = _u16(g, at), _u16(g, at + 2)
            at += 4
            dx, dy = struct.unpack_from(">hh" if flags & 1 else ">bb", g, at)
            at += 4 if flags & 1 else 2
            count = 1 if flags & 8 else 2 if flags & 64 else 4 if flags & 128 else 0
            v = [x / 16384 for x in struct.unpack_from(f">{count}h", g, at)]
            at += 2 * count
            m = np.array([[1, 0], [0, 1]] if not v else [[v[0], 0], [0, v[0]]] if count == 1 else [[v[0], 0], [0, v[1]]] if count == 2 else [v[:2], v[2:]], dtype=float)
            move = np.array([dx, dy]) / em if flags & 2 else np.zeros(2)
            out += [c @ m + move for c in self.outline(part, depth + 1)]
            more = bool(flags & 32)
        return out

    def glyph(self, code: int) -> int:
        symbol, mac = self.maps.get((3, 0), {}), self.maps.get((1, 0), {})
        return next((g for m, c in ((symbol, 0xF000 + code), (symbol, code), (mac, code)) if (g := m.get(c))), 0)


_DUP = re.compile(rb"dup[" + SPACE + rb"]+(\d+)[" + SPACE + rb"]*/([^" + SPACE + rb"/()<>\[\]{}%]+)[" + SPACE + rb"]+put")


def type1_encoding(data: bytes) -> dict[int, str] | None:
    """Code -> glyph name of a Type 1 program's own encoding; None where it is the standard one."""
    clear = data.split(b"eexec", 1)[0]
    at = clear.find(b"/Encoding")
    if at < 0 or re.match(rb"/Encoding[" + SPACE + rb"]+StandardEncoding", clear[at:]):
        return None
    return {int(m[1]): m[2].decode("latin-1") for m in _DUP.finditer(clear, at) if int(m[1]) < 256}


def _index(b: bytes, at: int) -> tuple[list[bytes], int]:
    n = _u16(b, at)
    if not n:
        return [], at + 2
    size = b[at + 2]
    off = [int.from_bytes(b[at + 3 + size * k : at + 3 + size * (k + 1)], "big") for k in range(n + 1)]
    base = at + 2 + size * (n + 1)
    return [b[base + x : base + y] for x, y in zip(off, off[1:])], base + off[-1]


def _dict(b: bytes) -> dict[int, list]:
    """Operators (escaped ones plus 1200) with their operands; reals are not needed and count as 0."""
    out, args, at = {}, [], 0
    while at < len(b):
        x = b[at]
        at += 1
        if x == 12:
            out[1200 + b[at]], args = args, []
            at += 1
        elif x <= 21:
            out[x], args = args, []
        elif x == 28:
            args.append(int.from_bytes(b[at : at + 2], "big", signed=True))
            at += 2
        elif x == 29:
            args.append(int.from_bytes(b[at : at + 4], "big", signed=True))
            at += 4
        elif x == 30:
            while at < len(b) and b[at] & 15 != 15 and b[at] >> 4 != 15:
                at += 1
            at += 1
            args.append(0)
        elif x <= 246:
            args.append(x - 139)
        elif x <= 250:
            args.append((x - 247) * 256 + b[at] + 108)
            at += 1
        else:
            args.append(-(x - 251) * 256 - b[at] - 108)
            at += 1
    return out


class CFF:
    """Glyph names by glyph, and glyphs by code where the program has an encoding of its own.

    Names with a standard number below 150 are those of the standard encoding in the order of its codes; ``standard`` gives
    the characters of these. Further standard names are unknown here.
    """

    def __init__(self, data: bytes, standard: list[str]):
        _, at = _index(data, data[2])
        tops, at = _index(data, at)
        strings, _ = _index(data, at)
        top = _dict(tops[0])
        count = _u16(data, top[17][0])
        self.keyed = 1230 in top  # glyphs have numbers, not names
        self.sids = [0] * count
        at = top.get(15, [0])[0]
        if at > 2:
            kind, at, g = data[at], at + 1, 1
            while g < count:
                first = _u16(data, at)
                at += 2
                left = 0 if kind == 0 else data[at] if kind == 1 else _u16(data, at)
                at += kind
                for k in range(left + 1):
                    if g < count:
                        self.sids[g] = first + k
                        g += 1
        elif not self.keyed:
            self.sids = list(range(count))
        self.names: dict[int, str] = {}
        self.chars: dict[int, str] = {}
        for g, sid in enumerate(self.sids):
            if self.keyed or not g:
                continue
            if sid >= 391 and sid - 391 < len(strings):
                self.names[g] = strings[sid - 391].decode("latin-1")
            elif 1 <= sid <= len(standard):
                self.chars[g] = standard[sid - 1]
        self.codes: dict[int, int] | None = None
        at = top.get(16, [0])[0]
        if at > 1 and not self.keyed:
            self.codes, kind, n, at = {}, data[at] & 127, data[at + 1], at + 2
            g = 1
            for k in range(n):
                first, left = (data[at + k], 0) if kind == 0 else (data[at + 2 * k], data[at + 2 * k + 1])
                for c in range(first, first + left + 1):
                    self.codes[c] = g
                    g += 1

"""Opening a file: its cross-reference chain, or a sweep for objects where that is damaged."""

from __future__ import annotations

import re
from typing import Any

import numpy as np

from . import filters
from .crypt import Handler
from .lexer import END, SPACE, parse, skip
from .objects import FolioError, Keyword, Ref, Stream, broken, invalid

MAX_SECTIONS = 1024
MAX_DEPTH = 256
MAX_HOPS = 256
MAX_MEMBERS = 65_536
_HEAD = re.compile(rb"(\d{1,10})[" + SPACE + rb"]+(\d{1,5})[" + SPACE + rb"]+obj(?![A-Za-z0-9])")
_SWEEP = re.compile(rb"(?<![^" + SPACE + rb"()<>\[\]{}/%A-Za-z])(?<!\d)(\d{1,10})[" + SPACE + rb"]+(\d{1,5})[" + SPACE + rb"]+obj(?![A-Za-z0-9])(?=[" + SPACE + rb"]*(?:[<\[(/+\-.0-9%]|true|false|null|endobj|\Z))")
_EOL = re.compile(rb"\r\n|\n|\r")
_ENTRY = re.compile(rb"[" + SPACE + rb"]*(\d{1,20})[" + SPACE + rb"]+(\d{1,10})[" + SPACE + rb"]+([nf])")
_VERSION = re.compile(rb"%PDF-([0-9.]+)")
_ENCRYPT = re.compile(rb"/Encrypt[" + SPACE + rb"]+\d+[" + SPACE + rb"]+\d+[" + SPACE + rb"]+R")


class Damaged(FolioError):
    """An offset that does not lead to its object; a rebuilt cross-reference may help."""

    def __init__(self, message: str):
        super().__init__("pdf", message)

    def __reduce__(self):
        return Damaged, (self.message,)


def read_indirect(buf: bytes, pos: int, length_of=None) -> tuple[int, int, Any, int]:
    """Number, generation and value of the object at ``pos``, and where it ends."""
    m = _HEAD.match(buf, skip(buf, pos))
    if m is None:
        raise Damaged(f"no object at offset {pos}")
    v, end = parse(buf, m.end())
    if isinstance(v, Keyword):
        if v == b"endobj":
            return int(m[1]), int(m[2]), None, end
        raise Damaged(f"unparsable object at offset {pos}")
    if isinstance(v, dict):
        at = skip(buf, end)
        if buf.startswith(b"stream", at):
            start = at + 6
            if buf.startswith(b"\r\n", start):
                start += 2
            elif buf[start : start + 1] in (b"\n", b"\r"):
                start += 1
            n = v.get("Length")
            if isinstance(n, Ref):
                n = length_of(n) if length_of else None
            if isinstance(n, int) and 0 <= n <= len(buf) - start and buf.startswith(b"endstream", skip(buf, start + n)):
                stop = start + n
            else:
                stop = buf.find(b"endstream", start)
                if stop < 0:
                    raise Damaged(f"stream without an end at offset {pos}")
                if buf[stop - 2 : stop] == b"\r\n":
                    stop -= 2
                elif buf[stop - 1 : stop] in (b"\n", b"\r"):
                    stop -= 1
                stop = max(stop, start)
            return int(m[1]), int(m[2]), Stream(filters.normalise(v), buf[start:stop]), buf.find(b"endstream", stop) + 9
    return int(m[1]), int(m[2]), v, end


def xref_stream_entries(d: dict, data: bytes) -> dict[int, tuple]:
    w = d.get("W")
    if not isinstance(w, list) or len(w) < 3 or any(not isinstance(x, int) or not 0 <= x <= 8 for x in w):
        raise Damaged("bad widths in a cross-reference stream")
    w, width = w[:3], sum(w)
    index = d.get("Index") or [0, d.get("Size", 0)]
    if len(index) % 2 or any(not isinstance(x, int) or x < 0 for x in index) or not width:
        raise Damaged("bad index in a cross-reference stream")
    total = sum(index[1::2])
    if total * width > len(data):
        raise Damaged("cross-reference stream is too short")
    t = np.frombuffer(data, dtype=np.uint8, count=total * width).reshape(total, width)
    cols, at = [], 0
    for k, n in enumerate(w):
        c = np.full(total, 1 if k == 0 and n == 0 else 0, dtype=object if n == 8 else np.int64)
        for j in range(n):
            c = c * 256 + t[:, at + j]
        cols.append(c)
        at += n
    out, row = {}, 0
    for first, count in zip(index[::2], index[1::2]):
        for k in range(count):
            kind, a, b = (int(c[row]) for c in cols)
            row += 1
            if kind == 1 and b <= 65535:
                out.setdefault(first + k, ("n", a, b))
            elif kind == 2:
                out.setdefault(first + k, ("c", a, b))
    return out


def classic_entries(buf: bytes, pos: int) -> tuple[dict[int, tuple], dict]:
    """The table that begins after the word xref, and its trailer."""
    out: dict[int, tuple] = {}
    while True:
        pos = skip(buf, pos)
        if buf.startswith(b"trailer", pos):
            t, _ = parse(buf, pos + 7)
            if not isinstance(t, dict):
                raise Damaged("trailer is not a dictionary")
            return out, t
        m = re.compile(rb"(\d{1,10})[" + SPACE + rb"]+(\d{1,10})").match(buf, pos)
        if m is None:
            raise Damaged("bad cross-reference subsection")
        first, count, pos = int(m[1]), int(m[2]), m.end()
        if count * 18 > len(buf) - pos:
            raise Damaged("cross-reference subsection exceeds the file")
        for k in range(count):
            e = _ENTRY.match(buf, pos)
            if e is None:
                raise Damaged("bad cross-reference entry")
            pos = e.end()
            if e[3] == b"n" and int(e[2]) <= 65535:
                out.setdefault(first + k, ("n", int(e[1]), int(e[2])))


class Document:
    """A file's objects by number. ``sections`` lists every cross-reference section, newest first."""

    def __init__(self, buf: bytes, source: str = "input"):
        self.buf, self.source = buf, source
        self.xref: dict[int, tuple] = {}
        self.sections: list[dict[int, tuple]] = []
        self.trailer: dict = {}
        self.version, self.load_path = "1.4", "xref"
        self.repaired, self.warnings = False, []
        self.handler: Handler | None = None
        self._cache: dict[int, Any] = {}
        self._members: dict[int, dict[int, Any]] = {}

    # -- objects

    @property
    def size(self) -> int:
        return max(self.xref, default=0) + 1

    def get(self, num: int) -> Any:
        """The object's value; one that is missing is null."""
        if num in self._cache:
            return self._cache[num]
        e = self.xref.get(num)
        if e is None:
            return None
        if e[0] == "n":
            self._cache[num] = None  # a length that refers to its own stream
            try:
                n, g, v, _ = read_indirect(self.buf, e[1], lambda r: self.resolve(r))
                if n != num:
                    raise Damaged(f"object {num} expected at offset {e[1]}, found {n}")
            except FolioError as x:
                if self.repaired:  # nothing better is to be had: as if it were missing
                    return None
                del self._cache[num]
                raise x if isinstance(x, Damaged) else Damaged(x.message) from None
            if self.handler is not None and not (isinstance(self.trailer.get("Encrypt"), Ref) and self.trailer["Encrypt"].num == num):
                v = self.handler.value(v, n, g)
        else:
            v = self.members(e[1]).get(num)
        self._cache[num] = v
        return v

    def resolve(self, v: Any) -> Any:
        """What ``v`` leads to; a chain without end or with a gap leads to null."""
        for _ in range(MAX_HOPS):
            if not isinstance(v, Ref):
                return v
            v = self.get(v.num)
        return None

    def members(self, container: int) -> dict[int, Any]:
        """Objects in an object stream, by number."""
        if container in self._members:
            return self._members[container]
        e = self.xref.get(container)
        if e is None or e[0] != "n":
            raise invalid(f"object stream {container} is not a plain object")
        s = self.get(container)
        if not isinstance(s, Stream):
            raise Damaged(f"object stream {container} is not a stream")
        data = self.decoded(s)
        n, first = self.resolve(s.dict.get("N")), self.resolve(s.dict.get("First"))
        if not isinstance(n, int) or not isinstance(first, int) or not 0 <= n <= MAX_MEMBERS:
            raise Damaged(f"bad object stream {container}")
        head = [int(x) for x in re.findall(rb"\d+", data[:first])][: 2 * n]
        out = {}
        for num, off in zip(head[::2], head[1::2]):
            try:
                v, _ = parse(data, first + off)
                out.setdefault(num, None if isinstance(v, Keyword) else v)
            except FolioError:
                out.setdefault(num, None)
        self._members[container] = out
        return out

    def decoded(self, s: Stream) -> bytes:
        return filters.decode(s.raw, *filters.chain(s.dict, self.resolve))

    # -- opening

    def read_chain(self) -> None:
        """Follow the cross-reference sections from the newest on; the first entry of a number counts."""
        buf = self.buf
        at = buf.rfind(b"startxref")
        m = re.compile(rb"startxref[" + SPACE + rb"]*(\d{1,20})").match(buf, at) if at >= 0 else None
        if m is None:
            raise Damaged("no startxref")
        todo, seen = [int(m[1])], set()
        while todo:
            pos = todo.pop(0)
            if pos in seen or len(seen) >= MAX_SECTIONS:
                raise Damaged("cross-reference sections form a loop")
            seen.add(pos)
            if not 0 <= pos < len(buf):
                raise Damaged("cross-reference offset outside the file")
            at = skip(buf, pos)
            if buf.startswith(b"xref", at):
                entries, t = classic_entries(buf, at + 4)
            else:
                _, _, s, _ = read_indirect(buf, at)
                if not isinstance(s, Stream) or s.dict.get("Type") != "XRef":
                    raise Damaged("no cross-reference section at its offset")
                t = s.dict
                entries = xref_stream_entries(t, filters.decode(s.raw, *filters.chain(t)))
            if not self.sections:
                self.trailer = {k: v for k, v in t.items() if k not in ("Prev", "XRefStm", "W", "Index", "Filter", "DecodeParms", "Length", "Type")}
            self.sections.append(entries)
            for n, e in entries.items():
                self.xref.setdefault(n, e)
            nxt = [t[k] for k in ("XRefStm", "Prev") if isinstance(t.get(k), int)]
            todo = nxt + todo
        m = _VERSION.search(buf, 0, 1024)
        self.version = m[1].decode() if m else "1.4"
        if not buf.startswith(b"%PDF-"):  # its offsets are right all the same
            self.load_path = "late header"
        for n, e in self.xref.items():
            if e[0] == "c" and self.xref.get(e[1], ("c",))[0] != "n":
                raise invalid(f"object {n} lies in {e[1]}, which is no plain object")

    def sweep(self) -> None:
        """Rebuild the cross-reference from object headers; the last header of a number counts."""
        buf = self.buf
        self._cache.clear()
        self._members.clear()
        self.xref, self.sections = {}, []
        for m in _SWEEP.finditer(buf):
            num, gen = int(m[1]), int(m[2])
            if num > 0 and gen <= 65535:
                self.xref[num] = ("n", m.start(), gen)
        catalogs, streams, tables = [], [], []
        for num, e in sorted(self.xref.items(), key=lambda x: x[1][1]):
            try:
                v = read_indirect(buf, e[1], lambda r: self.resolve(r))[2]
            except FolioError:
                continue
            d = v.dict if isinstance(v, Stream) else v if isinstance(v, dict) else {}
            t = d.get("Type")
            if t == "Catalog":
                catalogs.append(num)
            elif t == "ObjStm" and isinstance(v, Stream):
                streams.append(num)
            elif t == "XRef":
                tables.append(d)
        trailers = []
        for m in re.finditer(rb"trailer", buf):
            try:
                t, _ = parse(buf, m.end())
            except FolioError:
                continue
            if isinstance(t, dict):
                trailers.append(t)
        encrypted = any("Encrypt" in t for t in trailers + tables) or not trailers and _ENCRYPT.search(buf)
        if encrypted:
            raise broken("damaged cross-reference table or trailer (an encrypted file cannot be rebuilt)")
        best = next((t for t in reversed(trailers) if isinstance(t.get("Root"), Ref)), None) or next((t for t in reversed(tables) if isinstance(t.get("Root"), Ref)), {})
        plain = set(self.xref)
        for num in streams:  # later streams win over earlier ones, plain objects over both
            try:
                inside = self.members(num)
            except FolioError:
                continue
            for k, n in enumerate(inside):
                if n not in plain:
                    self.xref[n] = ("c", num, k)
        inner = [n for n, e in self.xref.items() if e[0] == "c" and isinstance(v := self.get(n), dict) and v.get("Type") == "Catalog"]
        for root in ([best["Root"].num] if best else []) + catalogs[::-1] + inner:
            v = self._try(root)
            if isinstance(v, dict) and (v.get("Type") == "Catalog" or "Pages" in v):
                self.trailer = {k: v for k, v in best.items() if k in ("Info", "ID")} | {"Root": Ref(root, self.xref[root][2] if self.xref[root][0] == "n" else 0)}
                break
        else:
            raise broken("damaged cross-reference table or trailer (no catalog found)")
        m = _VERSION.search(buf, 0, 1024)
        self.version = m[1].decode() if m else "1.4"
        self.repaired, self.load_path = True, "repair"
        self.warnings.append(f"{self.source}: damaged file, cross-reference rebuilt from {len(self.xref)} objects")

    def _try(self, num: int) -> Any:
        try:
            return self.get(num)
        except FolioError:
            return None

    def unlock(self, password: str | None) -> None:
        enc = self.trailer.get("Encrypt")
        if enc is None:
            return
        d = self.resolve(enc)
        if not isinstance(d, dict):
            raise broken("encryption dictionary is missing")
        ids = self.resolve(self.trailer.get("ID"))
        first = ids[0] if isinstance(ids, list) and ids and isinstance(ids[0], bytes) else b""
        self._cache.clear()
        self.handler = Handler({k: self.resolve(v) for k, v in d.items()}, bytes(first), password, self.source)
        self._cache.clear()
        self._members.clear()

    # -- page tree

    def catalog(self) -> dict:
        c = self.resolve(self.trailer.get("Root"))
        if not isinstance(c, dict):
            raise broken("catalog is missing")
        return c

    def fast_count(self) -> int | None:
        """The declared number of pages if it can be true: direct, not negative, not above the number of objects."""
        p = self.resolve(self.catalog().get("Pages"))
        n = p.get("Count") if isinstance(p, dict) else None
        return n if isinstance(n, int) and not isinstance(n, bool) and 0 <= n <= self.size else None

    def pages(self, limit: int | None = None) -> list[int]:
        """Numbers of the page objects in document order, at most ``limit``."""
        root = self.catalog().get("Pages")
        if not isinstance(root, Ref):
            raise invalid("catalog has no reference to a page tree")
        out, todo, seen = [], [(root.num, 0)], set()
        while todo and (limit is None or len(out) < limit):
            num, depth = todo.pop()
            if num in seen:
                raise invalid(f"page tree cycle detected at object {num}")
            if depth > MAX_DEPTH:
                raise invalid("page tree exceeds maximum depth")
            seen.add(num)
            kind, kids = classify(self.get(num), num)
            if kind == "Page":
                out.append(num)
            elif kind == "Pages":
                todo += [(k.num, depth + 1) for k in reversed(kid_refs(self.resolve(kids), num))]
        return out

    def count(self, strict: bool = True) -> int:
        if not strict and (n := self.fast_count()) is not None:
            return n
        return len(self.pages())


def classify(v: Any, num: int) -> tuple[str, Any]:
    if not isinstance(v, dict):
        raise invalid(f"page tree node {num} is not a dictionary")
    t = v.get("Type")
    if not isinstance(t, str):
        raise invalid(f"page tree node {num} has no type")
    return str(t), v.get("Kids")


def kid_refs(kids: Any, num: int) -> list[Ref]:
    if not isinstance(kids, list):
        raise invalid(f"kids of page tree node {num} are not an array")
    if any(isinstance(k, dict) for k in kids):
        raise invalid(f"page tree node {num} has a direct object as kid")
    return [k for k in kids if isinstance(k, Ref)]


def nesting(buf: bytes) -> int:
    """How deep ``<<`` nests, pairs taken greedily and never below zero."""
    if buf.count(b"<<") <= 4096:
        return 0
    depth = deepest = 0
    for m in re.finditer(rb"<<|>>", buf):
        depth = depth + 1 if m[0] == b"<<" else max(0, depth - 1)
        deepest = max(deepest, depth)
    return deepest


def open_document(buf: bytes, password: str | None = None, source: str = "input") -> Document:
    """A document ready to read: by its cross-reference, or rebuilt where that is damaged."""
    d = Document(buf, source)
    try:
        d.read_chain()
        d.unlock(password)
        if not isinstance(d.resolve(d.catalog().get("Pages")), dict):
            raise Damaged("no page tree")
        return d
    except FolioError as x:
        if x.code in ("password", "unsupported"):
            raise
        why = x.message
    d = Document(buf, source)
    try:
        d.sweep()
    except FolioError as x:
        raise x if "damaged" in x.message else broken(f"damaged cross-reference table or trailer ({why})") from None
    return d


def with_repair(buf: bytes, run, password: str | None = None, source: str = "input"):
    """``run(document)``; where an offset proves wrong on the way, once more on the rebuilt document."""
    d = open_document(buf, password, source)
    try:
        return run(d)
    except Damaged:
        if d.repaired:
            raise
        d = Document(buf, source)
        d.sweep()
        return run(d)


__all__ = ["END", "Damaged", "Document", "classify", "kid_refs", "nesting", "open_document", "read_indirect", "with_repair"]

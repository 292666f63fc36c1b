"""Objects to bytes: a file with a classic cross-reference table."""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Callable
from typing import Any

import numpy as np

from .objects import FolioError, Hex, Name, Ref, Stream

_PLAIN = re.compile(r"[A-Za-z0-9!\"$&'*+,\-.:;=?@\\^_`|~]*")
_ESCAPED = re.compile(rb"[()\\\r]")
HEADER = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"


def name(n: str) -> bytes:
    if _PLAIN.fullmatch(n):
        return b"/" + n.encode("ascii")
    return b"/" + b"".join(bytes([c]) if _PLAIN.fullmatch(chr(c)) else b"#%02X" % c for c in n.encode("latin-1", "replace"))


def number(x: float) -> bytes:
    if x != x or x in (float("inf"), float("-inf")):
        return b"0"
    s = f"{x:.9g}"
    if "e" in s:
        s = f"{x:.10f}".rstrip("0").rstrip(".")
    return (s if "." in s or "e" in s else s).encode()


def _atom(v: Any) -> bytes:
    if v is None:
        return b"null"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, Ref):
        return b"%d %d R" % v
    if isinstance(v, int):
        return b"%d" % v
    if isinstance(v, float):
        return number(v)
    if isinstance(v, Name):
        return name(v)
    if isinstance(v, Hex):
        return b"<" + v.hex().upper().encode() + b">"
    if isinstance(v, bytes):
        return b"(" + _ESCAPED.sub(lambda m: b"\\r" if m[0] == b"\r" else b"\\" + m[0], v) + b")"
    raise FolioError("pdf", f"cannot write {type(v).__name__}")


def value(v: Any) -> bytes:
    """``v`` as a file has it; nesting costs no recursion."""
    if isinstance(v, Stream):
        return value(v.dict | {Name("Length"): len(v.raw)}) + b"stream\n" + v.raw + b"\nendstream"
    out: list[bytes] = []
    apart = True  # whether what comes needs no space before it

    def put(b: bytes) -> None:
        nonlocal apart
        out.append(b if apart or b[:1] in b"/([<" else b" " + b)
        apart = False

    todo: list[tuple[Any, bool]] = [(v, False)]  # a value, or bytes that close one
    while todo:
        x, closing = todo.pop()
        if closing:
            out.append(x)
            apart = False
        elif isinstance(x, (list, tuple)) and not isinstance(x, Ref):
            put(b"[")
            apart = True
            todo.append((b"]", True))
            todo += [(y, False) for y in reversed(x)]
        elif isinstance(x, dict):
            put(b"<<")
            todo.append((b">>", True))
            for k, y in reversed(x.items()):
                todo += [(y, False), (k if isinstance(k, Name) else Name(k), False)]
        else:
            put(_atom(x))
    return b"".join(out)


class Writer:
    """A file written object by object: header, objects as they come, and at the end a classic cross-reference table.

    ``sink`` takes bytes; nothing but the offsets is held. Offsets have to fit 32 bits.
    """

    def __init__(self, sink: Callable[[bytes], Any]):
        self.sink, self.at, self.where = sink, 0, {}
        self.put(HEADER)

    def put(self, b: bytes) -> None:
        self.sink(b)
        self.at += len(b)
        if self.at >= 1 << 32:
            raise FolioError("io", "output exceeds 4 GiB")

    def object(self, num: int, v: Any) -> None:
        self.raw(num, b"%d 0 obj\n" % num + value(v) + b"\nendobj\n")

    def raw(self, num: int, body: bytes) -> None:
        """An object in the bytes of a file, its header included."""
        self.where[num] = self.at
        self.put(body)

    def finish(self, root: Ref, info: Ref | None = None, more: dict | None = None) -> None:
        size, start = max(self.where, default=0) + 1, self.at
        self.put(b"xref\n0 %d\n0000000000 65535 f \n" % size)
        for n in range(1, size):
            self.put(b"%010d 00000 n \n" % self.where[n] if n in self.where else b"0000000000 65535 f \n")
        trailer = {Name("Size"): size, Name("Root"): root} | ({Name("Info"): info} if info else {}) | (more or {})
        self.put(b"trailer\n" + value(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


def file(objects: dict[int, Any], root: Ref, info: Ref | None = None, more: dict | None = None) -> bytes:
    """A file of ``objects`` (number -> value), all of generation 0; ``more`` goes into the trailer."""
    out = io.BytesIO()
    w = Writer(out.write)
    for n in sorted(objects):
        w.object(n, objects[n])
    w.finish(root, info, more)
    return out.getvalue()


# --- other layouts


def _table_stream(rows: dict[int, tuple[int, int, int]], size: int, entries: dict) -> Stream:
    """A cross-reference stream of all numbers below ``size``, with the up predictor."""
    t = np.zeros((size, 7), dtype=np.uint8)
    for n, (kind, a, b) in rows.items():
        t[n] = [kind, *a.to_bytes(4, "big"), *b.to_bytes(2, "big")]
    up = np.vstack([t[:1], t[1:] - t[:-1]])
    raw = np.hstack([np.full((size, 1), 2, dtype=np.uint8), up]).tobytes()
    d = {Name("Type"): Name("XRef"), Name("Size"): size, Name("W"): [1, 4, 2], Name("Filter"): Name("FlateDecode"), Name("DecodeParms"): {Name("Predictor"): 12, Name("Columns"): 7}}
    return Stream(d | entries, zlib.compress(raw))


def _container(objects: dict[int, Any]) -> Stream:
    """An object stream."""
    bodies = [value(v) + b"\n" for v in objects.values()]
    at = np.cumsum([0, *map(len, bodies[:-1])]).tolist() if bodies else []
    head = b" ".join(b"%d %d" % x for x in zip(objects, at)) + b"\n"
    return Stream({Name("Type"): Name("ObjStm"), Name("N"): len(objects), Name("First"): len(head), Name("Filter"): Name("FlateDecode")}, zlib.compress(head + b"".join(bodies)))


def packed_file(objects: dict[int, Any], root: Ref, info: Ref | None = None, per_container: int = 50, hybrid: bool = False) -> bytes:
    """A file whose objects other than streams lie in object streams, found by a cross-reference stream.

    ``hybrid`` keeps the catalog plain and adds a classic table that names the stream by ``XRefStm``, so that readers
    without object streams see a file with gaps.
    """
    out = io.BytesIO()
    w = Writer(out.write)
    inner = [n for n, v in objects.items() if not isinstance(v, Stream) and not (hybrid and n == root.num)]
    rows: dict[int, tuple[int, int, int]] = {0: (0, 0, 65535)}
    for n in sorted(set(objects) - set(inner)):
        w.object(n, objects[n])
    new = max(objects, default=0)
    for at in range(0, len(inner), per_container):
        part = inner[at : at + per_container]
        new += 1
        w.object(new, _container({n: objects[n] for n in part}))
        rows |= {n: (2, new, k) for k, n in enumerate(part)}
    table = new + 1
    start = w.at
    rows |= {n: (1, p, 0) for n, p in w.where.items()} | {table: (1, start, 0)}
    trailer = {Name("Root"): root} | ({Name("Info"): info} if info else {})
    w.object(table, _table_stream(rows, table + 1, trailer))
    if not hybrid:
        w.put(b"startxref\n%d\n%%%%EOF\n" % start)
        return out.getvalue()
    w.finish(root, info, {Name("XRefStm"): start})
    return out.getvalue()


def updated_file(base: bytes, changed: dict[int, Any], root: Ref, free: tuple[int, ...] = (), info: Ref | None = None) -> bytes:
    """``base`` with an incremental update: objects anew, numbers freed, a table of these only and a way back."""
    back = int(base[base.rfind(b"startxref") + 9 :].split()[0])
    out = bytearray(base)
    rows = {n: b"0000000000 00001 f \n" for n in free}
    for n, v in changed.items():
        rows[n] = b"%010d 00000 n \n" % len(out)
        out += b"%d 0 obj\n" % n + value(v) + b"\nendobj\n"
    at, size = len(out), max([*rows, root.num]) + 1
    out += b"xref\n" + b"".join(b"%d 1\n" % n + rows[n] for n in sorted(rows))
    out += b"trailer\n" + value({Name("Size"): size, Name("Root"): root, Name("Prev"): back} | ({Name("Info"): info} if info else {})) + b"\nstartxref\n%d\n%%%%EOF\n" % at
    return bytes(out)

"""Reading objects from bytes. The parser keeps its own stack, so nesting is limited by a number, not by Python."""

from __future__ import annotations

import re
import struct
from typing import Any

from .objects import Hex, Keyword, Name, Ref, broken

SPACE = rb"\x00\t\n\x0c\r "
DELIM = rb"()<>\[\]{}/%"
_SKIP = re.compile(rb"(?:[" + SPACE + rb"]+|%[^\r\n]*)*")
_TOKEN = re.compile(
    rb"(?P<ref>\d{1,10}[" + SPACE + rb"]+\d{1,5}[" + SPACE + rb"]+R(?![^" + SPACE + DELIM + rb"]))"
    rb"|(?P<num>[+-]*(?:\d+\.?\d*|\.\d+)(?:-\d*)?(?![^" + SPACE + DELIM + rb"]))"
    rb"|(?P<name>/[^" + SPACE + DELIM + rb"]*)"
    rb"|(?P<open><<|\[)|(?P<close>>>|\])|(?P<lit>\()|(?P<hex><)|(?P<brace>[{}])|(?P<word>[^" + SPACE + DELIM + rb"]+)"
)
_ESCAPE = re.compile(rb"#([0-9A-Fa-f]{2})")
_LITERAL = re.compile(rb"[()\\]|\r\n?")
_OCTAL = re.compile(rb"[0-7]{1,3}")
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
MAX_DEPTH = 262_144
END = Keyword(b"")


def float32(x: float) -> float:
    """``x`` narrowed to single precision; beyond its range, infinity."""
    try:
        return struct.unpack("<f", struct.pack("<f", x))[0]
    except OverflowError:
        return float("inf") if x > 0 else float("-inf")


def skip(buf: bytes, pos: int) -> int:
    return _SKIP.match(buf, pos).end()


def read_name(raw: bytes) -> Name:
    if b"#" in raw:
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 16)]), raw)
    return Name(raw.decode("latin-1"))


def read_number(raw: bytes) -> int | float:
    sign = -1 if raw.startswith(b"-") else 1
    body = raw.lstrip(b"+-")
    body = body.split(b"-")[0]
    if b"." in body:
        return float32(sign * float(body if body != b"." else b"0"))
    n = sign * int(body)
    return n if -(2**63) <= n < 2**63 else float32(float(n))


def literal_string(buf: bytes, pos: int) -> tuple[bytes, int]:
    """The string whose opening bracket is just before ``pos`` and where it ends."""
    out, depth, at = [], 1, pos
    while True:
        m = _LITERAL.search(buf, at)
        if m is None:
            raise broken("unterminated string")
        out.append(buf[at : m.start()])
        c, at = m[0], m.end()
        if c == b"(":
            depth += 1
            out.append(c)
        elif c == b")":
            depth -= 1
            if not depth:
                return b"".join(out), at
            out.append(c)
        elif c[:1] == b"\r":
            out.append(b"\n")
        else:
            nxt = buf[at : at + 1]
            if o := _OCTAL.match(buf, at):
                out.append(bytes([int(o[0], 8) & 255]))
                at = o.end()
            elif nxt in (b"\r", b"\n"):
                at += 2 if buf[at : at + 2] == b"\r\n" else 1
            else:
                out.append(_PLAIN.get(nxt, nxt))
                at += 1


def hex_string(buf: bytes, pos: int) -> tuple[Hex, int]:
    end = buf.find(b">", pos)
    if end < 0:
        raise broken("unterminated hexadecimal string")
    digits = re.sub(rb"[" + SPACE + rb"]+", b"", buf[pos:end])
    try:
        return Hex(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))), end + 1
    except (ValueError, UnicodeDecodeError):
        raise broken("bad hexadecimal string") from None


def parse(buf: bytes, pos: int, refs: bool = True, depth_limit: int = MAX_DEPTH) -> tuple[Any, int]:
    """The object at ``pos`` and where it ends. A bare word comes back as a ``Keyword``; the end of ``buf`` as ``END``."""
    stack: list[tuple[bytes, list]] = []
    while True:
        pos = skip(buf, pos)
        m = _TOKEN.match(buf, pos)
        if m is None:
            if pos >= len(buf) and not stack:
                return END, pos
            raise broken(f"unexpected byte or end of data at {pos}")
        kind, tok = m.lastgroup, m[0]
        if kind == "ref" and not refs:
            m = re.compile(rb"\d+").match(buf, pos)
            kind, tok = "num", m[0]
        pos = m.end()
        if kind == "open":
            if len(stack) >= depth_limit:
                raise broken("nesting depth exceeds the limit")
            stack.append((tok, []))
            continue
        if kind == "close":
            if not stack:
                raise broken(f"unexpected {tok.decode()}")
            opened, items = stack.pop()
            if (opened == b"[") != (tok == b"]"):
                raise broken("mismatched brackets")
            v = items if opened == b"[" else _dictionary(items)
        elif kind == "ref":
            a, b, _ = tok.split()
            v = Ref(int(a), int(b))
        elif kind == "num":
            v = read_number(tok)
        elif kind == "name":
            v = read_name(tok[1:])
        elif kind == "lit":
            v, pos = literal_string(buf, pos)
        elif kind == "hex":
            v, pos = hex_string(buf, pos)
        elif tok == b"true":
            v = True
        elif tok == b"false":
            v = False
        elif tok == b"null":
            v = None
        else:
            if stack:
                if tok in (b"endobj", b"stream", b"obj", b"endstream"):
                    raise broken("unterminated array or dictionary")
                v = None  # a stray word inside a container reads as null
            else:
                return Keyword(tok), pos
        if not stack:
            return v, pos
        stack[-1][1].append(v)


def _dictionary(items: list) -> dict:
    out: dict[Name, Any] = {}
    i = 0
    while i < len(items):
        k = items[i]
        if not isinstance(k, Name):
            raise broken("dictionary key is not a name")
        if i + 1 < len(items):
            out.pop(k, None)  # a repeated key: the last one counts
            out[k] = items[i + 1]
        i += 2
    return out

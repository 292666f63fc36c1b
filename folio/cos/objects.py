"""The values a PDF file holds.

null, booleans, integers and reals are Python's own; strings are ``bytes`` (``Hex`` if written in hexadecimal), names are
``Name``, arrays lists and dictionaries dicts with names as keys.
"""

from __future__ import annotations

from typing import Any, NamedTuple


class FolioError(Exception):
    """An error with a stable code: range, pdf, io, unsupported, password or invalid_structure."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.message = code, message

    def __reduce__(self):
        return FolioError, (self.code, self.message)


def broken(message: str) -> FolioError:
    return FolioError("pdf", message)


def invalid(message: str) -> FolioError:
    return FolioError("invalid_structure", message)


class Name(str):
    """A name; bytes beyond ASCII are kept as Latin-1 characters."""

    __slots__ = ()


class Hex(bytes):
    """A string written in hexadecimal."""

    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Keyword(bytes):
    """An operator or any bare word that is no value."""

    __slots__ = ()


class Stream:
    __slots__ = ("dict", "raw")

    def __init__(self, d: dict, raw: bytes):
        self.dict, self.raw = d, raw

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Stream) and (self.dict, self.raw) == (other.dict, other.raw)


def kind_of(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, Ref):
        return "reference"
    for t, k in ((int, "integer"), (float, "real"), (Name, "name"), (bytes, "string"), (list, "array"), (dict, "dictionary"), (Stream, "stream")):
        if isinstance(v, t):
            return k
    return "keyword"


def references(v: Any, path: str = "") -> list[tuple[str, Ref]]:
    """Every reference in ``v`` with the path that leads to it, in order; nesting costs no recursion."""
    out, todo = [], [(path, v)]
    while todo:
        p, x = todo.pop()
        if isinstance(x, Ref):
            out.append((p, x))
        elif isinstance(x, Stream):
            todo.append((p, x.dict))
        elif isinstance(x, dict):
            todo += [(f"{p}/{k}", y) for k, y in reversed(x.items())]
        elif isinstance(x, list):
            todo += [(f"{p}[{i}]", y) for i, y in reversed(list(enumerate(x)))]
    return out

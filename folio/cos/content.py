"""Content streams: operators, the names they use, and what a page draws."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from .document import Document
from .lexer import END, SPACE, parse, skip
from .objects import FolioError, Keyword, Name, Ref, Stream, broken

_IMAGE_END = re.compile(rb"[" + SPACE + rb"]EI(?=[" + SPACE + rb"]|$)")
MAX_FORMS = 32
#: Operators that name a resource, with the class of the resource. Fixed values.
NAMED = {"CS": "ColorSpace", "cs": "ColorSpace", "gs": "ExtGState", "Tf": "Font", "SCN": "Pattern", "scn": "Pattern", "BDC": "Properties", "DP": "Properties", "sh": "Shading", "Do": "XObject"}


def operators(data: bytes, lenient: bool = False) -> Iterator[tuple[str, list]]:
    """Each operator with its operands. Malformed content raises, or ends the walk when ``lenient``."""
    pos, operands = 0, []
    while True:
        try:
            v, pos = parse(data, pos, refs=False, depth_limit=512)
        except FolioError:
            if lenient:
                return
            raise
        if v is END:
            if operands and not lenient:
                raise broken("operands without an operator")
            return
        if not isinstance(v, Keyword):
            operands.append(v)
            continue
        if v == b"BI":
            d, pos = _inline(data, pos)
            yield "BI", [d]
            operands = []
            continue
        yield v.decode("latin-1"), operands
        operands = []


def _inline(data: bytes, pos: int) -> tuple[dict, int]:
    items = []
    while True:
        v, pos = parse(data, pos, refs=False)
        if v is END:
            raise broken("inline image without data")
        if isinstance(v, Keyword):
            if v != b"ID":
                raise broken("inline image without data")
            break
        items.append(v)
    m = _IMAGE_END.search(data, pos)
    if m is None:
        raise broken("inline image without an end")
    return dict(zip(items[::2], items[1::2])), m.end()


def strip_comments(data: bytes) -> bytes:
    """Comments outside strings become spaces; data with an inline image stays as it is."""
    if re.search(rb"(?<![^" + SPACE + rb"])BI(?![^" + SPACE + rb"/])", data):
        return data
    out, at = bytearray(data), 0
    find = re.compile(rb"[(%]")
    from .lexer import literal_string

    while m := find.search(data, at):
        if m[0] == b"(":
            try:
                at = literal_string(data, m.end())[1]
            except FolioError:
                break
        else:
            e = re.compile(rb"[^\r\n]*").match(data, m.start()).end()
            out[m.start() : e] = b" " * (e - m.start())
            at = e
    return bytes(out)


def page_content(d: Document, contents: Any) -> bytes:
    """A page's content streams joined by line feeds; none is empty content."""
    v = d.resolve(contents)
    if v is None:
        return b""
    if isinstance(v, Stream):
        return d.decoded(v)
    if isinstance(v, list):
        parts = []
        for x in v:
            s = d.resolve(x)
            if isinstance(s, Stream):
                parts.append(d.decoded(s))
            elif s is not None:
                raise broken("contents hold something other than streams")
        return b"\n".join(parts)
    raise broken("contents are no stream")


def used_names(data: bytes) -> set[tuple[str, str]]:
    """(class, name) of every resource the content uses."""
    out = set()
    for op, args in operators(data):
        if c := NAMED.get(op):
            named = [a for a in args if isinstance(a, Name)]
            if named:
                out.add((c, str(named[-1])))
    return out


def names_with_forms(d: Document, data: bytes, resources: dict, depth: int = 0, seen: set | None = None) -> set[tuple[str, str]]:
    """Names the content uses, with those of forms that have no resources of their own; every font and form must be there."""
    seen = set() if seen is None else seen
    if depth > MAX_FORMS:
        raise broken("forms nest too deep")
    names = used_names(data)
    xobjects = d.resolve(resources.get("XObject")) or {}
    for cls, n in sorted(names):
        if cls in ("Font", "XObject") and n not in (d.resolve(resources.get(cls)) or {}):
            raise broken(f"{cls} {n} is not among the resources")
        if cls != "XObject":
            continue
        ref = xobjects.get(n)
        key = ref.num if isinstance(ref, Ref) else n
        if key in seen:
            continue
        seen.add(key)
        form = d.resolve(ref)
        if not isinstance(form, Stream) or form.dict.get("Subtype") != "Form":
            continue
        own = d.resolve(form.dict.get("Resources"))
        if isinstance(own, dict):
            names_with_forms(d, d.decoded(form), own, depth + 1, seen)
        else:
            names |= names_with_forms(d, d.decoded(form), resources, depth + 1, seen)
    return names


__all__ = ["names_with_forms", "operators", "page_content", "skip", "strip_comments", "used_names"]

"""Page ranges as column expressions: ``1-3,z,r2-5`` and lists of them, ``1-3;z``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"\+?0*[1-9][0-9]{0,18}"
_POINT = rf"\s*(z|r{_NUMBER}|{_NUMBER})\s*"
_PART = rf"{_POINT}(-{_POINT})?"
VALID = rf"^{_PART}(,{_PART})*$"
_BLANK = r"^\s*$|^\s*[,-]|[,-]\s*$|,\s*[,-]|-\s*,|-\s*-|,\s*,"
_ZERO = r"(^|[,-])\s*r?\+?0+\s*($|[,-])"


def _lit(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def range_error(spec: Column | str) -> Column:
    """Null for a good range, else which rule it breaks."""
    s = F.trim(_lit(spec), F.lit(" \t\r\n\x0b\x0c"))
    return (
        F.when(s.isNull() | (s == ""), "empty_group")
        .when(s.contains(";"), "group_separator")
        .when(s.rlike(VALID), F.lit(None))
        .when(s.rlike(_BLANK), "empty_range")
        .when(s.rlike(_ZERO), "zero_page")
        .otherwise("invalid_number")
    )


def _point(p: Column, n: Column) -> Column:
    """The page a point names, or the number out of bounds as a negative."""
    p = F.trim(p, F.lit(" \t\r\n\x0b\x0c"))
    num = F.regexp_replace(p, r"^r?\+?", "").try_cast("bigint")
    at = F.when(p == "z", n).when(p.startswith("r"), F.when(num > n, -num).otherwise(n + 1 - num)).otherwise(F.when(num > n, -num).otherwise(num))
    return F.coalesce(at, F.lit(-(2**31)))


def bounds(spec: Column | str, n: Column | str) -> Column:
    """Array of (a, b) of each part; points outside the document are negative."""
    n = _lit(n).cast("bigint")

    def part(p: Column) -> Column:
        # split at the first dash only
        pair = F.split(p, "-", 2)
        return F.struct(_point(pair[0], n).alias("a"), _point(F.coalesce(F.get(pair, 1), pair[0]), n).alias("b"))

    return F.transform(F.split(_lit(spec), ","), part)


def resolve_error(spec: Column | str, n: Column | str) -> Column:
    out = F.filter(bounds(spec, n), lambda x: (x["a"] < 0) | (x["b"] < 0))
    first = F.when(out[0]["a"] < 0, -out[0]["a"]).otherwise(-out[0]["b"])
    return F.coalesce(range_error(spec), F.when(_lit(n) == 0, F.lit("no_pages")).when(F.size(out) > 0, F.concat(F.lit("out_of_bounds:"), first.cast("string"))))


def resolve(spec: Column | str, n: Column | str) -> Column:
    """Pages in the order written, repeats kept; null where ``resolve_error`` is not."""
    seq = F.flatten(F.transform(bounds(spec, n), lambda x: F.sequence(x["a"], x["b"])))
    return F.when(resolve_error(spec, n).isNull(), seq)


def dedupe(pages: Column) -> Column:
    """Each page once, at its first place."""
    return F.array_distinct(pages)


def bounded_max(spec: Column | str) -> Column:
    """The highest page the range can name, null if it depends on the number of pages."""
    s = _lit(spec)
    return F.when(s.rlike(r"[zr]"), F.lit(None)).otherwise(F.array_max(F.transform(F.split(s, "[,-]"), lambda x: F.trim(x).try_cast("bigint"))))


def is_full_document(spec: Column | str) -> Column:
    return _lit(spec).rlike(r"^\s*1\s*-\s*z\s*$")


def groups(spec: Column | str) -> Column:
    return F.split(_lit(spec), ";")


# --- the same for one string, without Spark

import re as _re  # noqa: E402

from ..cos.objects import FolioError  # noqa: E402

_ERRORS = {
    "empty_group": "page range is empty",
    "group_separator": "';' separates range groups and is not allowed inside one",
    "empty_range": "empty page range part",
    "zero_page": "page numbers start at 1",
    "invalid_number": "invalid page number",
}


def check(spec: str) -> str:
    """The range without surrounding space; a bad one raises."""
    s = (spec or "").strip()
    why = None
    if not s:
        why = "empty_group"
    elif ";" in s:
        why = "group_separator"
    elif not _re.search(VALID, s):
        why = "empty_range" if _re.search(_BLANK, s) else "zero_page" if _re.search(_ZERO, s) else "invalid_number"
    if why:
        raise FolioError("range", f"{_ERRORS[why]}: {spec!r}")
    return s


def pages_of(spec: str, n: int) -> list[int]:
    s = check(spec)
    if n == 0:
        raise FolioError("range", "document has no pages")

    def point(p: str) -> int:
        p = p.strip()
        v = n if p == "z" else int(p.lstrip("r"))
        if v > n:
            raise FolioError("range", f"page {v} is out of range (document has {n} pages)")
        return n + 1 - v if p.startswith("r") else v

    out: list[int] = []
    for part in s.split(","):
        a, _, b = part.partition("-")
        a, b = point(a), point(b or a)
        out += range(a, b + 1) if a <= b else range(a, b - 1, -1)
    return out


def highest(spec: str) -> int | None:
    s = check(spec)
    return None if _re.search("[zr]", s) else max(int(x) for x in _re.split("[,-]", s))

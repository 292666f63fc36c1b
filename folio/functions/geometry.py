"""Page geometry as column expressions, in single precision as the files have it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PIXELS = 65_535


def _f(x: float | Column) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


A4_WIDTH, A4_HEIGHT = 210 * 72 / 25.4, 297 * 72 / 25.4


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Corners put in order, as an array."""
    return F.array(F.least(_f(x0), _f(x1)), F.least(_f(y0), _f(y1)), F.greatest(_f(x0), _f(x1)), F.greatest(_f(y0), _f(y1)))


def effective_box(media: Column, crop: Column) -> Column:
    """Width and height of the crop box within the media box; A4 where there is no such area."""
    m = F.coalesce(media, F.array(_f(0.0), _f(0.0), _f(A4_WIDTH), _f(A4_HEIGHT)))
    c = F.coalesce(crop, m)
    w = (F.least(m[2], c[2]) - F.greatest(m[0], c[0])).cast("float")
    h = (F.least(m[3], c[3]) - F.greatest(m[1], c[1])).cast("float")
    none = (w <= _f(2.0**-12)) | (h <= _f(2.0**-12)) | F.isnan(w) | F.isnan(h) | (w == _f(float("inf"))) | (h == _f(float("inf")))
    return F.named_struct(F.lit("width"), F.when(none, _f(A4_WIDTH)).otherwise(F.greatest(w, _f(1.0))), F.lit("height"), F.when(none, _f(A4_HEIGHT)).otherwise(F.greatest(h, _f(1.0))))


def rotation(r: Column) -> Column:
    """0, 90, 180 or 270; anything else is 0."""
    t = F.pmod(F.coalesce(r.cast("int"), F.lit(0)), F.lit(360))
    return F.when(t.isin(90, 180, 270), t).otherwise(F.lit(0)).cast("smallint")


def page_dimensions(media: Column, crop: Column, rotate: Column) -> Column:
    """Struct of width, height and rotation as shown."""
    box, turn = effective_box(media, crop), rotation(rotate)
    side = turn.isin(90, 270)
    w, h = F.when(side, box["height"]).otherwise(box["width"]), F.when(side, box["width"]).otherwise(box["height"])
    return F.named_struct(F.lit("width"), w, F.lit("height"), h, F.lit("rotation"), turn)


def pixels(length: Column, dpi: Column | float) -> Column:
    """Pixels of a length in points: the scale and the product are both rounded to single precision."""
    scale = ((dpi if isinstance(dpi, Column) else F.lit(float(dpi))).cast("float") / F.lit(72.0)).cast("float")
    return F.floor(_f(length) * scale).cast("bigint")


def json_number(v: Column) -> Column:
    """Three decimals, halves away from zero, no fraction where whole; what is not finite is 0."""
    d = v.cast("double")
    r = F.signum(d) * F.floor(F.abs(d) * 1000.0 + 0.5) / 1000.0
    whole = r == F.floor(r)
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), "0").when(whole, r.cast("bigint").cast("string")).otherwise(r.cast("string"))


def json_string(s: Column) -> Column:
    """Quoted and escaped."""
    out = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, e in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(c), F.lit(e))
    for i in range(32):
        if chr(i) not in "\n\r\t":
            out = F.replace(out, F.lit(chr(i)), F.lit(f"\\u{i:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _short(v: Column) -> Column:
    """Shortest form of a single, without ``.0``."""
    return F.regexp_replace(v.cast("string"), r"\.0$", "")


def dimensions_json(pages: Column) -> Column:
    """``{"pages":n,"page_sizes":[...]}`` of an array of page dimensions."""
    one = lambda p: F.concat(F.lit('{"width":'), _short(p["width"]), F.lit(',"height":'), _short(p["height"]), F.lit(',"rotation":'), p["rotation"].cast("string"), F.lit("}"))
    return F.concat(F.lit('{"pages":'), F.size(pages).cast("string"), F.lit(',"page_sizes":['), F.array_join(F.transform(pages, one), ","), F.lit("]}"))

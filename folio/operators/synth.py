"""PDF files made from rows: a file for each group, a page for each row."""

from __future__ import annotations

import re
import textwrap
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cos import write
from ..cos.crypt import Sealer
from ..cos.objects import Hex, Ref, Stream
from ..cos.objects import Name as N
from ..workers import ship

FONT = {N("Type"): N("Font"), N("Subtype"): N("Type1"), N("BaseFont"): N("Helvetica"), N("Encoding"): N("WinAnsiEncoding")}


def text_content(text: str, size: int = 10, columns: int = 90) -> bytes:
    """Words of ``text`` set in lines."""
    lines = textwrap.wrap(" ".join(text.split()), columns, break_long_words=False, break_on_hyphens=False)
    out = [b"BT /F1 %d Tf %d TL 40 750 Td" % (size, size + 2)]
    for line in lines:
        out.append(write.value(line.encode("cp1252", "replace")) + b" Tj T*")
    return b"\n".join([*out, b"ET"])


def annotation(rect: list, text: str, flags: int | None = None) -> tuple[dict, Stream]:
    """A widget and its appearance, in Helvetica of 9 points."""
    w, h = rect[2] - rect[0], rect[3] - rect[1]
    look = Stream({N("Type"): N("XObject"), N("Subtype"): N("Form"), N("BBox"): [0, 0, w, h], N("Resources"): {N("Font"): {N("F1"): Ref(3, 0)}}}, b"BT /F1 9 Tf 2 4 Td " + write.value(text.encode("cp1252", "replace")) + b" Tj ET")
    return {N("Type"): N("Annot"), N("Subtype"): N("Widget"), N("Rect"): rect} | ({N("F"): flags} if flags is not None else {}), look


LAYOUTS = ("plain", "packed", "hybrid", "updated")
DAMAGE = ("cut", "junk", "shifted", "trailer", "tail")


def build(pages: list[dict], fan_out: int = 10, count: int | None = None, compress: bool = True, title: str | None = None, layout: str = "plain", seal: Sealer | None = None) -> bytes:
    """A file of ``pages``: dicts of text (or ``raw`` content) and, where wanted, media, crop, rotate, fonts (how many the
    resources name), annots (rows of rect, text, flags), forms (content by name).

    Pages hang in a tree of ``fan_out`` kids a node. ``count`` overrides the declared number of pages. ``layout`` is
    ``plain``, ``packed`` (object and cross-reference streams), ``hybrid`` (both kinds of table) or ``updated`` (a page more than asked for,
    which an incremental update takes away, and a title that it sets anew).
    """
    objects: dict[int, object] = {1: None, 2: None, 3: FONT}
    new = iter(range(4, 1 << 30))

    def add(v: object) -> Ref:
        n = next(new)
        objects[n] = v
        return Ref(n, 0)

    level = []
    extra = [{"text": "taken away"}] if layout == "updated" else []
    for p in [*pages, *extra]:
        n, c = next(new), next(new)
        raw = p["raw"] if "raw" in p else text_content(p.get("text") or "")
        raw = raw.encode("latin-1") if isinstance(raw, str) else raw
        objects[c] = Stream({N("Filter"): N("FlateDecode")}, zlib.compress(raw)) if compress else Stream({}, raw)
        fonts = {N(f"F{k}"): Ref(3, 0) for k in range(1, 1 + p.get("fonts", 1))}
        page = {N("Type"): N("Page"), N("Contents"): Ref(c, 0), N("Resources"): {N("Font"): fonts}}
        if p.get("forms"):
            form = {N("Type"): N("XObject"), N("Subtype"): N("Form"), N("BBox"): [0, 0, 612, 792]}
            page[N("Resources")][N("XObject")] = {N(k): add(Stream(form, v.encode("latin-1"))) for k, v in p["forms"].items()}
        for key, name in (("media", "MediaBox"), ("crop", "CropBox"), ("rotate", "Rotate")):
            if p.get(key) is not None:
                page[N(name)] = p[key]
        if p.get("annots"):
            made = [annotation(a["rect"], a["text"], a.get("flags")) for a in p["annots"]]
            page[N("Annots")] = [add(a | {N("AP"): {N("N"): add(look)}, N("P"): Ref(n, 0)}) for a, look in made]
        objects[n] = page
        level.append((n, 1))
    while len(level) > fan_out:
        up = []
        for i in range(0, len(level), fan_out):
            part, n = level[i : i + fan_out], next(new)
            objects[n] = {N("Type"): N("Pages"), N("Kids"): [Ref(k, 0) for k, _ in part], N("Count"): sum(c for _, c in part)}
            for k, _ in part:
                objects[k][N("Parent")] = Ref(n, 0)
            up.append((n, sum(c for _, c in part)))
        level = up
    n_pages = len(pages) + len(extra)
    objects[2] = {N("Type"): N("Pages"), N("Kids"): [Ref(k, 0) for k, _ in level], N("Count"): n_pages if count is None else count, N("MediaBox"): [0, 0, 612, 792]}
    for k, _ in level:
        objects[k][N("Parent")] = Ref(2, 0)
    objects[1] = {N("Type"): N("Catalog"), N("Pages"): Ref(2, 0)}
    info = None
    if title is not None:
        info = add({N("Title"): title.encode("cp1252", "replace")})
    if seal is not None:
        secret = next(new)
        sealed = {n: seal.value(v, n) for n, v in objects.items()} | {secret: seal.dict}
        return write.file(sealed, Ref(1, 0), info, {N("Encrypt"): Ref(secret, 0), N("ID"): [Hex(seal.file_id), Hex(seal.file_id)]})
    if layout in ("packed", "hybrid"):
        return write.packed_file(objects, Ref(1, 0), info, hybrid=layout == "hybrid")
    data = write.file(objects, Ref(1, 0), info)
    if layout == "updated":
        last = level[-1][0]
        # the page taken away hangs from the tree's last branch, down to its leaf
        changed, gone = {}, None
        while True:
            node = objects[last]
            if node[N("Type")] == "Page":
                gone = last
                break
            kids = node[N("Kids")] if last != 2 else objects[2][N("Kids")]
            changed[last] = node | {N("Count"): node[N("Count")] - 1}
            last = kids[-1].num
        changed[2] = objects[2] | {N("Count"): len(pages)}
        above = objects[gone][N("Parent")].num
        up = changed[above]
        changed[above] = up | {N("Kids"): [k for k in up[N("Kids")] if k.num != gone]}
        if info is not None:
            changed[info.num] = {N("Title"): (title + " anew").encode("cp1252", "replace")}
        data = write.updated_file(data, changed, Ref(1, 0), (gone,), info)
    return data


def damaged(data: bytes, how: str) -> bytes:
    """``cut`` before its table, with ``junk`` in front, with offsets ``shifted``, without a ``trailer``, or cut off at the ``tail`` before startxref."""
    table = data.rfind(b"xref\n0 ")
    if how == "cut":
        return data[:table]
    if how == "junk":
        return b"not part of the file\n" * 3 + data
    if how == "shifted":
        return data[:table] + re.sub(rb"(\d{10}) 00000 n", lambda m: b"%010d 00000 n" % (int(m[1]) + 7), data[table:])
    if how == "tail":
        return data[: data.rfind(b"startxref")]
    return data[: data.rfind(b"trailer")] + b"startxref\n0\n%%EOF\n"


def from_rows(rows: DataFrame, count_delta: bool = False, damage: bool = False) -> DataFrame:
    """``doc_id, content`` of ``rows(doc_id, page_no, text[, raw, media, crop, rotate, fonts, annots, forms, declared, layout, seal, damage])``.

    A group is one file. Of ``layout`` (see :func:`build`), ``seal`` (a kind of encryption, the user's password is the id
    where ``password`` is true) and ``damage`` (see :func:`damaged`) the first row's counts; with the argument ``damage`` every
    file is cut off before its cross-reference table.
    """
    cols = [c for c in ("text", "raw", "media", "crop", "rotate", "fonts", "annots", "forms") if c in rows.columns]
    declared = "declared" in rows.columns and count_delta

    def go(table: pa.Table) -> pa.Table:
        got = sorted(table.to_pylist(), key=lambda r: r["page_no"])
        first = got[0]
        title = str(first["doc_id"])
        kind = first.get("seal")
        seal = None if kind is None else Sealer(kind, title.encode() if first.get("password") else b"", b"owner", title.encode())
        pages = [{c: dict(r[c]) if c == "forms" else r[c] for c in cols if r[c] is not None} for r in got]
        data = build(pages, count=first["declared"] if declared else None, title=title, layout=first.get("layout") or "plain", seal=seal)
        how = "cut" if damage else first.get("damage")
        if how:
            data = damaged(data, how)
        return pa.table({"doc_id": pa.array([str(got[0]["doc_id"])]), "content": pa.array([data], pa.binary())})

    ship(rows.sparkSession)
    # a stated number of partitions: files are small in bytes and large in work, so they are not to be coalesced
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = rows.withColumn("doc_id", F.col("doc_id").cast("string")).repartition(parts, "doc_id")
    return d.groupBy("doc_id").applyInArrow(go, "doc_id string, content binary")

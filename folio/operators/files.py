"""Split, merge, count, measure, read and draw PDF files, many at a time.

Each operator takes ``files(doc_id, content)`` and gives rows. A document is parsed once in the task that holds it; a
merge gathers the inputs of one output, which is as large as the file it makes. Bad input gives a row with an
error, or raises in ``strict`` mode.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cos import assemble as A
from ..cos import geometry as geo
from ..cos import raster
from ..cos import text as T
from ..cos.document import Document, nesting
from ..cos.lexer import MAX_DEPTH
from ..cos.objects import FolioError
from ..functions import ranges as R
from ..sources.pdf import plain, read_document
from ..workers import ship

ERROR = "error struct<code string, message string>"
_ERROR = pa.struct([("code", pa.string()), ("message", pa.string())])


def _slim(files: DataFrame) -> DataFrame:
    ship(files.sparkSession)
    return files.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("content").cast("binary").alias("content"))


def _each(files: DataFrame, columns: str, schema: pa.Schema, run, password: str | None, mode: str) -> DataFrame:
    """``run(doc_id, document)`` yields rows as tuples; the last column of the result is the error."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, content in zip(b.column("doc_id").to_pylist(), b.column("content")):
                try:
                    rows = [(doc_id, *r, None) for r in read_document(content.as_py(), lambda d: list(run(doc_id, d)), password, doc_id)]  # noqa: B023
                except FolioError as x:
                    if mode == "strict":
                        raise
                    rows = [(doc_id, *[None] * (len(schema) - 2), {"code": x.code, "message": x.message})]
                for at in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 256]), schema)], schema=schema)

    return _slim(files).mapInArrow(go, columns)


def _schema(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("doc_id", pa.string()), *fields, ("error", _ERROR)])


def page_count(files: DataFrame, strict: bool = False, password: str | None = None, mode: str = "permissive") -> DataFrame:
    """``doc_id, pages, error``; fast unless ``strict``."""
    return _each(files, f"doc_id string, pages bigint, {ERROR}", _schema(("pages", pa.int64())), lambda _, d: [(d.count(strict),)], password, mode)


def page_dimensions(files: DataFrame, password: str | None = None, mode: str = "permissive") -> DataFrame:
    """``doc_id, page_no, width, height, rotation, error``."""
    run = lambda _, d: [(k, w, h, r) for k, (w, h, r) in enumerate(geo.dimensions(d), 1)]
    return _each(files, f"doc_id string, page_no int, width float, height float, rotation smallint, {ERROR}", _schema(("page_no", pa.int32()), ("width", pa.float32()), ("height", pa.float32()), ("rotation", pa.int16())), run, password, mode)


def split(files: DataFrame, outputs: DataFrame, password: str | None = None, mode: str = "permissive") -> DataFrame:
    """``doc_id, path, content, error`` for ``outputs(doc_id, path, spec)``: every output of a document, from one parse.

    All ranges of a document are resolved before its first output is made.
    """
    wanted = outputs.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.collect_list(F.struct("path", "spec")).alias("outputs"))
    both = _slim(files).join(wanted, "doc_id")
    schema = _schema(("path", pa.string()), ("content", pa.binary()))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, content, want in zip(b.column("doc_id").to_pylist(), b.column("content"), b.column("outputs").to_pylist()):

                def run(d: Document, want=want) -> list:
                    highest = [R.highest(o["spec"]) for o in want]
                    pages = d.pages(None if None in highest else max(highest))
                    if None not in highest and len(pages) < max(highest):
                        pages = d.pages()
                    order = [R.pages_of(o["spec"], len(pages)) for o in want]
                    out = []
                    for o, top, chosen in zip(want, highest, order):
                        prune = top is not None or len(set(chosen)) < len(pages)
                        out.append((o["path"], A.assemble([A.Part(d, [pages[n - 1] for n in chosen], prune)])))
                    return out

                try:
                    paths = [o["path"] for o in want]
                    if len(set(paths)) < len(paths):
                        raise FolioError("io", "two outputs have the same path")
                    rows = [(doc_id, p, c, None) for p, c in read_document(content.as_py(), run, password, doc_id)]
                except FolioError as x:
                    if mode == "strict":
                        raise
                    rows = [(doc_id, None, None, {"code": x.code, "message": x.message})]
                for r in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(r, schema)], schema=schema)

    return both.mapInArrow(go, f"doc_id string, path string, content binary, {ERROR}")


def split_pages(files: DataFrame, pattern: str, per_file: int = 1, password: str | None = None, mode: str = "permissive") -> DataFrame:
    """``doc_id, path, content, error``: files of ``per_file`` pages each, numbered from 1 with as many digits as the last needs."""
    if per_file < 1:
        raise FolioError("range", "pages per file must be at least 1")
    if pattern.count("%d") != 1:
        raise FolioError("io", "output pattern must contain exactly one %d")

    def run(_, d: Document) -> Iterator[tuple]:
        pages = A.whole(d)
        files_n = -(-len(pages) // per_file)
        for k, content in enumerate(A.chunks(d, pages, per_file), 1):
            yield pattern.replace("%d", str(k).zfill(len(str(files_n)))), content

    return _each(files, f"doc_id string, path string, content binary, {ERROR}", _schema(("path", pa.string()), ("content", pa.binary())), run, password, mode)


def merge(files: DataFrame, inputs: DataFrame, password: str | None = None, byte_copy: bool = False) -> DataFrame:
    """``output, content, error`` of ``inputs(output, input_ord, doc_id, spec)``; a null ``spec`` takes all pages.

    A document that is input twice to an output travels twice, one that is wanted by many outputs goes to each of them, as
    their files need it.
    """
    rows = inputs.select(F.col("output").cast("string").alias("output"), F.col("input_ord").cast("int").alias("input_ord"), F.col("doc_id").cast("string").alias("doc_id"), "spec").join(_slim(files), "doc_id", "left")

    def go(table: pa.Table) -> pa.Table:
        parts = sorted(zip(*(table.column(c).to_pylist() for c in ("input_ord", "doc_id", "spec", "content"))), key=lambda r: r[0])
        error = content = None
        try:
            if byte_copy and len(parts) == 1 and parts[0][2] is None and parts[0][3] is not None:
                content = read_document(parts[0][3], lambda d: None if d.repaired or d.handler else parts[0][3], password, parts[0][1])
            if content is None:
                content = _merged(parts, password)
        except FolioError as x:
            error = {"code": x.code, "message": x.message}
        return pa.table({"output": table.column("output").slice(0, 1), "content": pa.array([content], pa.binary()), "error": pa.array([error], _ERROR)})

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "output").groupBy("output").applyInArrow(go, f"output string, content binary, {ERROR}")


def _merged(parts: list[tuple], password: str | None) -> bytes:
    out = io.BytesIO()
    merge_to(lambda: (out.seek(0), out.truncate()) and out.write, parts, password)
    return out.getvalue()


def merge_to(begin: Callable[[], Callable[[bytes], Any]], parts: list[tuple], password: str | None, copy_annotations: bool = True) -> None:
    """Inputs in order, written as they are copied; one whose offsets prove wrong on the way is rebuilt and the merge begun anew.

    ``begin`` empties the target and gives what takes its bytes.
    """
    if not parts:
        raise FolioError("range", "nothing to merge")
    forced: set[int] = set()
    for _ in range(len(parts) + 1):
        docs, at = [], 0
        try:
            for at, (_, doc_id, spec, content) in enumerate(parts):
                if content is None:
                    raise FolioError("io", f"{doc_id} does not exist")
                docs.append(_part(content, doc_id, spec, password, at in forced))
            A.assemble_to(begin(), docs, copy_annotations)
            return
        except FolioError as x:
            culprit = at if len(docs) < len(parts) else next((k for k in range(len(parts)) if k not in forced and not docs[k].doc.repaired), None)
            if type(x).__name__ != "Damaged" or culprit is None or culprit in forced:
                raise
            forced.add(culprit)
    raise FolioError("pdf", "merge did not settle")


def _part(content: bytes, doc_id: str, spec: str | None, password: str | None, rebuild: bool) -> A.Part:
    def run(d: Document) -> A.Part:
        pages = A.whole(d)
        if spec is None:
            return A.Part(d, pages, False)
        order = [n for g in spec.split(";") for n in R.pages_of(g, len(pages))]
        return A.Part(d, [pages[n - 1] for n in order], True)

    if rebuild:
        d = Document(content, doc_id)
        d.sweep()
        return run(d)
    return read_document(content, run, password, doc_id)


RUNS = "array<struct<text string, x float, y float, width float, height float, font_size float>>"
_RUNS = pa.list_(pa.struct([("text", pa.string()), *((n, pa.float32()) for n in ("x", "y", "width", "height", "font_size"))]))


def extract_text(files: DataFrame, pages: str | None = None, annotations: bool = True, password: str | None = None, mode: str = "permissive", values: bool = False) -> DataFrame:
    """``doc_id, page, page_width, page_height, degraded, runs[, value], error``; each selected page once, in the order given.

    With ``values`` the page's dictionary comes along as JSON, from the same parse.
    """

    def run(_, d: Document) -> Iterator[tuple]:
        if nesting(d.buf) > MAX_DEPTH:
            raise FolioError("pdf", "nesting depth exceeds the limit")
        have = d.pages()
        order = range(1, len(have) + 1) if pages is None else dict.fromkeys(R.pages_of(pages, len(have)))
        for n in order:
            p = T.page_text(d, have[n - 1], n, annotations)
            row = (p.page, p.width, p.height, p.degraded, [r._asdict() for r in p.runs])
            yield (*row, json.dumps(plain(d.get(have[n - 1])), ensure_ascii=False)) if values else row

    columns = f"doc_id string, page int, page_width float, page_height float, degraded boolean, runs {RUNS}, {'value string, ' if values else ''}{ERROR}"
    fields = [("page", pa.int32()), ("page_width", pa.float32()), ("page_height", pa.float32()), ("degraded", pa.bool_()), ("runs", _RUNS), *([("value", pa.string())] if values else [])]
    return _each(files, columns, _schema(*fields), run, password, mode)


def render_pages(files: DataFrame, dpi: float = 150.0, pages: str | None = None, mode: str = "permissive") -> DataFrame:
    """``doc_id, page, width_px, height_px, png, name_no, error``: white paper, one image a page. What is drawn and what not: see ``cos.raster``."""
    if not (dpi > 0 and dpi < float("inf")):
        raise FolioError("range", "dpi must be a positive number")

    def run(_, d: Document) -> Iterator[tuple]:
        have = d.pages()
        order = range(1, len(have) + 1) if pages is None else dict.fromkeys(R.pages_of(pages, len(have)))
        for n in order:
            w, h, png = raster.page_png(d, have[n - 1], dpi)
            yield n, w, h, png, str(n).zfill(len(str(len(have))))

    def locked(doc_id: str, d: Document) -> Iterator[tuple]:
        yield from run(doc_id, d)

    out = _each(files, f"doc_id string, page int, width_px int, height_px int, png binary, name_no string, {ERROR}", _schema(("page", pa.int32()), ("width_px", pa.int32()), ("height_px", pa.int32()), ("png", pa.binary()), ("name_no", pa.string())), locked, None, mode)
    needs = F.col("error.code") == "password"
    return out.withColumn("error", F.when(needs, F.struct(F.lit("unsupported").alias("code"), F.lit("encrypted files cannot be rendered").alias("message"))).otherwise(F.col("error")))


def color_counts(images: DataFrame) -> DataFrame:
    """``doc_id, page, color, pixels`` of ``images(doc_id, page, png)``: how many pixels have each colour, as six hexadecimal digits."""
    ship(images.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, page, png in zip(*(b.column(c).to_pylist() for c in ("doc_id", "page", "png"))):
                p = raster.read_png(png).reshape(-1, 3).astype(np.uint32)
                colors, n = np.unique(p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2], return_counts=True)
                rows += [(doc_id, page, f"{c:06x}", k) for c, k in zip(colors.tolist(), n.tolist())]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names=["doc_id", "page", "color", "pixels"])

    return images.where("png is not null").select("doc_id", "page", "png").mapInArrow(go, "doc_id string, page int, color string, pixels bigint")


def text_json(files: DataFrame, pages: str | None = None, annotations: bool = True, password: str | None = None, mode: str = "permissive") -> DataFrame:
    """``doc_id, json, error``: the runs of the selected pages of each document as one JSON array."""

    def run(_, d: Document) -> list[tuple]:
        have = d.pages()
        order = range(1, len(have) + 1) if pages is None else dict.fromkeys(R.pages_of(pages, len(have)))
        return [(T.pages_json([T.page_text(d, have[n - 1], n, annotations) for n in order]),)]

    return _each(files, f"doc_id string, json string, {ERROR}", _schema(("json", pa.string())), run, password, mode)

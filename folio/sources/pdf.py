"""PDF files as tables.

``parse`` reads every file once, in Arrow batches, and gives one wide table of records; the named tables (documents,
xref, objects, refs, page nodes) are selections of it. A file that cannot be read gives a document row with an
error and nothing else, unless ``mode`` is ``strict``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cos import geometry, write
from ..cos.document import Document, with_repair
from ..cos.objects import FolioError, Name, Ref, Stream, kind_of, references
from ..scratch import stage
from ..workers import ship

RECORD = (
    "doc_id string, rec string, obj bigint, gen int, ord int, dst bigint, key string, kind string, type string, subtype string, value string, body binary, data binary, "
    "version string, size bigint, declared bigint, root bigint, info bigint, load_path string, repaired boolean, encrypted boolean, code string, message string, "
    "media array<float>, crop array<float>, rotate int"
)
_FIELDS = [x.split(" ", 1) for x in re.split(r",\s*", RECORD)]
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32())}
SCHEMA = pa.schema([(n, _ARROW[t]) for n, t in _FIELDS])


def session_settings(spark: SparkSession) -> SparkSession:
    """What the queries rely on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``doc_id, path, content`` of files; ``doc_id`` is the path."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return f.select(F.col("path").alias("doc_id"), "path", "content")


def plain(v: Any) -> Any:
    """A value as JSON would have it: references as {"ref": [n, g]}, strings that are no text in hexadecimal."""
    if isinstance(v, Ref):
        return {"ref": [v.num, v.gen]}
    if isinstance(v, Stream):
        return plain(v.dict)
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, Name):
        return "/" + v
    if isinstance(v, bytes):
        return text_string(v)
    if isinstance(v, float) and (v != v or abs(v) == float("inf")):
        return None
    return v


def text_string(b: bytes) -> str:
    if b.startswith(b"\xfe\xff"):
        return b[2:].decode("utf-16-be", "replace")
    if b.startswith(b"\xef\xbb\xbf"):
        return b[3:].decode("utf-8", "replace")
    return b.decode("latin-1")


def records(doc_id: str, d: Document, streams: bool = False, keep: tuple[str, ...] = ()) -> Iterator[dict]:
    """The records of one open document."""
    root = d.catalog().get("Pages")
    info = d.trailer.get("Info")
    yield {
        "doc_id": doc_id, "rec": "doc", "version": d.version, "size": d.size, "declared": d.fast_count() if isinstance(root, Ref) else None,
        "root": root.num if isinstance(root, Ref) else None, "info": info.num if isinstance(info, Ref) else None, "load_path": d.load_path,
        "repaired": d.repaired, "encrypted": d.handler is not None, "message": "; ".join(d.warnings) or None,
    }
    for k, section in enumerate(d.sections or [d.xref]):
        for n, e in section.items():
            yield {"doc_id": doc_id, "rec": "xref", "obj": n, "ord": k, "kind": "plain" if e[0] == "n" else "member", "dst": e[1], "gen": e[2]}
    for n in sorted(d.xref):
        v = d.get(n)
        x = v.dict if isinstance(v, Stream) else v
        t = x.get("Type") if isinstance(x, dict) else None
        row = {"doc_id": doc_id, "rec": "object", "obj": n, "gen": d.xref[n][2] if d.xref[n][0] == "n" else 0, "kind": kind_of(v), "type": str(t) if isinstance(t, str) else None}
        if isinstance(x, dict):
            s = x.get("Subtype")
            row["subtype"] = str(s) if isinstance(s, str) else None
        if "value" in keep:
            row["value"] = json.dumps(plain(v), ensure_ascii=False)
        row["body"] = write.value(x) if "body" in keep else None
        if isinstance(v, Stream) and streams:
            row["data"] = v.raw
        if isinstance(x, dict) and t in ("Page", "Pages"):
            row |= {"media": _floats(geometry.rectangle(d, x.get("MediaBox"))), "crop": _floats(geometry.rectangle(d, x.get("CropBox"))), "rotate": geometry.rotation(d.resolve(x.get("Rotate")))}
        yield row
        for k, (path, r) in enumerate(references(v)):
            yield {"doc_id": doc_id, "rec": "ref", "obj": n, "ord": k, "dst": r.num, "gen": r.gen, "key": path}
        if isinstance(x, dict) and t == "Pages":
            kids = d.resolve(x.get("Kids"))
            for k, r in enumerate(kids if isinstance(kids, list) else []):
                if isinstance(r, Ref):
                    yield {"doc_id": doc_id, "rec": "edge", "obj": n, "ord": k, "dst": r.num}
                elif isinstance(r, dict):
                    yield {"doc_id": doc_id, "rec": "edge", "obj": n, "ord": k, "dst": None, "message": "direct object"}
            if not isinstance(kids, list):
                yield {"doc_id": doc_id, "rec": "edge", "obj": n, "ord": 0, "dst": None, "message": "kids are not an array"}


def _floats(r: tuple | None) -> list[float] | None:
    return None if r is None else [float(x) for x in r]


def failed(doc_id: str, x: FolioError) -> dict:
    return {"doc_id": doc_id, "rec": "doc", "code": x.code, "message": x.message}


def to_batch(rows: list[dict], schema: pa.Schema = SCHEMA) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def read_document(content: bytes, run, password: str | None, source: str) -> Any:
    """``run(document)`` with every kind of trouble turned into a ``FolioError``."""
    try:
        return with_repair(content or b"", run, password, source)
    except FolioError:
        raise
    except (RecursionError, MemoryError, ValueError, TypeError, KeyError, IndexError, AttributeError, OverflowError) as x:
        raise FolioError("pdf", f"{source}: {type(x).__name__}: {x}") from None


def parse(files: DataFrame, password: str | None = None, streams: bool = False, keep: tuple[str, ...] = ("value",), mode: str = "permissive") -> DataFrame:
    """All records of ``files(doc_id, content)``."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, content in zip(b.column("doc_id").to_pylist(), b.column("content")):
                try:
                    rows = read_document(content.as_py(), lambda d: list(records(doc_id, d, streams, keep)), password, doc_id)  # noqa: B023
                except FolioError as x:
                    if mode == "strict":
                        raise
                    rows = [failed(doc_id, x)]
                for at in range(0, len(rows), 10_000):
                    yield to_batch(rows[at : at + 10_000])

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, RECORD)


def load(files: DataFrame, **options) -> dict[str, DataFrame]:
    """The tables of ``files``, parsed once and kept in the shared folder: recursive plans read them many times."""
    return tables(stage(parse(files, **options), "parsed"))


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The named tables of what ``parse`` gave."""
    of = lambda rec, *cols: parsed.where(F.col("rec") == rec).select("doc_id", *cols)
    error = F.when(F.col("code").isNotNull(), F.struct("code", "message")).alias("error")
    return {
        "documents": of("doc", "version", F.col("size").alias("xref_size"), F.col("declared").alias("declared_count"), F.col("root").alias("pages_root"), "info", "load_path", "repaired", "encrypted", "message", error),
        "xref": of("xref", F.col("ord").alias("section_no"), "obj", "kind", F.col("dst").alias("place"), F.col("gen").alias("gen_or_index")),
        "objects": of("object", "obj", "gen", "kind", "type", "subtype", "value", "body", "data", "media", "crop", "rotate"),
        "refs": of("ref", F.col("obj").alias("src_obj"), F.col("key").alias("key_path"), "ord", F.col("dst").alias("dst_obj"), F.col("gen").alias("dst_gen")),
        "page_edges": of("edge", F.col("obj").alias("parent"), "ord", F.col("dst").alias("kid"), "message"),
    }


# --- a data source of its own: spark.read.format("folio"), df.write.format("folio")


def register(spark: SparkSession) -> None:
    from .datasource import FolioDataSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes filters on ``rec`` and ``doc_id``
    spark.dataSource.register(FolioDataSource)

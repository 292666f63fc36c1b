"""Stream data through filter chains, in Arrow batches."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cos import filters
from ..cos.objects import FolioError
from ..workers import ship


def _run_length(data: bytes) -> bytes:
    """Literal runs of up to 128 bytes and an end mark."""
    return b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128)) + b"\x80"


def _lzw(data: bytes) -> bytes:
    """Codes of growing width; the table is cleared before it is full."""
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    put(256, 9)
    table = {bytes([i]): i for i in range(256)}
    width, word = 9, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        if len(table) + 2 >= 4094:
            put(256, width)
            table, width = {bytes([i]): i for i in range(256)}, 9
        else:
            table[longer] = len(table) + 2
            if len(table) + 2 >= 1 << width:
                width += 1
        word = data[i : i + 1]
    if word:
        put(table[word], width)
        if len(table) + 3 >= 1 << width and width < 12:
            width += 1
    put(257, width)
    put(0, -bits % 8)
    return bytes(out)


def _predicted(data: bytes, predictor: int, columns: int) -> bytes:
    """Rows of ``columns`` bytes, the last one filled up with zeros: TIFF differences, or the PNG filter of this number."""
    rows = np.zeros((-(-len(data) // columns), columns), dtype=np.uint8)
    rows.ravel()[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    left, up = np.hstack([rows[:, :1] * 0, rows[:, :-1]]), np.vstack([rows[:1] * 0, rows[:-1]])
    if predictor == 2:
        return (rows - left).tobytes()
    corner = np.hstack([up[:, :1] * 0, up[:, :-1]])
    a, b, c = (x.astype(int) for x in (left, up, corner))
    near = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), a, np.where(near[1] <= near[2], b, c))
    guess = [0 * a, a, b, (a + b) // 2, paeth][predictor - 10]
    return np.hstack([np.full((len(rows), 1), predictor - 10, dtype=np.uint8), (rows - guess).astype(np.uint8)]).tobytes()


ENCODERS = {
    "FlateDecode": zlib.compress,
    "LZWDecode": _lzw,
    "ASCIIHexDecode": lambda b: b.hex().encode() + b">",
    "ASCII85Decode": lambda b: base64.a85encode(b) + b"~>",
    "RunLengthDecode": _run_length,
}


def encode_streams(streams: DataFrame) -> DataFrame:
    """``data`` as a stream with these ``filters`` (and the JSON array ``parms``) would hold it; other columns stay."""
    ship(streams.sparkSession)
    has_parms = "parms" in streams.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            parms = b.column("parms").to_pylist() if has_parms else [None] * b.num_rows
            for data, names, p in zip(b.column("data").to_pylist(), b.column("filters").to_pylist(), parms):
                p = json.loads(p) if p else []
                for k, f in reversed(list(enumerate(names))):
                    own = (p[k] if k < len(p) else None) or {}
                    if own.get("Predictor", 1) > 1:
                        data = _predicted(data, own["Predictor"], own["Columns"])
                    data = ENCODERS[filters.full_name(f)](data)
                out.append(data)
            yield b.set_column(b.schema.get_field_index("data"), "data", pa.array(out, pa.binary()))

    return streams.mapInArrow(go, streams.schema)


def decode_streams(streams: DataFrame) -> DataFrame:
    """``data`` decoded by ``filters`` and, if there is one, the JSON array ``parms``; ``error`` where that fails."""
    ship(streams.sparkSession)
    has_parms = "parms" in streams.columns
    out_schema = streams.withColumn("error", F.lit(None).cast("string")).schema

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, errors = [], []
            parms = b.column("parms").to_pylist() if has_parms else [None] * b.num_rows
            for data, names, p in zip(b.column("data").to_pylist(), b.column("filters").to_pylist(), parms):
                try:
                    out.append(filters.decode(data or b"", names or [], json.loads(p) if p else []))
                    errors.append(None)
                except FolioError as x:
                    out.append(None)
                    errors.append(f"{x.code}: {x.message}")
            b = b.set_column(b.schema.get_field_index("data"), "data", pa.array(out, pa.binary()))
            yield b.append_column("error", pa.array(errors, pa.string()))

    return streams.mapInArrow(go, out_schema)


def normalised(filter_names: Column) -> Column:
    """Full names for abbreviated filters, as a column."""
    table = F.create_map(*[F.lit(x) for kv in filters.SHORT.items() for x in kv])
    return F.transform(filter_names, lambda f: F.coalesce(table[f], f))

"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's four-word shingles. Two fingerprints
within ``2 * HALF`` bits of each other share a point that is within ``HALF`` bits of both, so every
distinct fingerprint emits all ``1 + 64 + 2016`` points of its ball and equal points link their owners.

Writing 2,081 points per fingerprint to a shuffle would cost far more than the corpus. A point's shard is
the parity of each of its byte lanes, so a fingerprint's ball touches only ``1 + 8 + 28`` of 256 shards: the
shuffle carries the bare fingerprint to these shards and each shard makes its own points, sorts them and
keeps the links of a spanning forest. With every doubling of the fingerprints there is a lane more, so a shard's work
stays the same and a fingerprint travels to ``1 + lanes + lanes * (lanes - 1) / 2`` shards: 37 up to half a million
fingerprints, 92 at 15 million, 191 at a billion. Near-copies differ in some bit and so spread over the shards as well.

Nulls: a null text counts as empty and has fingerprint zero. A null id takes no part in the choice of a
component's id unless all its ids are null. Fingerprints, not ids, are linked, so rows without an id or with a
shared one are never joined by it. Repeated rows are kept by :func:`classes`. Empty input gives empty output.
Extra columns, whatever their names, are not read by :func:`fingerprints` and pass through :func:`keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workers import ship
from .common import stage
from .components import components

SHINGLE = 4
HALF = 2
SEED = 42
#: Points a shard should make at most, on average.
SHARD_POINTS = 4_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, as an unsigned integer."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return digest(b" ".join(w), SEED)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]).tolist()
    starts = [0, *ends[: len(w) - shingle]]
    view = memoryview(joined)
    h = np.fromiter((digest(view[s : e - 1], SEED) for s, e in zip(starts, ends[shingle - 1 :])), dtype=np.uint64, count=len(starts))
    return majority(h)


def majority(h: np.ndarray) -> int:
    """Bit i is 1 if over half of ``h`` have it; counted in blocks so that a long text needs no large table."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * votes > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


def _fingerprint_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("text")), dtype=np.uint64, count=b.num_rows)
            cols = {n: b.column(n) for n in b.schema.names if n != "text"}
            yield pa.RecordBatch.from_pydict(cols | {"fp": pa.array(fp.view(np.int64))})

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, extra: list[Column] = ()) -> DataFrame:
    """``doc_id, *extra, fp`` with ``fp`` the fingerprint's bits as a signed long; ``extra`` are longs it carries along."""
    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"{c} long" for c in d.columns if c != "text")
    return d.mapInArrow(_fingerprint_batches(shingle), f"{schema}, fp long")


# --- shards ---------------------------------------------------------------------------------------------


def lane_masks(lanes: int) -> np.ndarray:
    """``lanes`` masks of neighbouring bits, as equal as can be."""
    masks = [0] * lanes
    for i, lane in enumerate(lane_of_bit(lanes)):
        masks[lane] |= 1 << i
    return np.array(masks, dtype=np.uint64)


def lane_of_bit(lanes: int) -> list[int]:
    return [i * lanes // 64 for i in range(64)]


def _parity(x: np.ndarray) -> np.ndarray:
    for s in (32, 16, 8, 4, 2, 1):
        x = x ^ (x >> np.uint64(s))
    return (x & np.uint64(1)).astype(np.int64)


def shard_of(fp: np.ndarray, lanes: int) -> np.ndarray:
    out = np.zeros(len(fp), dtype=np.int64)
    for i, m in enumerate(lane_masks(lanes)):
        out |= _parity(fp & m) << i
    return out


@cache
def ball_flips(lanes: int, half: int = HALF) -> dict[int, np.ndarray]:
    """The flips of at most ``half`` bits, by what they do to a shard's number; made once in a worker."""
    lane = lane_of_bit(lanes)
    by: dict[int, list[int]] = {0: [0]}
    frontier = [(0, -1, 0)]
    for _ in range(half):
        grown = []
        for mask, top, move in frontier:
            for i in range(top + 1, 64):
                m, to = mask | (1 << i), move ^ (1 << lane[i])
                by.setdefault(to, []).append(m)
                grown.append((m, i, to))
        frontier = grown
    return {k: np.array(v, dtype=np.uint64) for k, v in by.items()}


def ball_size(half: int = HALF) -> int:
    return sum(math.comb(64, k) for k in range(half + 1))


def lanes_for(n: int, points: int = 2081) -> int:
    """The fewest lanes, 8 to 32, that keep a shard's points at ``SHARD_POINTS``: the work of a shard stays the same as ``n`` grows."""
    return next((k for k in range(8, 32) if n * points >> k <= SHARD_POINTS), 32)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, parent) of a spanning forest of the links a-b among 0..n-1: labels sink to the minimum."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        lo, hi = np.minimum(la, lb), np.maximum(la, lb)
        if (lo == hi).all():
            break
        np.minimum.at(label, hi, lo)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def _links_of_shard(shard: int, fp: np.ndarray, rep: np.ndarray, flips: dict[int, np.ndarray], lanes: int, half: int = HALF) -> tuple[np.ndarray, np.ndarray]:
    """Links between the representatives whose balls meet in points of this shard.

    The points are made in slices by their top bits when there are too many to sort at once.
    """
    order = np.argsort(fp, kind="stable")
    fp, rep = fp[order], rep[order]
    own = shard_of(fp, lanes)
    total = sum(len(flips[int(m)]) * int(c) for m, c in zip(*np.unique(own ^ shard, return_counts=True)))
    cuts = max(1, -(-total // (2 * SHARD_POINTS)))
    found_a, found_b = [], []
    for cut in range(cuts):
        points, owner = [], []
        for move in np.unique(own ^ shard):
            idx = np.flatnonzero(own ^ shard == move)
            f = flips[int(move)]
            step = max(1, (1 << 20) // len(f))
            for at in range(0, len(idx), step):
                part = idx[at : at + step]
                p = (fp[part][:, None] ^ f[None, :]).ravel()
                o = np.repeat(part.astype(np.int32), len(f))
                if cuts > 1:
                    keep = ((p * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(cuts) == np.uint64(cut)
                    p, o = p[keep], o[keep]
                points.append(p)
                owner.append(o)
        p, o = np.concatenate(points), np.concatenate(owner)
        by = np.argsort(p)
        p, o = p[by], o[by]
        same = p[1:] == p[:-1]
        a, b = o[1:][same], o[:-1][same]
        if len(a):
            pairs = np.unique(np.maximum(a, b).astype(np.int64) * len(fp) + np.minimum(a, b))
            a, b = pairs // len(fp), pairs % len(fp)
            near = np.bitwise_count(fp[a] ^ fp[b]) <= 2 * half
            found_a.append(a[near])
            found_b.append(b[near])
    if not found_a:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    child, parent = _forest(np.concatenate(found_a), np.concatenate(found_b), len(fp))
    return rep[child], rep[parent]


def _spread(lanes: int, half: int):
    moves = np.array(sorted(ball_flips(lanes, half)), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                c = b.slice(at, 20_000)
                fp = c.column("fp").to_numpy(zero_copy_only=False)
                shard = (shard_of(fp.view(np.uint64), lanes)[:, None] ^ moves[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.repeat(fp, len(moves))), pa.array(np.repeat(c.column("rep").to_numpy(zero_copy_only=False), len(moves)))], names=["shard", "fp", "rep"])

    return run


def _meet(lanes: int, half: int):
    def run(table: pa.Table) -> pa.Table:
        flips = ball_flips(lanes, half)
        fp = table.column("fp").to_numpy().view(np.uint64)
        a, b = _links_of_shard(table.column("shard")[0].as_py(), fp, table.column("rep").to_numpy(), flips, lanes, half)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def links(distinct: DataFrame, lanes: int | None = None, half: int = HALF) -> DataFrame:
    """Links ``a, b`` that connect exactly the components of ``distinct(fp, rep)`` under "at most ``2 * half`` bits apart"."""
    n = lanes or lanes_for(distinct.count(), ball_size(half))
    spread = distinct.mapInArrow(_spread(n, half), "shard long, fp long, rep long")
    return spread.groupBy("shard").applyInArrow(_meet(n, half), "a long, b long")


def _rooted(fps: DataFrame, half: int) -> DataFrame:
    """``l_fp, root`` of every distinct fingerprint. Fingerprints are the nodes, so rows that share an id stay apart."""
    distinct = stage(fps.select("fp", F.col("fp").alias("rep")).distinct(), "fps")
    found = components(links(distinct, half=half))
    return distinct.join(found, distinct["fp"] == found["node"], "left").select(F.col("fp").alias("l_fp"), F.coalesce("root", "rep").alias("root"))


def classes(fps: DataFrame, half: int = HALF) -> DataFrame:
    """Every row of ``fps(doc_id, fp)`` with ``component_id``, the smallest id its fingerprint is linked with."""
    low = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    rooted = stage(low.join(_rooted(fps, half), F.col("fp") == F.col("l_fp")).select("l_fp", "root", "low"), "rooted")
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    label = rooted.join(least, "root").select("l_fp", "component_id")
    return fps.join(label, fps["fp"] == label["l_fp"], "left").drop("l_fp")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, half: int = HALF) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates: the one with the smallest id (then text hash).

    A row is known by its id and text, so rows without an id, or that share one, are judged by their texts alone.
    """
    of_text = [F.xxhash64("text").alias("_folio_h1"), F.xxhash64(F.lit(1), F.col("text")).alias("_folio_h2")]
    fps = stage(fingerprints(docs, shingle, of_text), "fp")
    order = [F.col("doc_id").asc_nulls_last(), "_folio_h1", "_folio_h2"]
    nth = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(*order))
    best = fps.withColumn("nth", nth("fp")).where("nth = 1")
    best = best.join(_rooted(fps, half), F.col("fp") == F.col("l_fp")).withColumn("nth", nth("root")).where("nth = 1")
    best = best.select(F.col("doc_id").alias("_folio_id"), F.col("_folio_h1").alias("_folio_k1"), F.col("_folio_h2").alias("_folio_k2"))
    of_row = docs.select("*", *of_text)
    kept = of_row.join(best, F.col("doc_id").eqNullSafe(F.col("_folio_id")) & (F.col("_folio_h1") == F.col("_folio_k1")) & (F.col("_folio_h2") == F.col("_folio_k2")), "left_semi")
    # rows alike in id and text: one of them, by the other columns
    one = Window.partitionBy("doc_id", "_folio_h1", "_folio_h2").orderBy("_folio_h1", *[F.col(c) for c in docs.columns if c not in ("doc_id", "text")])
    return kept.withColumn("_folio_n", F.row_number().over(one)).where("_folio_n = 1").select(*docs.columns)

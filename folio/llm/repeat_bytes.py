"""Removal of repeated byte strings by a distributed difference-cover sort.

A suffix sort orders suffixes; strings of ``LENGTH`` bytes that repeat are neighbours in it. A difference cover D of
residues modulo v holds, for any two positions i and j, a shift below v that takes both into the sample of positions
whose residue is in D. So two equal strings of ``LENGTH`` bytes share, at some sampled position of both, a string of
``LENGTH - v + 1`` bytes. The steps are those of the difference-cover algorithm, with tuples that long (the triples
of the usual v = 3 would be sampled from two thirds of all positions; here v = 133 and one position in eleven is):

1. The tuples at sampled positions are sorted by their names (hashes) in shards. Tuples whose name is unique are
   settled and leave: no suffix that begins near them can repeat by them. This is the recursion's discarding step;
   with tuples of 68 bytes nothing is left to recurse on but the names of true repeats.
2. Remaining suffixes are those that begin up to v - 1 bytes before a sampled position that is left. They are merged:
   each is named by its first ``LENGTH`` bytes, sorted in shards, and compared with its neighbours.
   Equal neighbours are repeats. This goes in ``ROUNDS`` rounds, each over its share of the names, so that at any time
   only that share is on disk.

3. Neighbours are compared. Each repeated place knows its neighbour in the sorted order; neighbouring places whose
   neighbours lie side by side as well form runs, and both ends of a run tell a digest of its bytes. If any two
   differ, names have collided, and step 2 is done again with other names; so a result never rests on names alone.
   Places of one batch are compared byte for byte.

A name of step 1 only proposes candidates. A name of step 2 is two independent sums of 64 bits each, so that it hardly
ever has to be done again: among n windows about n² / 2**129 unlike pairs with one name are expected.

Names and places travel in packed arrays, one row for each batch of texts and shard, and a batch sends each name once
however often it has it; so neither a frequent line nor a large group of copies makes a large shard. Exact copies
of whole texts are found first, by a hash of 128 bits, and one of each group takes part.

Nulls count as empty. Repeated rows repeat each other's strings. Empty input gives empty output. Extra columns are
not read. Texts are handled whole: one of more than ``PIECE`` bytes goes in pieces that overlap by a window, so a batch
never holds more than about ``BATCH + PIECE`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import ship
from .common import handed, stage

LENGTH = 200
V = 133
#: A perfect difference set modulo 133: every residue but 0 is the difference of one ordered pair.
COVER = (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
TUPLE = LENGTH - V + 1
#: Bytes of text named at a time, and the most of one text among them.
BATCH = 1 << 20
PIECE = 1 << 20
SLICE = 1 << 17
#: Bytes of rows that a worker is handed at a time.
HANDED = "8m"
#: Bytes of names and places a shard should hold, on average.
SHARD_BYTES = 8 << 20
LEAST_SHARDS = 64
ROUNDS = 4
#: Copied texts whose table is broadcast, at most; beyond it the table is joined by a shuffle.
BROADCAST_ROWS = 500_000

_rng = np.random.default_rng(20240229)
#: How often step 2 is tried with names of its own, should they collide.
TRIES = 8
_TABLES = _rng.integers(0, 2**64, size=(2 * TRIES, 256), dtype=np.uint64)
_BASES = [int(x) | 1 for x in _rng.integers(2**62, 2**63, size=2 * TRIES)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step
        have += take
    return out


@cache
def _power_table(which: int) -> np.ndarray:
    """Powers of a base for the longest batch there is; made once in a worker."""
    return _powers(_BASES[which], BATCH + 2 * PIECE)


class Names:
    """Names of windows of a byte array: polynomial sums modulo 2**64 over random values of the bytes.

    Byte i counts times the base to the i; a window's sum is raised to the same power wherever it begins.
    """

    def __init__(self, raw: np.ndarray, which: int):
        self.power = _power_table(which)
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_TABLES[which][raw] * self.power[: len(raw)], out=self.sums[1:])

    def at(self, pos: np.ndarray, width: int) -> np.ndarray:
        x = self.sums[pos + width] - self.sums[pos]
        x *= self.power[len(self.power) - 1 - pos]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return x


_IN_COVER = np.isin(np.arange(V), COVER)


def sampled(start: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of the sample in pieces laid end to end.

    A piece begins at ``start``, holds its text from byte ``at`` on, and has ``count`` places at which a window begins.
    """
    p = _spans(start, start + count)
    return p[_IN_COVER[(p + np.repeat(at - start, count)) % V]]


def merged(runs: np.ndarray, start: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places up to V - 1 bytes before one that is left. ``runs`` are rows of piece, where in its text, and how many."""
    k = runs[:, 0]
    first = runs[:, 1] - at[k] + start[k]
    a = np.maximum(first - (V - 1), start[k])
    b = np.minimum(first + runs[:, 2], start[k] + count[k])
    a, b = a[a < b], b[a < b]
    head = np.r_[True, a[1:] > b[:-1]] if len(a) else np.zeros(0, dtype=bool)
    return _spans(a[head], b[np.r_[head[1:], True]] if len(b) else b)


def _spans(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``a .. b``, one after the other."""
    n = b - a
    return np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


# --- packed places ----------------------------------------------------------------------------------------


def gap_bytes(shards: int, spacing: int) -> int:
    """Bytes of a gap between neighbouring places of a shard, when every ``spacing``-th byte is a place."""
    return 1 if shards * spacing <= 80 else 2 if shards * spacing <= 20_000 else 4


def _pack(offsets: np.ndarray, names: np.ndarray, gap: int) -> bytes:
    """Gaps between ascending offsets in ``gap`` bytes, then the names, a row of bytes each.

    A large gap is led by fillers that stand for the largest number; a place's own gap is always below it.
    """
    most = 256**gap - 1
    g = np.diff(offsets, prepend=0)
    extra = g // most
    if extra.any():
        total = len(g) + int(extra.sum())
        at = np.cumsum(extra + 1) - 1
        wide, rows = np.full(total, most, dtype=np.int64), np.zeros((total, names.shape[1]), dtype=np.uint8)
        wide[at], rows[at] = g % most, names
        g, names = wide, rows
    return np.array([len(g), gap], dtype="<u4").tobytes() + g.astype(f"<u{gap}").tobytes() + np.ascontiguousarray(names).tobytes()


def _unpack(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    n, gap = (int(x) for x in np.frombuffer(blob, dtype="<u4", count=2))
    g = np.frombuffer(blob, dtype=f"<u{gap}", count=n, offset=8).astype(np.int64)
    m = np.frombuffer(blob, dtype=np.uint8, count=n * width, offset=8 + gap * n).reshape(n, width)
    off = np.cumsum(g)
    real = g != 256**gap - 1
    return off[real], m[real]


def to_runs(places: np.ndarray) -> bytes:
    """Ascending places as 32-bit pairs of where a run of neighbours starts and how long it is."""
    if not len(places):
        return b""
    edge = np.flatnonzero(np.r_[True, places[1:] != places[:-1] + 1])
    out = np.empty((len(edge), 2), dtype="<u4")
    out[:, 0], out[:, 1] = places[edge], np.diff(np.r_[edge, len(places)])
    return out.tobytes()


def from_runs(runs: bytes) -> np.ndarray:
    r = np.frombuffer(runs, dtype="<u4").astype(np.int64).reshape(-1, 2)
    return _spans(r[:, 0], r[:, 0] + r[:, 1])


_OUT = pa.schema([("shard", pa.int32()), ("uid", pa.int64()), ("kind", pa.int8()), ("blob", pa.binary())])
INFO, PLACES = 0, 1
#: Bytes of a name that travel in the first and the second step.
NAME_BYTES = (6, 16)


def _row(shard: list, uid: list, kind: list, blob: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(uid, pa.int64()), pa.array(kind, pa.int8()), pa.array(blob, pa.binary())], schema=_OUT)


def _pieces(batches: Iterator[pa.RecordBatch], width: int, with_left: bool) -> Iterator[tuple[list, list, list]]:
    """Lists of (id, text hash, offset of the piece), of its bytes and of its runs of places left, of about ``BATCH`` bytes."""
    who, raws, left, size = [], [], [], 0
    for b in batches:
        ids, hs = b.column("doc_id").to_pylist(), b.column("h1").to_pylist()
        runs = b.column("places").to_pylist() if with_left else [b""] * b.num_rows
        for i, raw in enumerate(b.column("raw").to_pylist()):
            last = len(raw or b"") - width + 1
            for at in range(0, max(last, 0), PIECE):
                part, theirs = raw, runs[i]
                if last > PIECE:
                    part = raw[at : at + PIECE + width - 1]
                    r = np.frombuffer(theirs, dtype="<u4").reshape(-1, 2)
                    near = np.searchsorted(r[:, 0], (at, at + PIECE + V)) + (-1, 0)
                    theirs = r[max(0, near[0]) : near[1]].tobytes()
                who.append((ids[i], hs[i], at)), raws.append(part), left.append(theirs)
                size += len(part)
                if size >= BATCH:
                    yield who, raws, left
                    who, raws, left, size = [], [], [], 0
    if who:
        yield who, raws, left


def _alike(raw: np.ndarray, pos: np.ndarray, by: np.ndarray, same: np.ndarray, width: int) -> np.ndarray:
    """Which of the neighbours ``same`` names alike are alike byte for byte; runs on one diagonal are compared once."""
    at = np.flatnonzero(same)
    if not len(at):
        return same
    a, b = pos[by[at]].astype(np.int64), pos[by[at + 1]].astype(np.int64)
    a, off = np.minimum(a, b), np.abs(b - a)
    order = np.argsort((off << 32) | a)
    x, d = a[order], off[order]
    head = np.r_[True, (d[1:] != d[:-1]) | (x[1:] > x[:-1] + width)]
    lo, hi = x[head], x[np.r_[head[1:], True]] + width
    where = _spans(lo, hi)
    wrong = raw[where] != raw[where + np.repeat(d[head], hi - lo)]
    if not wrong.any():
        return same
    upto = np.r_[0, np.cumsum(wrong)]
    run = np.cumsum(head) - 1
    begin = (np.cumsum(hi - lo) - (hi - lo))[run] + x - lo[run]
    out = same.copy()
    out[at[order]] = upto[begin] == upto[begin + width]
    return out


def _uid(who: list) -> int:
    """A number for a batch, by the texts and pieces in it."""
    keys = np.array([v for i, h, at in who for v in (0 if i is None else i, int(i is None), h, at)], dtype="<i8")
    return int.from_bytes(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), "little", signed=True)


def _info(who: list, start: np.ndarray, length: np.ndarray) -> bytes:
    """What :func:`resolve` has to know of a batch's pieces: ids, text hashes, offsets in their texts and in the batch, lengths."""
    ids, hs, at = zip(*who)
    cols = [0 if i is None else i for i in ids], [int(i is None) for i in ids], hs, at, start, length
    return np.array([len(who)], dtype="<i8").tobytes() + b"".join(np.array(c, dtype="<i8").tobytes() for c in cols)


def _laid(batches: Iterator[pa.RecordBatch], width: int, with_left: bool) -> Iterator[tuple[int, bytes, bytes, np.ndarray]]:
    """Batches of texts: their number, what is in them, their bytes and the places at which windows of ``width`` are named."""
    for who, raws, left in _pieces(batches, width, with_left):
        length, at = np.array([len(x) for x in raws], dtype=np.int64), np.array([x[2] for x in who], dtype=np.int64)
        start, count = np.cumsum(length) - length, length - width + 1
        if with_left:
            r = np.frombuffer(b"".join(left), dtype="<u4").astype(np.int64).reshape(-1, 2)
            which = np.repeat(np.arange(len(who)), [len(x) // 8 for x in left])
            pos = merged(np.column_stack([which, r]), start, at, count)
        else:
            pos = sampled(start, at, count)
        if len(pos):
            yield _uid(who), _info(who, start, length), b"".join(raws), pos


def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``uid, info, raw, places``: what remains for step 2, about ``BATCH`` bytes each."""
    for uid, info, raw, pos in _laid(batches, LENGTH, True):
        yield pa.RecordBatch.from_pydict({"uid": [uid], "info": [info], "raw": [raw], "places": [to_runs(pos)]})


def _relaid(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, bytes, np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            uid, info, raw, places = (b.column(c)[i].as_py() for c in ("uid", "info", "raw", "places"))
            yield uid, info, raw, from_runs(places)


def _ours(names: Names, pos: np.ndarray, width: int, few: np.uint64, share: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The places whose name is of this share, and their names; looked at in slices, so that the rest takes no room."""
    kept = []
    for at in range(0, len(pos), SLICE):
        p = pos[at : at + SLICE]
        c = names.at(p, width) & few
        mine = (c >> np.uint64(60)) % np.uint64(rounds) == np.uint64(share)
        kept.append((p[mine], c[mine]))
    return tuple(np.concatenate(x) for x in zip(*kept))


def emit(shards: int, verify: bool, share: int = 0, rounds: int = 1, attempt: int = 0, bits: int = 64):
    """Names and places of one step's windows, packed by shard; of the names, the ``share``-th of ``rounds`` shares."""
    width, size = LENGTH if verify else TUPLE, NAME_BYTES[verify]
    gap = gap_bytes(shards * rounds, 1 if verify else V // len(COVER))
    few = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uid, info, data, pos in _relaid(batches) if verify else _laid(batches, width, False):
            raw, pos = np.frombuffer(data, dtype=np.uint8), pos.astype(np.int32)
            pos, check = _ours(Names(raw, 2 * attempt + 1), pos, width, few, share, rounds)
            if not len(pos):
                continue
            name = Names(raw, 2 * attempt).at(pos, width) & few if verify else check
            # a name the batch has twice or more: all its places are repeats, one of them tells other batches
            by, same = _ordered(name, check)
            if verify:
                same = _alike(raw, pos, by, same, width)
            local = np.sort(pos[by[np.r_[same, False] | np.r_[False, same]]]).astype(np.int64)
            out = [[uid % shards], [uid], [INFO], [info + to_runs(local)]]
            one = by[np.r_[True, ~same]]
            pos, name, check = pos[one], name[one], check[one]
            shard = (((check >> np.uint64(20)) & np.uint64(0xFFFFFFFF)) % np.uint64(shards)).astype(np.int64)
            one = np.argsort((shard << 32) | pos)
            pos, shard = pos[one].astype(np.int64), shard[one]
            table = np.stack([x[one].astype("<u8") for x in ((name, check) if verify else (name,))], axis=1).view(np.uint8)[:, :size]
            edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                for x, v in zip(out, (int(shard[a]), uid, PLACES, _pack(pos[a:b], table[a:b], gap))):
                    x.append(v)
            yield _row(*out)

    return run


def _ordered(first: np.ndarray, second: np.ndarray | None, stable: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal names are neighbours, and which neighbours are equal."""
    by = np.argsort(first, kind="stable" if stable else None)
    x = first[by]
    same = x[1:] == x[:-1]
    if second is not None and second is not first:
        at = np.flatnonzero(same)
        alike = second[by[at + 1]] == second[by[at]]
        if not alike.all():  # first words collide: order by both
            by = np.lexsort((second, first))
            same = (first[by[1:]] == first[by[:-1]]) & (second[by[1:]] == second[by[:-1]])
    return by, same


def _shared(words: np.ndarray, whose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of one or two 64-bit words: which are equal to a row of another owner, and for each one such neighbour.

    Owners are in ascending order, and so are the rows of a class: a row's neighbour is the one before it in its class,
    of the first one the one after.
    """
    two = words.shape[1] > 1
    by, same = _ordered(np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1]) if two else None, stable=two)
    several = by[np.r_[same, False] | np.r_[False, same]]
    head = np.flatnonzero(np.r_[True, ~same])
    n = np.diff(np.r_[head, len(by)])
    n = n[n > 1]
    if not len(n):
        return several, several
    start, w = np.cumsum(n) - n, whose[several]
    first = np.zeros(len(several), dtype=bool)
    first[start] = True
    near = np.where(first, np.r_[several[1:], several[:1]], np.r_[several[-1:], several[:-1]])
    keep = np.repeat(np.minimum.reduceat(w, start) != np.maximum.reduceat(w, start), n)
    hit, near = several[keep], near[keep]
    order = np.argsort(hit)
    return hit[order], near[order]


def meet(size: int):
    """In a shard: the places whose name another batch has too; what is known of each batch passes through.

    In the second step (names of two words) each place comes with its neighbour's batch and place.
    """
    told = size > 8

    def run(table: pa.Table) -> pa.Table:
        kind, uid, blob = table.column("kind").to_pylist(), table.column("uid").to_pylist(), table.column("blob")
        out_uid, out_kind, out_blob = [], [], []
        offs, names, owners = [], [], []
        for i in sorted(range(len(kind)), key=uid.__getitem__):
            b = blob[i].as_buffer()
            if kind[i] == INFO:
                out_uid.append(uid[i]), out_kind.append(INFO), out_blob.append(bytes(b))
            else:
                o, m = _unpack(b, size)
                offs.append(o.astype(np.int32)), names.append(m), owners.append(uid[i])
        if offs:
            whose = np.repeat(np.arange(len(offs), dtype=np.int32), [len(o) for o in offs])
            wide = np.zeros((len(whose), -(-size // 8) * 8), dtype=np.uint8)
            wide[:, :size] = np.concatenate(names)
            names.clear()
            hit, near = _shared(wide.view("<u8"), whose)
            off = np.concatenate(offs)
            o, w = off[hit].astype(np.int64), whose[hit]
            edge = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else w
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(w)]):
                beside = _neighbours(off[near[a:b]], whose[near[a:b]], owners) if told else (b"", np.zeros((b - a, 0), dtype=np.uint8))
                out_uid.append(owners[w[a]]), out_kind.append(PLACES), out_blob.append(beside[0] + _pack(o[a:b], beside[1], 2))
        return pa.table({"uid": pa.array(out_uid, pa.int64()), "kind": pa.array(out_kind, pa.int8()), "blob": pa.array(out_blob, pa.binary())})

    return run


def _neighbours(off: np.ndarray, whose: np.ndarray, owners: list[int]) -> tuple[bytes, np.ndarray]:
    """Places in other batches as rows of bytes: three of the place, the rest of the batch's number in the list that comes first."""
    batches, number = np.unique(whose, return_inverse=True)
    size = 1 if len(batches) <= 256 else 2 if len(batches) <= 65_536 else 4
    head = np.array([len(batches), size], dtype="<u4").tobytes() + np.array([owners[b] for b in batches.tolist()], dtype="<i8").tobytes()
    places = off.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return head, np.hstack([places, number.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size]])


def _beside(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places with their neighbours' places and batches, from what :func:`meet` wrote."""
    n, size = (int(x) for x in np.frombuffer(blob, dtype="<u4", count=2))
    owners = np.frombuffer(blob, dtype="<i8", count=n, offset=8)
    o, t = _unpack(blob[8 + 8 * n :], 3 + size)
    wide = np.zeros((len(o), 8), dtype=np.uint8)
    wide[:, :3], wide[:, 4 : 4 + size] = t[:, :3], t[:, 3:]
    place, number = wide.view("<u4").astype(np.int64).T
    return o, place, owners[number]


def resolve(told: bool):
    """Of one batch: the repeated places of each of its texts, counted from the text's start.

    In the second step (``told``) also runs of places whose neighbours lie side by side: where in the batch, how many bytes,
    the neighbours' batch, where in that.
    """

    def run(table: pa.Table) -> pa.Table:
        info, parts = None, []
        for k, b in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
            if k == INFO:
                info = info or b
            else:
                parts.append(_beside(b) if told else (_unpack(b, 0)[0],))
        n = int(np.frombuffer(info, dtype="<i8", count=1)[0])
        ids, null, hs, base, start, length = np.frombuffer(info, dtype="<i8", count=6 * n, offset=8).reshape(6, n)
        place = np.unique(np.concatenate([*(p[0] for p in parts), from_runs(info[8 + 48 * n :])])).astype(np.int64)
        piece = np.searchsorted(start + length, place, side="right")
        edge = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]) if len(piece) else np.zeros(0, dtype=np.int64)
        end = np.r_[edge[1:], len(piece)]
        who = piece[edge] if len(piece) else edge
        blobs = [to_runs(place[a:b] - start[k] + base[k]) for a, b, k in zip(edge.tolist(), end.tolist(), who.tolist())]
        out = {"p_id": [None if null[k] else int(ids[k]) for k in who], "p_h1": hs[who].tolist(), "places": blobs, "uid": [None] * len(who), "runs": [None] * len(who)}
        if told and parts:
            for c, v in zip(out, (None, None, None, table.column("uid")[0].as_py(), _runs(*(np.concatenate(x) for x in zip(*parts))))):
                out[c].append(v)
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), types)})

    return run


def _runs(o: np.ndarray, near: np.ndarray, batch: np.ndarray) -> bytes:
    by = np.argsort(o)
    o, near, batch = o[by].astype(np.int64), near[by], batch[by]
    head = np.r_[True, (batch[1:] != batch[:-1]) | (o[1:] - near[1:] != o[:-1] - near[:-1]) | (o[1:] > o[:-1] + LENGTH)]
    first, last = np.flatnonzero(head), np.flatnonzero(np.r_[head[1:], True])
    return np.column_stack([o[first], o[last] + LENGTH - o[first], batch[first], near[first]]).astype("<i8").tobytes()


def repeated_places(texts: DataFrame, shards: int, verify: bool, share: int = 0, rounds: int = 1, attempt: int = 0, bits: int = 64) -> DataFrame:
    """``p_id, p_h1, places, uid, runs``; ``places`` are runs.

    The first step takes ``texts(doc_id, h1, raw)``, the second the batches that :func:`lay` made. A text has a row for each
    batch that held a piece of it, and rows alike in id and text have rows each.
    """
    packed = texts.mapInArrow(emit(shards, verify, share, rounds, attempt, bits), "shard int, uid long, kind byte, blob binary")
    met = packed.groupBy("shard").applyInArrow(meet(NAME_BYTES[verify]), "uid long, kind byte, blob binary")
    return met.groupBy("uid").applyInArrow(resolve(verify), "p_id long, p_h1 long, places binary, uid long, runs binary")


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a batch's runs, for each batch of neighbours: what either is to digest."""
    for b in batches:
        rows = []
        for uid, share, runs in zip(b.column("uid").to_pylist(), b.column("share").to_pylist(), b.column("runs").to_pylist()):
            r = np.frombuffer(runs, dtype="<i8").reshape(-1, 4)
            r = r[np.argsort(r[:, 2], kind="stable")]
            edge = np.flatnonzero(np.r_[True, r[1:, 2] != r[:-1, 2]]) if len(r) else []
            for part in np.split(r, edge[1:]) if len(r) else []:
                other = int(part[0, 2])
                rows += [(uid, uid, other, share, part[:, [0, 1]].astype("<u4").tobytes()), (other, uid, other, share, part[:, [3, 1]].astype("<u4").tobytes())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["uid", "a", "b", "share", "spans"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for raw, asked in zip(b.column("raw"), b.column("asked").to_pylist()):
            view = memoryview(raw.as_buffer())
            for q in asked:
                h = hashlib.blake2b(digest_size=32)
                for at, n in np.frombuffer(q["spans"], dtype="<u4").reshape(-1, 2).tolist():
                    h.update(view[at : at + n])
                rows.append((q["a"], q["b"], q["share"], h.digest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["a", "b", "share", "digest"])


def collided(laid: DataFrame, runs: DataFrame) -> bool:
    """Whether any run's bytes are not those of its neighbours."""
    asked = runs.mapInArrow(_requests, "uid long, a long, b long, share int, spans binary")
    # no more than a batch has places
    asked = asked.groupBy("uid").agg(F.collect_list(F.struct("a", "b", "share", "spans")).alias("asked"))
    told = laid.select("uid", "raw").join(asked, "uid").mapInArrow(_digests, "a long, b long, share int, digest binary")
    return not told.groupBy("a", "b", "share").agg(F.count_distinct("digest").alias("n")).where("n > 1").isEmpty()


def repeats(laid: DataFrame, shards: int, first_bits: int = 64) -> tuple[DataFrame, int]:
    """Step 2 and 3: ``p_id, p_h1, places, ...`` of what :func:`lay` made, and how many tries it took.

    ``first_bits`` are the bits of either sum that count in the first try.
    """
    for attempt in range(TRIES):
        bits = 64 if attempt else first_bits
        found = [stage(repeated_places(laid, shards, True, k, ROUNDS, attempt, bits), "repeats") for k in range(ROUNDS)]
        runs = reduce(DataFrame.unionAll, [f.where("runs is not null").select("uid", "runs", F.lit(k).alias("share")) for k, f in enumerate(found)])
        if not collided(laid, runs):
            return reduce(DataFrame.unionAll, found).where("places is not null"), attempt + 1
    raise RuntimeError("names keep colliding")


def shards_for(places: float, verify: bool) -> int:
    """How many shards hold the names of so many places."""
    return int(max(LEAST_SHARDS, -(-places * (NAME_BYTES[verify] + 2) // SHARD_BYTES)))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [x[0] if len(x) == 1 else to_runs(np.unique(np.concatenate([from_runs(r) for r in x]))) for x in b.column("several").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("p_id"), b.column("p_h1"), pa.array(out, pa.binary())], names=["p_id", "p_h1", "places"])


def one_each(found: DataFrame) -> DataFrame:
    """Places by text, from rows of its pieces; rows alike in id and text have the same places and count once."""
    lists = found.groupBy("p_id", "p_h1").agg(F.collect_set("places").alias("several"))
    return lists.mapInArrow(_united, "p_id long, p_h1 long, places binary")


def _cut(raw: bytes, places: bytes) -> tuple[int, int, str]:
    """Removed bytes, removed runs and the digest of the rest."""
    p = from_runs(places)
    new = np.r_[True, p[1:] > p[:-1] + LENGTH]
    a, b = p[new], p[np.r_[new[1:], True]] + LENGTH
    h = hashlib.sha256()
    at = 0
    view = memoryview(raw)
    for x, y in zip(a.tolist(), b.tolist()):
        h.update(view[at:x])
        at = y
    h.update(view[at:])
    return int((b - a).sum()), len(a), h.hexdigest()


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [_cut(r, p) for r, p in zip(b.column("raw").to_pylist(), b.column("places").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("h1"), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.string())],
            names=["c_id", "c_h1", "n_removed", "n_spans", "kept_sha256"],
        )


def remove_repeats(docs: DataFrame, first_bits: int = 64) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every text; ``first_bits`` as for :func:`repeats`."""
    ship(docs.sparkSession)
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"), F.xxhash64(raw).alias("h1"), F.xxhash64(F.lit(1), raw).alias("h2"))
    slim = stage(d.select("doc_id", "h1", "h2", F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("sha")), "texts")
    copies = slim.where(F.col("n_bytes") >= LENGTH).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")).where("n > 1")
    copies = stage(copies.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "rep"), "copies")
    few = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    same = lambda df: (df["h1"] == few["k1"]) & (df["h2"] == few["k2"])
    total = slim.where(F.col("n_bytes") >= LENGTH).agg(F.sum("n_bytes")).first()[0] or 0
    shards = shards_for(total * len(COVER) / V, False)

    taking = d.where(F.octet_length("raw") >= LENGTH)
    taking = taking.join(few, same(taking), "left").where(F.col("rep").isNull() | (F.col("doc_id") == F.col("rep"))).select("doc_id", "h1", "raw")
    on = lambda a, b: a["doc_id"].eqNullSafe(b["p_id"]) & (a["h1"] == b["p_h1"])
    with handed(docs.sparkSession, HANDED):
        left = stage(one_each(repeated_places(taking, shards, False)), "left")
        remaining = stage(taking.join(left, on(taking, left)).select("doc_id", "h1", "raw", "places"), "remaining")
        laid = stage(remaining.mapInArrow(lay, "uid long, info binary, raw binary, places binary"), "laid")
        total = laid.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
        found, _ = repeats(laid, shards_for(total / ROUNDS, True), first_bits)
        found = stage(one_each(found), "repeats")
        text = remaining.drop("places").dropDuplicates(["doc_id", "h1"]) if _has_twins(remaining) else remaining.drop("places")
        cut = text.join(found, on(text, found)).select("doc_id", "h1", "raw", "places").mapInArrow(_cut_batches, "c_id long, c_h1 long, n_removed long, n_spans long, kept_sha256 string")
        cut = stage(cut, "cut")
    out = slim.join(few, same(slim), "left")
    out = out.join(cut, out["doc_id"].eqNullSafe(cut["c_id"]) & (out["h1"] == cut["c_h1"]), "left")
    whole = F.col("k1").isNotNull()
    return out.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def _has_twins(rows: DataFrame) -> bool:
    """Whether any two rows share id and text."""
    n, m = rows.select("doc_id", "h1").agg(F.count("*"), F.countDistinct(F.struct("doc_id", "h1"))).first()
    return n != m

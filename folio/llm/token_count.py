"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pre-tokens; for each, adjacent pairs wait in a heap by (rank, position) and symbols form a
linked list. Popping the lowest-ranked pair that still stands merges it. The count is the number of bytes less
the number of merges; no ids are made. Counts of pre-tokens are remembered in a bounded table.

Nulls count as empty texts with no tokens. Repeated rows are kept; empty input gives empty output. Extra
columns are not read. One pre-token of n bytes takes n log n steps, however long it is.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import ship

#: The byte-level pre-token pattern, with white space as Unicode defines it. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CACHE = 300_000
LIMIT = 512


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in a byte-level vocabulary: itself where printable, else 256 and up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own}
    out |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in out)}
    return [out[b] for b in range(256)]


class Counter(dict):
    """Pre-token -> number of tokens; missing ones are counted and remembered."""

    def __init__(self, path: str):
        super().__init__()
        spec = json.load(open(path, encoding="utf-8"))
        number = dict(spec["model"]["vocab"])
        self.pairs = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault((number[a], number[b]), (rank, number[a + b]))
        self.bytes = [number[s] for s in byte_symbols()]
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(map(regex.escape, self.special))).split if self.special else None

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self.merge(token.encode("utf-8", "surrogatepass"))
        self[token] = n
        return n

    def merge(self, raw: bytes) -> int:
        sym = [self.bytes[b] for b in raw]
        n = len(sym)
        if n < 2:
            return n
        pairs = self.pairs
        prev, succ = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(p[0], i, p[1], sym[i], sym[i + 1]) for i in range(n - 1) if (p := pairs.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = succ[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has been merged meanwhile
            sym[i], sym[j] = new, -1
            k = succ[i] = succ[j]
            left -= 1
            if k < n:
                prev[k] = i
                if p := pairs.get((new, sym[k])):
                    heapq.heappush(heap, (p[0], i, p[1], new, sym[k]))
            h = prev[i]
            if h >= 0 and (p := pairs.get((sym[h], new))):
                heapq.heappush(heap, (p[0], h, p[1], sym[h], new))
        return left

    def count(self, text: str) -> int:
        get, find = self.__getitem__, self.find
        if self.special and any(s in text for s in self.special):
            parts = self.cut(text)
            return len(parts) - 1 + sum(sum(map(get, find(p))) for p in parts)
        return sum(map(get, find(text)))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``; special strings inside a text count as one token each."""
    path = vocabulary or default_vocabulary()
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = [c.count(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

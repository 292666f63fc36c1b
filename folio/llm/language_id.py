"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary n-gram classifier (two multinomial models over hashed byte
trigrams, whose log-ratio is averaged over a text) predicts whether the text's language has it. Decoding takes
the codeword with the least loss, each bit weighed by how well its classifier does on held-back training texts.
The share of the best codeword among all, by loss, is the score; a text whose two best are close is ambiguous.

Learning uses at most ``TRAIN_ROWS`` labelled texts of each language, drawn by a hash of their ids. Trigrams are counted
and margins taken where the texts are; the driver sees one table of counts a language and a few numbers a text.

A null text, or one without a letter (Unicode category L), is ``und`` with score 0. Null labels are not learned from;
without labels every text is ``und``. Repeated rows are kept; empty input gives empty output. Extra columns are not
read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workers import ship
from .common import fold, stage

#: Texts of a language to learn from, at most.
TRAIN_ROWS = 500
BUCKETS = 1 << 14
AMBIGUOUS = 0.15
CHUNK = 1 << 19
LETTER = regex.compile(r"\p{L}").search


def codewords(n: int) -> np.ndarray:
    """A row of +1/-1 for each of ``n`` classes.

    Up to 5 classes: every way to part them in two, once. More: random words of 8 log2 n bits, the best of a few
    draws by least distance between rows.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        cols = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, dtype=float).T
    r = np.random.default_rng(0)
    bits = int(8 * np.ceil(np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        m = r.choice([1.0, -1.0], size=(n, bits))
        if (np.abs(m.sum(axis=0)) == n).any():
            continue
        d = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        if d > far:
            best, far = m, d
    return best


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that begins at each byte but the last two."""
    b = raw.astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return (h >> np.uint32(13)) & np.uint32(BUCKETS - 1)


def _bytes(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "surrogatepass") + b" "


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER(text) is not None


class Codes:
    """The learned code: languages, codewords, a weight per bucket and bit, a scale and a weight per bit."""

    def __init__(self, langs: list[str], words: np.ndarray, table: np.ndarray, scale: np.ndarray, trust: np.ndarray):
        self.langs, self.words, self.table, self.scale, self.trust = langs, words, table, scale, trust

    def margins(self, texts: list[str]) -> np.ndarray:
        """Each classifier's mean log-ratio over a text's trigrams, for every text."""
        out = np.zeros((len(texts), self.table.shape[1]))
        at = 0
        while at < len(texts):
            parts, size, first = [], 0, at
            while at < len(texts) and (not parts or size < CHUNK):
                parts.append(_bytes(texts[at]))
                size += len(parts[-1])
                at += 1
            raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
            length = np.array([len(p) for p in parts])
            start = np.cumsum(length) - length
            if len(parts) == 1:  # a long text: sum it up piece by piece
                total, n = 0.0, length[0] - 2
                for k in range(0, n, CHUNK):
                    total = total + self.table[trigrams(raw[k : min(n, k + CHUNK) + 2])].sum(axis=0, dtype=np.float64)
                out[first] = total / max(1, n)
                continue
            w = self.table[trigrams(raw)]
            # trigrams across two texts count for the earlier one unless taken out
            inner = np.ones(len(w), dtype=bool)
            for off in (1, 2):
                x = start[1:] - off
                inner[x[x < len(w)]] = False
            w *= inner[:, None]
            sums = np.add.reduceat(w, start, axis=0, dtype=np.float64)
            out[first:at] = sums / np.maximum(1, length - 2)[:, None]
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: the best language's number, its share, whether the second best is close."""
        f = margins * self.scale
        loss = (np.log1p(np.exp(-np.clip(f[:, None, :] * self.words[None, :, :], -30, 30))) * self.trust).sum(axis=2) / self.trust.sum()
        e = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * 8)
        share = e / e.sum(axis=1, keepdims=True)
        ranked = np.sort(share, axis=1)
        close = (ranked[:, -1] - ranked[:, -2] < AMBIGUOUS) if share.shape[1] > 1 else np.zeros(len(share), dtype=bool)
        return share.argmax(axis=1), share.max(axis=1), close

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        ok = [bool(self.langs) and has_letter(t) for t in texts]
        langs, scores, close = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        where = [i for i, x in enumerate(ok) if x]
        if where:
            best, share, near = self.decode(self.margins([texts[i] for i in where]))
            for i, b, s, n in zip(where, best.tolist(), share.tolist(), near.tolist()):
                langs[i], scores[i], close[i] = self.langs[b], s, n
        return langs, scores, close


def count(text: str) -> np.ndarray:
    """How often a text has the trigrams of each bucket."""
    raw = np.frombuffer(_bytes(text), dtype=np.uint8)
    n = max(0, len(raw) - 2)
    return sum((np.bincount(trigrams(raw[k : min(n, k + CHUNK) + 2]), minlength=BUCKETS) for k in range(0, n, CHUNK)), np.zeros(BUCKETS, dtype=np.int64))


def coded(names: list[str], counts: np.ndarray) -> Codes:
    """Classifiers for every bit from ``counts[language, bucket]``; all bits are trusted alike."""
    words = codewords(len(names))
    p = counts + 0.2
    p = p / p.sum(axis=1, keepdims=True)
    table = np.zeros((BUCKETS, words.shape[1]), dtype=np.float32)
    for b in range(words.shape[1]):
        up, down = p[words[:, b] > 0], p[words[:, b] < 0]
        if len(up) and len(down):
            table[:, b] = np.log(up.mean(axis=0)) - np.log(down.mean(axis=0))
    return Codes(names, words, table, np.ones(words.shape[1]), np.ones(words.shape[1]))


def trusted(codes: Codes, margins: np.ndarray, y: np.ndarray) -> Codes:
    """``codes`` with scales and weights of bits from margins of texts that the classifiers had not learned from."""
    if len(codes.langs) > 1 and len(y):
        codes.scale = 3.0 / np.maximum(1e-6, np.abs(margins).mean(axis=0))
        codes.trust = np.maximum(0.02, 2 * ((margins > 0) == (codes.words[y] > 0)).mean(axis=0) - 1)
    return codes


def nothing() -> Codes:
    return Codes([], np.ones((0, 1)), np.zeros((BUCKETS, 1), dtype=np.float32), np.ones(1), np.ones(1))


def learn(texts: list[str], langs: list[str]) -> Codes:
    names = sorted(set(langs))
    if not names:
        return nothing()
    y = np.array([names.index(x) for x in langs])
    counts = np.zeros((2, len(names), BUCKETS))  # the two halves of the sample
    for k, t in enumerate(texts):
        counts[k % 2, y[k]] += count(t)
    margins = np.zeros((len(texts), codewords(len(names)).shape[1]))
    for part in (0, 1):
        idx = list(range(part, len(texts), 2))
        margins[idx] = coded(names, counts[1 - part]).margins([texts[k] for k in idx])
    return trusted(coded(names, counts.sum(axis=0)), margins, y)


def training_rows(docs: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """``text, lang, half``: of each language at most ``bound`` labelled texts with a letter whose fold of 3 is not 1."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    d = d.where("lang is not null").where(F.col("text").rlike(r"\p{L}")).where(~F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)))
    h = F.xxhash64(F.lit("sample"), F.col("doc_id"), F.col("lang"))
    nth = lambda *order: F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    slim = d.select("doc_id", "lang").withColumn("nth", nth(h, "doc_id")).where(F.col("nth") <= bound).select(F.col("doc_id").alias("c_id"), F.col("lang").alias("c_lang")).distinct()
    chosen = F.broadcast(stage(slim, "drawn"))  # ``bound`` rows a language
    rows = d.join(chosen, d["doc_id"].eqNullSafe(chosen["c_id"]) & (d["lang"] == chosen["c_lang"]), "left_semi")
    # rows that share an id count one by one
    rows = rows.withColumn("nth", nth(h, "doc_id", F.xxhash64("text"))).where(F.col("nth") <= bound)
    return stage(rows.select("text", "lang", (F.col("nth") % 2).cast("int").alias("half")), "training")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for b in batches:
        for t, lang, half in zip(b.column("text"), b.column("lang").to_pylist(), b.column("half").to_pylist()):
            held[lang, half] = held.get((lang, half), 0) + count(t.as_py())
    for (lang, half), c in held.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang], "half": pa.array([half], pa.int32()), "counts": [c.astype("<i8").tobytes()]})


def _added(table: pa.Table) -> pa.Table:
    c = sum(np.frombuffer(x, dtype="<i8") for x in table.column("counts").to_pylist())
    return pa.table({"lang": table.column("lang").slice(0, 1), "half": table.column("half").slice(0, 1), "counts": pa.array([c.tobytes()], pa.binary())})


def fit(docs: DataFrame, bound: int = TRAIN_ROWS) -> Codes:
    """Learn from labelled texts whose fold of 3 is not 1."""
    ship(docs.sparkSession)
    rows = training_rows(docs, bound)
    schema = "lang string, half int, counts binary"
    found = rows.mapInArrow(_counted, schema).groupBy("lang", "half").applyInArrow(_added, schema).collect()
    names = sorted({r.lang for r in found})
    if not names:
        return nothing()
    counts = np.zeros((2, len(names), BUCKETS))
    for r in found:
        counts[r.half, names.index(r.lang)] = np.frombuffer(r.counts, dtype="<i8")
    others = [coded(names, counts[1 - half]) for half in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = [others[half].margins([t.as_py()])[0].tolist() for t, half in zip(b.column("text"), b.column("half").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(m, pa.list_(pa.float64()))], names=["lang", "m"])

    got = sorted((r.lang, list(r.m)) for r in rows.mapInArrow(run, "lang string, m array<double>").collect())
    return trusted(coded(names, counts.sum(axis=0)), np.array([m for _, m in got]), np.array([names.index(x) for x, _ in got]))


def predict(docs: DataFrame, codes: Codes) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                c = b.slice(at, 1024)
                langs, scores, close = codes.predict(c.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(close, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")

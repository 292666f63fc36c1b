"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where no piece can cross: before a run of spaces that follows something else, and around
characters that no longer piece contains. Every distinct word of a batch is encoded once: all words lie in one flat
symbol array, a round looks up the rank of each neighbouring pair, takes each word's best, merges all
its leftmost occurrences at once and compacts the array, until no pair is left. Two kinds of rank merge
only their leftmost occurrence in a round, as the one-at-a-time order would show: ranks that different
pieces share, and pieces that could at once be part of a better-ranked one.

Nulls count as empty texts. Repeated rows are kept; empty input gives empty output. Extra columns are not
read. Long texts are handled whole: memory grows with one text, never with a batch's number of rows.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import ship

SPACE = "▁"
UNKNOWN, BEGIN, END = 0, 1, 2
CACHE = 200_000
codecs.register_error("folio-one-byte", lambda e: ("�", e.start + 1))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Tables of a BPE model with byte fallback, built from its vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.symbol = {self.pieces[i]: i for i in plain}
        score = {i: sp.get_score(i) for i in plain}
        chars = {c for i in plain for c in self.pieces[i]}
        #: single characters that only occur inside pieces get numbers above the vocabulary
        for c in sorted(chars - self.symbol.keys()):
            self.symbol[c] = n + len(self.symbol)
        self.width = n + len(self.symbol) + 2
        self.loose = self.width - 1  # stands for any character that no piece contains
        order = sorted(plain, key=lambda i: -score[i])
        rank, tied, at = {}, set(), -1
        for k, i in enumerate(order):
            if k == 0 or score[i] != score[order[k - 1]]:
                at += 1
            else:
                tied.add(at)
            rank[i] = at
        keys, ranks, merged, single = [], [], [], set(tied)
        for i in plain:
            p = self.pieces[i]
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is None or b is None:
                    continue
                keys.append(a * self.width + b)
                ranks.append(rank[i])
                merged.append(i)
                single |= {rank[x] for x in (a, b) if x in rank and rank[x] > rank[i] and len(self.pieces[x]) > 1}
        by = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[by]
        self.ranks = np.array(ranks, dtype=np.int64)[by]
        self.merged = np.array(merged, dtype=np.int64)[by]
        self.single = np.zeros(at + 2, dtype=bool)
        self.single[list(single)] = True
        self.none = at + 1
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.symbol)
        joins = {c for p in self.symbol if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\t\r|" if c not in joins)
        self.cut = re.compile(r"(?s).+" if crossing else f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        self.texts = [b""] * n
        for i in plain:
            self.texts[i] = self.pieces[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_id):
            self.texts[i] = bytes([b])
        self.texts[UNKNOWN] = " ⁇ ".encode()

    # -- merge rounds

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each word."""
        get, loose = self.symbol.get, self.loose
        text = "".join(words)
        sym = np.fromiter((get(c, loose) for c in text), dtype=np.int64, count=len(text))
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        word = np.repeat(np.arange(len(words)), length)
        char = np.arange(len(text))  # of each symbol, its first character
        done_sym, done_word, done_char = [], [], []
        while len(sym):
            key = sym[:-1] * self.width + sym[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            ok = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.full(len(sym), self.none, dtype=np.int64)
            rank[:-1][ok] = self.ranks[at[ok]]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            of = np.cumsum(np.r_[False, word[1:] != word[:-1]])
            active = best < self.none
            if not active.all():
                keep = active[of]
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
                done_char.append(char[~keep])
                if not keep.any():
                    break
                at_full = np.zeros(len(sym), dtype=np.int64)
                at_full[:-1] = at
                sym, word, char, rank, at = sym[keep], word[keep], char[keep], rank[keep], at_full[keep]
                of = np.cumsum(np.r_[False, word[1:] != word[:-1]])
                best = best[active]
            hit = np.flatnonzero(rank == best[of])
            # overlapping hits stand next to each other: of each such run take the 1st, 3rd, ...
            fresh = np.r_[True, (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])]
            begin = np.maximum.accumulate(np.where(fresh, hit, 0))
            take = (hit - begin) % 2 == 0
            only = self.single[rank[hit]]
            if only.any():
                lead = np.r_[True, of[hit[1:]] != of[hit[:-1]]]
                take &= ~only | lead
            hit = hit[take]
            sym[hit] = self.merged[at[hit]]
            gone = np.ones(len(sym), dtype=bool)
            gone[hit + 1] = False
            sym, word, char = sym[gone], word[gone], char[gone]
        if done_sym:
            sym, word, char = np.concatenate(done_sym), np.concatenate(done_word), np.concatenate(done_char)
            by = np.argsort(char, kind="stable")
            sym, word, char = sym[by], word[by], char[by]
        count = np.ones(len(sym), dtype=np.int64)
        out = sym
        odd = np.flatnonzero(sym >= len(self.pieces))
        if len(odd):  # characters without a piece: their UTF-8 bytes
            raw = [text[c].encode("utf-8", "surrogatepass") for c in char[odd].tolist()]
            count[odd] = [len(r) for r in raw]
            out = np.repeat(sym, count)
            start = np.cumsum(count) - count
            where = np.repeat(start[odd], count[odd]) + np.concatenate([np.arange(len(r)) for r in raw])
            out[where] = np.array(self.byte_id)[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        return out.astype(np.uint32), np.bincount(word, weights=count, minlength=len(words)).astype(np.int64)

    # -- texts

    def split(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def decode(self, ids) -> str:
        t = self.texts
        s = b"".join([t[i] for i in ids]).decode("utf-8", "folio-one-byte")
        return s[1:] if s.startswith(" ") else s


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


class Encoder:
    """Encodes texts and remembers words; the memory is emptied when it holds ``CACHE`` words."""

    def __init__(self, m: PieceModel):
        self.m = m
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.uint32)
        self.start = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)

    def learn(self, segments: list[str]) -> None:
        new = list({s for s in segments if s not in self.index})
        if not new:
            return
        flat, count = self.m.encode_words(new)
        base = len(self.index)
        self.index.update(zip(new, range(base, base + len(new))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, flat])

    def ids(self, segments: list[str]) -> np.ndarray:
        """Ids of a text whose segments were learned, with begin and end."""
        at = np.fromiter(map(self.index.__getitem__, segments), dtype=np.int64, count=len(segments))
        count = self.count[at]
        n = int(count.sum())
        out = np.empty(n + 2, dtype="<u4")
        out[0], out[-1] = BEGIN, END
        if n:
            shift = self.start[at] - (np.cumsum(count) - count)
            out[1:-1] = self.flat[np.repeat(shift, count) + np.arange(n)]
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text; words are learned for about a megabyte of text at a time."""
        at = 0
        while at < len(texts):
            chunk, size = [], 0
            while at < len(texts) and (not chunk or size + len(texts[at]) <= 1 << 20):
                chunk.append(self.m.split(texts[at]))
                size += len(texts[at])
                at += 1
            if len(self.index) > CACHE:
                self.clear()
            self.learn([s for x in chunk for s in x])
            for x in chunk:
                yield self.ids(x)


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        e = Encoder(m)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                n, a, d = [], [], []
                for ids in e.encode([t or "" for t in c.column("text").to_pylist()]):
                    n.append(len(ids))
                    a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    d.append(hashlib.sha256(m.decode(ids.tolist()).encode("utf-8", "surrogatepass")).hexdigest())
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(model(path))
        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                ids = list(e.encode([t or "" for t in c.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _slim(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id, ids`` with begin and end ids."""
    return _slim(docs).mapInArrow(_encoded(model_path or default_model()), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids give a null text."""
    path = model_path or default_model()
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if x is None else m.decode(x) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, then decode what was encoded."""
    return _slim(docs).mapInArrow(_digests(model_path or default_model()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Removal of repeated bytes against a plain table of all 200-byte strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from folio.llm import repeat_bytes as rb


def plain(texts: list[str]) -> list[tuple]:
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + rb.LENGTH] for r in raws for i in range(len(r) - rb.LENGTH + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - rb.LENGTH + 1):
            if seen[r[i : i + rb.LENGTH]] > 1:
                gone[i : i + rb.LENGTH] = True
        g = gone[:-1]
        spans = int((np.diff(np.r_[0, g.astype(int)]) == 1).sum())
        out.append((len(r), int(g.sum()), spans, hashlib.sha256(bytes(np.frombuffer(r, dtype=np.uint8)[~g])).hexdigest()))
    return out


def run(spark, texts, parts=5):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    got = {r.doc_id: tuple(r)[1:] for r in rb.remove_repeats(docs).collect()}
    return [got[i] for i in range(len(texts))]


def test_cover():
    d = rb.COVER
    assert {(a - b) % rb.V for a in d for b in d if a != b} == set(range(1, rb.V))


def test_made_up_texts(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(2, 7)))
    some = lambda n: " ".join(word() for _ in range(n))
    passage = [some(60), some(45), some(100)]
    texts = [None, "", "x" * 199, "y" * 200, "z" * 201, "z" * 500, "ab" * 400, some(3000)]
    for k in range(40):
        texts.append(some(r.randrange(1, 200)) + " " + r.choice(passage) + " " + some(r.randrange(1, 80)) + r.choice(["", r.choice(passage)]))
    base = some(300).split()
    for k in range(12):  # near copies
        w = list(base)
        for _ in range(k):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [texts[10], texts[10], texts[50]]  # copies
    for n in range(195, 206):  # shared strings about as long as the limit
        s = some(80)[:n]
        texts += [some(20) + s + "#", some(31) + "|" + s]
    assert run(spark, texts) == plain(texts)


def test_table(spark):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    assert run(spark, texts, 3) == plain(texts)


def test_repeated_rows_nulls_and_nothing(spark):
    docs = spark.createDataFrame([(1, "q" * 150 + "r" * 150, 9)] * 2 + [(None, "s" * 10, 9)], "doc_id long, text string, n_bytes int")
    got = sorted(map(tuple, rb.remove_repeats(docs).collect()), key=str)
    assert [x[:4] for x in got] == [(1, 300, 300, 1)] * 2 + [(None, 10, 0, 0)]
    assert rb.remove_repeats(docs.limit(0)).count() == 0


def test_long_texts_go_in_pieces(spark):
    r = random.Random(9)
    line = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = line(700)
    # longer than a piece, repeats across the edges of pieces and inside one text
    edge = rb.PIECE
    long = line(edge - 400) + shared + line(edge) + shared[:350] + line(50)
    texts = [long, line(300) + shared[100:420], line(2000), line(150) * 3]
    assert run(spark, texts, 2) == plain(texts)


def test_names_that_collide_make_no_repeat():
    raw = np.frombuffer(random.Random(1).randbytes(4000), dtype=np.uint8)
    pos = np.array([0, 500, 900, 2000, 2001], dtype=np.int32)
    by, every = np.arange(5), np.ones(4, dtype=bool)
    assert not rb._alike(raw, pos, by, every, rb.LENGTH).any()
    twice = np.r_[raw[:600], raw[:600]]
    assert rb._alike(twice, np.array([0, 600, 100, 700], dtype=np.int32), np.arange(4), np.array([True, False, True]), rb.LENGTH).tolist() == [True, False, True]
    first = np.array([[7, 1], [7, 2], [7, 3], [7, 2], [8, 5], [8, 5]], dtype=np.uint64)
    hit, near = rb._shared(first, np.array([0, 0, 1, 1, 2, 2]))
    assert hit.tolist() == [1, 3] and near.tolist() == [3, 1]


def test_names_that_collide_are_drawn_again(spark):
    """Names of six bits say that nearly everything repeats; the comparison of bytes does not."""
    r = random.Random(11)
    line = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    # every text shares 68 bytes at least with another, so that all are looked at
    shared = line(120)
    texts = [line(150) + shared + line(300) for _ in range(12)] + [line(40) + "x" * 10 + shared + line(250)]
    texts += [texts[0][100:420] + line(30), "q" + texts[1][:250]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {x.doc_id: tuple(x)[1:] for x in rb.remove_repeats(docs, first_bits=6).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)
    rows = [(i, i, t.encode(), rb.to_runs(np.arange(len(t) - 67))) for i, t in enumerate(texts)]
    laid = spark.createDataFrame(rows, "doc_id long, h1 long, raw binary, places binary").repartition(6).mapInArrow(rb.lay, "uid long, info binary, raw binary, places binary")
    assert [rb.repeats(laid, 4, bits)[1] for bits in (6, 64)] == [2, 1]


def test_positions():
    # the pieces of three texts of 300, 900 and 50 places, the second in two pieces
    texts = {0: (0, 300), 1: (0, 500), 2: (500, 400), 3: (0, 50)}
    at, count = (np.array(x) for x in zip(*texts.values()))
    start = np.cumsum(count + 199) - (count + 199)
    left = [[0, 5, 1], [0, 140, 2], [1, 490, 20], [1, 700, 1], [2, 490, 20], [2, 700, 1], [2, 1400, 3]]
    got = rb.merged(np.array(left), start, at, count).tolist()
    want = [start[k] + p - at[k] for k in texts for p in range(at[k], at[k] + count[k]) if any(g == k and f - rb.V < p < f + n for g, f, n in left)]
    assert got == want
    assert rb.sampled(start, at, count).tolist() == [start[k] + p - at[k] for k in texts for p in range(at[k], at[k] + count[k]) if p % rb.V in rb.COVER]
    assert not len(rb.merged(np.zeros((0, 3), dtype=int), start, at, count))

"""Both tokenizers against their libraries, on the tables' texts and on made-up ones."""

import random

import pyarrow.parquet as pq
import pytest

from folio.llm import piece_bpe, token_count

TEXTS = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
ODD = ["", " ", "  lead", "trail  ", "a\x00b\x01", "▁x ▁", "　xＡ é", "tab\tnew\n\n  line\r\n", "😀😀 zero​width", "aaaaaaa aaaa", "'s't've IT'S", "<s></s><unk><0x41>", "<|endoftext|>a<|endoftext|>", "x" * 3000, "\x1c\x1f\x85\xa0 a", "1234567 ٣٤ ½²"] + [" " * k + "w" for k in range(1, 45)]


def fuzz(n: int, seed: int = 7) -> list[str]:
    r = random.Random(seed)
    pools = ["abcdefgh ", "the inrs  ", "éàüß ñ¿", "\n\t \x0b|", "漢字かな 😀", "0123456789.,", "ABC'sdtlvrem "]
    return ["".join(r.choice(r.choice(pools)) for _ in range(r.randrange(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())


def test_pieces_as_the_library(library):
    texts = TEXTS + ODD + fuzz(3000)
    e = piece_bpe.Encoder(piece_bpe.model(piece_bpe.default_model()))
    for t, ids in zip(texts, e.encode(texts)):
        want = library.encode(t, add_bos=True, add_eos=True)
        assert ids.tolist() == want, t
        assert e.m.decode(want) == library.decode(want), t


def test_decode_of_any_ids(library):
    r = random.Random(3)
    m = piece_bpe.model(piece_bpe.default_model())
    for _ in range(500):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259)]) for _ in range(r.randrange(12))]
        assert m.decode(ids) == library.decode(ids)


def test_counts_as_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_count.default_vocabulary())
    c = token_count.Counter(token_count.default_vocabulary())
    for x in TEXTS + ODD + fuzz(3000):
        assert c.count(x) == len(t.encode(x, add_special_tokens=False).ids), x


def test_frames(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, token_count.token_counts(docs).collect()))
    assert got == [(1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (3, 3, 2, False)]
    assert sorted(r.n_tokens for r in piece_bpe.digests(docs).collect()) == [2, 2, 2, 4]
    back = piece_bpe.decode(piece_bpe.encode(docs))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(1, ""), (2, ""), (2, ""), (3, "a b")]
    assert piece_bpe.digests(docs.limit(0)).count() == token_count.token_counts(docs.limit(0)).count() == 0

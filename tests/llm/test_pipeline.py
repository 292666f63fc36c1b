"""The pipeline's stages against plain versions, each on what the one before kept."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
from folio.llm import piece_bpe, toxicity
from folio.llm.common import documents, stage
from tests.llm.test_corpus_operators import plain_ball, plain_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = documents(spark, SF)
    kept = [docs]
    for _, f in corpus_pipeline.STAGES:
        kept.append(stage(f(spark, kept[-1], SF)))
    assert all(d.columns == docs.columns for d in kept[:-1])
    rows = [sorted((tuple(r) for r in d.collect()), key=str) for d in kept]
    grammar = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert rows[1] == [r for r in rows[0] if grammar.score(r[1]) < 0.5]

    sites, first = {}, {}
    for i, t, _, s, _ in sorted(rows[1]):
        for p, line in enumerate(t.split("\n")):
            k = line.strip(" \t\r")
            if k:
                sites.setdefault(k, set()).add(s)
                first.setdefault(k, (i, p))
    cut = lambda i, t: "\n".join(x for p, x in enumerate(t.split("\n")) if len(sites.get(k := x.strip(" \t\r"), ())) < 10 or first[k] == (i, p))
    want = sorted(((i, cut(i, t), lang, s, len(cut(i, t))) for i, t, lang, s, _ in rows[1]), key=str)
    assert rows[2] == want

    keep = set(plain_components({r[0]: plain_ball(r[1]) for r in rows[2]}).values())
    assert rows[3] == [r for r in rows[2] if r[0] in keep]

    size = Counter()
    for r in rows[3]:
        size[r[3]] += len(WORD.findall(r[1]))
    taken, per = Counter(), Counter()
    for r in rows[4]:
        taken[r[3]] += len(WORD.findall(r[1]))
        per[r[0]] += 1
    assert abs(sum(taken.values()) - sum(size.values())) < 0.02 * sum(size.values()) and max(per.values()) <= 3
    texts = {r[0]: r[1] for r in rows[3]}
    whole = sum(r[1] == texts[r[0]] for r in rows[4])
    assert len(rows[4]) - whole <= 3 * len(size)

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())
    out = []
    for i, t, *_ in rows[4]:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        out.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert rows[5] == sorted(out, key=str)

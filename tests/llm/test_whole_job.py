"""Cases in which an operator or stage once did less than the whole job."""

from collections import Counter

import pytest
import xxhash

import corpus_pipeline
from folio.llm import line_dedup, mixing, simhash_ball

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """Rows of ``(doc_id, text, lang, source)``."""
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], SCHEMA)


# --- op9 and the near-dedup stage


def test_shingle_and_radius_are_parameters(spark):
    words = [f"w{k}" for k in range(300)]
    r = [(k, " ".join([*words[:at], *[f"new{k}x{j}" for j in range(k)], *words[at + k :]])) for k, at in enumerate(range(0, 120, 6))]
    d = spark.createDataFrame(r, "doc_id long, text string")

    def plain(text):
        w = text.encode().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 5]), 42) for i in range(len(w) - 4)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {i: plain(t) for i, t in r}
    assert {x.doc_id: x.fp & (2**64 - 1) for x in simhash_ball.fingerprints(d, 5).collect()} == fps
    kept = {}
    for half in (1, 3):
        root = {i: i for i in fps}
        for _ in fps:
            for a in fps:
                for b in fps:
                    if (fps[a] ^ fps[b]).bit_count() <= 2 * half:
                        root[a] = root[b] = min(root[a], root[b])
        kept[half] = {x.doc_id for x in simhash_ball.keep_one(d, 5, half).collect()}
        assert kept[half] == set(root.values())
    assert kept[1] != kept[3]


def far_apart(k):
    return " ".join(f"w{k}x{j}" for j in range(40))


def test_rows_without_an_id_or_with_a_shared_one_stay(spark):
    rows = [(None, far_apart(k), "en", "s") for k in range(6)] + [(7, far_apart(k), "en", "s") for k in range(10, 13)]
    rows += [(None, far_apart(0), "fr", "s"), (8, far_apart(1), "en", "s"), (9, far_apart(20), "en", "s"), (9, far_apart(20), "en", "s")]
    d = table(spark, rows)
    kept = simhash_ball.keep_one(d)
    assert kept.columns == d.columns
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    want = [(0, far_apart(k)) for k in (0, 2, 3, 4, 5)] + [(7, far_apart(k)) for k in (10, 11, 12)] + [(8, far_apart(1)), (9, far_apart(20))]
    assert got == sorted(want)
    ids = {(r.doc_id, r.component_id) for r in simhash_ball.classes(simhash_ball.fingerprints(d)).collect()}
    assert ids == {(None, None), (None, 8), (7, 7), (8, 8), (9, 9)}


# --- op4 and the line dedup stage


def test_lines_go_only_where_they_are_boilerplate(spark):
    common = [(k, f"shared line\nown {k}", "en", f"s{k}") for k in range(12)]
    rows = common + [(None, f"first {k}\nsecond {k}", "en", "s") for k in range(5)] + [(None, "shared line\nmine", "en", "s"), (3, "clean\nlines", "en", "s")]
    got = sorted(r.text for r in line_dedup.remove_boilerplate(table(spark, rows)).collect())
    want = ["shared line\nown 0", *[f"own {k}" for k in range(1, 12)], *[f"first {k}\nsecond {k}" for k in range(5)], "mine", "clean\nlines"]
    assert got == sorted(want)
    none = table(spark, [(None, t, lang, s) for _, t, lang, s in common])
    texts = [r.text for r in line_dedup.remove_boilerplate(none).collect()]
    assert sum(t.startswith("shared line\n") for t in texts) == 1 and len(texts) == 12
    assert sorted(r.n_removed for r in line_dedup.report(none).collect()) == [0] + [1] * 11


# --- op2 and the mixing stage


@pytest.mark.parametrize("slots", [1 << 20, 64])
def test_every_source_gets_its_target(spark, monkeypatch, slots):
    monkeypatch.setattr(mixing, "SLOTS", slots)
    rows = [(k, " ".join(f"w{j}" for j in range(400)), "en", "big") for k in range(30)]
    rows += [(1000 + 3 * k + i, " ".join(f"v{j}" for j in range(1 + (k + i) % 9)), "en", f"small{k}") for k in range(60) for i in range(3)]
    d = table(spark, rows)
    sizes = spark.createDataFrame([(s, len(t.split())) for _, t, _, s in rows], "source string, size long")
    want = {r.source: int(r.target) for r in mixing.plan_sources(sizes).collect()}
    got, per = Counter(), Counter()
    for r in corpus_pipeline.mix_sources(spark, d, "").collect():
        got[r.source] += len(r.text.split())
        per[r.doc_id] += 1
    assert got == want and len(got) == 61 and max(per.values()) <= 3
    taken = Counter()
    for r in mixing.mix(d, exact=True).collect():
        assert r.taken == sum(c["to"] - c["from"] for c in r.copies) <= 3 * r["size"]
        taken[r.source] += r.taken
    assert taken == want

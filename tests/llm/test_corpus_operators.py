"""The corpus operators against plain versions, on the tables and on odd rows."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folio.llm import components, doc_simhash, language_id, line_dedup, mixing, quality_rules, queries, simhash_ball, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return sorted(docs.collect(), key=lambda r: r.doc_id)


def odd(spark, more=()):
    """Nulls, empty and repeated rows, a long text, ties."""
    long = "lorem ipsum dolor sit amet " * 20_000
    r = [(1, None, None, None), (2, "", "en", "s1"), (2, "", "en", "s1"), (3, "a b c", "en", "s1"), (3, "a b c", "en", "s1"), (None, "x y", "fr", None), (4, long, "en", "s2"), (5, " \n\t\n", "de", "s2"), *more]
    return spark.createDataFrame([(a, b, c, d, len(b) if b is not None else None) for a, b, c, d in r], SCHEMA).withColumn("size", F.lit("clash")).withColumn("fp", F.lit("clash"))


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    a, b = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    for c in a.columns:
        assert a.sort_values("doc_id")[c].tolist() == b.sort_values("doc_id")[c].tolist(), c


# --- op1


def test_language(spark, docs):
    codes = language_id.fit(docs)
    got = language_id.predict(docs, codes).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    o = language_id.predict(odd(spark, [(9, "12 34 !", "en", "s")]), codes).collect()
    assert len(o) == 9 and {r.lang_pred for r in o if r.doc_id in (1, 2, 5, 9)} == {"und"}
    assert language_id.predict(docs.limit(0), codes).count() == 0
    none = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.predict(docs.limit(3), none).collect()} == {"und"}


def test_language_margins_do_not_depend_on_neighbours(rows):
    texts = [r.text for r in rows[:40]]
    c = language_id.learn(texts, [r.lang for r in rows[:40]])
    alone = np.vstack([c.margins([t]) for t in texts])
    assert np.allclose(alone, c.margins(texts), atol=1e-4)
    assert language_id.codewords(4).shape == (4, 7) and language_id.codewords(20).shape[0] == 20


# --- op2


def test_mixing(spark, docs, rows):
    got = mixing.mix(docs).collect()
    size = {r.doc_id: len(WORD.findall(r.text)) for r in rows}
    by: dict = {}
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"]
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    total = sum(size.values())
    assert abs(sum(v[0] for v in by.values()) - total) < 1e-6 * total
    assert all(abs(v[1] - v[0]) <= 5 * max(16, total / mixing.SLOTS) for v in by.values())
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    m = mixing.mixed_documents(docs)
    assert m.columns == docs.columns
    words = Counter()
    for r in m.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == Counter({r.doc_id: r.taken for r in got if r.taken})


def test_mixing_odd(spark):
    o = odd(spark)
    got = mixing.mix(o).collect()
    assert len(got) == 8 and sum(r.taken for r in got) > 0 and all(r.taken <= 3 * r["size"] for r in got)
    kept = mixing.mixed_documents(o.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")))
    assert sum(len(WORD.findall(r.text)) for r in kept.collect()) == sum(r.taken for r in got)
    assert mixing.mix(o.limit(0)).count() == 0


def test_targets(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, size long")
    p = {r.source: r for r in mixing.plan_sources(s).collect()}
    assert [p[k].weight for k in ("a", "b", "c", None)] == [5, 2, 1, 5]
    assert p["a"].target == 30 and p[None].target == 15 and abs(p["b"].target - 2 * p["c"].target) < 1e-9
    assert abs(sum(r.target for r in p.values()) - 2015) < 1e-9


# --- op3


def test_toxicity_grammar():
    rng = np.random.default_rng(1)
    plain = lambda: " ".join(rng.choice("sun moon tree river stone cloud wind leaf road hill bird fish".split(), 9))
    clean, toxic = [plain() for _ in range(120)], [f"{plain()} {w} {plain()} {w}" for w in ("idiot", "grumpfling") for _ in range(20)]
    g = toxicity.learn(clean + toxic, [0] * 120 + [1] * 40)
    assert g.score("sun you idiot moon") > 0.5 > g.score("moon river tree") and g.score("grumpfling tree grumpflings") > 0.5
    assert g.score(None) == g.score("") == g.score("  ") and 0 <= g.score("idiot " * 50_000) <= 1
    f = lambda t: toxicity.features(g.lexicon.classes(t))
    names = [n for n, _ in toxicity.PATTERNS]
    assert f("they said idiot")[names.index("reported")] > 0 and f("not an idiot")[names.index("negated")] > 0
    assert f("i will kill you")[names.index("threat")] > 0 and f("i will. you see")[names.index("threat")] == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    pos, neg = [r.score for r in got if r.toxic and r.held_out], [r.score for r in got if not r.toxic and r.held_out]
    assert np.mean([np.mean(p > np.array(neg)) + 0.5 * np.mean(p == np.array(neg)) for p in pos]) > 0.75
    assert np.mean(np.array(neg) >= 0.5) < 0.05


def test_toxicity_odd(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    g = toxicity.fit(docs, labels.withColumn("toxic", F.lit(None).cast("int")))
    o = odd(spark)
    assert toxicity.score(o, g).count() == 8 and toxicity.reject(o, g).columns == o.columns
    assert toxicity.fit(docs.limit(0), labels).score("x") >= 0


# --- op4


def test_line_dedup_odd(spark):
    more = [(100 + k, f"shared line\nown {k}\n shared line ", "en", f"s{k}") for k in range(12)]
    o = odd(spark, more)
    got = {r.doc_id: r for r in line_dedup.report(o).collect()}
    assert got[100].n_removed == 1 and all(got[100 + k].n_removed == 2 for k in range(1, 12))
    assert got[101].kept_sha256 == hashlib.sha256(b"own 1").hexdigest()
    out = line_dedup.remove_boilerplate(o)
    assert out.columns == o.columns and out.count() == 20
    r = {x.doc_id: x for x in out.collect()}
    assert r[105].text == "own 5" and r[105].n_chars == 5 and r[1].text is None
    nine = line_dedup.report(o.where("doc_id < 109 and doc_id >= 100"))
    assert {x.n_removed for x in nine.collect()} == {0}
    assert line_dedup.report(o.limit(0)).count() == 0


# --- op6


def spark_hash(*words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h


def plain_fingerprint(text):
    w = WORD.findall(text or "")
    h = [] if not w else [spark_hash(" ".join(w))] if len(w) < 5 else [spark_hash(*w[i : i + 5]) for i in range(len(w) - 4)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check_edited(got, ordered_rows):
    n = len(ordered_rows)
    for k, (i, t) in enumerate(ordered_rows):
        t, nxt = t or "", ordered_rows[(k + 1) % n][1] or ""
        cut = len(t) // 4
        e = t[: len(t) - cut] + nxt[:cut]
        r = got.pop((i, hashlib.sha256(e.encode()).hexdigest()))
        assert (r.n_chars, int(r.fingerprint, 16), int(r.edited_fingerprint, 16)) == (len(t), plain_fingerprint(t), plain_fingerprint(e))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_fingerprints(docs, rows):
    got = {(r.doc_id, r.edited_sha256): r for r in doc_simhash.edited_report(docs).collect()}
    check_edited(got, [(r.doc_id, r.text) for r in rows])


def test_fingerprints_of_sparse_and_repeated_ids(spark):
    rows = [(10**15, "far away text of some length here"), (None, "no id at all"), (5, "five words are in here now"), (5, "five words are in here now"), (5, ""), (7, None)]
    o = spark.createDataFrame(rows, "doc_id long, text string")
    got = doc_simhash.edited_report(o).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in got) == sorted((i is not None, i or 0, len(t or "")) for i, t in rows)
    assert doc_simhash.edited_report(o.limit(0)).count() == 0
    one = doc_simhash.edited_report(o.where("doc_id = 7")).collect()
    assert [(r.n_chars, r.fingerprint, r.near_next) for r in one] == [(0, "0" * 16, 1.0)]


def test_search(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(-(2**63), 2**63, 60)]
    flip = lambda x, k: (x ^ doc_simhash._signed(sum(1 << int(b) for b in rng.choice(64, k, replace=False))))
    fps = base + [flip(x, k) for x in base for k in (1, 2, 3, 4, 5)]
    f = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {(r.q_fp, r.fp, r.distance) for r in doc_simhash.search(f, f).collect()}
    dist = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert got == {(a, b, dist(a, b)) for a in set(fps) for b in set(fps) if dist(a, b) <= 3}


# --- op8


def test_quality_base(docs, rows):
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    for r in rows:
        w = WORD.findall(r.text)
        wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cov = {j for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in r.text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text)), len(lines) - len(set(lines)), len(cov))
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert g.base_failed == failed and (not g.kept if failed else True)


def test_quality_verdicts(spark):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefg"), int(k))) for k in rng.integers(2, 9, n))
    rows = [(k, text(int(rng.integers(40, 400))), "en", "s0") for k in range(400)]
    rows += [(1000 + k, text(200).replace(" ", "### "), "en", "s0") for k in range(40)]
    rows += [(2000 + k, text(100), "xx", f"t{k}") for k in range(5)]
    d = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(d).collect()}
    assert not any(got[1000 + k] for k in range(40)) and sum(got[k] for k in range(400)) >= 396 and all(got[2000 + k] for k in range(5))
    assert abs(quality_rules._chi2_cdf(11.0705, 5) - 0.95) < 1e-4
    o = {r.doc_id: r for r in quality_rules.apply_rules(odd(spark)).collect()}
    assert o[1].base_failed and not o[4].kept and o[4].n_repeat_words == o[4].n_words == 100_000
    assert quality_rules.apply_rules(d.limit(0)).count() == 0


# --- op9


def plain_ball(text):
    w = (text or "").encode().lower().split()
    h = [] if not w else [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_dedup(spark, rows):
    r = [(x.doc_id, x.text) for x in rows[:120]]
    base = rows[0].text.split()
    r += [(1000 + k, " ".join([*base[:k], "changed", *base[k + 1 :]])) for k in range(0, min(40, len(base)), 2)] + [(2000, None), (2001, ""), (2002, rows[0].text.upper())]
    d = spark.createDataFrame(r, "doc_id long, text string")
    got = {x.doc_id: x for x in simhash_ball.classes(simhash_ball.fingerprints(d)).collect()}
    fps = {i: plain_ball(t) for i, t in r}
    assert {i: x.fp & (2**64 - 1) for i, x in got.items()} == fps
    assert {i: x.component_id for i, x in got.items()} == plain_components(fps)
    kept = simhash_ball.keep_one(d)
    assert {x.doc_id for x in kept.collect()} == set(plain_components(fps).values())


def test_balls(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for c in centres for k in (0, 1, 2, 3, 4, 4, 5, 6)]
    want = plain_components(dict(enumerate(fps)))
    for lanes in (8, 16):
        f = spark.createDataFrame([(i, doc_simhash._signed(x)) for i, x in enumerate(fps)], "rep long, fp long").select("fp", "rep")
        got = {r.node: r.root for r in components.components(simhash_ball.links(f, lanes)).collect()}
        assert {i: got.get(i, i) for i in range(len(fps))} == want
    assert sum(len(v) for v in simhash_ball.ball_flips(8).values()) == 2081 and len(simhash_ball.ball_flips(8)) == 37


def test_components(spark):
    chain = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)] + [(2000, 2000 + k) for k in range(1, 200)]
    e = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.root for r in components.components(e).collect()}
    assert got == {**{k: 0 for k in range(301)}, 1000: 1000, 1001: 1000, **{2000 + k: 2000 for k in range(200)}}
    assert components.components(e.limit(0)).count() == 0


def test_near_dedup_odd(spark):
    o = odd(spark)
    got = simhash_ball.classes(simhash_ball.fingerprints(o)).collect()
    assert len(got) == 8 and {r.component_id for r in got if r.doc_id in (1, 2, 5)} == {1}
    k = simhash_ball.keep_one(o)
    assert k.columns == o.columns and sorted(r.doc_id for r in k.where("doc_id is not null").collect()) == [1, 3, 4]
    assert simhash_ball.classes(simhash_ball.fingerprints(o.limit(0))).count() == 0

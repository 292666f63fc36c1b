"""The operators' methods against plain versions, and tables that once were treated wrongly."""

import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import common, doc_simhash, language_id, line_dedup, mixing, quality_rules, simhash_ball, toxicity
from folio.llm.transducers import Compiled, Transducer
from tests.llm.test_corpus_operators import SF, WORD, odd
from tests.llm.test_whole_job import table

CLASHING = ["size", "c", "r", "k_id", "row_key", "src", "gone", "_n", "fp", "rep", "nth", "toxic", "ordinal", "start", "h1", "line", "pos", "site", "score", "root", "node"]


def clashing(spark, more=()):
    o = odd(spark, more)
    for k, c in enumerate(CLASHING):
        o = o.withColumn(c, F.lit(f"clash {k}"))
    return o


# --- op1


def test_language_codes_decode_to_the_least_loss():
    rng = np.random.default_rng(5)
    for n in (2, 4, 9):
        words = language_id.codewords(n)
        bits = words.shape[1]
        c = language_id.Codes([f"l{k}" for k in range(n)], words, np.zeros((language_id.BUCKETS, bits), dtype=np.float32), rng.uniform(0.5, 3, bits), rng.uniform(0.1, 1, bits))
        margins = rng.normal(size=(50, bits))
        best, share, close = c.decode(margins)
        for row, b, s, near in zip(margins, best, share, close):
            loss = [sum(t * math.log1p(math.exp(-m * sc * w)) for m, sc, t, w in zip(row, c.scale, c.trust, word)) / sum(c.trust) for word in words]
            weight = [math.exp(-8 * x) for x in loss]
            assert b == int(np.argmin(loss)) and abs(s - max(weight) / sum(weight)) < 1e-9
            two = sorted((w / sum(weight) for w in weight), reverse=True)
            assert near == (two[0] - two[1] < language_id.AMBIGUOUS)


def test_only_letters_make_a_language(spark):
    rows = [(k, f"das ist ein wort {k}", "de", "s") for k in range(40)] + [(100 + k, f"this is a word {k}", "en", "s") for k in range(40)] + [(200 + k, f"sana rara yksi {k}", "fi", "s") for k in range(9)]
    codes = language_id.fit(table(spark, rows), bound=6)
    assert codes.langs == ["de", "en", "fi"]  # the bound is one of each language
    none = ["½ ²", "①", "ⅷ", "12 34", "", None, "_ - _"]
    assert codes.predict(none)[0] == ["und"] * len(none)
    assert "und" not in codes.predict(["ä", "字", "x1"])[0]
    drawn = Counter(r.lang for r in language_id.training_rows(table(spark, rows), 6).collect())
    assert set(drawn.values()) == {6} or max(drawn.values()) <= 6


# --- op2


def test_small_sources_get_their_target(spark):
    rows = [(k, "w " * 500, "en", "big") for k in range(200)] + [(1000 + k, "a b c", "en", f"tiny{k}") for k in range(6)]
    for exact in (True, False):
        got = {}
        for r in mixing.mix(table(spark, rows), exact=exact).collect():
            g = got.setdefault(r.source, [r.target, 0, r.source_size])
            g[1] += r.taken
            assert 0 <= r.taken <= 3 * r["size"]
        for target, taken, size in got.values():
            block = max(1, min(16, int(target) // mixing.PARTS)) if size < 100 else 16
            assert abs(taken - target) <= max(0.01 * target, block)


def test_schedule_is_even_at_every_point(spark):
    sizes = spark.createDataFrame([("a", 5000), ("b", 90000), ("c", 40000)], "source string, size long")
    plan = mixing.plan_sources(sizes)
    want = {r.src: r.blocks for r in plan.collect()}
    slots = sorted((r.slot, r.src, r["rank"]) for r in mixing.schedule(plan).collect())
    assert Counter(s for _, s, _ in slots) == want
    seen: Counter = Counter()
    total = sum(want.values())
    for k, (_, src, rank) in enumerate(slots, 1):
        assert rank == seen[src]  # ranks without gaps, in the order of slots
        seen[src] += 1
        if k < 0.9 * total:
            assert all(abs(seen[s] - k * n / total) <= 12 for s, n in want.items())


# --- op3


def plain_clause(clause: str) -> dict[str, int]:
    """What a clause is weighed for, said without machines."""
    insults, strong, negated, reported, said = 0, False, False, False, False
    since = 99
    for a in clause:
        if a in "IJ":
            if since <= toxicity.SCOPE:
                negated = True
            elif said:
                reported = True
            else:
                insults += 1
                strong |= a == "I"
        since = 1 if a == "N" else since + 1
        said |= a == "R"
    before_report = clause.split("R")[0]
    target = "G" in clause
    return {"insult": insults > 0, "strong": strong, "repeated": insults > 1, "directed": insults > 0 and target, "threat": "T" in before_report and target, "negated": negated, "reported": reported}


def test_composed_transducers_weigh_as_their_parts_say():
    rng = np.random.default_rng(6)
    for _ in range(4000):
        clause = "".join(rng.choice(list("IJTGNRooo"), int(rng.integers(1, 12))))
        want = plain_clause(clause)
        assert toxicity.GRAMMAR.weigh(clause.encode()).tolist() == [float(want[n]) for n, _ in toxicity.PATTERNS], clause


def test_composition():
    double = Transducer(0, {0: {"a": (1, "b", ("w",)), "b": (0, "b", ())}, 1: {"a": (0, "a", ()), "b": (1, "a", ("v",))}}, {0: (), 1: ("end",)})
    count = Transducer.grown(0, "ab", lambda s, x: ((s + (x == "b")) % 3, x), lambda s: ("two",) if s == 2 else ())
    both = Compiled(double.then(count), ["w", "v", "end", "two"])
    rng = np.random.default_rng(7)
    for _ in range(300):
        word = "".join(rng.choice(list("ab"), int(rng.integers(0, 9))))
        s, out, total = 0, "", Counter()
        for x in word:
            s, y, w = double.arcs[s][x]
            out += y
            total.update(w)
        total.update(double.final[s])
        total.update(["two"] if out.count("b") % 3 == 2 else [])
        assert both.weigh(word.encode()).tolist() == [total[n] for n in both.features]


def test_long_texts_take_linear_time():
    lexicon = toxicity.learn_lexicon([], [])
    for text in ("you word " * 500_000, "word " * 1_000_000, "kill word you " * 333_000):
        start = time.process_time()
        toxicity.features(lexicon.classes(text))
        assert time.process_time() - start < 5
    assert toxicity.features(lexicon.classes("idiot" * 1)).tolist() == toxicity.features(lexicon.classes("idiot.")).tolist()


def test_words_are_counted_alike_on_executors(spark):
    rng = np.random.default_rng(8)
    plain = lambda: " ".join(rng.choice("sun moon tree river stone cloud wind leaf road hill bird fish".split(), 9))
    texts = [plain() for _ in range(60)] + [f"{plain()} grumpfling {plain()}" for _ in range(30)]
    toxic = [0] * 60 + [1] * 30
    rows = spark.createDataFrame([(t, y, k % 2) for k, (t, y) in enumerate(zip(texts, toxic))], "text string, toxic int, half int")
    got = toxicity.lexicons(rows)
    for lex, idx in zip(got, (range(0, 90, 2), range(1, 90, 2), range(90))):
        assert lex.args == toxicity.learn_lexicon([texts[i] for i in idx], [toxic[i] for i in idx]).args
    assert any("grumpfling".startswith(s) for s in got[2].args[2] | got[2].args[3])


# --- op4 and op9


def test_fingerprints_of_rows_without_ids_still_link(spark):
    fps = spark.createDataFrame([(1, 0), (None, 15), (2, 255), (3, 2**40 - 1)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash_ball.classes(fps).collect()}
    assert got == {1: 1, None: 1, 2: 1, 3: 3}


def test_wide_lanes_find_the_same_links(spark):
    rng = np.random.default_rng(9)
    fps = [int(x) for x in rng.integers(0, 2**63, 30)]
    fps += [x ^ sum(1 << int(b) for b in rng.choice(63, 4, replace=False)) for x in fps]
    f = spark.createDataFrame([(x, x) for x in fps], "fp long, rep long")
    want = {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4}
    assert {frozenset((r.a, r.b)) for r in simhash_ball.links(f, 16).collect()} == want


# --- op6


def test_search_counts_all_neighbours(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split() * 6
    rows = [(100 * k if k < 4 else 1000 + 7 * k, " ".join(base if k % 3 else [*base[:40], f"x{k}", *base[41:]])) for k in range(30)]
    rows += [(500, "something else altogether in here today"), (600, None), (7, None), (None, " ".join(base))]
    got = doc_simhash.edited_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = [int(r.fingerprint, 16) for r in got]
    for r in got:
        want = sum((int(r.fingerprint, 16) ^ x).bit_count() <= doc_simhash.RADIUS for x in fps) - 1
        assert r.n_near == (want if r.doc_id is not None and r.doc_id % 100 == 0 else None)


# --- op8


def plain_mcd(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the subset with the least determinant, from three starts."""
    floor = np.diag([(1000 * f) ** 2 for f in quality_rules.FLOORS])
    with_floor = lambda c: c + floor
    q1, med, q3 = np.percentile(x, [25, 50, 75], axis=0)
    sd = np.maximum((q3 - q1) * 0.7413, [1000 * f for f in quality_rules.FLOORS])
    y = np.round(np.clip((x - med) / sd, -quality_rules.WINSOR, quality_rules.WINSOR) * 1000)
    starts = [(med, np.diag(sd**2)), (x.mean(axis=0), with_floor(np.cov(x.T, bias=True))), (med + sd * y.mean(axis=0) / 1000, with_floor(np.cov(y.T, bias=True) * np.outer(sd, sd) / 1e6))]
    found = []
    for mean, cov in starts:
        for _ in range(quality_rules.STEPS):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            bins = np.floor(np.log2(1 + d) * 256)
            near = x[bins <= np.sort(bins)[math.ceil(quality_rules.H * len(x)) - 1]]
            mean, cov = near.mean(axis=0), with_floor(np.cov(near.T, bias=True))
        found.append((np.linalg.det(cov), near))
    near = min(found, key=lambda f: f[0])[1]
    return near.mean(axis=0), quality_rules.consistency() * np.cov(near.T, bias=True) + floor


def test_least_determinant_as_numpy_finds_it(spark):
    rng = np.random.default_rng(10)
    cluster = np.round(rng.multivariate_normal([5000, 1700, 300, 100, 20], np.diag([500, 80, 100, 60, 10]) ** 2.0, 500))
    junk = np.round(rng.multivariate_normal([7000, 2500, 2500, 900, 150], np.diag([300, 60, 200, 60, 10]) ** 2.0, 90))
    other = np.round(rng.multivariate_normal([4000, 1500, 100, 0, 0], np.diag([700, 50, 50, 30, 5]) ** 2.0, 300))
    groups = {"a": np.vstack([cluster, junk]), "b": other}
    rows = spark.createDataFrame([(g, *map(float, r)) for g, t in groups.items() for r in t], "grp string, x0 double, x1 double, x2 double, x3 double, x4 double")
    for r in quality_rules.estimates(rows).collect():
        mean, cov = plain_mcd(groups[r.grp])
        low = np.zeros((5, 5))
        for i, j in quality_rules.LOWER:
            low[i, j] = r[f"l{i}{j}"]
        assert np.allclose([r[f"m{i}"] for i in range(5)], mean, rtol=1e-9) and np.allclose(low @ low.T, cov, rtol=1e-6, atol=1e-3)
    mean, cov = plain_mcd(groups["a"])
    assert abs(mean[0] - 5000) < 100  # the junk is outside


def test_small_groups_are_judged_by_their_language(spark):
    rng = np.random.default_rng(11)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefg"), int(k))) for k in rng.integers(2, 9, n))
    rows = [(k, text(int(rng.integers(40, 400))), "en", "big") for k in range(400)]
    rows += [(1000, text(200).replace(" ", "### "), "en", "alone"), (1001, text(150), "en", "also alone"), (1002, text(150).replace(" ", "### "), None, None), (1003, text(120), "xx", "big")]
    got = {r.doc_id: r for r in quality_rules.apply_rules(table(spark, rows)).collect()}
    assert not got[1000].kept and not got[1002].kept and got[1001].kept and got[1003].kept and got[1000].d2 > 100
    assert sum(got[k].kept for k in range(400)) >= 396


# --- the pipeline


def test_stages_carry_any_columns(spark):
    more = [(100 + k, f"shared line\nown {k} with a few words more", "en", f"s{k}") for k in range(12)] + [(None, "words of a row without an id", None, None), (7, "first of two that share an id", "en", "s1"), (7, "second of two that share an id, unlike it", "en", "s1")]
    docs = clashing(spark, more)
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = common.stage(f(spark, docs, SF))
        assert out.columns == docs.columns and out.count() > 0
        assert {r[c] for r in out.collect() for c in CLASHING} == {f"clash {k}" for k in range(len(CLASHING))}
        docs = out
    texts = [r.text for r in docs.collect()]
    assert {"words of a row without an id", "first of two that share an id", "second of two that share an id, unlike it"} <= set(texts)
    assert sum(t.startswith("shared line\n") for t in texts if t) >= 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(texts)


def test_stages_of_nothing(spark):
    docs = clashing(spark).limit(0)
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, SF)
        assert out.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            docs = common.stage(out)


def test_operators_on_clashing_columns(spark):
    docs = clashing(spark, [(9, "a few words of text in a row", "en", "s9")])
    assert mixing.mix(docs).count() == docs.count()
    assert line_dedup.report(docs).count() == docs.count()
    assert simhash_ball.keep_one(docs).columns == docs.columns
    assert quality_rules.apply_rules(docs).count() == docs.count()
    words = sum(len(WORD.findall(r.text)) for r in mixing.mixed_documents(docs, exact=True).collect())
    assert words == sum(r.taken for r in mixing.mix(docs, exact=True).collect())
    with pytest.raises(RuntimeError, match="settle"):
        from folio.llm import components

        components.components(spark.createDataFrame([(k, k + 1) for k in range(50)], "a long, b long"), most=1)

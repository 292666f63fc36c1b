"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer reads words and writes one class letter each: insults of a strong or a weak kind, threats, targets
(whom one addresses), negations, reported speech, clause ends, anything else. The grammar over the letters of a clause
is composed of five transducers: *negation* rewrites insults up to ``SCOPE`` words after a negation, *reported speech*
rewrites insults and threats after its verb, *insult* weighs the insults that are left, *target* pairs them with an
addressee, *threat* pairs threats with one. Only whole clauses get weights, when they end; words by themselves
get none. The weights of a text's clauses are added by feature, damped, and a logistic combination of these and of the
share of clauses with an insult gives the score.

Insults are learned from labelled rows: a word, or the beginning of words, is an insult if labelled-toxic texts
have it far more often than chance allows. Words are counted by aggregation over a sample of at most ``TRAIN_ROWS``
labelled rows; the driver sees the words that pass and a few numbers a row. Threats, targets, negations and reporting
verbs are listed for four languages.

Time is linear in a text's length. A null or empty text has no clause and gets the score of a text without matches. Null
labels are not learned from; without any labelled row of both kinds nothing is an insult but the listed seeds.
Repeated rows are kept (and learned once); empty input gives empty output. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workers import ship
from .common import fold, stage
from .transducers import Compiled, Transducer

#: Labelled rows used for learning, at most.
TRAIN_ROWS = 6000

# Fixed word lists of the grammar's closed classes (English, German, French, Spanish).
SEEDS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown".split()
THREATS = "kill hurt destroy murder punch burn töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours yourself du dich dir dein deine ihr euch tu toi ton ta vous votre tú ti usted ustedes vosotros".split()
NEGATIONS = "not no never neither nor isn't aren't nicht kein keine keiner niemals pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say wrote writes quoted quote claimed called asked sagte sagt schrieb nannte dit écrit disait dijo dice escribió llamó".split()

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n|]")
END = frozenset(".!?;:\n|")
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Base-10 logarithm of the chance below which a word is taken for an insult.
SURE, LIKELY = -9.0, -5.5

#: Words after a negation that it reaches.
SCOPE = 3
#: What a clause can be weighed for. Letters: I strong insult, J weak insult, T threat, G target, N negation, R report,
#: o anything else; n and q are negated and reported insults.
PATTERNS = [
    ("insult", "an insult that is neither negated nor reported"),
    ("strong", "a strong one"),
    ("repeated", "two or more"),
    ("directed", "an insult and a target"),
    ("threat", "a threat and a target"),
    ("negated", "a negated insult"),
    ("reported", "a reported insult"),
]
LETTERS, REWRITTEN = "IJTGNRo", "IJTGNRonq"


def grammar() -> Transducer:
    """The composition of the five transducers."""
    negation = Transducer.grown(0, LETTERS, lambda left, a: (SCOPE if a == "N" else max(0, left - 1), "n" if left and a in "IJ" else a), lambda s: ())
    reported = Transducer.grown(False, LETTERS + "n", lambda said, a: (said or a == "R", "q" if said and a in "IJ" else "o" if said and a == "T" else a), lambda s: ())
    # how many insults, up to two; whether one is strong; whether one is negated, reported
    seen = lambda s, a: ((min(2, s[0] + (a in "IJ")), s[1] or a == "I", s[2] or a == "n", s[3] or a == "q"), a)
    names = lambda s: [n for n, x in zip(("insult", "strong", "repeated", "negated", "reported"), (s[0] > 0, s[1], s[0] > 1, s[2], s[3])) if x]
    insult = Transducer.grown((0, False, False, False), REWRITTEN, seen, names)
    pair = lambda of, name: Transducer.grown((False, False), REWRITTEN, lambda s, a: ((s[0] or a in of, s[1] or a == "G"), a), lambda s: (name,) * all(s))
    return negation.then(reported).then(insult).then(pair("IJ", "directed")).then(pair("T", "threat"))


GRAMMAR = Compiled(grammar(), [n for n, _ in PATTERNS])


class Lexicon(dict):
    """Word -> class letter; beginnings of words are looked up once per word and remembered."""

    LIMIT, LONGEST = 300_000, 40

    def __init__(self, strong: set[str], weak: set[str], strong_stems: set[str], weak_stems: set[str]):
        super().__init__()
        self.args = (strong, weak, strong_stems, weak_stems)
        self.fixed = {w: ord(".") for w in END}
        for letter, group in (("R", REPORTS), ("N", NEGATIONS), ("G", TARGETS), ("T", THREATS), ("J", weak), ("I", strong)):
            self.fixed |= {w: ord(letter) for w in group}
        self.stems = {s: ord("J") for s in weak_stems} | {s: ord("I") for s in strong_stems}
        self.lengths = sorted({len(s) for s in self.stems})

    def __reduce__(self):
        return Lexicon, self.args

    def __missing__(self, word: str) -> int:
        c = self.fixed.get(word)
        if c is None:
            c = ord("o")
            for n in self.lengths:
                if n > len(word):
                    break
                if (s := self.stems.get(word[:n])) is not None:
                    c = s if c != ord("I") else c
        if len(word) <= self.LONGEST:
            if len(self) > self.LIMIT:
                self.clear()
            self[word] = c
        return c

    def classes(self, text: str) -> bytes:
        return bytes(map(self.__getitem__, TOKEN.findall(text.lower())))


def features(classes: bytes) -> np.ndarray:
    """The weights of all clauses by feature, damped; last, the share of clauses with an insult, more for more of them."""
    total, hits, n = np.zeros(len(PATTERNS)), 0, 0
    if b"I" in classes or b"J" in classes or b"T" in classes:
        for clause in classes.split(b"."):
            n += clause != b""
            if b"I" in clause or b"J" in clause or b"T" in clause:
                w = GRAMMAR.weigh(clause)
                total += w
                hits += w[0] > 0
    return np.log1p(np.r_[total, 10 * hits / math.sqrt(n + 4)])


def _chance(k: int, n: int, rate: float) -> float:
    """log10 of the chance that at least k of n texts are toxic at this rate (a Chernoff bound)."""
    q = k / n
    if q <= rate:
        return 0.0
    d = q * math.log(q / rate) + ((1 - q) * math.log((1 - q) / (1 - rate)) if q < 1 else 0.0)
    return -n * d / math.log(10)


def vocabulary(text: str) -> tuple[set[str], set[str]]:
    """The words of a text and their beginnings."""
    w = {x for x in TOKEN.findall(text.lower()) if x not in END and len(x) <= Lexicon.LONGEST}
    return w, {x[:n] for x in w for n in PREFIXES if n <= len(x)}


def counted(texts: list[str], toxic: list[int]) -> dict[tuple[str, bool], list[int]]:
    """(word, whether it is a beginning) -> in how many texts, and in how many toxic ones."""
    out: dict[tuple[str, bool], list[int]] = {}
    for t, y in zip(texts, toxic):
        for group, stem in zip(vocabulary(t), (False, True)):
            for x in group:
                c = out.setdefault((x, stem), [0, 0])
                c[0] += 1
                c[1] += y
    return out


def base_rate(n: int, toxic: int) -> float:
    return min(max(toxic / max(1, n), 1e-4), 0.5)


def lexicon_of(counts: dict[tuple[str, bool], list[int]], rate: float) -> Lexicon:
    """Insults and their beginnings, from counts."""
    words, stems = {}, {}
    for (x, stem), (n, k) in counts.items():
        if k >= 4 and k >= (0.6 + 0.4 * rate) * n and (p := _chance(k, n, rate)) < LIKELY:
            (stems if stem else words)[x] = (p, k / n)
    # a stem says more than a word it begins, and a shorter stem more than a longer, if nearly as pure
    kept: dict[str, tuple[float, float]] = {}
    for s in sorted(stems, key=lambda s: (len(s), s)):
        p, pure = stems[s]
        if not any(kept[s[:n]][1] >= pure - 0.03 for n in range(min(PREFIXES), len(s)) if s[:n] in kept):
            kept[s] = (p, pure)
    strength = lambda p, pure: p < SURE and pure > 0.9
    strong = {w for w, x in words.items() if strength(*x)}
    return Lexicon(strong, set(words) - strong | set(SEEDS) - strong, {s for s, x in kept.items() if strength(*x)}, {s for s, x in kept.items() if not strength(*x)})


def learn_lexicon(texts: list[str], toxic: list[int]) -> Lexicon:
    return lexicon_of(counted(texts, toxic), base_rate(len(toxic), sum(toxic)))


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-3]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - penalty * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Grammar:
    """The lexicon, and what each feature of the composed grammar is worth."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str | None) -> float:
        f = features(self.lexicon.classes(text or ""))
        z = float(f @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def weighed(lexicon: Lexicon, x: np.ndarray, y: np.ndarray) -> Grammar:
    if not len(y) or y.min() == y.max():
        return Grammar(lexicon, np.r_[np.full(len(PATTERNS) + 1, 1.0), -2.0])
    return Grammar(lexicon, fit_weights(x, y))


def learn(texts: list[str], toxic: list[int]) -> Grammar:
    """Words are learned from one half and weighed on the other, and the other way round, so that the weights
    know how learned words do on texts they were not learned from."""
    half = np.arange(len(texts)) % 2
    x = np.zeros((len(texts), len(PATTERNS) + 1))
    for part in (0, 1):
        other = np.flatnonzero(half != part)
        lex = learn_lexicon([texts[i] for i in other], [toxic[i] for i in other])
        for i in np.flatnonzero(half == part):
            x[i] = features(lex.classes(texts[i]))
    return weighed(learn_lexicon(texts, toxic), x, np.array(toxic, dtype=float))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """``text, toxic, half``: at most ``bound`` labelled rows whose fold of 5 is not 0, each text once.

    Rows are drawn by a hash of their ids, then by their texts', so the draw is the same in every run; the two halves are
    of alternating rows in the order of ids.
    """
    l = labels.where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    l = stage(l.where(fold(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    h = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    n = l.count()
    if n > bound:
        cut = int(bound / n * 1.05 * (1 << 30)) + 1
        l = l.where(F.pmod(h, F.lit(1 << 30)) < cut).orderBy(h, "doc_id").limit(bound)
    chosen = F.broadcast(l)  # at most ``bound`` rows
    of_text = [F.xxhash64(F.lit(k), F.col("text")).alias(f"h{k}") for k in (1, 2)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(chosen, "doc_id").select("*", *of_text)
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("doc_id"))).where("nth = 1")
    # ids may repeat: the bound holds for rows as well
    rows = stage(rows.orderBy(h, "doc_id", "h1").limit(bound), "drawn")
    order = Window.orderBy("doc_id", "h1")  # at most ``bound`` rows
    halves = F.broadcast(rows.select("doc_id", "h1", "h2").withColumn("half", (F.row_number().over(order) - 1) % 2))
    return stage(rows.join(halves, ["doc_id", "h1", "h2"]).select("text", "toxic", "half"), "training")


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 64):
            c = b.slice(at, 64).to_pydict()
            out: Counter = Counter()
            for t, y, half in zip(c["text"], c["toxic"], c["half"]):
                for group, stem in zip(vocabulary(t), (False, True)):
                    out.update((x, stem, half, y) for x in group)
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(list(out.values()), pa.int64())], names=["word", "stem", "half", "toxic", "n"])


def lexicons(rows: DataFrame) -> tuple[Lexicon, Lexicon, Lexicon]:
    """From half 0, half 1 and all of ``rows(text, toxic, half)``: words counted on executors, candidates picked there."""
    size = {(r.half, r.toxic): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    counts = rows.mapInArrow(_count_batches, "word string, stem boolean, half int, toxic int, n long").groupBy("word", "stem")
    of = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    cells = [(half, y) for half in (0, 1) for y in (0, 1)]
    table = counts.agg(*[of((F.col("half") == half) & (F.col("toxic") == y)).alias(f"n{half}{y}") for half, y in cells])

    def could(n: Column, k: Column) -> Column:
        return (k >= 4) & (k >= 0.6 * n)

    table = table.where(could(F.col("n00") + F.col("n01"), F.col("n01")) | could(F.col("n10") + F.col("n11"), F.col("n11")) | could(sum((F.col(f"n{h}{y}") for h, y in cells), F.lit(0)), F.col("n01") + F.col("n11")))
    got = table.collect()
    out = []
    for halves in ((0,), (1,), (0, 1)):
        n, k = sum(size.get((h, y), 0) for h in halves for y in (0, 1)), sum(size.get((h, 1), 0) for h in halves)
        out.append(lexicon_of({(r.word, r.stem): [sum(r[f"n{h}{y}"] for h in halves for y in (0, 1)), sum(r[f"n{h}1"] for h in halves)] for r in got}, base_rate(n, k)))
    return tuple(out)


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> Grammar:
    ship(docs.sparkSession)
    rows = training_rows(docs, labels, bound)
    zero, one, every = lexicons(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features((zero, one)[1 - half].classes(t)).tolist() for t, half in zip(b.column("text").to_pylist(), b.column("half").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    got = sorted((list(r.x), r.toxic) for r in rows.mapInArrow(run, "toxic int, x array<double>").collect())
    return weighed(every, np.array([x for x, _ in got]).reshape(len(got), len(PATTERNS) + 1), np.array([y for _, y in got], dtype=float))


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``doc_id, score`` of every whole text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [grammar.score(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, grammar: Grammar, at: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores ``at`` or more."""
    ship(docs.sparkSession)
    cols = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([grammar.score(t.as_py()) < at for t in b.column("text")], pa.bool_())
            yield b.filter(keep)

    return docs.select(*cols).mapInArrow(run, docs.schema)

"""Quality rules with robust multivariate outliers.

Fixed rules come first (``base_failed``). Among the rest, five transformed statistics of each text form a vector. A
minimum-covariance-determinant estimate is made per language and source, and a text whose squared Mahalanobis
distance exceeds ``CUTOFF`` is rejected. The estimate has three starts: medians with quartile spreads, mean and
covariance of all rows, and those of rows winsorised at twice the spread. From each, concentration steps are taken
(the ``H`` share of rows nearest to the present centre, their mean and covariance) until the subset stands still, at
most ``STEPS``. Of the three the one with the least determinant is taken.

Languages and sources of fewer than ``LEAST_ROWS`` rows use the estimate of all rows of their language, and languages of
fewer than that the estimate of all rows; rows of large groups count in these as well.

Statistics that hardly vary would make a covariance singular, so each variance gets a floor (``FLOORS``). The share
of rows with the least distance is found through a histogram of distances (256 bins a doubling) that holds count and
moments of each bin: a step is one aggregation, and no group is sorted or gathered.

Everything is DataFrame code. A null text has no words and fails the base rules; null languages and sources are
values like others. Repeated rows are kept. Empty input gives empty output. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stage, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent
H = 0.75
WINSOR = 2.0
STEPS = 12
LEAST_ROWS = 100
#: Least standard deviation of each statistic.
FLOORS = (0.3, 0.05, 0.15, 0.1, 0.04)
#: Squared distance; about one in ten million by the chi-square law with five degrees of freedom.
CUTOFF = 42.0
DIMS = len(FLOORS)


def _repeated(w: Column) -> Column:
    """Words in windows that occur twice or more, by hashes of the windows of ``w``."""
    window = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), window)

    def cover(pos: Column) -> Column:
        step = F.transform(pos, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(pos, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def among(s: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
        return let(F.sort_array(F.transform(F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["p"])), cover)

    def over(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, among))

    return F.when(F.size(w) < WINDOW + 1, F.lit(0)).otherwise(let(hashes, over))


def base_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    of_words = let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("c"), _repeated(w).alias("r")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    d = docs.select("doc_id", "lang", "source", of_words.alias("w"), F.regexp_count(text, F.lit(SYMBOLS)).alias("s"), dup.alias("d"))
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return d.select("doc_id", "lang", "source", long("w.n", "n_words"), long("w.c", "word_chars"), long("s", "n_symbols"), long("d", "n_dup_lines"), long("w.r", "n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics in thousandths. Ratios are drawn towards a usual value in short texts."""
    n = F.col("n_words") + 10.0
    parts = [
        F.log1p(F.col("n_words").cast("double")),
        F.log((F.col("word_chars") + 50.0) / n),
        F.log1p(10.0 * F.col("n_symbols") / n),
        F.log1p(10.0 * F.col("n_dup_lines") / n),
        F.col("n_repeat_words") / n,
    ]
    return [F.round(p * 1000.0).alias(f"x{i}") for i, p in enumerate(parts)]


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= 20_000 else df


def groups(stats: DataFrame) -> DataFrame:
    """``g_lang, g_source, grp, counts_in``: which estimate the rows of a language and source use, and in which they count."""
    by = stats.groupBy(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n"))
    of_lang = Window.partitionBy("g_lang")
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    own, wide = F.concat(text("g_lang"), F.lit("\x1f"), text("g_source")), text("g_lang")
    by = by.withColumn("wide", wide).withColumn("in_lang", F.sum("n").over(of_lang))
    by = by.withColumn("grp", F.when(F.col("n") >= LEAST_ROWS, own).when(F.col("in_lang") >= LEAST_ROWS, F.col("wide")).otherwise(F.lit("all")))
    by = stage(by.withColumn("asked", F.max(F.col("grp") == F.col("wide")).over(of_lang)), "groups")
    rest = by.where("grp = 'all'").limit(1).count() > 0
    used = [F.when(F.col("n") >= LEAST_ROWS, F.col("grp")), F.when(F.col("asked"), F.col("wide")), F.when(F.lit(rest), F.lit("all"))]
    return by.select("g_lang", "g_source", "grp", F.array_compact(F.array(*used)).alias("counts_in"))


X = [f"x{i}" for i in range(DIMS)]
M = [f"m{i}" for i in range(DIMS)]
LOWER = [(i, j) for i in range(DIMS) for j in range(i + 1)]
FLOOR2 = [(1000 * f) ** 2 for f in FLOORS]


def _moments(rows: DataFrame, keys: list[str], names: list[str] = X) -> DataFrame:
    """Count, sums and sums of products of ``rows`` by ``keys``: whole numbers, exact in doubles up to 2**53 in any order."""
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(names)] + [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}{j}") for i, j in LOWER]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums)


def _factor(t: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """``keys``, means ``m``, Cholesky factor ``l`` of ``scale`` times the covariance, and ``det``, the factor's determinant."""
    t = t.select("*", *[(F.col(f"s{i}") / F.col("n")).alias(m) for i, m in enumerate(M)])
    cov = {(i, j): scale * (F.col(f"p{i}{j}") / F.col("n") - F.col(M[i]) * F.col(M[j])) for i, j in LOWER}
    return _cholesky(t, cov, keys)


def _cholesky(t: DataFrame, cov: dict, keys: list[str]) -> DataFrame:
    for i, j in LOWER:
        v = F.greatest(F.lit(0.0), cov[i, i]) + FLOOR2[i] if i == j else cov[i, j]
        for k in range(j):
            v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        t = t.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(FLOOR2[i] * 0.01))) if i == j else v / F.col(f"l{j}{j}"))
    det = F.col("l00")
    for i in range(1, DIMS):
        det = det * F.col(f"l{i}{i}")
    return t.select(*keys, *M, *[f"l{i}{j}" for i, j in LOWER], det.alias("det"))


def _with_distance(joined: DataFrame) -> DataFrame:
    """``d2`` of rows that hold ``x``, ``m`` and ``l``."""
    for i in range(DIMS):
        v = F.col(X[i]) - F.col(M[i])
        for k in range(i):
            v = v - F.col(f"l{i}{k}") * F.col(f"z{k}")
        joined = joined.withColumn(f"z{i}", v / F.col(f"l{i}{i}"))
    return joined.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, DIMS)), F.col("z0") * F.col("z0")))


def _starts(rows: DataFrame) -> DataFrame:
    """The three starts of every group: ``grp, st`` with means and factors."""
    spread = [F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i, x in enumerate(X)]
    t = rows.groupBy("grp").agg(*spread)
    sd = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) * 0.7413, F.lit(1000 * FLOORS[i])).alias(f"e{i}") for i in range(DIMS)]
    t = _small(stage(t.select("grp", *[F.col(f"q{i}")[1].alias(f"c{i}") for i in range(DIMS)], *sd), "spread"))
    keys = ["grp", "st"]
    zero = {(i, j): F.lit(0.0) for i, j in LOWER if i != j}
    # the factor of a diagonal is its square root; the floor is taken off as it is added again
    plain = t.select("grp", F.lit(0).alias("st"), *[F.col(f"c{i}").alias(m) for i, m in enumerate(M)], *[f"e{i}" for i in range(DIMS)])
    plain = _cholesky(plain, zero | {(i, i): F.col(f"e{i}") * F.col(f"e{i}") - FLOOR2[i] for i in range(DIMS)}, keys)
    every = _factor(_moments(rows, ["grp"]).withColumn("st", F.lit(1)), keys)
    y = [F.round(F.least(F.lit(WINSOR), F.greatest(F.lit(-WINSOR), (F.col(x) - F.col(f"c{i}")) / F.col(f"e{i}"))) * 1000).alias(f"y{i}") for i, x in enumerate(X)]
    w = _moments(rows.join(t, "grp").select("grp", *y), ["grp"], [f"y{i}" for i in range(DIMS)]).join(t, "grp")
    mean = [F.col(f"s{i}") / F.col("n") for i in range(DIMS)]
    cov = {(i, j): F.col(f"e{i}") * F.col(f"e{j}") * ((F.col(f"p{i}{j}") / F.col("n") - mean[i] * mean[j]) / 1e6) for i, j in LOWER}
    w = w.select("*", F.lit(2).alias("st"), *[(F.col(f"c{i}") + F.col(f"e{i}") * mean[i] / 1000).alias(m) for i, m in enumerate(M)])
    return plain.unionByName(every).unionByName(_cholesky(w, cov, keys))


def _concentrate(rows: DataFrame, centre: DataFrame) -> DataFrame:
    """Moments, by ``grp, st``, of the ``H`` share of rows with the least distance from each centre."""
    keys = ["grp", "st"]
    d = _with_distance(rows.join(_small(centre), "grp"))
    hist = _moments(d.withColumn("bin", F.floor(F.log2(1.0 + F.col("d2")) * 256)), [*keys, "bin"])
    nearer = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")) - F.col("n")
    near = hist.withColumn("nearer", nearer).withColumn("all_n", F.sum("n").over(Window.partitionBy(*keys))).where(F.col("nearer") < F.ceil(H * F.col("all_n")))
    return near.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ["n", *[f"s{i}" for i in range(DIMS)], *[f"p{i}{j}" for i, j in LOWER]]])


def _chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, t = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 500):
        term *= t / (a + n)
        total += term
    return total * math.exp(-t + a * math.log(t) - math.lgamma(a))


def consistency(h: float = H, k: int = DIMS) -> float:
    """What a covariance of the closest ``h`` share is multiplied by to be right for normal rows."""
    lo, hi = 1e-6, 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, k) < h else (lo, mid)
    return h / _chi2_cdf(lo, k + 2)


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """The estimate of every group of ``rows(grp, x0 .. x4)``: ``grp``, means and factor."""
    centre, last = stage(_starts(rows), "centre"), None
    for _ in range(steps):
        moments = stage(_concentrate(rows, centre), "moments")
        # whole-number sums: the same digest means the same subsets
        now = tuple(moments.agg(F.count("*"), F.sum(F.xxhash64(*moments.columns).cast("decimal(38,0)"))).first())
        centre = _factor(moments, ["grp", "st"])
        if now == last:
            break
        last = now
    cols = [c for c in moments.columns if c not in ("grp", "st")]
    ranked = moments.join(centre.select("grp", "st", "det"), ["grp", "st"])
    best = ranked.groupBy("grp").agg(F.min_by(F.struct(*cols), F.struct("det", "st")).alias("b")).select("grp", "b.*")
    return stage(_factor(best, ["grp"], consistency()), "centre")


def apply_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The statistics of every document with ``base_failed, d2, kept``."""
    stats = stage(base_statistics(docs).withColumn("base_failed", base_failed()), "stats")
    grp = _small(groups(stats))
    rows = stats.join(grp, stats["lang"].eqNullSafe(grp["g_lang"]) & stats["source"].eqNullSafe(grp["g_source"])).drop("g_lang", "g_source")
    rows = rows.select("*", *vector())
    usable = stage(rows.where(~F.col("base_failed")).select(F.explode("counts_in").alias("grp"), *X), "usable")
    far = _with_distance(rows.join(_small(estimates(usable)), "grp", "left"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return far.select(*stats.columns, "d2", kept.alias("kept"))

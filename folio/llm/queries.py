"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import doc_simhash, language_id, line_dedup, mixing, piece_bpe, quality_rules, repeat_bytes, simhash_ball, token_count, toxicity
from .common import documents, fold, stage


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(documents(spark, sf_dir), exact=True)
    return m.select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    grammar = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    s = toxicity.score(docs, grammar)
    return s.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_simhash.edited_report(documents(spark, sf_dir))


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_bytes.remove_repeats(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules.apply_rules(documents(spark, sf_dir))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = stage(simhash_ball.fingerprints(documents(spark, sf_dir)), "fp")
    found = simhash_ball.classes(fps)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_mix_sources, op3_toxicity, op4_line_dedup, op5_sentencepiece, op6_fingerprints, op7_repeated_bytes, op8_quality_rules, op9_simhash_near_dedup, op10_token_counts)}
ORACLES: dict[str, str] = {}

ORACLES["op4_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, source, unnest(range(len(a))) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
keyed AS (SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS t FROM lines),
boiler AS (SELECT t, min(doc_id) AS first_doc FROM keyed WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 10),
firsts AS (SELECT k.t, min(k.pos) AS first_pos FROM keyed k JOIN boiler b ON k.t = b.t AND k.doc_id = b.first_doc GROUP BY k.t),
marked AS (
  SELECT k.doc_id, k.pos, k.line, b.t IS NOT NULL AND NOT (k.doc_id = b.first_doc AND k.pos = f.first_pos) AS gone
  FROM keyed k LEFT JOIN boiler b ON k.t = b.t LEFT JOIN firsts f ON k.t = f.t)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLES["op2_mix_sources"] = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM by_source),
weighed AS (SELECT *, CASE src % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM numbered),
running AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_w,
    coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0,
    coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0
  FROM weighed WINDOW o AS (ORDER BY source_size::DOUBLE / weight::DOUBLE, src)),
capping AS (SELECT *, (total - 3 * s0) * weight >= 3 * source_size * (all_w - w0) AS capped FROM running),
targets AS (
  SELECT source, src, source_size, total, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE
      weight::DOUBLE * (total - 3 * coalesce(sum(source_size) FILTER (WHERE capped) OVER (), 0))::DOUBLE
      / (all_w - coalesce(sum(weight) FILTER (WHERE capped) OVER (), 0))::DOUBLE END AS target
  FROM capping),
quotas AS (SELECT *, floor(target)::BIGINT AS quota FROM targets),
cut AS (SELECT *, least(greatest(16, ceil(total::DOUBLE / 1048576.0))::BIGINT, greatest(1, quota // 64)) AS block FROM quotas),
blocked AS (SELECT *, ceil(quota::DOUBLE / block::DOUBLE)::BIGINT AS blocks FROM cut),
summed AS (SELECT *, (sum(blocks) OVER (ORDER BY src ROWS UNBOUNDED PRECEDING))::BIGINT AS cum, (sum(blocks) OVER ())::BIGINT AS all_blocks FROM blocked),
plan AS (
  SELECT *, floor((cum - blocks)::DOUBLE * 2147483648.0 / all_blocks::DOUBLE)::BIGINT AS lo,
    floor(cum::DOUBLE * 2147483648.0 / all_blocks::DOUBLE)::BIGINT AS hi FROM summed WHERE all_blocks > 0),
slots AS (
  SELECT i AS slot, ((i % 2147483648) * 1327217885) % 2147483648 AS point FROM (SELECT unnest(range((SELECT 3 * max(all_blocks) FROM plan))) AS i)),
held AS (SELECT p.src, count(*) AS n FROM slots s JOIN plan p ON s.point >= p.lo AND s.point < p.hi GROUP BY p.src),
got AS (SELECT s.source, s.source_size, s.target, s.src, least(s.quota, least(s.blocks, coalesce(h.n, 0)) * s.block) AS got FROM summed s LEFT JOIN held h ON h.src = s.src),
placed AS (
  SELECT d.doc_id, d.size, g.*, sum(d.size) OVER (PARTITION BY g.src ORDER BY md5(d.doc_id::VARCHAR), d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS start
  FROM sized d JOIN got g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, got - start)) + greatest(0, least(size, got - source_size - start)) + greatest(0, least(size, got - 2 * source_size - start)))::BIGINT AS taken
FROM placed
"""

ORACLES["op7_repeated_bytes"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (
  SELECT doc_id, b, n, substr(h, (400 * b + 1)::BIGINT, 800) AS c
  FROM (SELECT doc_id, h, len(h) // 2 AS n, unnest(range((len(h) // 2 + 199) // 200)) AS b FROM d WHERE len(h) >= 400)),
w AS (
  SELECT doc_id, 200 * b + j AS i, hash(substr(c, (2 * j + 1)::BIGINT, 400)) AS s
  FROM (SELECT *, unnest(range(200)) AS j FROM blocks) WHERE 200 * b + j <= n - 200),
r AS (SELECT doc_id, i FROM w SEMI JOIN (SELECT s FROM w GROUP BY s HAVING count(*) > 1) t USING (s)),
n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM n),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, k),
before AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS pb FROM spans),
cut AS (
  SELECT s.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last_b,
    string_agg(substr(h, (2 * pb + 1)::BIGINT, (2 * (a - pb))::BIGINT), '' ORDER BY a) AS kept
  FROM before s JOIN d ON d.doc_id = s.doc_id GROUP BY s.doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN last_b IS NULL THEN h ELSE kept || substr(h, (2 * last_b + 1)::BIGINT) END)) AS kept_sha256
FROM d LEFT JOIN cut c ON c.doc_id = d.doc_id
"""


def _quality_sql() -> str:
    """The fixed rules, the three starts and every concentration step, written out. A step past the last that changes anything changes nothing."""
    q, dims = quality_rules, range(quality_rules.DIMS)
    lower = [(i, j) for i in dims for j in range(i + 1)]
    xs = ", ".join(f"x{i}" for i in dims)
    floor = [(1000 * f) ** 2 for f in q.FLOORS]

    def chol(cov: dict) -> str:
        out = []
        for i, j in lower:
            less = "".join(f" - l{i}{x} * l{j}{x}" for x in range(j))
            out.append(f"sqrt(greatest(greatest(0, {cov[i, j]}) + {floor[i]}{less}, {floor[i] * 0.01})) AS l{i}{i}" if i == j else f"({cov[i, j]}{less}) / l{j}{j} AS l{i}{j}")
        return ", ".join(out)

    means, factors = ", ".join(f"m{i}" for i in dims), ", ".join(f"l{i}{j}" for i, j in lower)
    spread = {(i, j): f"(p{i}{j} - m{i} * m{j})" for i, j in lower}
    sums = ", ".join([f"sum(x{i}) / count(*) AS m{i}" for i in dims] + [f"sum(x{i} * x{j}) / count(*) AS p{i}{j}" for i, j in lower])
    ctes = [
        "d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents)",
        "wd AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d)",
        "win AS (SELECT doc_id, i, hash(w[i:i + 4]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM wd WHERE len(w) > 5))",
        "rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1)",
        "gaps AS (SELECT doc_id, lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i AS gap FROM rep)",
        "cover AS (SELECT doc_id, sum(least(5, coalesce(gap, 5)))::BIGINT AS r FROM gaps GROUP BY doc_id)",
        "base AS (SELECT wd.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words FROM wd LEFT JOIN cover USING (doc_id))",
        f"stats AS MATERIALIZED (SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS base_failed FROM base)",
        # a row's estimate: its language and source, its language or all, the first with enough rows
        "sized AS (SELECT *, count(*) FILTER (WHERE NOT base_failed) OVER (PARTITION BY lang, source) AS n_own, count(*) FILTER (WHERE NOT base_failed) OVER (PARTITION BY lang) AS n_lang FROM stats)",
        f"v AS MATERIALIZED (SELECT *, CASE WHEN n_own >= {q.LEAST_ROWS} THEN {{'l': lang, 's': source, 'k': 2}} WHEN n_lang >= {q.LEAST_ROWS} THEN {{'l': lang, 's': NULL, 'k': 1}} ELSE {{'l': NULL, 's': NULL, 'k': 0}} END AS grp,"
        """ n_words + 10.0::DOUBLE AS n, round(ln(1 + n_words::DOUBLE) * 1000) AS x0, round(ln((word_chars + 50) / n) * 1000) AS x1, round(ln(1 + 10 * n_symbols / n) * 1000) AS x2,
          round(ln(1 + 10 * n_dup_lines / n) * 1000) AS x3, round(n_repeat_words / n * 1000) AS x4 FROM sized)""",
        "asked AS (SELECT DISTINCT grp FROM v)",
        f"u AS MATERIALIZED (SELECT a.grp, {xs} FROM asked a JOIN v ON NOT base_failed AND (a.grp.k = 0 OR v.lang IS NOT DISTINCT FROM a.grp.l) AND (a.grp.k < 2 OR v.source IS NOT DISTINCT FROM a.grp.s))",
        "q AS (SELECT grp, " + ", ".join(f"quantile_cont(x{i}, [0.25, 0.5, 0.75]) AS q{i}" for i in dims) + " FROM u GROUP BY grp)",
        "ce AS MATERIALIZED (SELECT grp, " + ", ".join(f"q{i}[2] AS c{i}, greatest((q{i}[3] - q{i}[1]) * 0.7413, {1000 * q.FLOORS[i]}::DOUBLE) AS e{i}" for i in dims) + " FROM q)",
        "st0 AS (SELECT grp, 0 AS st, " + ", ".join(f"c{i} AS m{i}" for i in dims) + ", " + chol({(i, j): f"(e{i} * e{i} - {floor[i]})" if i == j else "0.0::DOUBLE" for i, j in lower}) + " FROM ce)",
        f"mo AS (SELECT grp, {sums} FROM u GROUP BY grp)",
        f"st1 AS (SELECT grp, 1 AS st, {means}, {chol(spread)} FROM mo)",
        "y AS (SELECT u.grp, " + ", ".join(f"round(least({q.WINSOR}, greatest(-{q.WINSOR}, (x{i} - c{i}) / e{i})) * 1000) AS x{i}" for i in dims) + " FROM u JOIN ce ON u.grp = ce.grp)",
        f"my AS (SELECT grp, {sums} FROM y GROUP BY grp)",
        "wy AS (SELECT my.grp, " + ", ".join([f"c{i} + e{i} * m{i} / 1000 AS w{i}" for i in dims] + [f"e{i} * e{j} * ((p{i}{j} - m{i} * m{j}) / 1e6::DOUBLE) AS v{i}{j}" for i, j in lower]) + " FROM my JOIN ce ON my.grp = ce.grp)",
        "st2 AS (SELECT grp, 2 AS st, " + ", ".join(f"w{i} AS m{i}" for i in dims) + ", " + chol({(i, j): f"v{i}{j}" for i, j in lower}) + " FROM wy)",
        "c0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT grp, st, {means}, {factors} FROM st{k}" for k in range(3)) + ")",
    ]

    def distance(rows: str, centre: str, join: str, keep: str) -> str:
        z = ", ".join(f"(x{i} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i)) + f") / l{i}{i} AS z{i}" for i in dims)
        return f"SELECT {keep}, {z}, " + " + ".join(f"z{i} * z{i}" for i in dims) + f" AS d2 FROM {rows} r {join} {centre} c ON r.grp = c.grp"

    for k in range(q.STEPS):
        ctes.append(f"d{k} AS ({distance('u', f'c{k}', 'JOIN', 'r.grp AS grp, st, ' + xs)})")
        ctes.append(f"b{k} AS MATERIALIZED (SELECT *, floor(log2(1 + d2) * 256) AS bin FROM d{k})")
        ctes.append(f"h{k} AS (SELECT grp, st, bin, sum(count(*)) OVER (PARTITION BY grp, st ORDER BY bin) AS cum, sum(count(*)) OVER (PARTITION BY grp, st) AS n FROM b{k} GROUP BY grp, st, bin)")
        ctes.append(f"e{k} AS (SELECT grp, st, min(bin) AS last FROM h{k} WHERE cum >= ceil({q.H} * n) GROUP BY grp, st)")
        ctes.append(f"s{k} AS MATERIALIZED (SELECT b.grp, b.st, {sums} FROM b{k} b JOIN e{k} e ON b.grp = e.grp AND b.st = e.st AND bin <= last GROUP BY b.grp, b.st)")
        ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT grp, st, {means}, {chol(spread)} FROM s{k})")
    least = " * ".join(f"l{i}{i}" for i in dims)
    ctes.append(f"won AS (SELECT grp, arg_min(st, ({least}, st)) AS st FROM c{q.STEPS} GROUP BY grp)")
    scaled = {(i, j): f"{q.consistency()!r}::DOUBLE * (p{i}{j} - m{i} * m{j})" for i, j in lower}
    ctes.append(f"last AS (SELECT s.grp, {means}, {chol(scaled)} FROM s{q.STEPS - 1} s JOIN won w ON s.grp = w.grp AND s.st = w.st)")
    cols = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"
    ctes.append(f"far AS ({distance('v', 'last', 'LEFT JOIN', cols)})")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {cols}, NOT base_failed AND coalesce(d2 <= {q.CUTOFF}, true) AS kept FROM far"


ORACLES["op8_quality_rules"] = _quality_sql()

"""Queries over the supplied tables, each with the same question in SQL.

Two kinds. Some ask an operator's question of ordinary rows (ranges, trees, windows, closures). The others make PDF
files out of rows, run the PDF operators on the files, and compare with SQL over the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import ranges as R
from .operators import files as ops
from .operators import synth
from .plans import closure, selection, tree
from .sources import pdf

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return pdf.session_settings(spark).read.parquet(f"{sf}/{name}.parquet")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as documents: ``doc_id, page_no, text``."""
    return table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), "text")


def turn_counts(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"))


def pdfs(spark: SparkSession, sf: str, damage: bool = False) -> DataFrame:
    return synth.from_rows(turns(spark, sf), damage=damage)


COUNTS = "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id"


# --- counting


@query(f"SELECT conv_id::BIGINT AS conv_id, n AS pages FROM ({COUNTS})")
def page_count_strict(spark, sf):
    t = pdf.load(pdfs(spark, sf), keep=())
    return tree.page_counts(t, tree.pages(t)).select(F.col("doc_id").cast("long").alias("conv_id"), F.col("strict").alias("pages"))


@query(f"""SELECT conv_id, CASE conv_id % 4 WHEN 1 THEN 2 WHEN 2 THEN n WHEN 3 THEN n ELSE n END AS fast, n AS strict FROM ({COUNTS})""")
def page_count_fast(spark, sf):
    """A plausible lie about the number of pages is trusted; a negative or huge one is not."""
    d = turns(spark, sf)
    lie = F.when(F.col("doc_id").cast("long") % 4 == 1, F.lit(2)).when(F.col("doc_id").cast("long") % 4 == 2, F.lit(-3)).when(F.col("doc_id").cast("long") % 4 == 3, F.lit(1_000_000))
    n = turn_counts(spark, sf)
    files = synth.from_rows(d.join(n, "doc_id").withColumn("declared", F.coalesce(lie, F.col("n")).cast("int")), count_delta=True)
    t = pdf.load(files, keep=())
    return tree.page_counts(t, tree.pages(t)).select(F.col("doc_id").cast("long").alias("conv_id"), "fast", "strict")


# --- ranges


def _range(spark, sf, spec: str) -> DataFrame:
    c = turn_counts(spark, sf)
    p = selection.select_pages(c.select("doc_id", F.lit(spec).alias("spec"), F.lit("o").alias("output")), c)
    return p.select(F.col("doc_id").cast("long").alias("conv_id"), "ord", "page_no")


@query(f"""SELECT conv_id, p - 1 AS ord, p AS page_no FROM (SELECT conv_id, unnest(generate_series(1, 3)) AS p, n FROM ({COUNTS}) WHERE n >= 3)""")
def range_forward(spark, sf):
    return _range(spark, sf, "1-3")


@query(f"""SELECT conv_id, o AS ord, CASE o WHEN 0 THEN n WHEN 1 THEN n - 1 ELSE 1 END AS page_no FROM (SELECT conv_id, n, unnest([0, 1, 2])::BIGINT AS o FROM ({COUNTS}) WHERE n >= 2)""")
def range_reverse(spark, sf):
    return _range(spark, sf, "z, r2,1")


@query(f"""SELECT conv_id, n - p AS ord, p AS page_no FROM (SELECT conv_id, n, unnest(generate_series(n, 1, -1)) AS p FROM ({COUNTS}))""")
def range_descending(spark, sf):
    return _range(spark, sf, "z-1")


@query(f"""
WITH c AS ({COUNTS}),
listed AS (SELECT conv_id, unnest([n, 1, 2, n, 1]) AS p, unnest([0, 1, 2, 3, 4]) AS o, n FROM c WHERE n >= 2)
SELECT conv_id, p AS page_no, min(o)::BIGINT AS first_ord FROM listed GROUP BY conv_id, p""")
def range_dedupe_ordered(spark, sf):
    c = turn_counts(spark, sf)
    pages = R.resolve(F.lit("z,1-2,z,1"), "n")
    d = c.select("doc_id", pages.alias("pages")).where("pages is not null").select("doc_id", "pages", F.explode(R.dedupe(F.col("pages"))).alias("page_no"))
    return d.select(F.col("doc_id").cast("long").alias("conv_id"), "page_no", (F.array_position("pages", F.col("page_no")) - 1).alias("first_ord"))


SPECS = ["1-3", "z", "r2", "1-z", " 1 - z ", "z,1-z", "5,2-9,3", "12", "2-r1", "+5", "1-1"]


@query("""
WITH s AS (SELECT unnest(['1-3', 'z', 'r2', '1-z', ' 1 - z ', 'z,1-z', '5,2-9,3', '12', '2-r1', '+5', '1-1']) AS spec)
SELECT spec, CASE WHEN regexp_matches(spec, '[zr]') THEN NULL ELSE list_max(list_transform(string_split_regex(spec, '[,-]'), lambda x: trim(x)::BIGINT)) END AS max_page,
  regexp_matches(spec, '^\\s*1\\s*-\\s*z\\s*$') AS whole FROM s""")
def range_bounds(spark, sf):
    s = pdf.session_settings(spark).createDataFrame([(x,) for x in SPECS], "spec string")
    return s.select("spec", R.bounded_max("spec").cast("long").alias("max_page"), R.is_full_document("spec").alias("whole"))


@query("""
SELECT * FROM (VALUES ('', 'empty_group'), ('1;2', 'group_separator'), ('1,,2', 'empty_range'), ('1-', 'empty_range'), ('-3', 'empty_range'), ('0', 'zero_page'),
  ('r0', 'zero_page'), ('1-2-3', 'invalid_number'), ('Z', 'invalid_number'), ('r 3', 'invalid_number'), ('99', 'out_of_bounds:99'), ('r99', 'out_of_bounds:99'), ('2,z', NULL)) AS t(spec, error)""")
def range_errors(spark, sf):
    bad = ["", "1;2", "1,,2", "1-", "-3", "0", "r0", "1-2-3", "Z", "r 3", "99", "r99", "2,z"]
    return pdf.session_settings(spark).createDataFrame([(x,) for x in bad], "spec string").select("spec", R.resolve_error("spec", F.lit(10)).alias("error"))


# --- split and merge as relations


@query(f"""
WITH c AS ({COUNTS}), r AS (SELECT conv_id, n, unnest(generate_series(1, n)) AS p FROM c)
SELECT conv_id, 'head' AS output, p - 1 AS ord, p AS page_no FROM r WHERE p <= 2 AND n >= 2
UNION ALL SELECT conv_id, 'tail', p - 3, p FROM r WHERE p >= 3""")
def split_outputs(spark, sf):
    c = turn_counts(spark, sf)
    specs = c.select("doc_id", F.explode(F.array(F.struct(F.lit("head").alias("output"), F.lit("1-2").alias("spec")), F.struct(F.lit("tail").alias("output"), F.lit("3-z").alias("spec")))).alias("s"), F.col("n").alias("m"))
    specs = specs.where((F.col("s.output") == "head") | (F.col("m") >= 3)).select("doc_id", "s.output", "s.spec")
    p = selection.select_pages(specs, c)
    return p.select(F.col("doc_id").cast("long").alias("conv_id"), "output", "ord", "page_no")


@query("""
WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey),
k AS (SELECT l_orderkey, n, (n + 3) // 4 AS files, unnest(generate_series(1, (n + 3) // 4)) AS chunk FROM c)
SELECT l_orderkey, chunk, (chunk - 1) * 4 + 1 AS first, least(chunk * 4, n) AS last, replace('out/%d.pdf', '%d', lpad(chunk::VARCHAR, length(files::VARCHAR)::INT, '0')) AS path FROM k""")
def split_pages_chunks(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("n"))
    k = selection.chunks(c, 4)
    return k.select(F.col("doc_id").alias("l_orderkey"), "chunk", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), selection.output_path("out/%d.pdf", F.col("name_no")).alias("path"))


def _merge_inputs(spark, sf) -> tuple[DataFrame, DataFrame]:
    c = turn_counts(spark, sf)
    i = c.select(F.floor(F.col("doc_id").cast("long") / 3).alias("output"), (F.col("doc_id").cast("long") % 3).cast("int").alias("input_ord"), "doc_id", F.when(F.col("doc_id").cast("long") % 3 == 1, F.lit("2-1;z")).alias("spec"))
    return i, c


@query(f"""
WITH c AS ({COUNTS}),
p AS (
  SELECT conv_id // 3 AS output, conv_id % 3 AS i, conv_id, 0 AS g, p AS o, p AS page_no FROM (SELECT conv_id, unnest(generate_series(1, n)) AS p FROM c WHERE conv_id % 3 <> 1)
  UNION ALL SELECT conv_id // 3, 1, conv_id, 0, o, 3 - o FROM (SELECT conv_id, unnest([1, 2]) AS o FROM c WHERE conv_id % 3 = 1 AND n >= 2)
  UNION ALL SELECT conv_id // 3, 1, conv_id, 1, 1, n FROM c WHERE conv_id % 3 = 1)
SELECT output::BIGINT AS output, conv_id::BIGINT AS conv_id, page_no::BIGINT AS page_no, row_number() OVER (PARTITION BY output ORDER BY i, g, o) AS new_page_no FROM p""")
def merge_order(spark, sf):
    i, c = _merge_inputs(spark, sf)
    m = selection.merge_order(i, c)
    return m.select("output", F.col("doc_id").cast("long").alias("conv_id"), "page_no", "new_page_no")


@query("SELECT (conv_id // 3)::BIGINT AS output, min(conv_id)::BIGINT AS donor FROM conversations GROUP BY conv_id // 3")
def merge_metadata_first(spark, sf):
    i, _ = _merge_inputs(spark, sf)
    return selection.donor(i).select("output", F.col("doc_id").cast("long").alias("donor"))


@query("""
SELECT regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '^https?://(www\\.|m\\.|blog\\.)?([^/]*)/.*$', '\\2') AS path, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1""")
def duplicate_paths(spark, sf):
    u = F.regexp_replace(F.regexp_replace(F.lower("url"), "[?#].*$", ""), r"^https?://(www\.|m\.|blog\.)?([^/]*)/.*$", "$2")
    return selection.duplicate_paths(table(spark, sf, "pages").select(u.alias("path")))


# --- trees, inheritance, geometry


@query("""
WITH RECURSIVE w(id, depth, path) AS (
  SELECT 0::BIGINT, 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT p.p_partkey, w.depth + 1, list_append(w.path, p.p_partkey) FROM w JOIN part p ON p.p_partkey > 0 AND (p.p_partkey - 1) // 10 = w.id)
SELECT id AS p_partkey, depth, row_number() OVER (ORDER BY path) AS position FROM w""")
def tree_walk(spark, sf):
    """Parts as a tree of ten kids a node, in depth-first order."""
    t = _part_tree(spark, sf)
    w = tree.walk(t)
    # the order of a whole tree has one sequence; it is asked for here, so one task numbers it
    return w.select(F.col("obj").alias("p_partkey"), F.col("depth").cast("long").alias("depth"), F.row_number().over(Window.partitionBy("doc_id").orderBy("path")).cast("long").alias("position"))


def _part_tree(spark, sf) -> dict[str, DataFrame]:
    p = table(spark, sf, "part")
    none = F.lit(None)
    one = F.lit("parts").alias("doc_id")
    return {
        "documents": spark.range(1).select(one, F.lit(0).cast("long").alias("pages_root"), none.cast("string").alias("error")),
        "objects": p.select(one, F.col("p_partkey").alias("obj"), F.lit("dictionary").alias("kind"), F.lit("Pages").alias("type"), none.cast("array<float>").alias("media"), none.cast("array<float>").alias("crop"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_size")).alias("rotate")),
        "page_edges": p.where("p_partkey > 0").select(one, F.floor((F.col("p_partkey") - 1) / 10).alias("parent"), F.pmod(F.col("p_partkey") - 1, F.lit(10)).cast("int").alias("ord"), F.col("p_partkey").alias("kid"), none.cast("string").alias("message")),
    }


@query("""
WITH RECURSIVE w(id, v) AS (
  SELECT p_partkey, p_size FROM part WHERE p_partkey = 0 UNION ALL
  SELECT p.p_partkey, CASE WHEN p.p_partkey % 7 = 0 THEN p.p_size ELSE w.v END FROM w JOIN part p ON p.p_partkey > 0 AND (p.p_partkey - 1) // 10 = w.id)
SELECT id AS p_partkey, v AS inherited FROM w""")
def inherit_nearest(spark, sf):
    return tree.walk(_part_tree(spark, sf)).select(F.col("obj").alias("p_partkey"), F.col("rotate").alias("inherited"))


_BOX = """
WITH b AS (
  SELECT p_partkey, (p_size * 10 % 700)::FLOAT AS a0, (p_partkey % 300)::FLOAT AS a1, (p_partkey % 977)::FLOAT AS a2, (p_size * 13 % 800)::FLOAT AS a3,
    CASE WHEN p_partkey % 3 = 0 THEN [(p_partkey % 50)::FLOAT, 0::FLOAT, 500::FLOAT, (100 + p_partkey % 600)::FLOAT] END AS crop, (p_partkey % 9 - 4) * 45 AS turn FROM part),
m AS (SELECT p_partkey, turn, [least(a0, a2), least(a1, a3), greatest(a0, a2), greatest(a1, a3)] AS media, crop FROM b),
e AS (SELECT p_partkey, turn, media, coalesce(crop, media) AS c FROM m),
d AS (SELECT p_partkey, turn, (least(media[3], c[3]) - greatest(media[1], c[1]))::FLOAT AS w, (least(media[4], c[4]) - greatest(media[2], c[2]))::FLOAT AS h FROM e),
f AS (SELECT p_partkey, ((turn % 360) + 360) % 360 AS t, w <= 1 / 4096.0 OR h <= 1 / 4096.0 AS bad, w, h FROM d),
g AS (SELECT p_partkey, CASE WHEN t IN (90, 180, 270) THEN t ELSE 0 END AS r, CASE WHEN bad THEN (210 * 72 / 25.4::DOUBLE)::FLOAT ELSE greatest(w, 1::FLOAT) END AS w, CASE WHEN bad THEN (297 * 72 / 25.4::DOUBLE)::FLOAT ELSE greatest(h, 1::FLOAT) END AS h FROM f),
s AS (SELECT p_partkey, r, CASE WHEN r IN (90, 270) THEN h ELSE w END AS width, CASE WHEN r IN (90, 270) THEN w ELSE h END AS height FROM g)
"""


def _boxes(spark, sf) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    f = lambda c: c.cast("float")
    return table(spark, sf, "part").select(
        "p_partkey", G.rectangle(s * 10 % 700, k % 300, k % 977, s * 13 % 800).alias("media"),
        F.when(k % 3 == 0, F.array(f(k % 50), f(F.lit(0)), f(F.lit(500)), f(100 + k % 600))).alias("crop"), ((k % 9 - 4) * 45).cast("int").alias("rotate"),
    )


@query(_BOX + "SELECT p_partkey, round(width::DOUBLE * 1000)::BIGINT AS width_k, round(height::DOUBLE * 1000)::BIGINT AS height_k, r::BIGINT AS rotation FROM s")
def effective_box(spark, sf):
    d = _boxes(spark, sf).select("p_partkey", G.page_dimensions(F.col("media"), F.col("crop"), F.col("rotate")).alias("d"))
    k = lambda c: F.round(F.col(c).cast("double") * 1000).cast("long")
    return d.select("p_partkey", k("d.width").alias("width_k"), k("d.height").alias("height_k"), F.col("d.rotation").cast("long").alias("rotation"))


@query(_BOX + ", q AS (SELECT *, (unnest([72, 96, 150, 300])::FLOAT / 72::FLOAT)::FLOAT AS scale, unnest([72, 96, 150, 300]) AS dpi FROM s) SELECT p_partkey, dpi::BIGINT AS dpi, floor(width * scale)::BIGINT AS width_px, floor(height * scale)::BIGINT AS height_px FROM q")
def pixel_size(spark, sf):
    d = _boxes(spark, sf).select("p_partkey", G.page_dimensions(F.col("media"), F.col("crop"), F.col("rotate")).alias("d"), F.explode(F.array(*map(F.lit, (72, 96, 150, 300)))).alias("dpi"))
    return d.select("p_partkey", F.col("dpi").cast("long").alias("dpi"), G.pixels(F.col("d.width"), F.col("dpi")).alias("width_px"), G.pixels(F.col("d.height"), F.col("dpi")).alias("height_px"))


@query("""
WITH b AS (SELECT p_partkey // 20 AS doc, p_partkey % 20 AS page, 100 + p_partkey % 500 AS w, 200 + p_size AS h, (p_partkey % 4) * 90 AS r FROM part)
SELECT doc::BIGINT AS doc, (page + 1)::BIGINT AS page_no, CASE WHEN r IN (90, 270) THEN h ELSE w END::BIGINT AS width, CASE WHEN r IN (90, 270) THEN w ELSE h END::BIGINT AS height, r::BIGINT AS rotation FROM b""")
def dimensions_roundtrip(spark, sf):
    """Sizes written into files and read back through the page tree."""
    k = F.col("p_partkey")
    media = F.array(F.lit(0).cast("long"), F.lit(0).cast("long"), 100 + k % 500, (200 + F.col("p_size")).cast("long"))
    rows = table(spark, sf, "part").select(F.floor(k / 20).cast("string").alias("doc_id"), (k % 20 + 1).alias("page_no"), F.lit("x").alias("text"), media.alias("media"), ((k % 4) * 90).cast("int").alias("rotate"))
    t = pdf.load(synth.from_rows(rows), keep=())
    g = tree.page_geometry(tree.pages(t))
    return g.select(F.col("doc_id").cast("long").alias("doc"), F.col("page_no").cast("long").alias("page_no"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.col("rotation").cast("long").alias("rotation"))


@query("""
WITH b AS (SELECT p_partkey // 20 AS doc, p_partkey, p_partkey % 20 AS page, 100 + p_partkey % 500 AS w, 200 + p_size AS h FROM part)
SELECT doc::BIGINT AS doc, '{"pages":' || count(*) || ',"page_sizes":[' || string_agg('{"width":' || w || ',"height":' || h || ',"rotation":0}', ',' ORDER BY page) || ']}' AS json FROM b GROUP BY doc""")
def dimensions_json(spark, sf):
    k = F.col("p_partkey")
    d = table(spark, sf, "part").select(F.floor(k / 20).alias("doc_id"), (k % 20).alias("page_no"), (100 + k % 500).cast("float").alias("width"), (200 + F.col("p_size")).cast("float").alias("height"), F.lit(0).cast("smallint").alias("rotation"))
    return tree.dimensions_json(d).select(F.col("doc_id").alias("doc"), "json")


# --- cross-reference, closure, pruning


@query("""
WITH o AS (SELECT o_orderkey, o_custkey FROM orders),
r AS (SELECT o_orderkey, 'customer' AS kind, o_custkey AS id, 1 AS depth FROM o
  UNION ALL SELECT o_orderkey, 'nation', c_nationkey, 2 FROM o JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT o_orderkey, 'region', n_regionkey, 3 FROM o JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT o_orderkey, kind, id::BIGINT AS id, depth::BIGINT AS depth FROM r""")
def reference_closure(spark, sf):
    """Orders as pages whose references lead to customer, nation and region."""
    o, c, n = (table(spark, sf, x) for x in ("orders", "customer", "nation"))
    code = lambda kind, col: F.col(col).cast("long") * 8 + kind
    edge = lambda d, a, ka, b, kb: d.select(F.lit("d").alias("doc_id"), code(ka, a).alias("src_obj"), code(kb, b).alias("dst_obj"))
    refs = edge(o, "o_orderkey", 0, "o_custkey", 1).union(edge(c, "c_custkey", 1, "c_nationkey", 2)).union(edge(n, "n_nationkey", 2, "n_regionkey", 3))
    starts = o.select(F.col("o_orderkey").alias("output"), F.lit("d").alias("doc_id"), code(0, "o_orderkey").alias("obj"))
    got = closure.closure(starts, refs).where("depth > 0")
    kind = F.element_at(F.array(F.lit("customer"), F.lit("nation"), F.lit("region")), F.col("depth"))
    return got.select(F.col("output").alias("o_orderkey"), kind.alias("kind"), F.shiftright("obj", 3).alias("id"), F.col("depth").cast("long").alias("depth"))


_NAMES = """
WITH names AS (SELECT DISTINCT l_orderkey AS scope, CASE WHEN l_partkey % 3 = 0 THEN 'ColorSpace' WHEN l_partkey % 3 = 1 THEN 'Font' ELSE 'XObject' END AS kind, 'N' || l_partkey AS name FROM lineitem),
used AS (SELECT * FROM names WHERE substr(name, 2)::BIGINT % 5 < 3 UNION SELECT l_orderkey, 'Font', 'missing' FROM lineitem WHERE l_orderkey % 11 = 0),
big AS (SELECT scope FROM names WHERE kind IN ('Font', 'XObject') GROUP BY scope HAVING count(*) > 6),
lost AS (SELECT DISTINCT scope FROM used u WHERE kind IN ('Font', 'XObject') AND NOT EXISTS (SELECT 1 FROM names n WHERE n.scope = u.scope AND n.kind = u.kind AND n.name = u.name))
"""


def _names(spark, sf) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_partkey") % 3 == 0, "ColorSpace").when(F.col("l_partkey") % 3 == 1, "Font").otherwise("XObject")
    names = li.select(F.col("l_orderkey").alias("scope"), kind.alias("kind"), F.concat(F.lit("N"), F.col("l_partkey")).alias("name")).distinct()
    used = names.where(F.substring("name", 2, 20).cast("long") % 5 < 3).union(li.where("l_orderkey % 11 = 0").select("l_orderkey", F.lit("Font"), F.lit("missing")).distinct())
    return names, used


@query(_NAMES + """
SELECT scope, kind, name FROM names n WHERE scope NOT IN (SELECT scope FROM big) OR scope IN (SELECT scope FROM lost) OR kind = 'ColorSpace'
  OR EXISTS (SELECT 1 FROM used u WHERE u.scope = n.scope AND u.kind = n.kind AND u.name = n.name)""")
def resource_prune(spark, sf):
    return closure.pruned_names(*_names(spark, sf))


@query(_NAMES + "SELECT scope FROM lost")
def unresolved_names(spark, sf):
    names, used = _names(spark, sf)
    return closure.unresolved(used, names)


@query("""
SELECT l_partkey AS obj FROM (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem) GROUP BY l_partkey HAVING count(*) = (SELECT count(DISTINCT l_linenumber) FROM lineitem)""")
def shared_closure(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("obj")).distinct()
    return closure.shared(li, li.select("page").distinct())


# --- percentiles


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (WHERE k = ceil(n * 0.5)) AS p50, max(value) FILTER (WHERE k = ceil(n * 0.95)) AS p95 FROM r GROUP BY event_type""")
def throughput_percentiles(spark, sf):
    """Nearest-rank percentiles by exact distributed aggregation."""
    e = table(spark, sf, "events").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy("event_type")
    e = e.withColumn("cum", F.sum("c").over(w.orderBy("value"))).withColumn("n", F.sum("c").over(w))
    at = lambda p: F.min(F.when(F.col("cum") >= F.ceil(F.col("n") * p), F.col("value")))
    return e.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


# --- round trips through files

_PAGES = "SELECT conv_id, turn + 1 AS page_no, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations"


def _page_texts(files: DataFrame) -> DataFrame:
    return _texts(ops.extract_text(files))


def _texts(t: DataFrame, *more: str) -> DataFrame:
    return t.select("doc_id", F.col("page").cast("long").alias("page_no"), F.array_join(F.transform("runs", lambda r: r["text"]), " ").alias("text"), *more)


@query(_PAGES)
def text_roundtrip(spark, sf):
    return _page_texts(pdfs(spark, sf)).select(F.col("doc_id").cast("long").alias("conv_id"), "page_no", "text")


@query(f"""
WITH p AS ({_PAGES}), c AS ({COUNTS}),
m AS (
  SELECT conv_id // 3 AS output, conv_id % 3 AS i, 0 AS g, page_no AS o, text FROM p WHERE conv_id % 3 <> 1
  UNION ALL SELECT p.conv_id // 3, 1, CASE WHEN k = 3 THEN 1 ELSE 0 END, k, text FROM p JOIN c USING (conv_id) JOIN (SELECT unnest([1, 2, 3]) AS k) ON page_no = CASE k WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE n END WHERE conv_id % 3 = 1 AND n >= 2)
SELECT output::BIGINT AS output, row_number() OVER (PARTITION BY output ORDER BY i, g, o) AS page_no, text FROM m""")
def merge_roundtrip(spark, sf):
    i, _ = _merge_inputs(spark, sf)
    m = ops.merge(pdfs(spark, sf), i)
    return _page_texts(m.select(F.col("output").cast("string").alias("doc_id"), "content")).select(F.col("doc_id").cast("long").alias("output"), "page_no", "text")


@query(f"WITH p AS ({_PAGES}) SELECT conv_id, ((page_no - 1) // 2 + 1)::BIGINT AS chunk, ((page_no - 1) % 2 + 1)::BIGINT AS page_no, text FROM p")
def split_roundtrip(spark, sf):
    s = ops.split_pages(pdfs(spark, sf), "%d", 2)
    files = s.select(F.concat("doc_id", F.lit("/"), "path").alias("doc_id"), "content")
    part = F.split("doc_id", "/")
    return _page_texts(files).select(part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("chunk"), "page_no", "text")


@query(f"SELECT conv_id, n AS pages, true AS repaired FROM ({COUNTS})")
def repair_roundtrip(spark, sf):
    """Files cut off before their cross-reference table."""
    t = pdf.load(pdfs(spark, sf, damage=True), keep=())
    counts = tree.page_counts(t, tree.pages(t)).join(t["documents"].select("doc_id", "repaired"), "doc_id")
    return counts.select(F.col("doc_id").cast("long").alias("conv_id"), F.col("strict").alias("pages"), "repaired")


@query("SELECT doc_id, sha256(text) AS sha, octet_length(encode(text)) AS n_bytes FROM documents")
def filter_chain_roundtrip(spark, sf):
    """Texts through ASCIIHex, RunLength and Flate and back."""
    from .operators.streams import decode_streams, encode_streams

    d = table(spark, sf, "documents").select("doc_id", F.encode(F.col("text"), "UTF-8").alias("data"), F.array(F.lit("AHx"), F.lit("RL"), F.lit("Fl")).alias("filters"))
    out = decode_streams(encode_streams(d))
    return out.select("doc_id", F.sha2("data", 256).alias("sha"), F.octet_length("data").cast("long").alias("n_bytes"))


@query(f"SELECT c.conv_id, c.n AS pages, 612::BIGINT AS width, 792::BIGINT AS height FROM ({COUNTS}) c")
def pages_with_sizes(spark, sf):
    """The flagship: pages of every file, counted and measured."""
    t = pdf.load(pdfs(spark, sf), keep=())
    g = tree.page_geometry(tree.pages(t))
    return g.groupBy(F.col("doc_id").cast("long").alias("conv_id")).agg(F.count("*").alias("pages"), F.max("width").cast("long").alias("width"), F.max("height").cast("long").alias("height"))

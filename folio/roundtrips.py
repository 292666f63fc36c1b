"""Queries that make PDF files out of rows, run the operators on the files, and are compared with SQL over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import files as ops
from .operators import synth
from .operators.streams import decode_streams, encode_streams
from .plans import closure, tree
from .queries import _PAGES, COUNTS, _merge_inputs, _page_texts, _texts, pdfs, query, table, turn_counts, turns
from .scratch import shared_dir, stage
from .sources import pdf


def pick(key: Column, *values: str | None) -> Column:
    """One of ``values`` by the remainder of ``key``."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.pmod(key.cast("long"), F.lit(len(values))) + 1).cast("int"))


def conv(c: str = "doc_id") -> Column:
    return F.col(c).cast("long").alias("conv_id")


def sealed(spark, sf, password: bool) -> DataFrame:
    kinds = pick(F.col("doc_id"), "rc4", "aes128", None, "rc4", "aes128", None, "rc4", "aes256")
    return synth.from_rows(turns(spark, sf).withColumn("seal", kinds).withColumn("password", F.lit(password)))


# --- encryption


@query(_PAGES)
def encrypted_text(spark, sf):
    """RC4, AES of 128 and of 256 bits with an owner's password only: they open without one."""
    return _page_texts(sealed(spark, sf, False)).select(conv(), "page_no", "text")


@query(f"SELECT conv_id, CASE WHEN conv_id % 8 IN (2, 5) THEN n ELSE -1 END AS locked, n AS opened, CASE WHEN conv_id % 8 NOT IN (2, 5) THEN 'password' END AS code FROM ({COUNTS})")
def password_needed(spark, sf):
    """Files with a user's password: an error without it, the count with the owner's."""
    files = stage(sealed(spark, sf, True), "sealed")
    shut = ops.page_count(files).select("doc_id", F.coalesce("pages", F.lit(-1)).alias("locked"), F.col("error.code").alias("code"))
    opened = ops.page_count(files, password="owner").select("doc_id", F.col("pages").alias("opened"))
    return shut.join(opened, "doc_id").select(conv(), "locked", "opened", "code")


# --- layouts and damage


def laid_out(spark, sf) -> DataFrame:
    return synth.from_rows(turns(spark, sf).withColumn("layout", pick(F.col("doc_id"), "packed", "hybrid", "updated", "plain")))


@query(_PAGES)
def layouts_text(spark, sf):
    """Object and cross-reference streams, hybrid files, incremental updates."""
    return _page_texts(laid_out(spark, sf)).select(conv(), "page_no", "text")


@query(f"""
SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN n + 2 WHEN 1 THEN n + 3 WHEN 2 THEN 2 * n + 6 ELSE 2 * n + 4 END AS plain,
  CASE conv_id % 4 WHEN 0 THEN n + 4 WHEN 1 THEN n + 3 ELSE 0 END AS members, CASE WHEN conv_id % 4 = 2 THEN 2 ELSE 0 END AS renewed FROM ({COUNTS})""")
def xref_latest_wins(spark, sf):
    """Of every object its newest entry: how many are plain, how many lie in object streams, how many an update renewed."""
    x = pdf.load(laid_out(spark, sf), keep=())["xref"]
    first = x.groupBy("doc_id", "obj").agg(F.max_by("place", "section_no").alias("oldest"))
    w = tree.latest_wins(x).join(first, ["doc_id", "obj"])
    count = lambda c: F.sum(c.cast("long"))
    return w.groupBy("doc_id").agg(count(F.col("kind") == "plain").alias("plain"), count(F.col("kind") == "member").alias("members"), count(F.col("place") != F.col("oldest")).alias("renewed")).select(conv(), "plain", "members", "renewed")


@query("""
WITH x AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS obj FROM lineitem)
SELECT doc_id, obj::BIGINT AS obj FROM x m WHERE obj % 2 = 0 AND NOT EXISTS (SELECT 1 FROM x p WHERE p.doc_id = m.doc_id AND p.obj = m.obj + 1)""")
def orphan_members(spark, sf):
    """Lines of orders as entries: even ones lie in the container with the next number, odd ones are plain."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("obj")).distinct()
    member = F.col("obj") % 2 == 0
    x = li.select("doc_id", F.lit(0).alias("section_no"), "obj", F.when(member, "member").otherwise("plain").alias("kind"), F.when(member, F.col("obj") + 1).otherwise(0).alias("place"), F.lit(0).alias("gen_or_index"))
    return tree.orphan_members(x).select("doc_id", "obj")


@query(f"SELECT conv_id, n AS pages, true AS repaired FROM ({COUNTS})")
def repair_kinds(spark, sf):
    """Cut off, junk in front, offsets that are wrong, no trailer, no end."""
    damage = pick(F.floor(F.col("doc_id").cast("long") / 2), "cut", "junk", "shifted", "trailer", "tail")
    layout = F.when(damage == "tail", "packed").otherwise("plain")
    t = pdf.load(synth.from_rows(turns(spark, sf).withColumn("damage", damage).withColumn("layout", layout)), keep=())
    c = tree.page_counts(t, tree.pages(t)).join(t["documents"].select("doc_id", "repaired"), "doc_id")
    return c.select(conv(), F.col("strict").alias("pages"), "repaired")


@query(_PAGES)
def repair_text(spark, sf):
    """The same files read for text: what is damaged is rebuilt on the way."""
    damage = pick(F.col("doc_id"), "cut", "junk", "shifted", "trailer", "tail")
    layout = F.when(damage == "tail", "packed").otherwise("plain")
    return _page_texts(synth.from_rows(turns(spark, sf).withColumn("damage", damage).withColumn("layout", layout))).select(conv(), "page_no", "text")


@query(f"SELECT conv_id, 'pdf' AS code, true AS damaged FROM ({COUNTS})")
def repair_refused(spark, sf):
    """Damaged files that were encrypted are not rebuilt."""
    d = turns(spark, sf).withColumn("seal", F.lit("rc4")).withColumn("damage", pick(F.col("doc_id"), "shifted", "junk"))
    e = ops.page_count(synth.from_rows(d), strict=True)
    return e.select(conv(), "error.code", F.col("error.message").contains("damaged cross-reference").alias("damaged"))


# --- filters


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def filter_predictors(spark, sf):
    """Texts through LZW, ASCII85 and Flate with TIFF and PNG predictors, and back."""
    k = F.col("doc_id").cast("long")
    chains = [(["A85", "LZW"], None), (["A85", "LZW"], 2), (["Fl"], 10), (["LZW"], 11), (["A85", "Fl"], 12), (["Fl"], 13), (["LZW"], 14)]
    at = (F.pmod(k, F.lit(len(chains))) + 1).cast("int")
    filters = F.element_at(F.array(*[F.array(*map(F.lit, f)) for f, _ in chains]), at)
    parms = F.element_at(F.array(*[F.lit(None if p is None else "[" + "null, " * (len(f) - 1) + f'{{"Predictor": {p}, "Columns": 7}}]').cast("string") for f, p in chains]), at)
    data = F.encode(F.col("text"), "UTF-8")
    d = table(spark, sf, "documents").select("doc_id", data.alias("data"), filters.alias("filters"), parms.alias("parms"), F.octet_length(data).alias("n"))
    out = decode_streams(encode_streams(d))
    # predictors work on whole rows: what fills the last one up is cut off
    return out.select("doc_id", F.sha2(F.expr("substring(data, 1, n)"), 256).alias("sha"))


# --- page trees


@query(f"SELECT conv_id, 2::BIGINT AS fast, n AS strict FROM ({COUNTS}) WHERE conv_id % 4 = 1 AND n <> 2")
def suspicious_counts(spark, sf):
    n = turn_counts(spark, sf)
    declared = F.when(F.col("doc_id").cast("long") % 4 == 1, F.lit(2)).otherwise(F.col("n")).cast("int")
    t = pdf.load(synth.from_rows(turns(spark, sf).join(n, "doc_id").withColumn("declared", declared), count_delta=True), keep=())
    return tree.suspicious(tree.page_counts(t, tree.pages(t))).select(conv(), "fast", "strict")


@query("""
SELECT DISTINCT p_partkey // 20 AS doc, 'page tree cycle detected at object ' || CASE WHEN p_partkey // 20 % 3 = 0 THEN 7 ELSE 0 END AS message
FROM part WHERE p_partkey // 20 % 3 < 2 AND p_partkey % 20 = 7""")
def tree_guards(spark, sf):
    """Trees of twenty nodes: in every third one node is listed twice, in every third the root is listed."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(F.floor(k / 20).alias("doc_id"), (k % 20).alias("obj"))
    p = p.join(p.where("obj = 7").select("doc_id"), "doc_id")
    none = F.lit(None)
    kind = F.when(F.col("obj").isin(0, 5, 6), "Pages").otherwise("Page")
    edge = lambda d, parent, kid: d.select("doc_id", F.lit(parent).cast("long").alias("parent"), F.lit(0).alias("ord"), kid.cast("long").alias("kid"), none.cast("string").alias("message"))
    docs = p.select("doc_id").distinct()
    t = {
        "documents": docs.select("doc_id", F.lit(0).cast("long").alias("pages_root"), none.cast("string").alias("error")),
        "objects": p.select("doc_id", "obj", F.lit("dictionary").alias("kind"), kind.alias("type"), *[none.cast("array<float>").alias(c) for c in ("media", "crop")], none.cast("int").alias("rotate")),
        "page_edges": edge(p.where("obj > 0"), 0, F.col("obj")).union(edge(docs.where("doc_id % 3 = 0"), 5, F.lit(7))).union(edge(docs.where("doc_id % 3 = 1"), 6, F.lit(0))),
    }
    return tree.tree_errors(t, tree.walk(t)).select(F.col("doc_id").alias("doc"), "message")


# --- copying


@query(f"SELECT conv_id, page_no, 3::BIGINT AS objects, 3::BIGINT AS last_number, 1::BIGINT AS cut FROM ({_PAGES})")
def page_closures(spark, sf):
    """What each page needs (itself, its content, its font), in new numbers; the way up to its parent is cut."""
    t = pdf.load(pdfs(spark, sf))
    pages = stage(tree.pages(t).select(F.concat("doc_id", F.lit("/"), "page_no").alias("output"), "doc_id", "obj"), "pages")
    closed = stage(closure.closure(pages, closure.page_refs(t["refs"], t["objects"])), "closed")
    numbered = stage(closure.renumber(closure.with_values(closed, t["objects"])), "numbered")
    cut = closure.rewritten_refs(numbered, t["refs"]).where("new_dst is null").groupBy("output").agg(F.count("*").alias("cut"))
    n = numbered.groupBy("output").agg(F.count("*").alias("objects"), F.max("new_obj").alias("last_number")).join(cut, "output")
    part = F.split("output", "/")
    return n.select(part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("page_no"), "objects", "last_number", "cut")


@query(f"SELECT conv_id, 2::BIGINT AS roots FROM ({COUNTS})")
def structure_references(spark, sf):
    """References from copied pages into the structure that stays behind: the tree's root and the catalog's way to it."""
    t = pdf.load(pdfs(spark, sf))
    copied = tree.pages(t).select("doc_id", "obj")
    return closure.structure_refs(t["refs"], t["objects"], copied).groupBy("doc_id").agg((F.count_distinct("dst_obj") + F.count(F.when(F.col("key_path") == "/Pages", 1))).alias("roots")).select(conv(), "roots")


def _pages_of(files: DataFrame) -> DataFrame:
    """``doc_id, page_no, value`` with the page's dictionary as JSON."""
    t = pdf.load(files)
    return tree.pages(t).join(t["objects"].select("doc_id", "obj", "value"), ["doc_id", "obj"]).select("doc_id", "page_no", "value")


@query(f"SELECT conv_id, page_no, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 5 END::BIGINT AS fonts FROM ({_PAGES})")
def pruned_fonts(spark, sf):
    """Pages that name eight fonts and use one keep that one; those that name five keep all."""
    d = turns(spark, sf).withColumn("fonts", F.when(F.col("doc_id").cast("long") % 2 == 0, 8).otherwise(5))
    s = ops.split_pages(synth.from_rows(d), "%d", 1).select(F.concat("doc_id", F.lit("/"), "path").alias("doc_id"), "content")
    p = _pages_of(s)
    part = F.split("doc_id", "/")
    fonts = F.size(F.json_object_keys(F.get_json_object("value", "$.Resources.Font"))).cast("long")
    return p.select(part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("page_no"), fonts.alias("fonts"))


@query("""
SELECT p_partkey // 10 AS doc, p_partkey % 10 + 1 AS page_no, 1::BIGINT AS forms, 'form ' || p_partkey AS text FROM part""")
def pruned_forms(spark, sf):
    """Pages that name eight forms and draw one, split: the form that is drawn is left and its text is read."""
    k = F.col("p_partkey")
    forms = F.map_from_arrays(F.array(*[F.lit(f"X{i}") for i in range(8)]), F.array(*[F.concat(F.lit("BT /F1 9 Tf 72 700 Td (form "), k + (i - 3), F.lit(") Tj ET")) for i in range(8)]))
    rows = table(spark, sf, "part").select(F.floor(k / 10).cast("string").alias("doc_id"), (k % 10 + 1).alias("page_no"), F.lit("% a comment\n/X3 Do").alias("raw"), forms.alias("forms"))
    s = ops.split_pages(synth.from_rows(rows), "%d", 1).select(F.concat("doc_id", F.lit("/"), F.col("path").cast("int").cast("string")).alias("doc_id"), "content")
    # text and dictionary of a page from one parse: files compress so well that joins of tables of them are taken for small
    left = F.size(F.json_object_keys(F.get_json_object("value", "$.Resources.XObject"))).cast("long")
    part = F.split("doc_id", "/")
    return _texts(ops.extract_text(s, values=True), "value").select(part[0].cast("long").alias("doc"), part[1].cast("long").alias("page_no"), left.alias("forms"), "text")


@query(f"""
WITH p AS ({_PAGES}), c AS ({COUNTS})
SELECT conv_id, 'head' AS output, page_no, text FROM p WHERE page_no <= 2
UNION ALL SELECT conv_id, 'back', n + 1 - page_no, text FROM p JOIN c USING (conv_id)""")
def split_text(spark, sf):
    """Two outputs of every file, one of its first two pages and one of all in reverse."""
    out = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(s).alias("spec")) for p, s in (("head", "1-2"), ("back", "z-1"))]))
    wanted = turn_counts(spark, sf).where("n >= 2").select("doc_id", out.alias("o")).select("doc_id", "o.path", "o.spec")
    s = ops.split(pdfs(spark, sf), wanted).select(F.concat("doc_id", F.lit("/"), "path").alias("doc_id"), "content")
    part = F.split("doc_id", "/")
    return _page_texts(s).select(part[0].cast("long").alias("conv_id"), part[1].alias("output"), "page_no", "text")


def _titles(files: DataFrame) -> DataFrame:
    t = pdf.load(files)
    o = t["objects"].select("doc_id", F.col("obj").alias("info"), F.get_json_object("value", "$.Title").alias("title"))
    return t["documents"].select("doc_id", "info").join(o, ["doc_id", "info"])


@query("SELECT (conv_id // 3)::BIGINT AS output, min(conv_id)::VARCHAR AS title FROM conversations GROUP BY conv_id // 3")
def merged_titles(spark, sf):
    """A merged file has the document information of its first input."""
    i, _ = _merge_inputs(spark, sf)
    m = ops.merge(pdfs(spark, sf), i)
    return _titles(m.where("content is not null").select(F.col("output").alias("doc_id"), "content")).select(F.col("doc_id").cast("long").alias("output"), "title")


@query(f"SELECT conv_id, (page_no::BIGINT) AS page_no, conv_id || CASE WHEN conv_id % 4 = 2 THEN ' anew' ELSE '' END AS title FROM ({_PAGES})")
def split_titles(spark, sf):
    """Every part of a split file has the whole one's document information, as last updated."""
    s = ops.split_pages(laid_out(spark, sf), "%d", 1).select(F.concat("doc_id", F.lit("/"), "path").alias("doc_id"), "content")
    part = F.split("doc_id", "/")
    return _titles(s).select(part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("page_no"), "title")


# --- annotations and text


def _notes(spark, sf) -> DataFrame:
    turn = F.col("page_no").cast("int")
    rect = F.array(*[F.lit(float(x)) for x in (200, 600, 300, 620)])
    note = F.struct(rect.alias("rect"), F.concat(F.lit("note "), F.col("page_no")).alias("text"), F.when(turn % 5 < 4, turn % 5).alias("flags"))
    return synth.from_rows(turns(spark, sf).withColumn("annots", F.array(note)))


@query(f"SELECT conv_id, page_no, CASE WHEN page_no % 5 NOT IN (2, 3) THEN 'note ' || page_no END AS note, 0::BIGINT AS without FROM ({_PAGES})")
def annotation_gate(spark, sf):
    """Notes on pages: hidden ones are not read, nor is any when annotations are not asked for."""
    files = stage(_notes(spark, sf), "notes")
    notes = F.filter("runs", lambda r: r["text"].startswith("note "))
    seen = ops.extract_text(files).select("doc_id", "page", F.get(notes, 0)["text"].alias("note"))
    off = ops.extract_text(files, annotations=False).select("doc_id", "page", F.size(notes).cast("long").alias("without"))
    return seen.join(off, ["doc_id", "page"]).select(conv(), F.col("page").cast("long").alias("page_no"), "note", "without")


@query(f"SELECT conv_id, 1::BIGINT AS chunk, min(turn) + 1 AS page_no, 'note ' || (min(turn) + 1) AS note FROM conversations GROUP BY conv_id")
def annotations_kept(spark, sf):
    """Notes go with their page into the first part of a split."""
    files = synth.from_rows(turns(spark, sf).withColumn("annots", F.array(F.struct(F.array(*[F.lit(float(x)) for x in (200, 600, 300, 620)]).alias("rect"), F.concat(F.lit("note "), F.col("page_no")).alias("text"), F.lit(4).alias("flags")))))
    s = ops.split_pages(files, "%d", 1).where("path rlike '^0*1$'").select("doc_id", "content")
    t = ops.extract_text(s)
    return t.select(conv(), F.lit(1).cast("long").alias("chunk"), F.col("page").cast("long").alias("page_no"), F.get(F.filter("runs", lambda r: r["text"].startswith("note ")), 0)["text"].alias("note"))


_GLYPHS = """
WITH g AS (
  SELECT user_id, event_id, (event_id % 10)::VARCHAR AS digit, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k,
    CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 0 ELSE event_id % 5 END AS c FROM events),
p AS (
  SELECT *, 7200 + 556 * (k - 1) + sum(CASE c WHEN 1 THEN 150 WHEN 2 THEN 700 WHEN 3 THEN -300 ELSE 0 END) OVER w AS x,
    70000 - 200 * sum(CASE WHEN c = 4 THEN 1 ELSE 0 END) OVER w AS y, sum(CASE WHEN k = 1 OR c >= 2 THEN 1 ELSE 0 END) OVER w AS run
  FROM g WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
"""


def _glyph_runs(spark, sf) -> DataFrame:
    """A page for each user: the last digits of its events set one by one, at the distances that the events' numbers give."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    all_before = w.rowsBetween(Window.unboundedPreceding, 0)
    k = F.row_number().over(w)
    e = table(spark, sf, "events").select("user_id", "event_id", k.alias("k"))
    c = F.when(F.col("k") == 1, F.lit(0)).otherwise(F.col("event_id") % 5)
    gap = F.when(c == 1, 150).when(c == 2, 700).when(c == 3, -300).otherwise(0)
    e = e.withColumn("x", 7200 + 556 * (F.col("k") - 1) + F.sum(gap).over(all_before)).withColumn("y", 70000 - 200 * F.sum(F.when(c == 4, 1).otherwise(0)).over(all_before))
    number = lambda v: F.concat(F.when(F.col(v) < 0, "-").otherwise(""), F.floor(F.abs(v) / 100), F.lit("."), F.lpad((F.abs(v) % 100).cast("string"), 2, "0"))
    one = F.concat(F.lit("1 0 0 1 "), number("x"), F.lit(" "), number("y"), F.lit(" Tm ("), F.col("event_id") % 10, F.lit(") Tj"))
    # the glyphs of one page
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("k", one.alias("op")))).alias("ops"))
    raw = F.concat(F.lit("BT /F1 10 Tf\n"), F.array_join(F.transform("ops", lambda o: o["op"]), "\n"), F.lit("\nET"))
    files = synth.from_rows(rows.select(F.col("user_id").alias("doc_id"), F.lit(1).alias("page_no"), raw.alias("raw")))
    t = ops.extract_text(files).select(F.col("doc_id").cast("long").alias("user_id"), F.posexplode("runs").alias("n", "r"))
    return t.select("user_id", (F.col("n") + 1).cast("long").alias("run_no"), "r.*")


@query(_GLYPHS + "SELECT user_id, run::BIGINT AS run_no, string_agg(CASE WHEN c = 1 THEN ' ' ELSE '' END || digit, '' ORDER BY k) AS text FROM p GROUP BY user_id, run")
def run_segmentation(spark, sf):
    """Which glyphs make a run and where a gap is a space."""
    return _glyph_runs(spark, sf).select("user_id", "run_no", "text")


@query(_GLYPHS + """
SELECT user_id, run::BIGINT AS run_no, arg_min(x, k)::BIGINT AS x, (79200 - arg_min(y, k) - 800)::BIGINT AS y, (arg_max(x, k) + 556 - arg_min(x, k))::BIGINT AS width, 1000::BIGINT AS height, 1000::BIGINT AS font_size
FROM p GROUP BY user_id, run""")
def run_box(spark, sf):
    """Where runs are and how large, in hundredths of a point."""
    h = lambda c: F.round(F.col(c).cast("double") * 100).cast("long").alias(c)
    return _glyph_runs(spark, sf).select("user_id", "run_no", h("x"), h("y"), h("width"), h("height"), h("font_size"))


@query("""
SELECT p_partkey // 20 AS doc, p_partkey % 20 + 1 AS page_no, p_partkey % 10 || CASE p_partkey % 3 WHEN 1 THEN '|' || p_partkey % 10 ELSE '' END AS texts FROM part""")
def glyph_filter(spark, sf):
    """Outlines over filled glyphs are no text of their own, unless they are drawn elsewhere."""
    k = F.col("p_partkey")
    word = F.concat(F.lit("("), k % 10, F.lit(") Tj"))
    twice = lambda x: F.concat(F.lit("1 0 0 1 72 700 Tm 0 Tr "), word, F.lit(f" 1 0 0 1 {x} 700 Tm 1 Tr "), word)
    shown = F.when(k % 3 == 0, twice(72)).when(k % 3 == 1, twice(300)).otherwise(F.concat(F.lit("1 0 0 1 72 700 Tm 2 Tr "), word))
    rows = table(spark, sf, "part").select(F.floor(k / 20).cast("string").alias("doc_id"), (k % 20 + 1).alias("page_no"), F.concat(F.lit("BT /F1 10 Tf "), shown, F.lit(" ET")).alias("raw"))
    t = ops.extract_text(synth.from_rows(rows))
    return t.select(F.col("doc_id").cast("long").alias("doc"), F.col("page").cast("long").alias("page_no"), F.array_join(F.transform("runs", lambda r: r["text"]), "|").alias("texts"))


@query("""
WITH s AS (SELECT s_suppkey AS doc, s_suppkey::VARCHAR AS t FROM supplier), w AS (SELECT doc, t, length(t) * 556 AS w FROM s)
SELECT doc, '[{"page":1,"page_width":612,"page_height":792,"degraded":false,"runs":[{"text":"' || t || '","x":72,"y":84,"width":' || w // 100
  || CASE WHEN w % 100 = 0 THEN '' ELSE '.' || rtrim(lpad((w % 100)::VARCHAR, 2, '0'), '0') END || ',"height":10,"font_size":10}]}]' AS json FROM w""")
def text_json(spark, sf):
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(k.alias("doc_id"), F.lit(1).alias("page_no"), F.concat(F.lit("BT /F1 10 Tf 72 700 Td ("), k, F.lit(") Tj ET")).alias("raw"))
    return ops.text_json(synth.from_rows(rows)).select(F.col("doc_id").cast("long").alias("doc"), "json")


@query("""
SELECT p_partkey // 20 AS doc, p_partkey % 20 + 1 AS page_no, CASE WHEN p_partkey % 4 IN (1, 3) THEN 792 ELSE 612 END::BIGINT AS width,
  CASE p_partkey % 4 WHEN 0 THEN 72 WHEN 1 THEN 700 WHEN 2 THEN 540 ELSE 92 END::BIGINT AS x FROM part""")
def rotated_text(spark, sf):
    """Where text is on pages that are shown turned: the edge of its run that its baseline or its start gives."""
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(F.floor(k / 20).cast("string").alias("doc_id"), (k % 20 + 1).alias("page_no"), F.lit("BT /F1 10 Tf 72 700 Td (turned) Tj ET").alias("raw"), (k % 4 * 90).cast("int").alias("rotate"))
    t = ops.extract_text(synth.from_rows(rows)).withColumn("r", F.col("runs")[0])
    turn = F.pmod(F.floor(F.col("doc_id").cast("long") * 20 + F.col("page") - 1), F.lit(4))
    # 90: the baseline is 2 points of descent right of the left edge; 180: text starts at the right edge; 270: the baseline is 2 points left of it
    x = F.when(turn == 0, F.col("r.x")).when(turn == 1, F.col("r.x") + 2).when(turn == 2, F.col("r.x") + F.col("r.width")).otherwise(F.col("r.x") + F.col("r.width") - 2)
    return t.select(F.col("doc_id").cast("long").alias("doc"), F.col("page").cast("long").alias("page_no"), F.col("page_width").cast("long").alias("width"), F.round(x).cast("long").alias("x"))


# --- drawing


@query("""
WITH p AS (SELECT p_partkey, 1 + p_partkey % 40 AS w, 1 + p_size % 30 AS h FROM part)
SELECT p_partkey // 20 AS doc, p_partkey % 20 + 1 AS page_no, c.color, CASE c.color WHEN 'ff0000' THEN w * h WHEN '0000ff' THEN 60 ELSE 60 * 50 - w * h - 60 END::BIGINT AS pixels
FROM p CROSS JOIN (VALUES ('ff0000'), ('0000ff'), ('ffffff')) AS c(color)""")
def drawn_rectangles(spark, sf):
    """Pages with a filled rectangle and a stroked line, drawn, and their pixels counted by colour."""
    k = F.col("p_partkey")
    raw = F.concat(F.lit("1 0 0 rg 5 5 "), 1 + k % 40, F.lit(" "), 1 + F.col("p_size") % 30, F.lit(" re f 0 0 1 RG 1 w 0 44.5 m 60 44.5 l S"))
    media = F.array(*[F.lit(x).cast("long") for x in (0, 0, 60, 50)])
    rows = table(spark, sf, "part").select(F.floor(k / 20).cast("string").alias("doc_id"), (k % 20 + 1).alias("page_no"), raw.alias("raw"), media.alias("media"))
    c = ops.color_counts(ops.render_pages(synth.from_rows(rows), dpi=72.0))
    return c.select(F.col("doc_id").cast("long").alias("doc"), F.col("page").cast("long").alias("page_no"), "color", "pixels")


@query("""
SELECT p_partkey // 20 AS doc, p_partkey % 20 + 1 AS page_no, floor((100 + p_partkey % 50)::FLOAT * (36::FLOAT / 72::FLOAT))::BIGINT AS width_px, floor((80 + p_size)::FLOAT * (36::FLOAT / 72::FLOAT))::BIGINT AS height_px,
  lpad((p_partkey % 20 + 1)::VARCHAR, 2, '0') AS name_no FROM part WHERE p_partkey // 20 < (SELECT count(*) // 20 FROM part)""")
def drawn_sizes(spark, sf):
    """Sizes and names of images at 36 dots an inch."""
    k = F.col("p_partkey")
    zero = F.lit(0).cast("long")
    p = table(spark, sf, "part")
    rows = p.select(F.floor(k / 20).cast("string").alias("doc_id"), (k % 20 + 1).alias("page_no"), F.lit("").alias("raw"), F.array(zero, zero, 100 + k % 50, (80 + F.col("p_size")).cast("long")).alias("media"))
    r = ops.render_pages(synth.from_rows(rows), dpi=36.0)
    full = p.count() // 20
    return r.where(F.col("doc_id").cast("long") < full).select(F.col("doc_id").cast("long").alias("doc"), F.col("page").cast("long").alias("page_no"), F.col("width_px").cast("long").alias("width_px"), F.col("height_px").cast("long").alias("height_px"), "name_no")


# --- stored files


@query(f"SELECT conv_id, n AS pages, 2 * n + 4 AS objects, 4 * n + 1 AS refs FROM ({COUNTS})")
def stored_files(spark, sf):
    """Files written and read by the data source of this package."""
    pdf.register(spark)
    top = f"{shared_dir(spark)}/stored-{sf.rstrip('/').rsplit('/', 1)[-1]}"
    files = pdfs(spark, sf)
    files.select(F.concat("doc_id", F.lit(".pdf")).alias("path"), "content").write.format("folio").mode("append").save(top)
    r = spark.read.format("folio").option("keep", "").load(top)
    count = lambda rec: F.count(F.when(F.col("rec") == rec, 1))
    n = r.groupBy("doc_id").agg(F.max("declared").alias("pages"), count("object").alias("objects"), count("ref").alias("refs"))
    return n.select(F.regexp_extract("doc_id", r"([0-9]+)\.pdf$", 1).cast("long").alias("conv_id"), "pages", "objects", "refs")

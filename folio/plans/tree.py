"""Page trees by recursive queries: document order, guards, counts and inherited geometry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..scratch import stage
from . import closure

MAX_DEPTH = 256


def _view(df: DataFrame, name: str) -> str:
    v = f"folio_{name}_{uuid.uuid4().hex[:12]}"
    df.createOrReplaceTempView(v)
    return v


def doubled(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Page tree edges of documents whose reachable nodes form a tree; and ``doc_id, obj`` of nodes listed more than once.

    A walk follows every listing of a node, so a few nodes that list their kids twice would make it endless. Listings are
    counted first. Documents with a node listed twice, or with their root listed, are looked at again with what their root
    reaches, each node once: a node that only an unused part of the file lists a second time does no harm.
    """
    spark = t["documents"].sparkSession
    roots = t["documents"].where("error is null and pages_root is not null").select("doc_id", "pages_root")
    edges = t["page_edges"].where("kid is not null").select("doc_id", "parent", "ord", "kid")

    def twice(e: DataFrame) -> DataFrame:
        again = e.groupBy("doc_id", F.col("kid").alias("obj")).agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "obj")
        root = roots.select("doc_id", F.col("pages_root").alias("obj"))
        return again.unionByName(e.select("doc_id", F.col("kid").alias("obj")).join(root, ["doc_id", "obj"], "left_semi")).distinct()

    suspect = stage(twice(edges), "listed")
    if suspect.isEmpty():
        return edges, suspect
    docs = suspect.select("doc_id").distinct()
    theirs = stage(edges.join(docs, "doc_id", "left_semi"), "edges")
    starts = roots.join(docs, "doc_id", "left_semi").select("doc_id", F.col("pages_root").alias("obj"))
    found = closure.closure(starts, theirs.select("doc_id", F.col("parent").alias("src_obj"), F.col("kid").alias("dst_obj")), ("doc_id",), MAX_DEPTH + 2, cut=True)
    reached = stage(theirs.join(found.select("doc_id", F.col("obj").alias("parent")), ["doc_id", "parent"], "left_semi"), "edges").select(*edges.columns)
    bad = stage(twice(reached), "listed")
    good = reached.join(bad, "doc_id", "left_anti").select(*edges.columns)
    return edges.join(docs, "doc_id", "left_anti").select(*edges.columns).unionByName(good), bad


def walk(t: dict[str, DataFrame]) -> DataFrame:
    """Every node once: ``doc_id, obj, path, depth, cycle, media, crop, rotate, kind, type`` with what it inherits.

    Children carry what they have or else what their parent carries, so inheritance needs no second walk. Documents whose
    page tree is none have a row with ``cycle`` for each node that is listed more than once, and no others but their root.
    One more level than allowed is kept, to be seen. The result is written, as the recursion is not to run again for
    every use; it is linear in the nodes, so no limit on its rows is needed.
    """
    spark = t["documents"].sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    sound, bad = doubled(t)
    roots = t["documents"].where("error is null").select("doc_id", "pages_root")
    docs, nodes, edges = _view(roots, "roots"), _view(t["objects"].where("type in ('Page', 'Pages') or kind <> 'stream'").select("doc_id", "obj", "kind", "type", "media", "crop", "rotate"), "nodes"), _view(sound, "edges")
    walked = spark.sql(f"""
        WITH RECURSIVE w(doc_id, obj, path, depth, media, crop, rotate) MAX RECURSION LEVEL {MAX_DEPTH + 2} AS (
          SELECT r.doc_id, r.pages_root, CAST(array() AS array<int>), 0, n.media, n.crop, n.rotate
          FROM {docs} r LEFT JOIN {nodes} n ON n.doc_id = r.doc_id AND n.obj = r.pages_root
          UNION ALL
          SELECT e.doc_id, e.kid, concat(w.path, array(e.ord)), w.depth + 1, coalesce(n.media, w.media), coalesce(n.crop, w.crop), coalesce(n.rotate, w.rotate)
          FROM w JOIN {edges} e ON e.doc_id = w.doc_id AND e.parent = w.obj
          LEFT JOIN {nodes} n ON n.doc_id = e.doc_id AND n.obj = e.kid
          WHERE w.depth <= {MAX_DEPTH})
        SELECT w.doc_id, w.obj, w.path, w.depth, false AS cycle, w.media, w.crop, w.rotate, n.kind, n.type FROM w LEFT JOIN {nodes} n ON n.doc_id = w.doc_id AND n.obj = w.obj
    """)
    none = [F.lit(None).cast(walked.schema[c].dataType).alias(c) for c in ("path", "depth")]
    rest = [F.lit(None).cast(walked.schema[c].dataType).alias(c) for c in ("media", "crop", "rotate", "kind", "type")]
    return stage(walked.unionByName(bad.select("doc_id", "obj", *none, F.lit(True).alias("cycle"), *rest)), "walked")


def tree_errors(t: dict[str, DataFrame], walked: DataFrame) -> DataFrame:
    """``doc_id, message`` of documents whose page tree cannot be used; the first in a fixed order of kinds."""
    seen = walked.groupBy("doc_id", "obj").agg(F.max("depth").alias("depth"), F.bool_or("cycle").alias("cycle"), F.first("kind", True).alias("kind"), F.first("type", True).alias("type"))
    m = (
        F.when(F.col("cycle"), F.struct(F.lit(1).alias("k"), F.concat(F.lit("page tree cycle detected at object "), F.col("obj")).alias("m")))
        .when(F.col("depth") > MAX_DEPTH, F.struct(F.lit(2).alias("k"), F.lit("page tree exceeds maximum depth").alias("m")))
        .when(F.col("kind").isNull() | (F.col("kind") != "dictionary"), F.struct(F.lit(3).alias("k"), F.concat(F.lit("page tree node "), F.col("obj"), F.lit(" is not a dictionary")).alias("m")))
        .when(F.col("type").isNull(), F.struct(F.lit(4).alias("k"), F.concat(F.lit("page tree node "), F.col("obj"), F.lit(" has no type")).alias("m")))
    )
    nodes = seen.select("doc_id", m.alias("m")).where("m is not null")
    reached = t["page_edges"].where("kid is null").join(seen.select("doc_id", F.col("obj").alias("parent")), ["doc_id", "parent"], "left_semi")
    direct = reached.select("doc_id", F.struct(F.lit(5).alias("k"), F.concat(F.lit("page tree node has a "), F.col("message")).alias("m")).alias("m"))
    return nodes.unionByName(direct).groupBy("doc_id").agg(F.min("m").alias("m")).select("doc_id", F.col("m.m").alias("message"))


def pages(t: dict[str, DataFrame], walked: DataFrame | None = None) -> DataFrame:
    """``doc_id, page_no, obj, media, crop, rotate`` of documents with a sound page tree, in document order."""
    w = walk(t) if walked is None else walked
    good = w.where("type = 'Page'").join(tree_errors(t, w), "doc_id", "left_anti")
    order = Window.partitionBy("doc_id").orderBy("path")
    return good.select("doc_id", F.row_number().over(order).cast("int").alias("page_no"), "obj", "path", "media", "crop", "rotate")


def page_counts(t: dict[str, DataFrame], page_table: DataFrame) -> DataFrame:
    """``doc_id, fast, strict``: fast trusts a plausible declared count, strict counts leaves."""
    n = page_table.groupBy("doc_id").agg(F.count("*").alias("n"))
    d = t["documents"].where("error is null").join(n, "doc_id", "left")
    strict = F.coalesce("n", F.lit(0)).cast("bigint")
    plausible = F.when(F.col("declared_count").between(0, F.col("xref_size")), F.col("declared_count"))
    return d.select("doc_id", F.coalesce(plausible, strict).alias("fast"), strict.alias("strict"))


def suspicious(counts: DataFrame) -> DataFrame:
    """Documents whose declared count is not what the walk finds."""
    return counts.where("fast <> strict")


def page_geometry(page_table: DataFrame) -> DataFrame:
    """``doc_id, page_no, width, height, rotation``."""
    g = page_table.select("doc_id", "page_no", G.page_dimensions(F.col("media"), F.col("crop"), F.col("rotate")).alias("g"))
    return g.select("doc_id", "page_no", "g.width", "g.height", "g.rotation")


def dimensions_json(geometry: DataFrame) -> DataFrame:
    """``doc_id, json`` with a document's pages in order."""
    one = F.struct("page_no", "width", "height", "rotation")
    # the sizes of one document's pages: bounded by the document
    return geometry.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("p")).select("doc_id", G.dimensions_json(F.col("p")).alias("json"))


def latest_wins(xref: DataFrame) -> DataFrame:
    """Of every object the entry of the newest section."""
    return xref.groupBy("doc_id", "obj").agg(F.min_by(F.struct("kind", "place", "gen_or_index"), "section_no").alias("e")).select("doc_id", "obj", "e.*")


def orphan_members(xref: DataFrame) -> DataFrame:
    """Entries in object streams that are no plain objects themselves; a sound file has none."""
    merged = latest_wins(xref)
    plain = merged.where("kind = 'plain'").select("doc_id", F.col("obj").alias("place"))
    return merged.where("kind = 'member'").join(plain, ["doc_id", "place"], "left_anti")

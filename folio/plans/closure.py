"""Reference closures: what a page needs, renumbered, with dangling references and structure cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cos.objects import FolioError
from ..scratch import stage

MAX_DEPTH = 4096
STRUCTURE = ("Page", "Pages", "Catalog", "StructTreeRoot")
PRUNED = ("Font", "XObject")
PRUNE_ABOVE = 6


def closure(starts: DataFrame, refs: DataFrame, keys: tuple[str, ...] = ("output", "doc_id"), most: int = MAX_DEPTH, cut: bool = False) -> DataFrame:
    """All objects reached from ``starts(*keys, obj)`` over ``refs(doc_id, src_obj, dst_obj)``: ``*keys, obj, depth``.

    Only objects first reached in a round are followed in the next, so work is linear in the references reached. A chain
    longer than ``most`` is an error, as the closure would not be whole, unless ``cut`` asks for the levels up to there.
    """
    seen = stage(starts.select(*keys, "obj").distinct().withColumn("depth", F.lit(0)), "closure")
    front = seen
    edges = refs.select(F.col("doc_id").alias("r_doc"), "src_obj", "dst_obj")
    for k in range(1, most + 1):
        step = front.join(edges, (F.col("doc_id") == F.col("r_doc")) & (F.col("obj") == F.col("src_obj"))).select(*keys, F.col("dst_obj").alias("obj")).distinct()
        front = stage(step.join(seen.select(*keys, "obj"), [*keys, "obj"], "left_anti").withColumn("depth", F.lit(k)), "closure")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if k % 16 == 0:
            seen = stage(seen, "closure")
    else:
        if cut:
            return seen
        raise FolioError("pdf", f"references are nested deeper than {most} levels")
    return seen


def page_refs(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """References without those from a page up to its parent."""
    pages = objects.where("type = 'Page'").select("doc_id", F.col("obj").alias("src_obj"), F.lit(True).alias("of_page"))
    r = refs.join(pages, ["doc_id", "src_obj"], "left")
    return r.where(~(F.coalesce("of_page", F.lit(False)) & (F.col("key_path") == "/Parent"))).drop("of_page")


def with_values(closed: DataFrame, objects: DataFrame) -> DataFrame:
    """The objects' rows; one that is missing is a null object."""
    o = objects.select("doc_id", "obj", "kind", "type", "subtype", "value")
    return closed.join(o, ["doc_id", "obj"], "left").withColumn("kind", F.coalesce("kind", F.lit("null")))


def renumber(closed: DataFrame, keys: tuple[str, ...] = ("output",)) -> DataFrame:
    """Dense new numbers from 1 in each output, nearer objects first."""
    return closed.withColumn("new_obj", F.row_number().over(Window.partitionBy(*keys).orderBy("depth", "doc_id", "obj")).cast("bigint"))


def rewritten_refs(numbered: DataFrame, refs: DataFrame) -> DataFrame:
    """References of an output's objects in new numbers; what is not in the output is null."""
    m = numbered.select("output", "doc_id", "obj", "new_obj")
    src = m.join(refs, (m["doc_id"] == refs["doc_id"]) & (m["obj"] == refs["src_obj"])).select("output", m["doc_id"], F.col("new_obj").alias("new_src"), "key_path", "ord", "dst_obj")
    to = m.select("output", "doc_id", F.col("obj").alias("dst_obj"), F.col("new_obj").alias("new_dst"))
    return src.join(to, ["output", "doc_id", "dst_obj"], "left")


def structure_refs(refs: DataFrame, objects: DataFrame, copied: DataFrame) -> DataFrame:
    """References into the document's structure that was not copied; a copy nulls them."""
    s = objects.where(F.col("type").isin(*STRUCTURE)).select("doc_id", F.col("obj").alias("dst_obj"))
    return refs.join(s, ["doc_id", "dst_obj"], "left_semi").join(copied.select("doc_id", F.col("obj").alias("dst_obj")), ["doc_id", "dst_obj"], "left_anti")


def prunable(names: DataFrame, above: int = PRUNE_ABOVE) -> DataFrame:
    """Scopes of ``names(scope, kind, name)`` with enough fonts and forms for pruning to be worth a look."""
    return names.where(F.col("kind").isin(*PRUNED)).groupBy("scope").agg(F.count("*").alias("n")).where(F.col("n") > above).select("scope")


def unresolved(used: DataFrame, names: DataFrame) -> DataFrame:
    """Scopes that use a font or form their resources do not have; they are copied whole."""
    u = used.where(F.col("kind").isin(*PRUNED))
    return u.join(names, ["scope", "kind", "name"], "left_anti").select("scope").distinct()


def pruned_names(names: DataFrame, used: DataFrame, above: int = PRUNE_ABOVE) -> DataFrame:
    """What stays of ``names``: all of it where pruning does not apply, else what is used and what is never pruned."""
    go = prunable(names, above).join(unresolved(used, names), "scope", "left_anti")
    whole = names.join(go, "scope", "left_anti")
    part = names.join(go, "scope", "left_semi")
    return whole.unionByName(part.where(~F.col("kind").isin(*PRUNED))).unionByName(part.where(F.col("kind").isin(*PRUNED)).join(used, ["scope", "kind", "name"], "left_semi"))


def shared(closed: DataFrame, of: DataFrame) -> DataFrame:
    """Objects in the closure of every page of ``of(page)``."""
    n = of.select("page").distinct().count()
    return closed.join(of, "page", "left_semi").groupBy("obj").agg(F.count_distinct("page").alias("n")).where(F.col("n") == n).select("obj")

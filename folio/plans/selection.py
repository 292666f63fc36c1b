"""Which pages go where: split, split into chunks, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranges as R


def select_pages(specs: DataFrame, counts: DataFrame, keys: tuple[str, ...] = ("output",)) -> DataFrame:
    """``*keys, doc_id, ord, page_no`` of ``specs(*keys, doc_id, spec)`` and ``counts(doc_id, n)``."""
    s = specs.join(counts, "doc_id").select(*keys, "doc_id", F.posexplode(R.resolve("spec", "n")).alias("ord", "page_no"))
    return s.withColumn("page_no", F.col("page_no").cast("bigint")).withColumn("ord", F.col("ord").cast("bigint"))


def selection_errors(specs: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of ``specs`` that cannot be resolved, with ``error``; to be looked at before anything is written."""
    return specs.join(counts, "doc_id", "left").withColumn("error", F.coalesce(F.when(F.col("n").isNull(), "no_document"), R.resolve_error("spec", "n"))).where("error is not null")


def duplicate_paths(outputs: DataFrame, column: str = "path") -> DataFrame:
    return outputs.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def chunks(counts: DataFrame, per_file: int) -> DataFrame:
    """``doc_id, n, chunk, first, last, name_no`` of a split into files of ``per_file`` pages; numbers are padded to the width of the number of files."""
    if per_file < 1:
        raise ValueError("pages per file must be at least 1")
    files = F.ceil(F.col("n") / per_file).cast("bigint")
    c = counts.where("n > 0").select("doc_id", "n", files.alias("files"), F.explode(F.sequence(F.lit(1).cast("bigint"), files)).alias("chunk"))
    first = (F.col("chunk") - 1) * per_file + 1
    name = F.lpad(F.col("chunk").cast("string"), F.length(F.col("files").cast("string")), "0")
    return c.select("doc_id", "n", "chunk", first.alias("first"), F.least(F.col("chunk") * per_file, F.col("n")).alias("last"), name.alias("name_no"))


def output_path(pattern: str, number):
    """``pattern`` with its one ``%d`` replaced."""
    if pattern.count("%d") != 1:
        raise ValueError("the pattern must have exactly one %d")
    return F.replace(F.lit(pattern), F.lit("%d"), number)


def merge_order(inputs: DataFrame, counts: DataFrame) -> DataFrame:
    """New page numbers of a merge of ``inputs(output, input_ord, doc_id, spec)``; ``spec`` may hold groups, null is all."""
    groups = inputs.withColumn("spec", F.coalesce("spec", F.lit("1-z"))).select("output", "input_ord", "doc_id", F.posexplode(R.groups("spec")).alias("group_ord", "spec"))
    p = select_pages(groups, counts, ("output", "input_ord", "group_ord"))
    order = Window.partitionBy("output").orderBy("input_ord", "group_ord", "ord")
    return p.withColumn("new_page_no", F.row_number().over(order).cast("bigint"))


def donor(inputs: DataFrame) -> DataFrame:
    """The input whose metadata an output takes: its first."""
    return inputs.groupBy("output").agg(F.min_by("doc_id", "input_ord").alias("doc_id"))


def prune_decision(kind: str, specs: DataFrame, counts: DataFrame) -> DataFrame:
    """``specs`` with ``prune``: always for chunks; for a split if the range is bounded or leaves a page out; for a merge
    where an input has a range; never for a rewrite."""
    if kind in ("chunks", "rewrite"):
        return specs.withColumn("prune", F.lit(kind == "chunks"))
    if kind == "merge":
        return specs.withColumn("prune", F.col("spec").isNotNull())
    distinct = F.size(F.array_distinct(R.resolve("spec", "n")))
    return specs.join(counts, "doc_id").withColumn("prune", R.bounded_max("spec").isNotNull() | (distinct < F.col("n"))).drop("n")

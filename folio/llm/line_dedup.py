"""Cross-site line deduplication by the spread of a line over distinct sites.

A line's site is its document's source. Lines are hashed (128 bits of the trimmed line); a HyperLogLog sketch of
sites per hash merges by aggregation. An estimate clearly above or below ``MIN_SITES`` decides; lines with an
estimate within ``BAND`` of it get an exact distinct count. A boilerplate line goes everywhere but at its
first place, the one with the smallest document id and position, so that nothing vanishes from the corpus.

Sketches are only made for lines that occur at least ``MIN_SITES`` times, as no other can reach as many sites.
Everything is DataFrame code; what is gathered per line is a sketch, per document the positions of its own lines.

Blank lines are never removed. A null text stays null and has no lines; a null source is no site. A document is
known by its id and the hash of its text, so rows without an id, or that share one, lose only their own lines; rows
alike in both are treated as one document. Rows without an id come last. Empty input gives empty output.
Extra columns, whatever their names, pass through :func:`remove_boilerplate` and are not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

MIN_SITES = 10
BAND = 0.15
LG_K = 12
BROADCAST_ROWS = 500_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, site, pos, h1, h2`` of every line that isn't blank."""
    d = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("source").cast("string").alias("site"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    t = F.trim(F.col("line"), F.lit(" \t\r"))
    return d.where(F.length(t) > 0).select("doc_id", "text_hash", "site", "pos", F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """``h1, h2, first_doc`` of the lines that occur at ``min_sites`` sites or more."""
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") >= min_sites)
    often = stage(often, "often")
    some = lines.join(often.select("h1", "h2"), ["h1", "h2"], "left_semi")
    spread = some.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    spread = stage(spread, "spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + band)).select("h1", "h2")
    close = spread.where(F.col("sites").between(min_sites * (1 - band), min_sites * (1 + band))).select("h1", "h2")
    exact = some.join(close, ["h1", "h2"], "left_semi").select("h1", "h2", "site").where("site is not null").distinct().groupBy("h1", "h2").count()
    found = sure.union(exact.where(F.col("count") >= min_sites).select("h1", "h2"))
    return found.join(often.select("h1", "h2", "first_doc"), ["h1", "h2"])


def _small(lines: DataFrame) -> DataFrame:
    """A table of boilerplate lines, broadcast if it is counted to be small, so that where a common line occurs does not meet in one task."""
    return F.broadcast(lines) if lines.count() <= BROADCAST_ROWS else lines


def removals(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``_folio_id, _folio_hash, _folio_gone``: of each document that loses lines, their positions."""
    lines = stage(line_hashes(docs), "lines")
    found = stage(boilerplate(lines, min_sites), "boilerplate")
    hits = lines.join(_small(found), ["h1", "h2"])
    # by id, then position; the hash decides between rows that share both
    place = F.struct("pos", "text_hash")
    first = stage(hits.where(F.col("doc_id").eqNullSafe(F.col("first_doc"))).groupBy("h1", "h2").agg(F.min(place).alias("first_place")), "first")
    hits = hits.join(_small(first), ["h1", "h2"], "left")
    stays = F.col("doc_id").eqNullSafe(F.col("first_doc")) & place.eqNullSafe(F.col("first_place"))
    return hits.where(~stays).groupBy(F.col("doc_id").alias("_folio_id"), F.col("text_hash").alias("_folio_hash")).agg(F.collect_set("pos").alias("_folio_gone"))


def _with_gone(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_folio_id"]) & (F.xxhash64(docs["text"]) == gone["_folio_hash"]), "left")


def _without(text: Column, gone: Column) -> Column:
    lines = lines_of(text)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    # rebuilt from the kept positions, with the split lines computed once
    rebuilt = F.transform(F.array(F.struct(lines.alias("l"), kept.alias("k"))), lambda x: F.array_join(F.transform(x["k"], lambda i: F.get(x["l"], i)), "\n"))[0]
    return F.when(gone.isNull(), text).otherwise(rebuilt)


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text`` and ``n_chars`` counted anew where it exists."""
    gone = removals(docs, min_sites)
    out = _with_gone(docs, gone)
    text = _without(F.col("text"), F.col("_folio_gone"))
    cols = [text.alias(c) if c == "text" else F.char_length(text).cast("long").alias(c) if c == "n_chars" else docs[c] for c in docs.columns]
    return out.select(*cols)


def report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` of every document; a null text counts as empty."""
    d = docs.select("doc_id", "source", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    gone = removals(d, min_sites)
    out = _with_gone(d, gone)
    n = (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    return out.select("doc_id", n.alias("n_lines"), F.coalesce(F.size("_folio_gone"), F.lit(0)).cast("long").alias("n_removed"), F.sha2(_without(F.col("text"), F.col("_folio_gone")), 256).alias("kept_sha256"))

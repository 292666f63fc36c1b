"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents, in the order of a hash of their ids, form one stream of words, gone through up to ``CAP`` times
and cut into blocks of equally many words. Blocks of large sources have ``total / SLOTS`` words; a source whose target
is less than ``PARTS`` of these has smaller ones, of a ``PARTS``-th of its target. A schedule of slots walks the
golden-ratio sequence: slot ``i`` is the point ``i * phi mod 1`` and belongs to the source whose stretch of the cumulated
numbers of blocks holds the point. The ``r``-th slot of a source takes its block ``r``, until the blocks its target asks
for are taken; so every prefix of the schedule is close to the wanted proportions. The sequence is walked
``WALK`` times as far as there are blocks: after that no gap between its points is as long as one block's stretch. With
``exact`` the last block of a source is cut so that it gets ``floor(target)`` words; else blocks stay whole.

Everything is DataFrame code. Running sums over sources and over documents go by ranges of the order, so neither many
sources nor one with a third of all rows makes a large task.

Nulls: a null text has size 0; a null source is a source of its own, last in order. Repeated rows each hold
their own place in the stream. Empty input gives empty output. Extra columns, whatever their names, are not read by
:func:`mix` and pass through :func:`mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, running, stage

#: round(2**31 / golden ratio), odd: multiplying by it permutes the residues of 2**31.
GOLDEN = 1327217885
RING = 1 << 31
SLOTS = 1 << 20
LEAST_BLOCK = 16
PARTS = 64
WALK = 3
CAP = 3
WEIGHTS = (5, 2, 1)
SLOT_CHUNK = 8192


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _big(c: Column | str) -> Column:
    """For products of sums, which may exceed a long."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def plan_sources(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source of ``sizes(source, size)``: ``source, src, source_size, weight, target, quota, before, block, blocks, walk, lo, hi``.

    Targets share the sum of all sizes by weight; one that would exceed ``cap`` times its source's size is
    held there and the excess is shared anew. Sources in ascending order of ``cap * size / weight`` reach
    their limit one after the other, which makes the sharing a running sum.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    p = running(by, [F.col("source").asc_nulls_last()], {"nth": F.lit(1), "upto": F.col("source_size")})
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    p = p.select("source", "source_size", (F.col("nth") - 1).cast("int").alias("src"), weight.alias("weight"), (F.col("upto") - F.col("source_size")).cast("long").alias("before"))
    p = running(p, [(F.col("source_size") / F.col("weight")).asc(), F.col("src").asc()], {"s_in": F.col("source_size"), "w_in": F.col("weight")})
    p = stage(p, "sources")
    total, all_w = p.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    s0, w0 = F.col("s_in") - F.col("source_size"), F.col("w_in") - F.col("weight")
    p = p.withColumn("capped", _big(F.lit(total) - cap * s0) * _big("weight") >= _big(cap * F.col("source_size")) * _big(F.lit(all_w) - w0))
    held_s, held_w = p.where("capped").agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    share = (F.col("weight").cast("double") * float(total - cap * held_s)) / float(max(1, all_w - held_w))
    p = p.withColumn("target", F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(share)).withColumn("quota", F.floor("target").cast("long"))
    block = F.least(F.lit(max(LEAST_BLOCK, -(-total // SLOTS))), F.greatest(F.lit(1), F.floor(F.col("quota") / PARTS))).cast("long")
    p = p.withColumn("block", block).withColumn("blocks", F.ceil(F.col("quota") / F.col("block")).cast("long"))
    p = stage(running(p, [F.col("src").asc()], {"cum": F.col("blocks")}), "sources")
    every = p.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    edge = lambda c: F.floor(c.cast("double") * float(RING) / float(max(1, every))).cast("long")
    return p.select(
        "source", "src", "source_size", "weight", "target", "quota", "before", "block", "blocks",
        F.lit(WALK * every).cast("long").alias("walk"), edge(F.col("cum") - F.col("blocks")).alias("lo"), edge(F.col("cum")).alias("hi"),
    )


def schedule(plan: DataFrame) -> DataFrame:
    """The slots that take a block, in order: ``slot, src, rank``; ``rank`` is the block's number in its source."""
    n = plan.agg(F.max("walk")).first()[0] or 0
    slots = plan.sparkSession.range(n).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id"), F.lit(RING)) * GOLDEN, F.lit(RING)).alias("point"))
    shift = 21  # 1,024 cells of the ring, so that finding a point's stretch is an equi-join
    cells = plan.where("hi > lo").select("src", "blocks", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))).alias("cell"))
    held = slots.withColumn("cell", F.shiftright("point", shift)).join(cells, "cell").where("point >= lo and point < hi").select("slot", "src", "blocks", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"))
    counts = held.groupBy("src", "chunk").agg(F.count("*").alias("c"))
    base = counts.select("src", "chunk", (F.sum("c").over(Window.partitionBy("src").orderBy("chunk")) - F.col("c")).alias("base"))
    ranked = held.join(base, ["src", "chunk"]).where("base < blocks")
    ranked = ranked.withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1)
    return ranked.where("rank < blocks").select("slot", "src", "rank")


def place(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Each document's stretch ``start .. start + size`` of its source's shuffled stream, and its place among all."""
    few = F.broadcast(plan) if plan.count() <= 20_000 else plan
    d = sized.join(few.withColumnRenamed("source", "p_source"), F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    d = d.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    # rows alike in all of these are interchangeable
    d = running(d, [F.col(c) for c in ("src", "h", "doc_id", "size", *[c for c in ("k1", "k2") if c in d.columns])], {"upto": F.col("size"), "ordinal": F.lit(1)})
    return d.withColumn("start", F.col("upto") - F.col("size") - F.col("before"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, exact: bool = False) -> DataFrame:
    """What the mix takes of each document: ``doc_id, source, size, source_size, target, start, ordinal, taken, copies``.

    ``taken`` counts words with repeats. ``copies`` lists the parts taken: for each epoch the words ``[from, to)`` of the
    document, and the slot that takes the first of them.
    """
    return _mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), weights, cap, exact).drop("src")


def _mix(sized: DataFrame, weights, cap: int, exact: bool) -> DataFrame:
    sized = stage(sized, "sizes")
    plan = stage(plan_sources(sized, weights, cap), "sources")
    slots = stage(schedule(plan), "slots")
    # ranks have no gaps: the number of a source's slots tells how far its stream is taken
    filled = slots.groupBy("src").agg(F.count("*").alias("filled"))
    most = F.col("quota") if exact else F.col("source_size") * cap
    plan = stage(plan.join(filled, "src", "left").withColumn("got", F.least(most, F.coalesce("filled", F.lit(0)) * F.col("block"))).drop("filled", "lo", "hi", "walk"), "filled")
    placed = stage(place(sized, plan), "placed")
    reach = lambda e: F.least(F.col("size"), F.col("got") - e * F.col("source_size") - F.col("start"))
    part = lambda e: F.struct(F.lit(e).alias("epoch"), F.lit(0).cast("long").alias("from"), reach(e).alias("to"), F.floor((F.col("start") + e * F.col("source_size")) / F.col("block")).alias("rank"))
    parts = F.filter(F.array(*[part(e) for e in range(cap)]), lambda c: c["to"] > 0)
    each = placed.select("ordinal", "src", F.explode(parts).alias("c"))
    found = each.join(slots, (each["src"] == slots["src"]) & (F.col("c.rank") == slots["rank"])).select("ordinal", F.struct("c.epoch", "c.from", "c.to", "slot").alias("c"))
    # at most ``cap`` parts a document
    found = found.groupBy("ordinal").agg(F.array_sort(F.collect_list("c")).alias("copies"), F.sum(F.col("c.to") - F.col("c.from")).alias("taken"))
    none = F.array().cast(found.schema["copies"].dataType)
    out = placed.join(found, "ordinal", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).withColumn("copies", F.coalesce("copies", none))
    return out.select(*[c for c in sized.columns if c != "size"], "src", "size", "source_size", "target", "start", "ordinal", "taken", "copies")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, exact: bool = False) -> DataFrame:
    """The mix itself: every taken part as a row with the columns of ``docs``; ``n_chars`` counts the part's text where it exists.

    A document that an epoch takes whole keeps its text as it is; one document per source, the last, may
    be cut. Documents without a word are not part of any mix and are left out.
    """
    told = F.concat(*[F.col(c).isNull().cast("string") for c in ("doc_id", "text", "lang", "source")])
    of_row = [F.xxhash64(F.lit(k), told, "doc_id", "text", "lang", "source") for k in (0, 1)]
    keyed = docs.select("*", of_row[0].alias("_folio_k1"), of_row[1].alias("_folio_k2"))
    sized = keyed.select("doc_id", "source", F.col("_folio_k1").alias("k1"), F.col("_folio_k2").alias("k2"), word_count(F.col("text")).alias("size"))
    taken = _mix(sized, weights, cap, exact).select(F.col("k1").alias("_folio_j1"), F.col("k2").alias("_folio_j2"), F.col("size").alias("_folio_size"), F.explode("copies").alias("_folio_c"))
    # of rows that are alike one is kept and stands for all: their parts all go to it
    first = Window.partitionBy("_folio_k1", "_folio_k2").orderBy(F.lit(1))
    once = keyed.withColumn("_folio_n", F.row_number().over(first)).where("_folio_n = 1")
    got = once.join(taken, (F.col("_folio_k1") == F.col("_folio_j1")) & (F.col("_folio_k2") == F.col("_folio_j2")))
    to = F.col("_folio_c.to")
    cut = F.array_join(F.slice(F.regexp_extract_all(docs["text"], F.lit(WORD), F.lit(0)), 1, to.cast("int")), " ")
    text = F.when(to == F.col("_folio_size"), docs["text"]).otherwise(cut)
    return got.select(*[text.alias(c) if c == "text" else F.char_length(text).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])

"""Document fingerprints by SimHash, and the search of all fingerprints within a Hamming radius.

Every term of a text (a window of ``SHINGLE`` words, or the whole text if it has fewer) votes with its hash,
once per occurrence, on 64 signed bits. Two 32-bit counters share a long, so that a vote is 32 additions that
Spark compiles, and all votes of a text meet in the task that read it.

The search keeps permuted block tables: 64 bits are cut in ``radius + 3`` blocks, of which 3 at least are equal
in any two fingerprints within the radius; each choice of 3 blocks is a table keyed by these.

Everything is DataFrame code. Null and empty texts have fingerprint zero. Repeated rows are kept. Empty input gives
empty output. Extra columns are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stage, words

SHINGLE = 5
#: Documents of a chunk, on average, when documents are put in order.
CHUNK = 1024
#: With more chunks than this for each of the session's shuffle partitions, there are more partitions.
CHUNKS_A_TASK = 16
PAIR = 0x0000000100000001
#: Documents whose id is divisible by this are looked up among all; the radius of the search in bits.
EVERY = 100
RADIUS = 3


def terms(text: Column, shingle: int = SHINGLE) -> Column:
    """The hashes of a text's terms, repeats included; no words give none."""
    def of(w: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(shingle)])
        whole = F.array(F.xxhash64(F.array_join(w, " ")))
        some = F.when(F.size(w) < shingle, whole).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - shingle), window))
        return F.when(F.size(w) > 0, some)

    return let(words(text), of)


def fingerprints(texts: DataFrame, keys: list[str], extra: list[str] = ()) -> DataFrame:
    """``keys, *extra, fp`` of ``texts(*keys, text, *extra)``. ``keys`` name a row; ``extra`` are longs it carries along."""
    t = texts.select(*keys, *extra, F.explode_outer(terms(F.col("text"))).alias("h"))
    # bit k + 32 j of the hash is counted in half j of sum k
    votes = [F.coalesce(F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(PAIR))), F.lit(0)).alias(f"v{k}") for k in range(32)]
    v = t.groupBy(*keys).agg(F.count("h").alias("n"), *votes, *[F.max(c).alias(c) for c in extra])
    low = F.lit(0xFFFFFFFF)
    fp = F.lit(0).cast("long")
    for k in range(32):
        for j in (0, 1):
            count = F.shiftrightunsigned(f"v{k}", 32 * j).bitwiseAND(low)
            fp = fp.bitwiseOR(F.when(2 * count > F.col("n"), F.lit(_signed(1 << (k + 32 * j)))).otherwise(F.lit(0).cast("long")))
    return v.select(*keys, *extra, fp.alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the cosine that the share of differing bits stands for, and 0 for a right angle or more."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * (F.lit(3.141592653589793) / 64.0)))


# --- neighbours in the order of ids -----------------------------------------------------------------------


def ordered(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with ``rank`` 0, 1, ... in ascending order of id (then text), and their number.

    Ids that are dense and unique are ranks already. Others are ranked in a slim table of ids and text hashes,
    range-partitioned, and the ranks joined back.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, ids, low, high, present = d.agg(F.count("*"), F.countDistinct("doc_id"), F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    if n == 0 or (ids == n == present and high - low + 1 == n):
        return d.withColumn("rank", F.col("doc_id") - F.lit(low or 0)), n
    keyed = d.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), F.col("text")))
    slim = keyed.select("doc_id", "h1", "h2").repartitionByRange(F.col("doc_id").asc_nulls_first(), "h1", "h2")
    slim = stage(slim.withColumn("part", F.spark_partition_id()), "order")
    counts = slim.groupBy("part").count()  # as many rows as partitions
    base = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("base"))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "h1", "h2")
    alike = Window.partitionBy("doc_id", "h1", "h2").orderBy("rank")
    ranks = slim.join(F.broadcast(base), "part").select("doc_id", "h1", "h2", (F.col("base") + F.row_number().over(inside) - 1).alias("rank"))
    ranks = ranks.select(F.col("doc_id").alias("r_id"), "h1", "h2", "rank", F.row_number().over(alike).alias("same"))
    own = keyed.withColumn("same", F.row_number().over(Window.partitionBy("doc_id", "h1", "h2").orderBy(F.lit(1))))
    on = own["doc_id"].eqNullSafe(ranks["r_id"]) & (own["h1"] == ranks["h1"]) & (own["h2"] == ranks["h2"]) & (own["same"] == ranks["same"])
    return own.join(ranks, on).select("doc_id", "text", "rank"), n


def with_next(docs: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, int]:
    """``rank, doc_id, text, next_text``; after the last document comes the first.

    Ranks are cut into chunks of equal length; the first document of a chunk also goes, as its end mark, to the
    chunk before. So one shuffle puts every document beside its next.
    """
    d, n = ordered(docs)
    own = F.struct(F.floor(F.col("rank") / chunk).alias("chunk"), F.col("rank").alias("at"))
    before = F.struct(F.floor(F.col("rank") / chunk - 1).alias("chunk"), F.col("rank").alias("at"))
    wrap = F.struct(F.floor(F.lit((n - 1) / chunk)).alias("chunk"), F.lit(n).cast("long").alias("at"))
    places = F.when(F.col("rank") == 0, F.array(own, wrap)).when(F.col("rank") % chunk == 0, F.array(own, before)).otherwise(F.array(own))
    p = d.select("rank", "doc_id", "text", F.explode(places).alias("p")).select("rank", "doc_id", "text", F.col("p.chunk").alias("chunk"), F.col("p.at").alias("at"))
    parts = -(-n // (chunk * CHUNKS_A_TASK))
    if parts > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        p = p.repartition(parts, "chunk")
    out = p.withColumn("next_text", F.lead("text").over(Window.partitionBy("chunk").orderBy("at")))
    return out.where((F.col("at") == F.col("rank")) & (F.floor(F.col("at") / chunk) == F.col("chunk"))).select("rank", "doc_id", "text", "next_text"), n


def edited_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near``; ``n_near`` is how
    many other documents the search finds within its radius of those whose id is divisible by ``EVERY``, else null.
    """
    d, n = with_next(docs)
    size = F.char_length("text")
    cut = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - cut), F.substring("next_text", F.lit(1), cut))
    e = d.select("rank", "doc_id", "text", size.cast("long").alias("n_chars"), edited.alias("edited"))
    sha = F.sha2("edited", 256)
    quarter = [F.conv(F.substring(sha, 1 + 16 * i, 16), 16, -10).cast("long").alias(f"q{i}") for i in range(4)]
    both = F.explode(F.array(F.struct(F.lit(0).alias("tag"), F.col("text").alias("t")), F.struct(F.lit(1).alias("tag"), F.col("edited").alias("t"))))
    rows = e.select("rank", "doc_id", "n_chars", *quarter, both.alias("b")).select("rank", F.col("b.tag").alias("tag"), F.col("b.t").alias("text"), "doc_id", "n_chars", "q0", "q1", "q2", "q3")
    extra = ["doc_id", "n_chars", "q0", "q1", "q2", "q3"]
    f = stage(fingerprints(rows, ["rank", "tag"], extra), "fp")
    own = f.where("tag = 0").select("rank", *extra, F.col("fp").alias("a"))
    changed = f.where("tag = 1").select("rank", F.col("fp").alias("b"))
    following = f.where("tag = 0").select(F.pmod(F.col("rank") - 1, F.lit(max(n, 1))).alias("rank"), F.col("fp").alias("c"))
    asked = (F.col("doc_id") % EVERY == 0) & F.col("doc_id").isNotNull()
    near = neighbours(own.where(asked).select(F.col("a").alias("fp")), own.select(F.col("a").alias("fp")))
    j = own.join(changed, "rank").join(following, "rank").join(near.select(F.col("fp").alias("a"), "n"), "a", "left")
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return j.select(
        "doc_id", "n_chars", F.concat(*[hexed(f"q{i}") for i in range(4)]).alias("edited_sha256"),
        hexed("a").alias("fingerprint"), hexed("b").alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
        F.when(asked, F.coalesce("n", F.lit(1)) - 1).cast("long").alias("n_near"),
    )


# --- search -----------------------------------------------------------------------------------------------


def tables(radius: int) -> list[int]:
    """Masks of the block tables: ``radius + 3`` blocks, any 3 of which may be untouched."""
    blocks = radius + 3
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [_signed(a | b | c) for a, b, c in itertools.combinations(masks, 3)]


def neighbours(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, n``: how many rows of ``index(fp)`` are within ``radius`` of each fingerprint of ``queries(fp)``."""
    rows = stage(index.groupBy("fp").agg(F.count("*").alias("n")), "index")
    found = search(queries, rows, radius).join(rows, "fp")
    return found.groupBy(F.col("q_fp").alias("fp")).agg(F.sum("n").alias("n"))


def search(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``q_fp, fp, distance`` of all distinct fingerprints of ``index(fp)`` within ``radius`` of those of ``queries(fp)``.

    A pair may meet in several tables; it is kept in the first one only, so no pair has to be remembered.
    """
    masks = tables(radius)
    keyed = lambda df, name: df.select(F.col("fp").alias(name)).distinct().select(name, F.posexplode(F.array(*[F.col(name).bitwiseAND(F.lit(m)) for m in masks])).alias("tab", "key"))
    q, x = keyed(queries, "q_fp"), keyed(index, "fp")
    pairs = q.join(x, ["tab", "key"])
    diff = F.col("q_fp").bitwiseXOR(F.col("fp"))
    first = F.array_position(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: diff.bitwiseAND(m) == 0), True) - 1
    return pairs.where(F.bit_count(diff) <= radius).where(first == F.col("tab")).select("q_fp", "fp", F.bit_count(diff).alias("distance"))

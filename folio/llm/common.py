"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import stage

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


@contextmanager
def handed(spark: SparkSession, size: str) -> Iterator[None]:
    """What is run inside hands Python workers about ``size`` bytes of rows at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def words(text: Column) -> Column:
    """The words of ``text``; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body's lambdas mention it."""
    return F.transform(F.array(value), body)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with a running total, its own row included, of each of ``sums`` in the given order.

    Rows are dealt by ranges of the order, summed inside each range, and the ranges' totals are added up; so no task
    sees more than a range, and the driver sees nothing.
    """
    d = stage(df.repartitionByRange(*order).withColumn("_folio_range", F.spark_partition_id()), "ordered")
    inside = Window.partitionBy("_folio_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_folio_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    totals = d.groupBy("_folio_range").agg(*[F.sum(c).alias(f"_folio_{n}") for n, c in sums.items()])
    base = totals.select("_folio_range", *[F.coalesce(F.sum(f"_folio_{n}").over(before), F.lit(0)).alias(f"_folio_{n}") for n in sums])
    out = d.join(F.broadcast(base), "_folio_range")
    return out.select(*df.columns, *[(F.col(f"_folio_{n}") + F.sum(c).over(inside)).alias(n) for n, c in sums.items()])

"""Boilerplate lines: those seen on many distinct sites.

Rows are documents (``doc_id``, ``text`` and a site column); all columns are kept. A
line is what stands between line feeds; blank lines are never boilerplate. A
NULL site counts as one site of its own. The first occurrence of a boilerplate line,
by ``doc_id``, then hash of the text, then place, stays; a NULL ``doc_id`` comes last. NULL
and empty texts stay as they are. Repeated rows (same ``doc_id`` and text) are
treated alike. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged
from .common import SPACE

#: A line on this many distinct sites is boilerplate.
MIN_SITES = 10
#: Registers of a sketch, as a power of two, and how far from the threshold an estimate is trusted.
LOG_REGISTERS, MARGIN = 12, 0.25


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """One row per non-blank line: its hash, site and occurrence."""
    rows = docs.select(
        F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
        _key(F.col("doc_id")).alias("key"),
        F.col("doc_id").isNull().alias("unnamed"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.split("text", "\n")).alias("place", "line"),
    )
    return rows.where(F.col("line").rlike(f"[^{SPACE}]")).select(
        F.xxhash64("line").alias("line_hash"), "site", "key", "text_hash", "place",
        F.struct("unnamed", "doc_id", "text_hash", "place").alias("occurrence"),
    )


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``line_hash`` and the occurrence that stays, for lines on ``min_sites`` or more sites.

    A sketch of the sites per line is built before the shuffle and merged after it, so
    a line in a third of all documents costs each task one row. Lines whose
    estimate is near the threshold are counted exactly.
    """
    lines = _lines(docs, site)
    spread = lines.groupBy("line_hash").agg(
        F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch"), F.min("occurrence").alias("first")
    )
    rated = spread.select("line_hash", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    likely = staged(rated.where(F.col("sites") >= min_sites * (1 - MARGIN)), "likely")
    near = likely.where(F.col("sites") <= min_sites * (1 + MARGIN)).select("line_hash")
    exact = lines.join(near, "line_hash", "left_semi").groupBy("line_hash").agg(F.countDistinct("site").alias("exact"))
    counted = likely.join(exact, "line_hash", "left")
    return counted.where(F.coalesce("exact", "sites") >= min_sites).select("line_hash", "first")


def drop_boilerplate(
    docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, removed: str | None = None
) -> DataFrame:
    """``docs`` without boilerplate lines; ``removed`` names a column for their number."""
    common = staged(boilerplate(docs, site, min_sites), "boilerplate")
    hits = (
        _lines(docs, site)
        .join(common, "line_hash")
        .where(F.col("occurrence") != F.col("first"))
        .groupBy("key", "text_hash")
        .agg(F.collect_set("place").alias("places"))
    )
    rows = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"),
        _key(F.col("doc_id")).alias("key"),
        F.xxhash64("text").alias("text_hash"),
    ).join(hits, ["key", "text_hash"], "left")
    lines = F.split(F.col("row.text"), "\n")
    kept = F.transform(F.array(lines), lambda own: F.array_join(
        F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("places")), lambda at: F.get(own, at)
        ), "\n"))[0]
    text = F.when(F.col("places").isNull(), F.col("row.text")).otherwise(kept)
    columns = [text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    if removed:
        columns.append(F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias(removed))
    return rows.select(*columns)


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))

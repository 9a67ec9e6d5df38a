"""Mixing sources to target weights: capped water-filling and seeded repetition, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, settled

#: Documents of a source that share a row of drawing lots, about; larger sources are salted into more rows.
ROW_OF_LOTS = 5000
#: Targets of so many sources at most are broadcast, a few dozen bytes each; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def number(*parts) -> Column:
    """60 bits of an md5 of the parts, null as `null`: the same in any engine."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...], most: int, share: float) -> DataFrame:
    """(source, source_size, n, target) of each source of (source, size).

    The sources, by code point with null last, have the weights in turn. In
    order of most * size / weight, a source is clamped while what is left to
    share, by the weights left, would give it no less than that; one pass of
    running sums so gives what repeated redistribution ends at.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    picked = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    table = sources.withColumn("weight", picked.cast("long")).withColumn("place", place).withColumn("cap", F.col("source_size") * most)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(W.unboundedPreceding, -1)
    table = (
        table.withColumn("left", F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("clamped", F.col("cap") * F.col("weights_left") <= F.col("left") * F.col("weight"))
    )
    level = F.max(F.when(~F.col("clamped"), F.col("left") / F.col("weights_left"))).over(whole)
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return table.withColumn("target", target).select("source", "source_size", "n", "target")


def allot(sized: DataFrame, weights: tuple[int, ...], most: int, share: float, seed: int) -> DataFrame:
    """sized (id, source, size, tie, ...) with source_size, target and times, how often the mix takes the document.

    Each document is taken floor(target / source_size) times. The fraction left
    is drawn systematically: documents of a source, salted into rows of about
    ROW_OF_LOTS and ordered by size, have every 1 / fraction-th taken once
    more, from a seeded start. So takes of all sizes come evenly, and the words
    taken come nearer to the target than with a draw for each document.
    """
    plan = settled(targets(sized.select("source", "size"), weights, most, share), "targets")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    rows = sized.join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    lot = number(F.col("id"), F.col("size"), F.lit(seed))
    salts = F.ceil(F.col("n") / F.lit(ROW_OF_LOTS)).cast("long")
    rows = rows.withColumn("ratio", ratio).withColumn("lot", lot).withColumn("salt", F.pmod(F.col("lot"), salts))
    fraction = F.col("ratio") - F.floor("ratio")
    start = F.pmod(number(F.col("source"), F.col("salt"), F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    turn = F.row_number().over(W.partitionBy("source", "salt").orderBy("size", "lot", "id", "tie"))
    once_more = F.floor(turn * fraction + start) - F.floor((turn - 1) * fraction + start)
    return rows.withColumn("times", (F.floor("ratio") + once_more).cast("long")).drop("plan_source", "n", "ratio", "lot", "salt", "tie")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, share: float = 1.0, seed: int = 1) -> DataFrame:
    """How the mix takes each document: (id, size, source_size, target, taken, times).

    size is the number of words, 0 for null and empty texts; a null source is a
    source of its own, the last. A source without words has target 0, and its
    documents add nothing whether taken or not. Equal rows draw lots each for
    itself, and a rerun gives the same rows. Other columns are ignored; an
    empty table gives an empty one.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.lit(0).alias("tie"))
    rows = allot(sized, weights, most, share, seed)
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, share: float = 1.0, seed: int = 1) -> DataFrame:
    """docs as the mix takes them: each row as often as mixture() says, with the columns of docs. Rows of one id and size go by a hash of their text, so a rerun repeats the same."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.xxhash64(text_col).alias("tie"), row.alias("row"))
    rows = allot(sized, weights, most, share, seed).where("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def oracle(weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 1, table: str = "documents", columns: str = "doc_id, size, source_size, target, taken, times") -> str:
    """mixture() in DuckDB's SQL."""
    picked = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
WITH sized AS (SELECT *, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {table}),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sources),
weighed AS (SELECT *, CASE place % {len(weights)} {picked} END AS weight, source_size * {most} AS cap FROM placed),
running AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rest,
  CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS weights_left FROM weighed),
tested AS (SELECT *, cap * weights_left <= rest * weight AS clamped FROM running),
aimed AS (SELECT source, source_size, n, CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE max(CASE WHEN NOT clamped THEN rest / weights_left END) OVER () * weight END AS target FROM tested),
met AS (SELECT s.*, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0.0 END AS ratio, CAST(ceil(a.n / {ROW_OF_LOTS}) AS BIGINT) AS salts,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || size || ':{seed}'), 1, 15) AS BIGINT) AS lot
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source),
salted AS (SELECT *, lot % salts AS salt FROM met),
turned AS (SELECT *, row_number() OVER (PARTITION BY source, salt ORDER BY size, lot, doc_id) AS turn, ratio - floor(ratio) AS fraction,
  CAST('0x' || substr(md5(coalesce(source, 'null') || ':' || salt || ':{seed}'), 1, 15) AS BIGINT) % 1000003 / 1000003.0::DOUBLE AS start FROM salted),
taking AS (SELECT *, CAST(floor(ratio) + floor(turn * fraction + start) - floor((turn - 1) * fraction + start) AS BIGINT) AS times FROM turned)
SELECT {columns.replace('taken', 'size * times AS taken')} FROM taking"""

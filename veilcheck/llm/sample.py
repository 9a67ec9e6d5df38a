"""A bounded sample of labelled texts, whatever their ids, copies and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Labels of a model at most: its size, and that of the sample, follow their number.
MOST_LABELS = 1000


def drawn(texts: DataFrame, most: int, seed: str, labels: DataFrame | None = None) -> tuple[DataFrame, dict] | None:
    """((label, draw, text), rows by label): `most` distinct texts of each label, or all if there are fewer; None without rows.

    texts holds (label, text), or (id, text) to be joined with labels (id,
    label), whose rows are distinct. A label's texts are those with the least
    hashes, so copies count once and a rerun draws the same. An approximate
    count of distinct hashes gives a share of them that leaves somewhat more
    than are asked for; the other texts are left out before any shuffle, and
    each task passes on no more than `most` of a label. More labels than
    MOST_LABELS are an error. Null labels and texts take no part.
    """
    spark = texts.sparkSession
    rows = texts.where("text is not null").withColumn("draw", F.xxhash64("text", F.lit(seed)))

    def named(d: DataFrame) -> DataFrame:
        return (d if labels is None else d.join(labels, "id")).where("label is not null")

    counted = named(rows.drop("text")).groupBy("label").agg(F.approx_count_distinct("draw").alias("distinct"), F.count("*").alias("n"))
    sizes = counted.limit(MOST_LABELS + 1).collect()  # a row for each label
    if not sizes:
        return None
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"a model takes {MOST_LABELS} labels at most")
    # hashes are long integers of all sizes: a share of them lies below a bound
    bounds = [(r.label, int(min(2**63 - 1, -(2**63) + 2**64 * min(1.0, (1.5 * most + 100) / max(1, r.distinct))))) for r in sizes]
    table = spark.createDataFrame(bounds, named(rows).select("label", F.col("draw").alias("bound")).schema)
    some = named(rows.where(F.col("draw") <= max(b for _, b in bounds))).join(F.broadcast(table), "label").where("draw <= bound")
    once = some.groupBy("label", "draw").agg(F.first("text").alias("text"))
    place = F.row_number().over(W.partitionBy("label").orderBy("draw"))
    return once.withColumn("place", place).where(F.col("place") <= most).drop("place"), {r.label: r.n for r in sizes}

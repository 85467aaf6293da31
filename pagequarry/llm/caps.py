"""Capping rows per contributor, at one level or at nested ones."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.session import shared_checkpoint


@dataclass(frozen=True)
class Cap:
    """At most `most` rows, or at most `share` of the rows that the level keeps, for each value of `by`.

    A share is of what is left: cutting a large contributor down makes all that is left less, so the quota is the
    largest number of rows that is within the share once all contributors are cut down to it. Where contributors are
    too few for any (fewer than 1 / share), each keeps its best row.
    """

    by: Sequence[str]
    most: int | None = None
    share: float | None = None

    def __post_init__(self) -> None:
        if (self.most is None) == (self.share is None):
            raise ValueError("give either most or share")
        if self.most is not None and self.most < 0 or self.share is not None and not 0 < self.share <= 1:
            raise ValueError("most must be >= 0 and share within (0, 1]")


def keep_best(rows: DataFrame, caps: Sequence[Cap], order: Sequence[Column]) -> DataFrame:
    """The rows kept under nested caps, given from the innermost (author) to the outermost (parent organisation).

    The caps form a laminar family if each level's groups lie inside the next one's; then taking the best rows by
    `order` within each level in turn yields the best set that obeys all caps (greedy on a laminar matroid).
    `order` must be total to make the choice unique; rows equal in it are chosen arbitrarily but never exceed a cap.
    Null group values form a group of their own. An empty table stays empty.

    A level with a fixed cap is a ranked window with a limit, which Spark cuts on the map side before the shuffle
    (WindowGroupLimit): a group with a third of all rows sends at most `most` rows per map task. A level with a
    share may keep very many of a group, so its ranks are found in slices: rows are range-partitioned by group and order,
    ranked within each slice, and moved up by the sizes of the group's slices before. No task gets a whole large group.
    """
    for cap in caps:
        by = list(cap.by)
        if cap.most is not None:
            rows = _ranked(rows, by, order).where(F.col("__rank") <= cap.most).drop("__rank")
        else:
            rows = _best_share(rows, by, order, cap.share)
    return rows


def quota(rows: DataFrame, by: Sequence[str], share: float) -> DataFrame:
    """One row, `quota`: the largest q, 1 at least, with q <= share * (the sum over groups of min(rows, q)).

    Between two sizes of groups the sum is linear in q, so each stretch has its largest q in closed form. What the window
    sees is one row for each different size, at most about the square root of twice the number of rows.
    """
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    # A first stretch begins at 0, below all groups.
    sizes = sizes.unionByName(rows.sparkSession.range(1).select(F.col("id").alias("n"), F.lit(0).cast("long").alias("c")))
    up = Window.orderBy("n")
    steps = sizes.select(
        "n", F.sum(F.col("n") * F.col("c")).over(up).alias("whole"), F.lead("n").over(up).alias("next"),
        (F.sum("c").over(Window.partitionBy()) - F.sum("c").over(up)).alias("cut"),
    )
    slope = 1 - F.col("cut") * F.lit(share)
    most = F.when(slope > 1e-9, F.floor(F.col("whole") * F.lit(share) / slope + 1e-9))
    most = F.least(F.coalesce("next", "n"), most)  # least() leaves out nulls
    return steps.agg(F.greatest(F.lit(1), F.coalesce(F.max(F.when(most >= F.col("n"), most)), F.lit(1))).alias("quota"))


def _best_share(rows: DataFrame, by: list[str], order: Sequence[Column], share: float) -> DataFrame:
    names = rows.columns
    # A rerun of the partitioning must not move rows between slices, so the slices are written.
    sliced = shared_checkpoint(
        rows.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("__slice", F.spark_partition_id())
    )
    local = F.row_number().over(Window.partitionBy("__slice", *by).orderBy(*order))
    group = [F.col(b).alias(f"__g{i}") for i, b in enumerate(by)]
    keys = [f"__g{i}" for i in range(len(by))]
    sizes = sliced.groupBy(F.col("__slice").alias("__s"), *group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__s", *keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = sliced.withColumn("__rank", local)
    on = [ranked["__slice"] == sizes["__s"], *[ranked[b].eqNullSafe(sizes[k]) for b, k in zip(by, keys)]]
    most = F.broadcast(quota(sliced, by, share))  # one row
    return ranked.join(sizes, on).crossJoin(most).where(F.col("__rank") + F.col("__before") <= F.col("quota")).select(*[ranked[c] for c in names])


def _ranked(rows: DataFrame, by: list[str], order: Sequence[Column]) -> DataFrame:
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def dropped(rows: DataFrame, kept: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows that keep_best left out, by their key; the key spreads evenly even where one contributor is huge."""
    other = kept.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)])
    same = [rows[k].eqNullSafe(other[f"__k{i}"]) for i, k in enumerate(key)]
    return rows.join(other, same, "left_anti")


def cap_hits_per_page(hits: DataFrame, sections: DataFrame, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """Of each query, at most `most` hits per page: the kept hits and the dropped ones.

    Hits delivered again count once. Hits with no section row, and those on a section whose page is null or empty, are
    in neither result. Higher score first, null scores last, then smaller path, then smaller sec_no.
    """
    key = ["query_id", "path", "sec_no"]
    # One row of a hit, whatever was delivered: the best score seen of it.
    hits = hits.groupBy(*key).agg(F.max("score").alias("score"))
    paged = sections.where(F.col("page") != "").groupBy("path", "sec_no").agg(F.max("page").alias("page"))
    rows = hits.join(paged, ["path", "sec_no"]).select(*key, "score", "page")
    order = [F.col("score").desc_nulls_last(), F.col("path"), F.col("sec_no")]
    kept = keep_best(rows, [Cap(["query_id", "page"], most=most)], order)
    return kept, dropped(rows, kept, key)

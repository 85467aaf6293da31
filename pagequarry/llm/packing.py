"""Packing texts into containers of fixed capacity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PackParams:
    #: Tokens a container holds.
    tokens: int = 8192
    #: Documents, or pieces of them, it holds.
    documents: int = 32
    #: Cost of attention within documents that it bears, the sum of the squares of their tokens, as a share of that of
    #: one document that fills it. A piece beyond it has a container to itself, as only tokens are a reason to split.
    attention: float = 0.9
    #: Weights of the three in choosing a container.
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2)
    #: "norm": the smallest weighted norm of what would be left; "dot": the largest weighted dot product of need and
    #: residual, relative to the residual's own, so that of residuals alike in shape the tightest wins.
    choose: str = "norm"
    #: Pieces that are packed together; a block leaves few containers unfilled, so that they don't count.
    block_rows: int = 20_000

    def __post_init__(self) -> None:
        if min(self.tokens, self.documents, self.block_rows) < 1 or self.attention <= 0 or self.choose not in ("dot", "norm"):
            raise ValueError("capacities and block_rows must be positive, choose be dot or norm")
        if self.tokens < 4:
            raise ValueError("a container must hold any one character")

    @property
    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention * float(self.tokens) ** 2])


def best_fit(sizes: np.ndarray, params: PackParams) -> np.ndarray:
    """The container of each item, by vector best fit of items in order of decreasing size.

    An item's needs, and a container's residuals, are (tokens, documents, attention) as shares of the capacities. Of
    the open containers in which the item fits in all three, one is chosen by the weighted norm of what it would have
    left, or by the weighted dot product of needs and residuals; where none fits a new one is opened. An item beyond
    the attention capacity on its own has a container to itself.
    """
    capacity, weights = params.capacity, np.array(params.weights)
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    free = np.empty((1024, 3))
    opened = 0
    # Containers that are full for the smallest item left are retired, so the search runs over few.
    live = np.empty(0, np.int64)
    smallest = sizes.min() / capacity[0] if len(sizes) else 0
    for i in order.tolist():
        size = float(sizes[i])
        need = np.array([size, 1.0, size * size]) / capacity
        room = free[live]
        fits = np.flatnonzero((room >= need - 1e-12).all(1))
        if len(fits):
            left = room[fits] - need
            if params.choose == "norm":
                value = (left * left) @ weights
            else:
                own = (room[fits] * room[fits]) @ weights
                value = -((room[fits] * need) @ weights) / np.maximum(own, 1e-300)
            at = fits[int(value.argmin())]
            bin_no = live[at]
            free[bin_no] -= need
        else:
            if opened == len(free):
                free = np.concatenate([free, np.empty_like(free)])
            bin_no, at = opened, len(live)
            free[bin_no] = 1.0 - need
            live = np.append(live, bin_no)
            opened += 1
        out[i] = bin_no
        if free[bin_no, 0] < smallest - 1e-12 or free[bin_no, 1] * capacity[1] < 1 - 1e-9 or free[bin_no, 2] <= 0:
            live = np.delete(live, at)
    return out


def _ends(text: str, tokens: int) -> Column:
    """Where the pieces of a text end, in bytes: as late as a container allows, but not within a character.

    A fold in the JVM; it looks at most at three bytes for each piece of a text that is too long.
    """
    inside = lambda back: f"(substring({text}, cast(z.e - {back} + 1 as int), 1) BETWEEN X'80' AND X'BF')"
    back = f"CASE WHEN NOT {inside(0)} THEN 0 WHEN NOT {inside(1)} THEN 1 WHEN NOT {inside(2)} THEN 2 ELSE 3 END"
    size = f"cast(octet_length({text}) as bigint)"
    return F.expr(f"""
        CASE WHEN {size} <= {tokens} THEN array({size}) ELSE
        aggregate(sequence(1, cast(ceil({size} / ({tokens} - 3.0)) as int)), cast(array() as array<bigint>), (a, i) ->
          CASE WHEN coalesce(try_element_at(a, -1), 0L) >= {size} THEN a
               ELSE array_append(a, element_at(transform(array(named_struct('e', coalesce(try_element_at(a, -1), 0L) + {tokens})),
                      z -> CASE WHEN z.e >= {size} THEN {size} ELSE z.e - ({back}) END), 1)) END) END""")


def pack_texts(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: PackParams = PackParams()
) -> DataFrame:
    """Containers of texts: id, text_hash, piece_no, n_pieces, byte_start, byte_end, tokens, container.

    A token is a UTF-8 byte, as a byte-level tokenizer counts at most. A text within the capacity is one piece; a longer one
    becomes pieces that are full up to the start of a character, and a rest. Pieces are dealt evenly into blocks by a
    hash, and each block is packed on its own, whatever the corpus size; it leaves few containers unfilled. container is
    unique over all blocks.

    A null text has one row with null tokens and container; an empty one has 0 tokens and a container (of its block's
    documents). Repeated rows count once; different texts of one id are packed each, told apart by text_hash. Texts are
    read once, in the JVM; only their lengths are shuffled.
    """
    rows = documents.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.encode(text_col, "UTF-8").alias("b")
    )
    rows = rows.select("id", "text_hash", F.when(F.col("b").isNotNull(), _ends("b", params.tokens)).alias("ends")).distinct()
    pieces = rows.select("id", "text_hash", F.size("ends").alias("n"), F.posexplode_outer("ends").alias("piece_no", "byte_end"), "ends")
    pieces = pieces.select(
        "id", "text_hash", F.coalesce("piece_no", F.lit(0)).alias("piece_no"), F.greatest("n", F.lit(1)).alias("n_pieces"),
        F.when(F.col("piece_no") > 0, F.get("ends", F.col("piece_no") - 1)).when(F.col("byte_end").isNotNull(), 0).alias("byte_start"), "byte_end",
    ).withColumn("tokens", (F.col("byte_end") - F.col("byte_start")).cast("int"))
    # As many as there are rows at most, or a little more; the count reads no text.
    blocks = max(1, -(-documents.count() // params.block_rows))
    block = F.pmod(F.xxhash64("id", "text_hash", "piece_no"), F.lit(blocks)).cast("int")

    def run(key, rows):
        rows = rows.sort_by([("tokens", "descending"), ("id", "ascending"), ("text_hash", "ascending"), ("piece_no", "ascending")])
        tokens = rows.column("tokens").combine_chunks()
        names = best_fit(tokens.drop_null().to_numpy(), params)
        block_no = key[0].as_py()
        # Nulls sort last.
        labels = [f"{block_no}-{n}" for n in names.tolist()] + [None] * tokens.null_count
        return rows.drop_columns(["block"]).append_column("container", pa.array(labels, pa.string()))

    schema = "id bigint, text_hash bigint, piece_no int, n_pieces int, byte_start bigint, byte_end bigint, tokens int, container string"
    # A partition for each block: packing takes far longer than its few bytes make adaptive execution think.
    packed = pieces.withColumn("block", block).repartition(blocks, "block").groupBy("block").applyInArrow(run, schema)
    return packed.withColumnRenamed("id", id_col)


def fill_report(packed: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """Containers and tokens; the mean fill and the most by each constraint; how many containers have their documents or
    attention used up to 97 percent; and the fewest containers that could hold so many tokens."""
    by_bin = packed.where(F.col("container").isNotNull()).groupBy("container").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.sum(F.col("tokens").cast("double") ** 2).alias("cost")
    )
    total = F.coalesce(F.sum("tokens"), F.lit(0))
    share = {"tokens": F.col("tokens") / params.capacity[0], "documents": F.col("pieces") / params.capacity[1], "attention": F.col("cost") / params.capacity[2]}
    return by_bin.agg(
        F.count(F.lit(1)).alias("containers"), total.alias("tokens"), F.max("tokens").alias("fullest"), F.max("pieces").alias("most_pieces"),
        *[F.round(F.avg(x), 6).alias(f"mean_{n}") for n, x in share.items()], *[F.count_if(x >= 0.97).alias(f"full_{n}") for n, x in share.items()],
        F.ceil(total / params.tokens).alias("fewest_possible"),
    )


def packing_checks(documents: DataFrame, packed: DataFrame, params: PackParams = PackParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each text: id, bytes, split, and whether its pieces follow on each other from its begin to its end (covered), begin
    with a character (whole_characters) and lie in containers within every capacity (fits)."""
    loads = packed.where(F.col("container").isNotNull()).groupBy("container").agg(
        F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.sum(F.col("tokens").cast("double") ** 2).alias("a")
    )
    within = (F.col("t") <= params.tokens) & (F.col("n") <= params.documents) & ((F.col("n") == 1) | (F.col("a") <= params.capacity[2] * (1 + 1e-9)))
    own = packed.join(loads.select("container", within.alias("within")), "container").groupBy(id_col, "text_hash").agg(
        F.array_sort(F.collect_list(F.struct("piece_no", "byte_start", "byte_end"))).alias("ps"), F.bool_and("within").alias("fits")
    )
    texts = documents.select(id_col, F.xxhash64(text_col).alias("text_hash"), F.encode(text_col, "UTF-8").alias("b")).where(F.col("b").isNotNull())
    texts = texts.dropDuplicates([id_col, "text_hash"]).join(own, [id_col, "text_hash"], "left")
    inside = lambda p: F.substring("b", (p["byte_start"] + 1).cast("int"), F.lit(1)).between(F.lit(b"\x80"), F.lit(b"\xbf"))
    size = F.octet_length("b").cast("long")
    follows = F.forall(F.sequence(F.lit(1), F.size("ps")), lambda i: F.when(i == 1, F.get("ps", i - 1)["byte_start"] == 0).otherwise(
        F.get("ps", i - 1)["byte_start"] == F.get("ps", i - 2)["byte_end"]))
    return texts.select(
        id_col, size.alias("bytes"), (F.size("ps") > 1).alias("split"),
        (follows & (F.try_element_at("ps", F.lit(-1))["byte_end"] == size)).alias("covered"),
        (~F.exists("ps", inside)).alias("whole_characters"), "fits",
    )

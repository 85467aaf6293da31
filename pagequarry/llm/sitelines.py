"""Lines that stand in many pages of one source, found through compressed bitmaps of the pages, and their removal."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.session import shared_checkpoint

_DIGITS = re.compile(r"[0-9]+")
_SPACES = re.compile(r"[^\S\n]+")


@dataclass(frozen=True)
class LineParams:
    #: A line is repeated if it stands in at least this share of its source's pages, and in this many.
    share: float = 0.05
    least_pages: int = 3
    #: Characters of the compared form that a line needs to count.
    least_chars: int = 25
    #: Pages of a source, on average, whose bits are kept together and looked up by one task.
    group_pages: int = 16_384


def compared_lines(body: str, least_chars: int) -> list[tuple[int, str, str]]:
    """Number (from 1), compared form and own spelling of each line that counts: not one of a code block, a heading or a
    table.

    The compared form is trimmed, lower case, with white space runs as one space and ASCII digit runs as one 0.
    """
    flat = _DIGITS.sub("0", _SPACES.sub(" ", body.lower()))
    out, fence = [], ""
    for no, (line, own) in enumerate(zip(flat.split("\n"), body.split("\n")), 1):
        line = line.strip()
        head = line[:3]
        if fence:
            if head == fence:
                fence = ""
        elif head in ("```", "~~~"):
            fence = head
        elif len(line) >= least_chars and line[0] not in "#|":
            out.append((no, line, own))
    return out


# ---- containers: 65,536 bits each, as a sorted array of uint16 (few bits) or as a bit field of 8 KB (many)
_MOST_LISTED = 4096


def container(bits: np.ndarray) -> bytes:
    """The smaller form of ascending distinct bits; the first byte says which."""
    if len(bits) <= _MOST_LISTED:
        return b"\x00" + bits.astype("<u2").tobytes()
    field = np.zeros(65536, np.uint8)
    field[bits] = 1
    return b"\x01" + np.packbits(field, bitorder="little").tobytes()


def bits_of(data: bytes) -> np.ndarray:
    if data[:1] == b"\x00":
        return np.frombuffer(data, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1), bitorder="little"))


def has_bits(data: bytes, bits: np.ndarray) -> np.ndarray:
    if data[:1] == b"\x00":
        have = np.frombuffer(data, "<u2", offset=1).astype(np.int64)
        at = np.searchsorted(have, bits)
        return (at < len(have)) & (have[np.minimum(at, max(0, len(have) - 1))] == bits) if len(have) else bits < 0
    field = np.frombuffer(data, np.uint8, offset=1)
    return (field[bits >> 3] >> (bits & 7)) & 1 > 0


def cardinality(data: bytes) -> int:
    return (len(data) - 1) // 2 if data[:1] == b"\x00" else int(np.unpackbits(np.frombuffer(data, np.uint8, offset=1)).sum())


def union(parts: list[bytes]) -> bytes:
    return container(np.unique(np.concatenate([bits_of(p) for p in parts]))) if len(parts) > 1 else parts[0]


def _page_lines(pages: DataFrame, path: str, source: str, body: str, params: LineParams) -> DataFrame:
    """Of each page row: path, source, version (hash of the body), and of its lines that count number, form and variant, by
    hashes. A page without a body has no lines, but is one. The 64-bit hash of a form takes in the source, so that equal lines of two sources differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], int] = {}
        for batch in batches:
            sources, offsets = batch.column(1).to_pylist(), [0]
            nos: list[int] = []
            forms: list[int] = []
            variants: list[int] = []
            for row, text in enumerate(batch.column(3)):
                for no, form, own in compared_lines(text.as_py() or "", params.least_chars):
                    key = (sources[row], form)
                    if (h := known.get(key)) is None:
                        if len(known) > 200_000:
                            known.clear()
                        data = f"{sources[row]}\0{form}".encode("utf-8", "surrogatepass")
                        h = known[key] = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
                    nos.append(no)
                    forms.append(h)
                    variants.append(zlib.crc32(own.encode("utf-8", "surrogatepass")))
                offsets.append(len(nos))
            at = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, k)) for x, k in ((nos, pa.int32()), (forms, pa.int64()), (variants, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *lists], names=["path", "source", "version", "nos", "forms", "variants"]
            )

    picked = pages.where(F.col(path).isNotNull()).select(
        F.col(path).alias("path"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.xxhash64(body).alias("version"), F.col(body).alias("body")
    )
    return picked.mapInArrow(run, "path string, source string, version bigint, nos array<int>, forms array<bigint>, variants array<bigint>")


def _placed(pages: DataFrame, path: str, source: str, body: str, params: LineParams) -> DataFrame:
    """The rows of _page_lines, each with its group and its bit in it: the number of its path among those of the group.

    A source's pages are split into groups by a hash, so that a huge source is many groups of like size. Pages without
    lines have bits too, as they count among the source's pages.
    """
    # A group gets group_pages of a hot source's pages, fewer of others'. The count reads no column.
    groups = max(1, -(-pages.count() // params.group_pages))
    lines = _page_lines(pages, path, source, body, params)
    rows = lines.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(groups)).cast("int"))
    place = F.dense_rank().over(Window.partitionBy("source", "bucket").orderBy("path")) - 1
    return rows.select("source", "bucket", place.cast("int").alias("bit"), "path", "version", "nos", "forms", "variants")


def _flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, form and variant of all lines of a group."""
    column = lambda c: rows.column(c).combine_chunks()
    sizes = np.diff(column("forms").offsets.to_numpy())
    values = lambda c: column(c).flatten().to_numpy()
    return np.repeat(np.arange(rows.num_rows), sizes), values("forms"), values("variants")


def _local_candidates(placed: DataFrame, params: LineParams) -> DataFrame:
    """source, form of the lines that reach the share in some group.

    A line that does in its source does so in one of its groups at least; so all others need no bitmap beyond their group.
    """

    def run(rows: pa.Table) -> pa.Table:
        bits = rows.column("bit").to_numpy()
        row, form, _ = _flat(rows)
        pairs = np.unique(np.stack([form, bits[row].astype(np.int64)]), axis=1)
        forms, n = np.unique(pairs[0], return_counts=True)
        forms = forms[n >= len(np.unique(bits)) * params.share - 1e-9]
        return pa.table({"source": pa.array([rows.column("source")[0].as_py()] * len(forms), pa.string()), "form": pa.array(forms, pa.int64())})

    return placed.groupBy("source", "bucket").applyInArrow(run, "source string, form bigint").distinct()


def _bitmaps(placed: DataFrame, candidates: DataFrame, buckets: DataFrame) -> DataFrame:
    """source, bucket, form, high, bitmap, n: the pages of each candidate line, as containers of 65,536 bits.

    Every spelling of a line (its variants) has a bitmap of its own; variants of one compared form are then united. high
    is the container's number within a group, which has one almost always.
    """

    def run(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        out: dict[str, list] = {"form": [], "high": [], "bitmap": [], "n": []}
        if rows.num_rows and wanted.num_rows:
            bits = rows.column("bit").to_numpy().astype(np.int64)
            row, form, variant = _flat(rows)
            keep = np.isin(form, wanted.column("form").to_numpy())
            bit, form, variant = bits[row[keep]], form[keep], variant[keep]
            order = np.lexsort((bit, variant, bit >> 16, form))
            bit, form, variant = bit[order], form[order], variant[order]
            high = bit >> 16
            new = lambda *xs: np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in xs], axis=0)])) if len(bit) else np.zeros(0, int)
            spellings = new(form, high, variant)
            own = [container(np.unique(x & 0xFFFF)) for x in np.split(bit, spellings[1:])] if len(bit) else []
            starts = new(form, high)
            bounds = np.append(np.searchsorted(spellings, starts), len(spellings))
            for at, lo, hi in zip(starts, bounds[:-1], bounds[1:]):
                data = union(own[lo:hi])
                for name, value in zip(out, (int(form[at]), int(high[at]), data, cardinality(data))):
                    out[name].append(value)
        n = len(out["form"])
        key = [rows.column(c)[0].as_py() if rows.num_rows else None for c in ("source", "bucket")]
        kinds = {"form": pa.int64(), "high": pa.int32(), "bitmap": pa.binary(), "n": pa.int32()}
        return pa.table({"source": pa.array([key[0]] * n, pa.string()), "bucket": pa.array([key[1]] * n, pa.int32()),
                         **{c: pa.array(out[c], k) for c, k in kinds.items()}})

    # Each group gets its source's candidates.
    wanted = buckets.join(candidates, "source")
    return placed.groupBy("source", "bucket").cogroup(wanted.groupBy("source", "bucket")).applyInArrow(
        run, "source string, bucket int, form bigint, high int, bitmap binary, n int"
    )


def repeated_lines(
    pages: DataFrame, path: str = "path", source: str = "docset", body: str = "body", params: LineParams = LineParams()
) -> DataFrame:
    """Every line that is repeated within its source: path, source, version (hash of the body), line_no, form (a hash), pages
    (how many have it).

    The pages of each spelling of a line are a compressed bitmap per source. Lines that differ only in what the compared
    form drops are variants: their bitmaps are united. The bitmaps' exact cardinalities are held against the source's
    number of pages; those over the threshold go, once, to the groups of pages they are of. There each page is looked up
    in them, and the lines are reported whose forms' bitmaps have the page.

    Pages delivered again set the same bits, other bodies of a path too. A null body has no lines but is a page, a null
    source is one source of its own, a null path is left out; an empty table gives no rows. Written on the way: the
    hashes of all lines, the candidates, and the bitmaps of candidates; of these a source has at most (lines of a
    page on average) / share in each group.
    """
    placed = shared_checkpoint(_placed(pages, path, source, body, params))
    sizes = placed.groupBy("source", "bucket").agg((F.max("bit") + 1).alias("of"))
    buckets = sizes.select(*[F.col(c).alias(c) for c in ("source", "bucket", "of")])
    candidates = shared_checkpoint(_local_candidates(placed, params))
    bitmaps = shared_checkpoint(_bitmaps(placed, candidates, buckets.select("source", "bucket")))
    of = buckets.groupBy("source").agg(F.sum("of").alias("of"))
    counts = bitmaps.groupBy("source", "form").agg(F.sum("n").alias("pages"))
    frequent = counts.where(F.col("pages") >= params.least_pages).join(of, "source").where(
        F.col("pages") >= F.col("of") * params.share - 1e-9
    ).select("source", "form", "pages")
    return _looked_up(placed, bitmaps.join(frequent, ["source", "form"]))


def _looked_up(placed: DataFrame, kept: DataFrame) -> DataFrame:
    """The lines of each page whose forms' bitmaps have the page's bit."""

    def run(rows: pa.Table, maps: pa.Table) -> pa.Table:
        hit = {"row": np.zeros(0, np.int64), "no": np.zeros(0, np.int32), "form": np.zeros(0, np.int64), "pages": np.zeros(0, np.int64)}
        if rows.num_rows and maps.num_rows:
            bits = rows.column("bit").to_numpy().astype(np.int64)
            forms, which = np.unique(maps.column("form").to_numpy(), return_inverse=True)
            pages = np.zeros(len(forms), np.int64)
            pages[which] = maps.column("pages").to_numpy()
            row, form, _ = _flat(rows)
            at = np.minimum(np.searchsorted(forms, form), len(forms) - 1)
            lines = np.flatnonzero(forms[at] == form)
            lines = lines[np.argsort(at[lines], kind="stable")]
            bounds = np.searchsorted(at[lines], np.arange(len(forms) + 1))
            gone = np.zeros(len(lines), bool)
            for k, high, data in zip(which.tolist(), maps.column("high").to_pylist(), maps.column("bitmap")):
                # The pages to delete the form from.
                has = (bits >> 16 == high) & has_bits(data.as_py(), bits & 0xFFFF)
                gone[bounds[k] : bounds[k + 1]] |= has[row[lines[bounds[k] : bounds[k + 1]]]]
            found = lines[gone]
            no = rows.column("nos").combine_chunks().flatten().to_numpy()
            hit = {"row": row[found], "no": no[found], "form": form[found], "pages": pages[at[found]]}
        take = pa.array(hit["row"], pa.int64())
        return pa.table({
            **{c: rows.column(c).take(take) for c in ("path", "source", "version")}, "line_no": pa.array(hit["no"], pa.int32()),
            "form": pa.array(hit["form"], pa.int64()), "pages": pa.array(hit["pages"], pa.int64()),
        })

    schema = "path string, source string, version bigint, line_no int, form bigint, pages bigint"
    maps = kept.select("source", "bucket", "form", "high", "bitmap", "pages")
    return placed.groupBy("source", "bucket").cogroup(maps.groupBy("source", "bucket")).applyInArrow(run, schema).distinct()


def without_lines(pages: DataFrame, found: DataFrame, path: str = "path", source: str = "docset", body: str = "body") -> DataFrame:
    """Every page (one row per path, source and body) with its body without the lines found: path, body, removed.

    Bodies are shuffled once, by their path, for dropping repeated rows and for the join.
    """
    marks = found.groupBy("path", "source", "version").agg(F.collect_set("line_no").alias("nos"))
    bodies = pages.select(F.col(path).alias("path"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(body).alias("body"))
    bodies = bodies.withColumn("version", F.xxhash64("body")).repartition("path").dropDuplicates(["path", "source", "version"])
    lines = F.split("body", "\n", -1)
    kept = F.array_join(
        F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("nos", i + 1), x)), lambda x: x.isNotNull()), "\n"
    )
    return bodies.join(marks, ["path", "source", "version"], "left").select(
        F.col("path").alias(path), F.when(F.col("nos").isNull(), F.col("body")).otherwise(kept).alias(body),
        F.coalesce(F.size("nos"), F.lit(0)).alias("removed"),
    )

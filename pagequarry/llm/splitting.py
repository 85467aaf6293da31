"""Splitting oversized texts at natural boundaries, guided by lexical cohesion."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SplitParams:
    """Sizes in code points."""

    limit: int = 4000
    overlap: int = 200
    #: A cut is sought in the last part of a piece first: not before this share of the room a piece has for new text.
    reach: float = 0.5
    #: What a boundary between blocks, lines and sentences adds to the depth of its valley (which is 0 to 2).
    natural: tuple[float, float, float] = (0.25, 0.1, 0.0)
    #: Tokens on either side of a boundary whose likeness is its cohesion.
    block_tokens: int = 80

    def __post_init__(self) -> None:
        if self.overlap < 0 or self.limit <= self.overlap or not 0 <= self.reach < 1 or self.block_tokens < 1:
            raise ValueError("limit must exceed overlap, reach lie in [0, 1), block_tokens be positive")


#: What text may be cut at, the most natural first; a cut lies at the end of a match.
BOUNDARIES = (
    re.compile(r"\n[^\S\n]*\n\s*"),  # blocks
    re.compile(r"\n"),  # lines
    re.compile(r"[.!?…。！？]+[\"'”’»)\]*_`]*\s+|[。！？]+"),  # sentences
    re.compile(r"\s+"),  # words
)
_TOKEN = re.compile(r"\w+")


class _Cohesion:
    """Likeness of the tokens before and after a position, and how deep a valley it is among its neighbours."""

    def __init__(self, text: str, width: int) -> None:
        self.width = width
        self.tokens: list[str] = []
        self.starts: list[int] = []
        for m in _TOKEN.finditer(text):
            self.tokens.append(m.group().lower())
            self.starts.append(m.start())

    def values(self, cuts: list[int]) -> list[float]:
        """Cosine of the token counts on either side of each cut (ascending), by sliding both blocks token by token."""
        gaps = [bisect_left(self.starts, c) for c in cuts]
        tokens, width, n = self.tokens, self.width, len(self.tokens)
        at = gaps[0]
        left, right = Counter(tokens[max(0, at - width) : at]), Counter(tokens[at : at + width])
        dot = sum(k * right[t] for t, k in left.items())
        norms = [sum(k * k for k in left.values()), sum(k * k for k in right.values())]
        out = []
        for gap in gaps:
            while at < gap:
                moved = tokens[at]
                # The token leaves the right block, enters the left one; another enters and leaves at the far ends.
                norms[1] -= 2 * right[moved] - 1
                dot -= left[moved]
                right[moved] -= 1
                norms[0] += 2 * left[moved] + 1
                dot += right[moved]
                left[moved] += 1
                if at + width < n:
                    new = tokens[at + width]
                    norms[1] += 2 * right[new] + 1
                    dot += left[new]
                    right[new] += 1
                if at - width >= 0:
                    old = tokens[at - width]
                    norms[0] -= 2 * left[old] - 1
                    dot -= right[old]
                    left[old] -= 1
                at += 1
            norm = norms[0] * norms[1]
            out.append(dot / norm**0.5 if norm else 0.0)
        return out

    def depths(self, cuts: list[int]) -> list[float]:
        """Of each cut: how far cohesion rises from it to the peaks on both sides, walking uphill."""
        if len(cuts) == 1:
            return [0.0]
        values = self.values(cuts)
        depths = [0.0] * len(cuts)
        for step in (1, -1):
            peak: list[float] = [0.0] * len(cuts)
            order = range(len(cuts)) if step == 1 else range(len(cuts) - 1, -1, -1)
            for k in order:
                before = k - step
                inside = 0 <= before < len(cuts)
                peak[k] = max(values[k], peak[before]) if inside and values[before] >= values[k] else values[k]
                depths[k] += peak[k] - values[k]
        return depths


def cut_points(text: str, params: SplitParams = SplitParams()) -> list[int]:
    """Where the pieces of a text end, in code points; the last is its length. One cut for a text within the limit.

    Within each size window the boundaries between blocks, lines and sentences compete by the depth of cohesion's valley
    at them, to which a more natural one adds some; of equal ones the last is taken, and words are parted only where there is
    no other boundary. If the window has no boundary, the rest of the piece's new text before
    it is searched in the same way. A piece without any boundary is cut at its end, but not between a letter and its
    combining marks where that can be helped. No piece is shorter than the overlap that the next one repeats.
    """
    size, ends = len(text), []
    if size <= params.limit:
        return [size]
    cohesion = _Cohesion(text, params.block_tokens)
    start = 0
    while size - start > params.limit:
        # start counts the overlap in; new text begins after it.
        begun = start + (params.overlap if ends else 0)
        latest = start + params.limit
        earliest = begun + max(1, int((latest - begun) * params.reach))
        chosen = _natural_cut(text, cohesion, params, earliest, latest, latest)
        chosen = chosen or _natural_cut(text, cohesion, params, max(begun + 1, start + params.overlap), earliest - 1, latest)
        if not chosen:
            chosen = latest
            while chosen > earliest and _joins(text[chosen]):
                chosen -= 1
        ends.append(chosen)
        start = chosen - params.overlap
    return [*ends, size]


def _natural_cut(text: str, cohesion: _Cohesion, params: SplitParams, first: int, last: int, limit: int) -> int:
    """The best boundary in [first, last], 0 if none is there; a match that runs beyond the piece's limit is used up to it."""
    worth: dict[int, float] = {}
    for boundary, more in zip(BOUNDARIES, (*params.natural, None)):
        if more is None and worth:
            break
        # One character more is in sight, so that white space at the limit is seen.
        ends = (min(m.end(), limit) for m in boundary.finditer(text, first - 1, limit))
        for end in ends:
            if first <= end <= last:
                worth.setdefault(end, more or 0.0)
    cuts = sorted(worth)
    if not cuts:
        return 0
    return max(zip(cohesion.depths(cuts), cuts), key=lambda x: (x[0] + worth[x[1]], x[1]))[1]


def _joins(ch: str) -> bool:
    return unicodedata.combining(ch) != 0 or ch in "\u200d\ufe0f"


def split_pieces(
    rows: DataFrame, text: str, key: list[str], params: SplitParams = SplitParams(), oversized_only: bool = True
) -> DataFrame:
    """Pieces of the oversized texts: key columns, text_hash (MD5 of the text), piece_no (from 0), n_pieces,
    piece_start, piece_end, piece.

    Offsets count code points; piece 0 starts at 0 and each next one `overlap` before the end of the one before, so
    that the pieces without their overlaps are the text. Rows with a null text have no pieces; with
    oversized_only=False a text within the limit, empty ones included, is its own single piece. Repeated rows yield
    their pieces once, different texts of one key each their own, told apart by text_hash. Only the key and the text are read, so other columns may have any name.

    The length filter runs in the JVM, so texts within the limit never reach Python.
    """
    picked = rows.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)], F.col(text).alias("t"))
    picked = picked.where(F.length("t") > params.limit if oversized_only else F.col("t").isNotNull())
    key = [*key, "text_hash"]
    picked = picked.distinct().select(*[f"k{i}" for i in range(len(key) - 1)], F.md5("t").alias(f"k{len(key) - 1}"), "t")
    schema = ", ".join(f"k{i} {picked.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(key)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took, cols = [], ([], [], [], [], [])
            for row, value in enumerate(batch.column(len(key)).to_pylist()):
                ends = cut_points(value, params)
                for no, end in enumerate(ends):
                    start = ends[no - 1] - params.overlap if no else 0
                    took.append(row)
                    for col, x in zip(cols, (no, len(ends), start, end, value[start:end])):
                        col.append(x)
            ks = [batch.column(i).take(pa.array(took, pa.int32())) for i in range(len(key))]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*ks, *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                names=[*[f"k{i}" for i in range(len(key))], "piece_no", "n_pieces", "piece_start", "piece_end", "piece"],
            )

    out = picked.mapInArrow(
        run, f"{schema}, piece_no int, n_pieces int, piece_start bigint, piece_end bigint, piece string"
    )
    for i, k in enumerate(key):
        out = out.withColumnRenamed(f"k{i}", k)
    return out

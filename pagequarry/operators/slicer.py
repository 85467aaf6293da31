"""Slicing Markdown pages into sections at their headings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_FENCE = re.compile(r" {0,3}(?:(`{3,})[^`]*|(~{3,}).*)\Z", re.S)
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]|\s*\Z)")
_CLOSING = re.compile(r"(?:^|[ \t]+)#+\Z")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)\s*\Z")
_INDENTED = re.compile(r" {4}")


class Section(NamedTuple):
    sec_no: int
    level: int
    heading: str
    breadcrumb: list[str]
    has_body: bool
    body: str
    start: int
    end: int


#: What a line is to fenced code.
OUTSIDE, OPENS, WITHIN, CLOSES = "outside", "opens", "within", "closes"


class Fences:
    """Follows fenced code along the lines of a page. mark is the open fence's run of characters, '' where none is open."""

    def __init__(self) -> None:
        self.mark = ""

    def step(self, line: str) -> str:
        """What the next line is: OUTSIDE, OPENS, WITHIN or CLOSES."""
        if self.mark:
            closer = re.fullmatch(r" {0,3}(%s+)\s*" % re.escape(self.mark[0]), line)
            if closer and len(closer[1]) >= len(self.mark):
                self.mark = ""
                return CLOSES
            return WITHIN
        opener = _FENCE.match(line)
        if opener:
            self.mark = opener[1] or opener[2]
        return OPENS if opener else OUTSIDE


def slice_text(text: str, max_level: int = 3) -> Iterator[Section]:
    """Sections of one page in order. Offsets are characters of the text; a body is text[start:end].

    A section runs from behind its heading to the next heading of max_level (1 to 6) or less. Text before the first
    one is of level 0. A heading without a body stays, what has neither is left out. Nothing in fenced code is a
    heading. A one-line paragraph over a row of = or - is a heading of level 1 or 2, whatever max_level is.
    """
    max_level = min(6, max(1, max_level))
    fences, stack, count = Fences(), [], 0
    level, heading, crumbs, start = 0, "", [], 0
    paragraph: tuple[int, str, int] | None = None  # where it begins, its text, its lines
    at = 0

    def section(end: int) -> Section | None:
        body = text[start:end]
        has_body = bool(body.strip())
        return Section(count, level, heading, crumbs, has_body, body, start, end) if heading or has_body else None

    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        begin, at = at, at + len(line)
        found: tuple[int, str, int] | None = None  # level, heading, where the section before it ends
        if fences.step(line) != OUTSIDE:
            paragraph = None
            continue
        if (m := _HEADING.match(line)) and len(m.group(1)) <= max_level:
            found = len(m.group(1)), _CLOSING.sub("", line[m.end(1) :].strip()).strip(), begin
        elif m := _UNDERLINE.match(line):
            if paragraph and paragraph[2] == 1:
                found = 1 if m.group(1)[0] == "=" else 2, paragraph[1], paragraph[0]
            paragraph = None
        elif not line.strip():
            paragraph = None
        elif paragraph:
            paragraph = paragraph[0], f"{paragraph[1]} {line.strip()}", paragraph[2] + 1
        elif not _INDENTED.match(line):
            paragraph = begin, line.strip(), 1
        if found:
            if done := section(found[2]):
                yield done
                count += 1
            level, heading, _ = found
            while stack and stack[-1][0] >= level:
                stack.pop()
            crumbs = [title for _, title in stack]
            stack.append((level, heading))
            start, paragraph = at, None
    if done := section(len(text)):
        yield done


_FIELDS = (
    "sec_no int, level tinyint, heading string, breadcrumb array<string>, has_body boolean, body string, body_bytes int,"
    " range_start bigint, range_end bigint"
)


def _with_bytes(text: str, max_level: int) -> Iterator[tuple]:
    """Rows of _FIELDS: offsets in bytes of the UTF-8 text."""
    known, byte = 0, 0
    for s in slice_text(text, max_level):
        byte += len(text[known : s.start].encode("utf-8", "surrogatepass"))
        known = s.start
        size = len(s.body.encode("utf-8", "surrogatepass"))
        yield s.sec_no, s.level, s.heading, s.breadcrumb, s.has_body, s.body, size, byte, byte + size


@udtf(returnType=_FIELDS)
class MarkdownSections:
    """Table function md_sections(body, max_level); a null body has no sections."""

    def eval(self, body: str, max_level: int):
        if body is not None:
            yield from _with_bytes(body, 3 if max_level is None else max_level)


def register(spark: SparkSession) -> None:
    """Makes md_sections known to SQL: FROM pages, LATERAL md_sections(body, 3)."""
    spark.udtf.register("md_sections", MarkdownSections)


def sections_of(pages: DataFrame, max_level: int = 3) -> DataFrame:
    """Sections of pages (path, body, and page_name, page_stem, url, docset where there are such columns).

    Each page is sliced on its own, in Arrow batches. A path delivered more than once is sliced once: the row ingested
    last where there is a column ingested_at, of equal ones that whose body has the largest hash, so that sections of
    two versions never mix. A null path or body has no sections. Missing names are empty, as in a corpus of a single file.
    Bodies are shuffled once, before slicing, and sections not at all.
    """
    have = set(pages.columns)
    text = lambda c: (F.col(c) if c in have else F.lit(None)).cast("string")
    last = F.col("ingested_at").cast("timestamp") if "ingested_at" in have else F.lit(None).cast("timestamp")
    order = F.struct(F.coalesce(last, F.timestamp_seconds(F.lit(0))), F.xxhash64("body"))
    picked = pages.where(F.col("body").isNotNull() & F.col("path").isNotNull()).groupBy("path").agg(
        F.max_by(F.struct(*[F.col(c) for c in ("page_name", "page_stem", "url", "docset") if c in have], "body"), order).alias("r")
    ).select("path", "r.*")
    have = set(picked.columns)
    picked = picked.select(
        "path", F.coalesce(text("page_name"), F.lit("")).alias("page"),
        F.coalesce(text("page_stem"), F.lit("")).alias("page_stem"), text("url").alias("url"), text("docset").alias("docset"),
        "body",
    )
    carried = "path string, page string, page_stem string, url string, docset string"
    kinds = [pa.int32(), pa.int8(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in f"{carried}, {_FIELDS}".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, body in enumerate(batch.column(5)):
                for row in _with_bytes(body.as_py(), max_level):
                    rows.append(row)
                    at.append(i)
            cols = list(zip(*rows)) if rows else [()] * len(kinds)
            index = pa.array(at, pa.int32())
            own = [pa.array(list(c), k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(index) for i in range(5)), *own], names=names)

    return picked.mapInArrow(run, f"{carried}, {_FIELDS}")


def heading_statistics(pages: DataFrame) -> DataFrame:
    """Of each page: whether its fences are balanced, and its headings (levels 1 to 3 outside of fences)."""
    head = re.compile(r" {0,3}#{1,3} \S")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            balanced, headings = [], []
            for body in batch.column(1).to_pylist():
                fences = Fences()
                n = sum(fences.step(line) == OUTSIDE and head.match(line) is not None for line in body.split("\n"))
                balanced.append(not fences.mark)
                headings.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(balanced, pa.bool_()), pa.array(headings, pa.int32())],
                names=["path", "balanced", "headings"],
            )

    picked = pages.where(F.col("body").isNotNull() & F.col("path").isNotNull()).select("path", "body")
    return picked.mapInArrow(run, "path string, balanced boolean, headings int").distinct()

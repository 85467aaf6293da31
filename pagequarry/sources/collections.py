"""Sources beside Markdown files: link lists, zip and EPUB archives, relevance sets; and text sinks."""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Links of an index that are pages, images of a book.
LINK = r"\((/docs[^)]*\.md)\)"
IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".svg", ".gif")
LEAST_LINKS = 100


def page_links(index: Column) -> Column:
    """Links to pages in an index, each once, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(index, F.lit(LINK), F.lit(1))))


def links(indexes: DataFrame, text: str = "text") -> DataFrame:
    """link of all indexes, each once."""
    return indexes.select(F.explode(page_links(F.col(text))).alias("link")).distinct()


def checked_links(indexes: DataFrame, least: int = LEAST_LINKS) -> DataFrame:
    found = links(indexes)
    if (n := found.count()) < least:
        raise ValueError(f"the index has {n} links, {least} are expected at least")
    return found


def fetched(links_: DataFrame, fetch: Callable[[str], str], tries: int = 3, wait_s: float = 2.0) -> DataFrame:
    """link, text, error of pages by a given function, tried again after growing waits; a failed page has a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for link in batch.column(0).to_pylist():
                text = error = None
                for n in range(tries):
                    try:
                        text, error = fetch(link), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = str(e)
                        if n + 1 < tries:
                            time.sleep(wait_s * (n + 1))
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["link", "text", "error"]
            )

    return links_.select("link").mapInArrow(run, "link string, text string, error string")


# Fixed value: what counts as front matter of a fetched page.
FETCHED_FRONT = r"(?s)\A---\s*\n.*?\n---\s*\n"


def concatenated(pages: DataFrame, order: str = "link", text: str = "text") -> DataFrame:
    """The text of all pages in order, a row (order, text) for each: front matter off, white space at the end replaced by
    a blank line. Joined without separators the rows are the corpus; they are sorted across partitions, so that no task
    holds it all."""
    bare = F.concat(F.regexp_replace(F.regexp_replace(text, FETCHED_FRONT, ""), r"(?U)\s+\z", ""), F.lit("\n\n"))
    return pages.where(F.col(text).isNotNull()).select(F.col(order).alias(order), bare.alias("text")).orderBy(order)


def _book(data: bytes) -> zipfile.ZipFile:
    """The archive itself, or the only book in it if it is no book."""
    outer = zipfile.ZipFile(io.BytesIO(data))
    names = outer.namelist()
    books = [n for n in names if n.lower().endswith(".epub")]
    if "META-INF/container.xml" not in names and len(books) == 1:
        return zipfile.ZipFile(io.BytesIO(outer.read(books[0])))
    return outer


def archive_members(files: DataFrame) -> DataFrame:
    """archive, member, kind ("image" or "other"), size of the members of archives (path, content); broken archives
    have one row with a null member. Members with a part ".." are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    members = _book(data).infolist()
                except (zipfile.BadZipFile, TypeError):
                    rows.append((path, None, None, None))
                    continue
                for m in members:
                    name = PurePosixPath(m.filename)
                    if not m.is_dir() and ".." not in name.parts:
                        rows.append((path, m.filename, "image" if name.suffix.lower() in IMAGES else "other", m.file_size))
            cols = list(zip(*rows)) if rows else [()] * 4
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["archive", "member", "kind", "size"]
            )

    return files.select("path", "content").mapInArrow(run, "archive string, member string, kind string, size bigint")


def archive_images(files: DataFrame) -> DataFrame:
    """archive, member, content of the images in archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    book = _book(data)
                except (zipfile.BadZipFile, TypeError):
                    continue
                names = [m.filename for m in book.infolist() if not m.is_dir()]
                names = [n for n in names if PurePosixPath(n).suffix.lower() in IMAGES and ".." not in PurePosixPath(n).parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(names), pa.string()), pa.array(names, pa.string()),
                     pa.array([book.read(n) for n in names], pa.binary())],
                    names=["archive", "member", "content"],
                )

    return files.select("path", "content").mapInArrow(run, "archive string, member string, content binary")


def relevance_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_id, docset, query, kind, expected of a relevance set in JSON ({description, cases: [...]})."""
    schema = "description string, cases array<struct<docset: string, query: string, kind: string, expected: array<string>>>"
    cases = spark.read.schema(schema).json(path, multiLine=True)
    rows = cases.select(F.posexplode("cases").alias("case_id", "c"))
    return rows.select(F.col("case_id").cast("long").alias("case_id"), "c.docset", "c.query", "c.kind", "c.expected")


def write_corpus(text: DataFrame, stem: str, folder: str, pages: DataFrame | None = None, built: str | None = None) -> None:
    """Text sinks: <stem>_clean.md, <stem>.pages.txt and BUILT_AT.txt as folders of parts in order that Spark writes, each
    by as many tasks as its rows have partitions. Rows end with a line feed, those that have one with that."""
    text.select(F.regexp_replace("text", r"\n\z", "").alias("value")).write.mode("overwrite").text(f"{folder}/{stem}_clean.md")
    if pages is not None:
        pages.select(F.col("link").alias("value")).orderBy("value").write.mode("overwrite").text(f"{folder}/{stem}.pages.txt")
    if built is not None:
        text.sparkSession.range(1).select(F.lit(built).alias("value")).write.mode("overwrite").text(f"{folder}/BUILT_AT.txt")

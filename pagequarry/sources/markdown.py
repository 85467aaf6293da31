"""Reading Markdown corpora: single files, directories, front matter and page identity."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from pagequarry.functions.matching import unicode_trim
from pagequarry.params import NoMarkdown, SourceError

#: Lines that open and close a page's front matter, with what is between; group 1 is its fields.
FRONT_MATTER = r"(?sU)\A---[^\S\n]*\n(|.*?\n)(?:---|\.\.\.)[^\S\n]*(?:\n|\z)"


# ---- front matter and identity, as Columns
def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, r"^\x{FEFF}", "")


def front_matter(text: Column) -> Column:
    """The fields of the front matter as text, '' where there is none; text is without byte-order mark."""
    return F.regexp_extract(text, FRONT_MATTER, 1)


def body_of(text: Column) -> Column:
    """What follows the front matter; all of a text whose front matter doesn't end."""
    return F.substring(text, F.length(F.regexp_extract(text, FRONT_MATTER, 0)) + 1, F.length(text))


def front_matter_field(fields: Column, key: str) -> Column:
    """The last value of a key at the start of a line that isn't empty, without quotes around it; null without one."""
    values = F.regexp_extract_all(fields, F.lit(rf"(?d)(?m)^{key}:([^\n]*)"), F.lit(1))
    values = F.filter(F.transform(values, lambda x: F.btrim(unicode_trim(x), F.lit("\"'"))), lambda x: x != "")
    return F.try_element_at(values, F.lit(-1))


def page_name(title: Column, path: Column) -> Column:
    return F.concat_ws(" ", title, F.regexp_replace(path, r"\.md$", ""))


def page_stem(path: Column) -> Column:
    """Last part of a path, in lower case, without .md, one .en and a manual's section number."""
    name = F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.md$", ""))
    return F.regexp_replace(F.regexp_replace(name, r"\.en$", ""), r"\.[0-9]{1,2}$", "")


def pages_from(raw: DataFrame, path: str = "path", text: str = "text", single: bool = False) -> DataFrame:
    """path, url, title, page_name, page_stem, body of raw pages. A single file's page has no name and no stem, so
    that rules on pages don't apply to it; its front matter is cut off all the same. Null texts give null bodies."""
    whole = without_bom(F.col(text))
    rows = raw.select(F.col(path).alias("path"), whole.alias("t")).withColumn("f", front_matter(F.col("t")))
    title, empty = front_matter_field(F.col("f"), "title"), F.lit("")
    return rows.select(
        "path", front_matter_field(F.col("f"), "url").alias("url"), title.alias("title"),
        (empty if single else page_name(title, F.col("path"))).alias("page_name"),
        (empty if single else page_stem(F.col("path"))).alias("page_stem"), body_of(F.col("t")).alias("body"),
    )


# ---- directories
def _store(path: str) -> tuple[fs.FileSystem, str] | None:
    """The store and the place in it of a path with a scheme (s3://, gs://, hdfs://, file://); None for a local path."""
    return fs.FileSystem.from_uri(path) if "://" in path else None


def _stored_files(root: str) -> list[tuple[str, int]]:
    store, place = _store(root)
    place = place.rstrip("/")
    found = []
    for info in store.get_file_info(fs.FileSelector(place, recursive=True)):
        inside = info.path[len(place) :].strip("/")
        if info.type == fs.FileType.File and inside.lower().endswith(".md") and not any(x.startswith(".") for x in inside.split("/")):
            found.append((inside, info.size))
    return sorted(found, key=lambda x: x[0].encode("utf-8", "surrogateescape"))


def markdown_files(root: str, every: bool = False) -> list[str]:
    """Relative paths of a local directory's Markdown files, in byte order of their UTF-8.

    Hidden files and directories (a leading dot) are skipped, and links to directories aren't followed; names with a
    leading underscore count. every: also hidden files, but only a lower-case extension, as checks of expected pages use.
    """
    found = []
    for folder, folders, names in os.walk(root):
        if not every:
            folders[:] = [f for f in folders if not f.startswith(".")]
        for name in [*names, *(f for f in folders if os.path.islink(os.path.join(folder, f)))]:
            wanted = name.endswith(".md") if every else name.lower().endswith(".md") and not name.startswith(".")
            if wanted:
                found.append(os.path.relpath(os.path.join(folder, name), root).replace(os.sep, "/"))
    return sorted(found, key=lambda p: p.encode("utf-8", "surrogateescape"))


def corpus_files(root: str) -> list[tuple[str, int]]:
    """Relative paths and sizes of a corpus's Markdown files, local or in a store, in byte order."""
    if _store(root):
        return _stored_files(root)
    return [(p, os.path.getsize(os.path.join(root, p))) for p in markdown_files(root)]


class _Chunk(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class MarkdownReader(DataSourceReader):
    #: Bytes of files that one task reads; a larger file is a task of its own.
    CHUNK = 32 << 20

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]

    def partitions(self) -> list[_Chunk]:
        chunks, size = [_Chunk([])], 0
        for path, own in corpus_files(self.root):
            if chunks[-1].paths and size + own > self.CHUNK:
                chunks.append(_Chunk([]))
                size = 0
            chunks[-1].paths.append(path)
            size += own
        return chunks

    def read(self, partition: _Chunk) -> Iterator[tuple[str, str]]:
        store, place = _store(self.root) or (fs.LocalFileSystem(), os.path.abspath(self.root))
        for path in partition.paths:
            with store.open_input_stream(f"{place.rstrip('/')}/{path}") as file:
                yield path, file.read().decode("utf-8")  # bytes that aren't UTF-8 are an error, not replaced


class MarkdownDirectory(DataSource):
    """spark.read.format("markdown_dir").load(folder): path, text of its Markdown files, in chunks by size.

    The folder is local or in an object store, read by Arrow's file systems: Spark's own file sources hide names with a
    leading underscore, which are pages here.
    """

    @classmethod
    def name(cls) -> str:
        return "markdown_dir"

    def schema(self) -> str:
        return "path string, text string"

    def reader(self, schema: StructType) -> MarkdownReader:
        return MarkdownReader(self.options)


def load_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """Pages of a file or a directory, local or in a store, and whether it is a directory."""
    stored = _store(path)
    is_folder = stored[0].get_file_info(stored[1]).type == fs.FileType.Directory if stored else os.path.isdir(path)
    if is_folder:
        if not corpus_files(path):
            raise NoMarkdown(path)
        spark.dataSource.register(MarkdownDirectory)
        return pages_from(spark.read.format("markdown_dir").load(path)), True
    store, place = stored or (fs.LocalFileSystem(), path)
    try:
        with store.open_input_stream(place) as file:
            text = file.read().decode("utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise SourceError(e) from e
    raw = spark.createDataFrame([(os.path.basename(path), text)], "path string, text string")
    return pages_from(raw, single=True), False

"""Search in one call."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from pagequarry.operators import render as R
from pagequarry.operators.search import prepared, rank_sections
from pagequarry.operators.slicer import sections_of
from pagequarry.params import InvalidParam, RankingParams
from pagequarry.sources.markdown import load_corpus


@dataclass
class SearchOutcome:
    """Ranked hits (rank, score, path, sec_no) over sections; pages is empty of names for a single file."""

    hits: DataFrame
    sections: DataFrame
    pages: DataFrame
    directory: bool

    @cached_property
    def found(self) -> list[dict]:
        """The hits with their texts, in order, collected once: at most top_k rows come to the driver."""
        columns = ["level", "heading", "breadcrumb", "body", "url"]
        rows = self.hits.join(self.sections.select("path", "sec_no", *columns), ["path", "sec_no"]).collect()
        return [r.asDict() | {"cited": self.directory} for r in sorted(rows, key=lambda r: r["rank"])]

    def output(self, query: str, max_tokens: int = 8000) -> str:
        """The rendered text of the hits."""
        return R.render(query, self.found, max_tokens)


def search(
    spark: SparkSession, corpus: str, query: str, top_k: int = 3, params: RankingParams = RankingParams()
) -> SearchOutcome:
    """The best sections of a Markdown file or directory for a query."""
    if top_k < 1:
        raise InvalidParam("top_k")
    pages, directory = load_corpus(spark, corpus)
    sections = sections_of(pages, params.max_heading_level).cache()
    return SearchOutcome(rank_sections(prepared(sections, params), query, top_k, params), sections, pages, directory)

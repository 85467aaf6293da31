"""Rendering ranked sections as text under a budget of characters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.operators.slicer import Fences
from pagequarry.params import InvalidParam, TooLarge
from pagequarry.session import BROADCAST_BYTES, shared_checkpoint

# What readers of the output parse.
BEGIN = "--- DÉBUT DE SECTION (Score: {score}) ---\n"
END = "--- FIN DE SECTION ---"
CUT = "\n\n[... Section tronquée pour respecter le budget de tokens ...]"
HEADER = "Résultats de recherche pour '{query}' :\n\n"
#: Characters that count as a token.
CHARS_PER_TOKEN = 4
#: The budget must fit an unsigned 64-bit number.
LARGEST = (1 << 64) - 1


def budget_of(max_tokens: int) -> int:
    if max_tokens < 1:
        raise InvalidParam("max_tokens")
    if max_tokens > LARGEST // CHARS_PER_TOKEN:
        raise TooLarge("max_tokens")
    return max_tokens * CHARS_PER_TOKEN


def shortened(body: str, most: int) -> str:
    """At most `most` characters, up to the end of a line where there is one; a fence left open is closed."""
    if len(body) <= most:
        return body
    kept = body[: body.rfind("\n", 0, most) + 1] or body[:most]
    fences = Fences()
    for line in kept.split("\n"):
        fences.step(line)
    if fences.mark and not kept.endswith("\n"):
        kept += "\n"
    return kept + fences.mark


def block(hit: dict, share: int) -> str:
    """One section: its head, and as much of its body as the share leaves room for."""
    score = int(hit["score"] + 0.5) if hit["score"] >= 0 else -int(0.5 - hit["score"])
    head = [BEGIN.format(score=score)]
    if hit["level"]:
        head.append(f"{'#' * hit['level']} {hit['heading']}\n")
    if hit["breadcrumb"]:
        head.append(f"> {' > '.join(hit['breadcrumb'])}\n")
    if hit["path"] and hit["cited"]:
        head += [f"> Source: {hit['url']}\n"] * (hit["url"] is not None) + [f"> File: {hit['path']}\n"]
    text, body = "".join(head), hit["body"] or ""
    room = max(0, share - (len(text) + len(END) + 3))
    if len(body) > room:
        room = max(0, room - len(CUT))
        body = shortened(body, room) + CUT if room else ""
    return f"{text}{body}\n{END}\n\n"


def render(query: str, hits: Sequence[dict], max_tokens: int = 8000) -> str:
    """The hits in rank order. Each may use an even share of what is left; what it leaves goes to those after it."""
    left = budget_of(max_tokens)
    out = [HEADER.format(query=query)]
    left = max(0, left - len(out[0]))
    for i, hit in enumerate(hits):
        share = left // (len(hits) - i)
        if not share:
            break
        out.append(block(hit, share))
        left = max(0, left - len(out[-1]))
    return "".join(out)


def rendered(hits: DataFrame, sections: DataFrame, queries: DataFrame, max_tokens: int = 8000, cited: bool = True) -> DataFrame:
    """query_id, output of every query with hits (query_id, rank, score, path, sec_no): the rendered text.

    Runs on hits that are cut to the top k before, so a query's rows are few. A null query is rendered as empty.
    """
    budget_of(max_tokens)
    columns = ["level", "heading", "breadcrumb", "body", "url"]
    # Few sections are hits; of rows with one (path, sec_no) the one with the largest hash is shown.
    texts = sections.select("path", "sec_no", F.xxhash64(*columns).alias("__v"), F.struct(*columns).alias("s"))
    names = queries.groupBy("query_id").agg(F.min("query").alias("query"))
    # Sent to where the sections are, if their size allows: texts without a hit are not shuffled then.
    hits = shared_checkpoint(hits.select("query_id", "rank", "score", "path", "sec_no"))
    size = hits.agg(F.sum(F.octet_length("path") + F.octet_length(F.col("query_id").cast("string")) + 64).alias("n")).first().n or 0
    # Both groups below are within a query's rows, so one shuffle does.
    shown = texts.join(F.broadcast(hits) if size <= BROADCAST_BYTES else hits, ["path", "sec_no"]).repartition("query_id")
    shown = shown.groupBy("query_id", "rank").agg(F.max_by(F.struct("score", "path", "s"), "__v").alias("h"))
    rows = shown.select("query_id", "rank", "h.score", "h.path", "h.s.*").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "score", "path", *columns))).alias("hits")
    ).join(names, "query_id").select("query_id", "query", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                render(q or "", [h | {"cited": cited} for h in hs], max_tokens)
                for q, hs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["query_id", "output"])

    return rows.mapInArrow(run, "query_id string, output string")

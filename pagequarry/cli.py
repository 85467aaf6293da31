"""Command lines: search a corpus (exit 0 with hits, 1 without, 2 on errors), and with --normalize first repair a crawled
file (exit 0, or 2 if nothing could be written)."""

from __future__ import annotations

import argparse
import datetime
import sys
from pathlib import Path

from pagequarry import __version__
from pagequarry.params import RankingParams, SearchError, SourceError


def _positive(text: str) -> int:
    value = int(text)
    if value < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("pagequarry", description="Search Markdown documentation.")
    p.add_argument("corpus", help="a Markdown file, or a directory of such files")
    p.add_argument("query")
    p.add_argument("max_tokens_at", nargs="?", type=_positive, metavar="max_tokens")
    p.add_argument("top_k_at", nargs="?", type=_positive, metavar="top_k")
    p.add_argument("--max-tokens", type=_positive, help="budget of the output (8000)")
    p.add_argument("--top-k", type=_positive, help="sections to show (3)")
    p.add_argument("--max-level", type=int, choices=range(1, 7), default=3, help="deepest heading that starts a section")
    p.add_argument("--fold-diacritics", action="store_true", help="match letters without their accents")
    p.add_argument("--version", action="version", version=__version__)
    return p


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("pagequarry").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def normalize_main(argv: list[str] | None = None) -> int:
    """Normalizes a file by the rules of its family: NAME.md to NAME_clean.md beside it, and the date to BUILT_AT.txt.

    Nothing is written if a fence is still open afterwards, nor with --dry-run, which only shows the state before.
    """
    p = argparse.ArgumentParser("pagequarry --normalize", description="Repair a crawled Markdown file.")
    p.add_argument("family", choices=("roblox-docs", "roblox-engine", "blender", "godot"))
    p.add_argument("--input", type=Path, required=True, help="the file; pages are fetched by other means")
    p.add_argument("--dry-run", action="store_true", help="statistics only, write nothing")
    args = p.parse_args(argv)
    try:
        text = args.input.read_bytes().decode("utf-8", "replace")
    except OSError as e:
        print(f"error: {SourceError(e)}", file=sys.stderr)
        return 2
    from pagequarry.operators import normalize
    from pagequarry.operators.slicer import heading_statistics

    pages = _spark().createDataFrame([(args.input.name, text)], "path string, body string")

    def shown(when: str, df) -> bool:
        row = df.join(heading_statistics(df), "path").first()
        print(f"{when}: {len(row.body.splitlines())} lines, fences balanced: {row.balanced}, H1-H3 outside fences: {row.headings}")
        return row.balanced

    shown("before", pages)
    if args.dry_run:
        print("dry-run: no file written")
        return 0
    clean = normalize.normalized(pages, args.family).cache()
    if not shown("after", clean):
        print("error: fences are still open after normalization; nothing was written", file=sys.stderr)
        return 2
    target = args.input.with_name(f"{args.input.stem}_clean.md")
    target.write_text(clean.first().body, encoding="utf-8", newline="")
    (args.input.parent / "BUILT_AT.txt").write_text(f"{args.family}: normalized {datetime.date.today().isoformat()}\n", encoding="utf-8")
    print(f"-> {target}")
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["--normalize"]:
        return normalize_main(argv[1:])
    p = parser()
    args = p.parse_args(argv)
    for name in ("max_tokens", "top_k"):
        if getattr(args, name) is not None and getattr(args, f"{name}_at") is not None:
            p.error(f"{name} is given twice")
    first = lambda *xs: next(x for x in xs if x is not None)
    max_tokens, top_k = first(args.max_tokens, args.max_tokens_at, 8000), first(args.top_k, args.top_k_at, 3)

    from pagequarry.api import search

    spark = _spark()
    params = RankingParams(fold_diacritics=args.fold_diacritics, max_heading_level=args.max_level)
    try:
        outcome = search(spark, args.corpus, args.query, top_k, params)
        if not outcome.found:
            print(f"No section matches the query '{args.query}'.", file=sys.stderr)
            return 1
        print(outcome.output(args.query, max_tokens), end="")
    except SearchError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())

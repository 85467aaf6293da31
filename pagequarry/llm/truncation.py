"""Texts that were cut off: by a limit on length, or in the middle of a transfer."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.session import shared_checkpoint


@dataclass(frozen=True)
class CutParams:
    #: Neighbouring lengths on either side that a length's hazard is held against.
    neighbours: int = 200
    #: Share of false discoveries among what is called significant.
    false_discoveries: float = 0.01
    #: Texts that must end at a length, or in a kind of ending, for it to be significant.
    least_texts: int = 3
    #: An ending is incomplete if it is significantly more than so many times as frequent at the end of texts as before:
    #: that lists or notes come last is no sign of a cut.
    ratio: float = 10.0
    #: Lengths whose hazards one task computes, of one source.
    length_block: int = 1 << 16
    #: A line is one of the site if it stands as a paragraph of its own in so many texts, and in this share of its source's
    #: texts, or in texts of so many sources.
    site_texts: int = 3
    site_share: float = 0.01
    site_sources: int = 3


_LIST = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+")
_STOPS, _CLOSERS = tuple(".!?:;…。！？؟"), "\"'”’»)]*_`"
_STOP = re.compile(r"[.!?:;…。！？؟][\"'”’»)\]*_`]*(?=\s)")
_NUMBER = re.compile(r"\d[.,]\Z")
_RULE = re.compile(r"\s*(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,}|=+)\Z")
_LINK = re.compile(r"\]\([^()\s]*\)[*_]*\Z")
_LABEL = re.compile(r"\*\*[^*]+\*\*\Z")
_SPAN = re.compile(r"`[^`]*`")
_DIGITS = re.compile(r"[0-9]+")
_FENCES = ("```", "~~~")
#: Ends that show a block to be whole, wherever the text stops.
_CLOSED = ("stop", "bar", "link", "label", "rule")


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def form_hash(line: str, source: str) -> int:
    """Hash of a line in compared form, with the source's name left out so that sources can be compared."""
    flat = " ".join(_DIGITS.sub("0", line.lower()).split()).strip("*_ ")
    for word in re.findall(r"[a-z]{3,}", source.lower()):
        flat = flat.replace(word, "")
    return _hash(flat)


def tail_hash(line: str) -> int:
    """Hash of the brackets, with what is in them, or the dots that a line ends in; 0 without, and for a link's address."""
    line = line.rstrip()
    if line.endswith(("...", "…")):
        return _hash("…")
    if not line.endswith(("]", ")", ">", "}")):
        return 0
    at = max(map(line.rfind, "[(<{"))
    if at < 0 or line[at - 1 : at] == "]" or any(x in line[at:-1] for x in "])>}"):
        return 0
    return _hash(_DIGITS.sub("0", line[at:]))


def _line_type(bare: str) -> str:
    if bare[0] == "#":
        return "heading"
    if bare[0] == "|":
        return "row"
    if _LIST.match(bare + " "):
        return "entry"
    return "rule" if bare[0] in "-*_=" and _RULE.match(bare) else "text"


def _end(bare: str, block: list[str]) -> str:
    """What a block ends in, and how many words after the last place where it could have ended."""
    whole = "\n".join(block) if len(block) > 1 else bare
    if "`" in whole:
        if whole.count("`") % 2:
            return "open"
        whole = _SPAN.sub("", whole)
    if "[" in whole:
        link, address = whole.rfind("["), whole.rfind("](")
        if not any(x in whole[link:] for x in "]\n") or address >= 0 and not any(x in whole[address:] for x in ")\n"):
            return "open"
    if bare.rstrip(_CLOSERS).endswith(_STOPS):
        return "number" if _NUMBER.search(bare) else "stop"
    if bare[-1] == "|":
        return "bar"
    if bare[-1] in ")*_" and _LINK.search(bare):
        return "link"
    if bare[0] == "*" and _LABEL.match(bare):
        return "label"
    if bare.count(" · ") >= 2:
        return "links"
    if " " not in bare and len(bare) >= 40:
        return "data"
    at = 0
    for m in _STOP.finditer(bare):
        at = m.end()
    n = len(bare[at:].split())
    if bare[-1] == "�":
        return "lost"
    sign = "word" if bare[-1].isalnum() else "code" if bare[-1] == "`" else "sign"
    return f"{sign}:{1 if n < 3 else 3 if n < 7 else 7}"


def blocks(lines: list[str]) -> tuple[list[tuple[int, str]], bool]:
    """The last line and the kind of ending of each paragraph, list entry, table row, heading and rule outside of code;
    and whether a code block is open at the end. lines has no blank lines at its end.

    A kind is the type of the block and what it ends in: a stop, a link, or a word so many words after the last stop.
    An entry's type says whether the entry before it ended with a stop.
    """
    found: list[tuple[int, str]] = []
    fence, block, before = "", [], "first"
    bares = [x.strip().lstrip("> \t") for x in lines]
    types = [_line_type(b) if b else "" for b in bares]
    for i, bare in enumerate(bares):
        head = bare[:3]
        if fence:
            fence = "" if head == fence else fence
            continue
        if head in _FENCES:
            fence, block, before = head, [], "first"
            continue
        if not bare:
            block = []
            continue
        kind = types[i]
        if kind != "text":
            block = []
        block.append(bare)
        after = types[i + 1] if i + 1 < len(lines) and bares[i + 1][:3] not in _FENCES else ""
        if after == "text" and kind in ("text", "entry"):
            if kind == "entry":
                types[i + 1] = "entry text"
            continue
        if kind == "entry text":
            if after == "text":
                types[i + 1] = kind
                continue
            kind = "entry"
        end = "rule" if kind == "rule" else _end(bare, block)
        if kind == "entry":
            found.append((i, f"entry after {before}, {end}"))
            before = "stop" if end in ("stop", "number") else "none"
        else:
            before = "first"
            found.append((i, f"{kind}, {end}"))
    return found, bool(fence)


def _may_be_site(lines: list[str], at: int) -> bool:
    """Whether a line is a paragraph of its own, of some length and no heading, row, fence or rule."""
    bare = lines[at].strip()
    alone = not (at and lines[at - 1].strip()) and not (at + 1 < len(lines) and lines[at + 1].strip())
    return alone and len(bare) >= 15 and not bare.startswith(("#", "|", *_FENCES)) and not _RULE.match(bare)


@dataclass
class Examined:
    open: bool
    #: Whether a line end follows the last line.
    ended: bool
    #: Of the last lines, from the last to the first that can't be the site's: hash (0 of that one), kind, hash of the tail.
    forms: list[int]
    kinds: list[str]
    tails: list[int]
    #: Of the blocks before those: kinds with their numbers; hash and kind of those that may be the site's and aren't
    #: closed, which count apart; hashes of tails.
    inner: Counter
    inner_forms: list[int]
    inner_kinds: list[str]
    inner_tails: list[int]


def examine(body: str, source: str) -> Examined:
    text = body.replace("\r", "")
    lines = text.rstrip().split("\n")
    found, is_open = blocks(lines)
    out = Examined(is_open, len(text.rstrip()) < len(text), [], [], [], Counter(), [], [], [])
    at = len(found)
    while at:
        at -= 1
        line, kind = found[at]
        site = _may_be_site(lines, line)
        out.forms.append(form_hash(lines[line], source) if site else 0)
        out.kinds.append(kind)
        out.tails.append(tail_hash(lines[line]))
        if not site:
            break
    for line, kind in found[:at]:
        if not kind.endswith(_CLOSED) and _may_be_site(lines, line):
            out.inner_forms.append(form_hash(lines[line], source))
            out.inner_kinds.append(kind)
        else:
            out.inner[kind] += 1
    out.inner_tails = [h for h in (tail_hash(lines[line]) for line, _ in found[:at]) if h]
    return out


def _examined(texts: DataFrame, path: str, source: str, body: str) -> DataFrame:
    """One row of each different (path, source, body), known by `version`, a hash of the body."""
    kinds = [pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()),
             pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())]
    fields = "open boolean, ended boolean, forms array<bigint>, kinds array<string>, tails array<bigint>, inner array<string>, inner_n array<int>, inner_forms array<bigint>, inner_kinds array<string>, inner_tails array<bigint>"  # noqa: E501
    names = ["path", "source", "version", "chars", "bytes", *[f.split()[0] for f in fields.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [examine(t.as_py(), s) for s, t in zip(batch.column(1).to_pylist(), batch.column(5))]
            cols = [
                [r.open for r in rows], [r.ended for r in rows], [r.forms for r in rows], [r.kinds for r in rows], [r.tails for r in rows],
                [list(r.inner) for r in rows], [list(r.inner.values()) for r in rows], [r.inner_forms for r in rows],
                [r.inner_kinds for r in rows], [r.inner_tails for r in rows],
            ]
            own = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), *own], names=names)

    picked = texts.where(F.col(body).isNotNull() & F.col(path).isNotNull()).select(
        F.col(path).alias("path"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.xxhash64(body).alias("version"),
        F.length(body).cast("long").alias("chars"), F.octet_length(body).cast("long").alias("bytes"), F.col(body).alias("body"),
    )
    schema = f"path string, source string, version bigint, chars bigint, bytes bigint, {fields}"
    return picked.mapInArrow(run, schema).dropDuplicates(["path", "source", "version", "chars", "bytes"])


def _p_value(ended: Column, at_risk: Column, expected: Column) -> Column:
    """Chernoff's bound on `ended` of `at_risk` or more where the chance of each is `expected`."""
    x, p = ended / at_risk, F.least(expected, F.lit(0.5))
    divergence = x * F.log(x / p) + F.when(x < 1, (1 - x) * F.log((1 - x) / (1 - p))).otherwise(0.0)
    return F.when(x > p, F.exp(-at_risk * divergence)).otherwise(1.0)


def _significant(rows: DataFrame, family: list[str], tie: list[str], params: CutParams) -> DataFrame:
    """Rows (with p_value, ended, and the number of tests of their family) that are significant in it by Benjamini and
    Hochberg's procedure.

    Only p-values up to the share of false discoveries can be, so that few rows are ranked, however large a family is.
    """
    low = rows.where(F.col("p_value") <= params.false_discoveries)
    ranked = Window.partitionBy(*(family or [F.lit(0)])).orderBy("p_value", *tie)
    below = F.col("p_value") <= F.row_number().over(ranked) / F.col("tests") * params.false_discoveries
    # All up to the last that lies below its bound.
    last = F.max("__below").over(ranked.rowsBetween(0, Window.unboundedFollowing))
    low = low.withColumn("__below", below).withColumn("__last", last)
    return low.where(F.col("__last") & (F.col("ended") >= params.least_texts)).drop("__below", "__last")


def length_hazards(examined: DataFrame, params: CutParams = CutParams()) -> DataFrame:
    """Of each source, measure ("chars" or "bytes") and length that occurs: texts that end there, texts at least as
    long, hazard, hazard of the neighbouring lengths, p_value; and tests, the number of lengths of its source and measure.

    A length's hazard is the share of texts at least as long that end right there; the neighbours' is the texts that end
    at them by the texts at risk, added up over the neighbours, each at its own length. The p-value is Chernoff's bound on
    a binomial tail under the neighbours' hazard. Texts are counted by length before any window, and a source's lengths
    are windowed in blocks that see their neighbours' edges, so no task gets all lengths of a large source.
    """
    w, size = params.neighbours, params.length_block
    each = F.explode(F.array(
        F.struct(F.lit("chars").alias("measure"), F.col("chars").alias("length")),
        F.struct(F.lit("bytes").alias("measure"), F.col("bytes").alias("length")),
    )).alias("m")
    counts = examined.select("source", each).select("source", "m.*").groupBy("source", "measure", "length").agg(
        F.count(F.lit(1)).alias("ended")
    )
    block = lambda x: F.floor(x / size)
    counts = counts.withColumn("home", block(F.col("length")))
    totals = counts.groupBy("source", "measure", "home").agg(F.sum("ended").alias("n"), F.count(F.lit(1)).alias("lengths"))
    whole = Window.partitionBy("source", "measure")
    later = whole.orderBy(F.desc("home")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source", "measure", "home", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("later"), F.sum("lengths").over(whole).alias("tests"))
    seen = counts.withColumn("block", F.explode(F.sequence(block(F.col("length") - w), block(F.col("length") + w))))
    part = Window.partitionBy("source", "measure", "block").orderBy("length")
    around, length = part.rangeBetween(-w, w), F.col("length")
    own = F.when(F.col("home") == F.col("block"), F.col("ended")).otherwise(0)
    rows = seen.withColumns({
        "near": F.sum("ended").over(around), "near_length": F.sum(F.col("ended") * length).over(around),
        "up_to": F.sum("ended").over(part.rangeBetween(0, w)), "from_here": F.sum(own).over(part.rangeBetween(0, Window.unboundedFollowing)),
    }).where(F.col("home") == F.col("block")).join(totals, ["source", "measure", "home"])
    at_risk = F.col("from_here") + F.col("later")
    low = F.greatest(F.lit(0), length - w)
    # Texts beyond the neighbours are at risk at each of them, those within up to their own length.
    exposure = (at_risk - F.col("up_to")) * (length + w - low + 1) + F.col("near_length") - (low - 1) * F.col("near") - at_risk
    # At least half a text is taken to end nearby, so that a lone cluster of texts isn't held against nothing.
    p0 = F.least((F.col("near") - F.col("ended") + 0.5) / F.greatest(exposure, F.lit(1)), F.lit(0.5))
    rows = rows.select("source", "measure", "length", "ended", "tests", at_risk.alias("at_risk"), p0.alias("neighbour_hazard"))
    return rows.withColumn("hazard", F.col("ended") / F.col("at_risk")).withColumn(
        "p_value", _p_value(F.col("ended"), F.col("at_risk"), F.col("neighbour_hazard"))
    )


def significant_lengths(examined: DataFrame, params: CutParams = CutParams()) -> DataFrame:
    """source, measure, length at which texts end too often, among the lengths of their source and measure.

    A limit in characters makes lengths in bytes frequent too, and the other way round: each text counts for the more
    significant of its two lengths, and lengths left with too few texts are dropped.
    """
    found = _significant(length_hazards(examined, params), ["source", "measure"], ["length"], params)
    # A source has few; so they come to its texts as one list.
    lists = found.groupBy("source").agg(F.collect_list(F.struct("measure", "length", "p_value")).alias("ls"))
    texts = examined.select("source", "chars", "bytes").join(lists, "source")
    own = F.filter("ls", lambda x: x["length"] == F.when(x["measure"] == "chars", F.col("chars")).otherwise(F.col("bytes")))
    best = F.try_element_at(F.array_sort(F.transform(own, lambda x: F.struct(x["p_value"].alias("p"), x["measure"].alias("m"), x["length"].alias("n")))), F.lit(1))
    counted = texts.select("source", best.alias("b")).where("b is not null").groupBy("source", "b.m", "b.n").agg(F.count(F.lit(1)).alias("ended"))
    return counted.where(F.col("ended") >= params.least_texts).select("source", F.col("m").alias("measure"), F.col("n").alias("length"), "ended")


def ending_hazards(kinds: DataFrame, params: CutParams = CutParams()) -> DataFrame:
    """Of each source and kind of ending: texts whose last block has it (ended), texts (at_risk), `ratio` times the hazard
    of the blocks before (neighbour_hazard), p_value, and the same over all sources (all_ended, all_at_risk, all_expected).

    kinds: source, kind, ended, blocks: numbers of texts' last blocks and of blocks before. How far a block runs on
    after its last stop is a discrete length too; a text's blocks before its last one are the neighbours. Over all sources
    each one's expectation is its own, so sources that write in other ways don't hide what is amiss in others.
    """
    rows = kinds.groupBy("source", "kind").agg(F.sum("ended").alias("ended"), F.sum("blocks").alias("blocks"))
    source, kind = Window.partitionBy("source"), Window.partitionBy("kind")
    rows = rows.withColumns({"inner_of": F.sum("blocks").over(source), "at_risk": F.sum("ended").over(source), "tests": F.count(F.lit(1)).over(source)})
    rows = rows.where("at_risk > 0")
    expected = F.col("at_risk") * F.col("blocks") / F.greatest("inner_of", F.lit(1))
    of = kinds.agg(F.sum("ended").alias("all_at_risk"), F.sum("blocks").alias("all_inner"))
    rows = rows.withColumns({"all_ended": F.sum("ended").over(kind), "expected": F.sum(expected).over(kind)}).crossJoin(F.broadcast(of))
    # Half a block is taken to have an ending that none has.
    rows = rows.withColumn("neighbour_hazard", params.ratio * (F.col("blocks") + 0.5) / (F.col("inner_of") + 1)).withColumn(
        "all_expected", params.ratio * (F.col("expected") / F.col("all_at_risk") + 0.5 / (F.col("all_inner") + 1))
    )
    return rows.withColumn("p_value", _p_value(F.col("ended"), F.col("at_risk"), F.col("neighbour_hazard")))


def incomplete_endings(kinds: DataFrame, params: CutParams = CutParams()) -> DataFrame:
    """source, kind of endings that texts have too often: in their source, or over all sources and more often in the
    source than its blocks before. Kinds that show a block to be whole are none."""
    whole = F.regexp_extract("kind", r", (.*)$", 1).isin(*_CLOSED)
    hazards = shared_checkpoint(ending_hazards(kinds, params).where(~whole & (F.col("ended") > 0)))
    here = _significant(hazards, ["source"], ["kind"], params).select("source", "kind")
    pooled = hazards.groupBy("kind").agg(F.first("all_ended").alias("ended"), F.first("all_at_risk").alias("n"), F.first("all_expected").alias("p"))
    pooled = pooled.withColumn("p_value", _p_value(F.col("ended"), F.col("n"), F.col("p"))).withColumn(
        "tests", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    )
    pooled = _significant(pooled, [], ["kind"], params).select("kind")
    more = hazards.where(F.col("ended") * F.col("inner_of") > F.col("blocks") * F.col("at_risk")).join(pooled, "kind").select("source", "kind")
    return here.union(more).distinct()


def _marks(tails: DataFrame, kinds: DataFrame, params: CutParams) -> DataFrame:
    """tail: what last blocks end in too often, of tails (tail, ended, blocks: in last blocks and in blocks before)."""
    of = kinds.agg(F.sum("ended").alias("at_risk"), F.sum("blocks").alias("of"))
    tails = tails.groupBy("tail").agg(F.sum("ended").alias("ended"), F.sum("blocks").alias("blocks")).where("ended > 0")
    tests = tails.agg(F.count(F.lit(1)).alias("tests"))
    tails = tails.crossJoin(F.broadcast(of)).crossJoin(F.broadcast(tests)).withColumn(
        "p_value", _p_value(F.col("ended"), F.col("at_risk"), (F.col("blocks") + 0.5) / (F.col("of") + 1))
    )
    return _significant(tails, [], ["tail"], params).select("tail")


def cut_texts(
    texts: DataFrame, path: str = "path", source: str = "docset", body: str = "body", params: CutParams = CutParams()
) -> DataFrame:
    """Texts that were cut: path, source, chars, bytes, at_limit, kind (of ending), reason.

    reason is "limit": the text's characters or bytes are a significant length of its source, by length_hazards, and its
    ending isn't surely whole. Cuts in mid-transfer have no common length, so another discrete length is tested for
    them: how far the last block runs on after its last stop, against the blocks before it, by ending_hazards. reason is
    "ending" where that is significant, "block" where a code block is open at the end, which no block before is, and
    "mark" where the last block ends in brackets or dots with the same content as other texts and not as blocks
    within texts: what is put after a cut. Lines of the site at a text's end don't count as its ending.

    Null and blank bodies aren't cut; a null source is one source of its own; repeated rows count once, different
    bodies of one path each; a null path is left out. Whole texts are read; what is shuffled is numbers and kinds of endings.
    """
    # Read several times below, and small: so written once.
    examined = shared_checkpoint(_examined(texts, path, source, body))
    key = ["path", "source", "version", "chars", "bytes"]
    forms = examined.select("source", F.explode(F.array_union("forms", "inner_forms")).alias("form")).where("form <> 0")
    stands = forms.groupBy("source", "form").agg(F.count(F.lit(1)).alias("n"))
    sizes = examined.groupBy("source").agg(F.count(F.lit(1)).alias("of"))
    wide = F.count(F.lit(1)).over(Window.partitionBy("form")) >= params.site_sources
    many = (F.col("n") >= params.site_texts) & (F.col("n") >= F.col("of") * params.site_share)
    site = shared_checkpoint(stands.withColumn("wide", wide).join(sizes, "source").where(many | F.col("wide")).select("source", "form"))
    # Each text's last block that isn't the site's, and the kinds of those before it.
    asked = examined.select(*key, F.posexplode("forms").alias("at", "form")).where("form <> 0")
    hits = asked.join(site, ["source", "form"], "left_semi").groupBy(*key).agg(F.collect_set("at").alias("site_at"))
    every = F.when(F.size("forms") > 0, F.sequence(F.lit(0), F.size("forms") - 1))
    left = F.filter(every, lambda i: F.col("site_at").isNull() | ~F.array_contains("site_at", i))
    rows = examined.join(hits, key, "left").withColumn("left", left).withColumn("at", F.try_element_at("left", F.lit(1)))
    own = shared_checkpoint(rows.select(
        *key, "open", "ended", F.when(F.col("open"), "block").otherwise(F.get("kinds", "at")).alias("kind"),
        F.coalesce(F.get("tails", "at"), F.lit(0)).alias("tail"),
        F.transform(F.filter("left", lambda i: F.col("open") | (i > F.col("at"))), lambda i: F.get("kinds", i)).alias("before"),
    ))
    last = own.where(F.col("kind").isNotNull())
    inner = examined.select("source", F.explode(F.arrays_zip("inner", "inner_n")).alias("i"))
    inner = inner.select("source", F.col("i.inner").alias("kind"), F.col("i.inner_n").cast("long").alias("blocks"))
    inner = inner.unionByName(own.select("source", F.explode("before").alias("kind"), F.lit(1).cast("long").alias("blocks")))
    apart = examined.select("source", F.explode(F.arrays_zip("inner_forms", "inner_kinds")).alias("i"))
    apart = apart.groupBy("source", F.col("i.inner_forms").alias("form"), F.col("i.inner_kinds").alias("kind")).agg(F.count(F.lit(1)).alias("blocks"))
    inner = inner.unionByName(apart.join(site, ["source", "form"], "left_anti").select("source", "kind", "blocks"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    kinds = last.select("source", "kind", one.alias("ended"), none.alias("blocks")).unionByName(inner.withColumn("ended", none))
    kinds = shared_checkpoint(kinds.groupBy("source", "kind").agg(F.sum("ended").alias("ended"), F.sum("blocks").alias("blocks")))
    incomplete = incomplete_endings(kinds, params).withColumn("incomplete", F.lit(True))
    tails = last.where("tail <> 0").select("tail", one.alias("ended"), none.alias("blocks")).unionByName(
        examined.select(F.explode("inner_tails").alias("tail"), none.alias("ended"), one.alias("blocks"))
    )
    marks = _marks(tails, kinds, params).withColumn("marked", F.lit(True))
    limits = significant_lengths(examined, params)
    limits = limits.groupBy("source").agg(F.collect_list(F.struct("measure", "length")).alias("limits"))
    rows = last.join(limits, "source", "left").join(incomplete, ["source", "kind"], "left").join(marks, "tail", "left")
    here = lambda x: x["length"] == F.when(x["measure"] == "chars", F.col("chars")).otherwise(F.col("bytes"))
    at_limit = F.coalesce(F.exists("limits", here), F.lit(False))
    whole = F.regexp_extract("kind", r", (.*)$", 1).isin(*_CLOSED)
    reason = (
        F.when(at_limit & ~whole & ~F.col("ended"), "limit").when(F.col("incomplete") & F.col("open"), "block")
        .when(F.col("marked"), "mark").when(F.col("incomplete"), "ending")
    )
    rows = rows.withColumn("at_limit", at_limit).withColumn("reason", reason).where(F.col("reason").isNotNull())
    return rows.select(F.col("path").alias(path), F.col("source").alias(source), "chars", "bytes", "at_limit", "kind", "reason")


def cut_report(texts: DataFrame, cut: DataFrame, path: str = "path", source: str = "docset") -> DataFrame:
    """Of each source: texts, cut texts, their share, and those at a significant length."""
    name = F.coalesce(F.col(source), F.lit("")).alias(source)
    of = texts.where(F.col(path).isNotNull()).select(name, path).distinct().groupBy(source).agg(F.count(F.lit(1)).alias("texts"))
    found = cut.groupBy(source).agg(F.countDistinct(path).alias("cut"), F.countDistinct(F.when(F.col("at_limit"), F.col(path))).alias("cut_at_limit"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return of.join(found, source, "left").select(
        source, "texts", zero("cut"), zero("cut_at_limit"), F.round(F.coalesce("cut", F.lit(0)) / F.col("texts"), 6).alias("share")
    )

"""Passages of evaluation items inside training documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.codepoints import SPACE, grouped, joined, word_text
from pagequarry.session import BROADCAST_BYTES, shared_checkpoint

_WORD = re.compile(r"[^\W_]+")
_B = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class LeakParams:
    #: A leaked run has this many words at least.
    words: int = 13
    #: Characters in a gram, less where an item's runs are shorter.
    q: int = 12
    #: Edits within a run of `words` words that an alignment may have.
    edits: int = 1
    #: Diagonals in half a band; bands overlap by half.
    half_band: int = 8
    #: Words that an item of fewer than `words` needs; of those, the whole text is the run.
    least_words: int = 5
    #: Bytes of the index of items that is sent to executors at a time.
    index_bytes: int = BROADCAST_BYTES
    #: Pairs of a document's and an item's equal grams that are held at a time.
    held_pairs: int = 1 << 22


#: Bytes that the index has for a character of the items: its text, its place, and its gram's hash and first place.
BYTES_PER_CHAR = 24


class ItemIndex:
    """Character q-grams of a block of items, with the places of each in the items' joined text."""

    def __init__(self, ids: list[int], texts: list[str], params: LeakParams) -> None:
        self.params = params
        counts = [len(_WORD.findall(t)) for t in texts]
        kept = [k for k, n in enumerate(counts) if n >= params.least_words]
        self.ids = np.array([ids[k] for k in kept], np.int64)
        # By the kernel the documents go through, so that both have the same characters.
        parts = [_normal(texts[k]) for k in kept]
        self.starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.chars = np.concatenate([*parts, np.zeros(0, np.uint32)]).astype(np.uint32)
        self.shortest = np.array([_shortest_run(p, min(params.words, counts[k])) for k, p in zip(kept, parts)], np.int64)
        self.q = int(min([params.q, *self.shortest])) if kept else params.q
        # q-gram lemma: a run of n characters shares n - q + 1 grams, less q for each edit, on nearby diagonals.
        self.edits = np.minimum(params.edits, (self.shortest - self.q) // self.q)
        self.need = self.shortest - self.q + 1 - self.q * self.edits
        hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k, part in enumerate(parts):
            h = grams(part, self.q)
            hashes.append(h)
            places.append(self.starts[k] + np.arange(len(h)))
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.places = np.concatenate(places)[order].astype(np.uint32)
        self.hash, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h)).astype(np.uint32)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.hash >> np.uint64(42)] = True
        self.longest = int(np.diff(self.starts).max()) if kept else 0
        self._words: dict[int, list[str]] = {}

    def text(self, item: int) -> np.ndarray:
        return self.chars[self.starts[item] : self.starts[item + 1]]

    def words(self, item: int) -> list[str]:
        """Of an item that was found; few are."""
        if item not in self._words:
            if len(self._words) > 10_000:
                self._words.clear()
            self._words[item] = self.text(item).tobytes().decode("utf-32-le", "surrogatepass").split(" ")
        return self._words[item]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_words": {}}


def _normal(text: str) -> np.ndarray:
    chars, _ = word_text(joined([text])[0])
    chars = chars[chars != 0]
    lo, hi = 0, len(chars)
    while lo < hi and chars[lo] == SPACE:
        lo += 1
    while hi > lo and chars[hi - 1] == SPACE:
        hi -= 1
    return chars[lo:hi]


def _shortest_run(chars: np.ndarray, words: int) -> int:
    starts = np.concatenate([[0], np.flatnonzero(chars == SPACE) + 1, [len(chars) + 1]])
    return int((starts[words:] - starts[:-words] - 1).min())


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all q-grams, built from those of half the length; one with a NUL in it hashes like any other."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = chars.astype(np.uint64) + np.uint64(1)
    total, length, power = None, 0, _B
    width = 1
    with np.errstate(over="ignore"):
        while True:
            if q & width:
                part = base[length : length + n]
                total = part.copy() if total is None else total * power + part
                length += width
            if length == q:
                return (total ^ (total >> np.uint64(29))) * _MIX
            base = base[:-width] * power + base[width:]
            width *= 2
            power = power * power


def find(index: ItemIndex, doc_ids: list[int], texts: list[str]) -> list[tuple]:
    """Aligned passages (doc_id, item_id, doc_start, doc_end, longest common run in words, score) of some documents."""
    q = index.q
    if not len(index.ids) or not texts:
        return []
    codes, starts = joined(texts, q)
    chars, source = word_text(codes)
    bounds = np.searchsorted(source, starts)
    h = grams(chars, q)
    at = np.flatnonzero(index.seen[h >> np.uint64(42)])
    slot = np.searchsorted(index.hash, h[at])
    slot[slot == len(index.hash)] = 0
    hit = index.hash[slot] == h[at]
    at, slot = at[hit], slot[hit]
    dense = _dense(at, int(index.need.min()), int((index.shortest + index.edits).max()))
    at, slot = at[dense], slot[dense]
    if not len(at):
        return []
    pairs = int((index.first[slot + 1] - index.first[slot]).astype(np.int64).sum())
    if pairs > index.params.held_pairs and len(texts) > 1:
        half = len(texts) // 2
        return find(index, doc_ids[:half], texts[:half]) + find(index, doc_ids[half:], texts[half:])
    rows = []
    # A document with very many pairs is held against the items a part of them at a time.
    parts = min(len(index.ids), -(-pairs // index.params.held_pairs))
    edges = np.linspace(0, len(index.ids), parts + 1).astype(np.int64)
    for lo, hi in zip(edges[:-1], edges[1:]):
        rows += _matched(index, doc_ids, texts, (chars, source, starts, bounds), *_expanded(index, at, slot, lo, hi))
    return rows


def _expanded(index: ItemIndex, at: np.ndarray, slot: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Every place of every gram of items lo to hi: document's and item's place."""
    n = (index.first[slot + 1] - index.first[slot]).astype(np.int64)
    wheres, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ends = np.cumsum(n)
    begin = 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + index.params.held_pairs, side="right")))
        m = n[begin:end]
        entry = np.repeat(index.first[slot[begin:end]] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
        place = index.places[entry.astype(np.int64)].astype(np.int64)
        own = (place >= index.starts[lo]) & (place < index.starts[hi])
        wheres.append(np.repeat(at[begin:end], m)[own])
        places.append(place[own])
        begin = end
    return np.concatenate(wheres), np.concatenate(places)


def _matched(index: ItemIndex, doc_ids: list[int], texts: list[str], joint: tuple, where: np.ndarray, place: np.ndarray) -> list[tuple]:
    """Rows of `find` from equal grams: banded, held against the edit budget, aligned."""
    if not len(where):
        return []
    params, q = index.params, index.q
    chars, source, starts, bounds = joint
    item = np.searchsorted(index.starts, place, side="right") - 1
    place = place - index.starts[item]
    doc = np.searchsorted(bounds, where, side="right") - 1
    diagonal = where - bounds[doc] - place + index.longest
    band = diagonal // params.half_band
    # Bands are two half bands wide and start at each half band, so each gram counts in two of them.
    span = (len(chars) + index.longest) // params.half_band + 3
    key = (doc * len(index.ids) + item) * span + band
    key = np.concatenate([key, key + 1])
    order = np.argsort(key)
    key, place, where = key[order], np.concatenate([place] * 2)[order], np.concatenate([where] * 2)[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    shared = np.diff(np.concatenate([begins, [len(key)]]))
    key = key[begins]
    item = key // span % len(index.ids)
    enough = shared >= index.need[item]
    if not enough.any():
        return []
    # Of each band: the stretch of the item that its grams span, and as much on either side as a shortest run has.
    least = lambda x: np.minimum.reduceat(x, begins)[enough].astype(np.int64)
    most = lambda x: np.maximum.reduceat(x, begins)[enough].astype(np.int64)
    from_row, to_row, from_char, to_char = least(place), most(place), least(where), most(where) + q
    key, item = key[enough], item[enough]
    doc, band = key // span // len(index.ids), key % span
    sizes = np.diff(index.starts)[item]
    from_row = np.maximum(0, from_row - index.shortest[item])
    to_row = np.minimum(sizes, to_row + q + index.shortest[item])
    low = (band - 1) * params.half_band - index.longest
    score, begin, end = align(index, chars, bounds, doc, item, low, 2 * params.half_band, from_row, to_row)
    good = score >= index.shortest[item] - 2 * index.edits[item]
    out: dict[tuple[int, int], list] = {}
    for d, i, b, e, s, x, y in zip(*(v[good].tolist() for v in (doc, item, begin, end, score, from_char, to_char))):
        best = out.setdefault((d, i), [b, e, s, []])
        best[0], best[1], best[2] = min(best[0], b), max(best[1], e), max(best[2], s)
        best[3].append((min(b, x), max(e, y)))
    rows = []
    for (d, i), (b, e, s, stretches) in out.items():
        lo, hi = source[b] - starts[d], source[min(e, len(source) - 1)] - starts[d]
        # The exact check sees all that the band's grams span, also beside its best alignment, widened to whole words.
        run = 0
        for x, y in _united(stretches):
            x, y = source[x] - starts[d], source[min(y, len(source) - 1)] - starts[d]
            passage = texts[d][_left(texts[d], int(x)) : _right(texts[d], int(y))]
            run = max(run, longest_run([w.lower() for w in _WORD.findall(passage)], index.words(i)))
        rows.append((doc_ids[d], int(index.ids[i]), int(lo), int(hi), run, s))
    return rows


def _united(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted(stretches):
        if out and x <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], y)
        else:
            out.append((x, y))
    return out


def _dense(at: np.ndarray, need: int, window: int) -> np.ndarray:
    """Of ascending places: which lie in some window with `need` of them, as all places of a passage's grams do."""
    marks = np.zeros(len(at) + 1, np.int64)
    if len(at) >= need:
        i = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < window)
        np.add.at(marks, i, 1)
        np.subtract.at(marks, np.searchsorted(at, at[i] + window), 1)
    return marks[:-1].cumsum() > 0


def _left(text: str, at: int) -> int:
    while at > 0 and text[at - 1].isalnum():
        at -= 1
    return at


def _right(text: str, at: int) -> int:
    while at < len(text) and text[at].isalnum():
        at += 1
    return at


_ONE = np.int64(1 << 34)


def align(index, chars, bounds, doc, item, low, width, from_row, to_row):
    """Best local alignment of each item's stretch with its document inside a band: score (match 1, edit -1), begin, end.

    All candidates go through their rows together; a row's cells are the band's diagonals. A cell holds the score in
    its upper bits and the place where its path began in the lower ones, so that one maximum keeps both.
    """
    n, pad = len(doc), index.params.edits + 1
    cells, longest = width + 2 * pad, int((to_row - from_row).max())
    text = np.zeros((n, longest), np.uint32)
    for k, i in enumerate(item):
        text[k, : to_row[k] - from_row[k]] = index.text(i)[from_row[k] : to_row[k]]
    first, last = bounds[doc][:, None], bounds[doc + 1][:, None]
    lanes = np.arange(cells, dtype=np.int64)
    place = first + (low - pad + from_row)[:, None] + lanes
    # All characters that the band touches, 0 outside of the document.
    span = place[:, :1] + np.arange(cells + longest)
    seen = np.where((span >= first) & (span < last), chars[np.clip(span, 0, len(chars) - 1)], 0)
    before = np.full((n, cells + 1), -_ONE)
    before[:, :-1] = np.maximum(place, 0)
    best, best_end, rows, shift = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n), lanes * _ONE
    for r in range(longest):
        c = text[:, r, None]
        same = (seen[:, r : r + cells] == c) & (c != 0)
        # Along the diagonal, or from the lane to the right where the item's character has no partner.
        now = np.maximum(before[:, :-1] + np.where(same, _ONE, -_ONE), before[:, 1:] - _ONE)
        # From lanes to the left, where characters of the document have none; or a new path.
        now = np.maximum.accumulate(now + shift, 1) - shift
        np.maximum(now, np.maximum(place + r + 1, 0), out=now)
        top = now.argmax(1)
        value = now[rows, top]
        up = value >> 34 > best >> 34
        best[up], best_end[up] = value[up], (place[rows, top] + r + 1)[up]
        before[:, :-1] = now
    lo, hi = first[:, 0], last[:, 0]
    return best >> 34, np.clip(best & (_ONE - 1), lo, hi), np.clip(best_end, lo, hi)


def longest_run(a: list[str], b: list[str]) -> int:
    """Words in the longest run that both have."""
    places: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    best, before = 0, {}
    for w in a:
        now = {j: before.get(j - 1, 0) + 1 for j in places.get(w, ())}
        best = max([best, *now.values()])
        before = now
    return best


_FOUND = "doc_id bigint, item_id bigint, doc_start bigint, doc_end bigint, run_words int, score int"


def leaked_passages(
    documents: DataFrame, items: DataFrame, params: LeakParams = LeakParams(), id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Passages of items found in documents: doc_id, item_id, doc_start, doc_end, run_words, score.

    Items are dealt into blocks by a hash, so that the index of each has about index_bytes, however many items there are. A
    block's items come to the driver, its index goes to the executors and is held against every document in one pass.
    Where there are several blocks, each one's rows are written and its index is dropped before the next is built: a
    larger test set takes more passes, not more memory.

    By the q-gram lemma a passage that has a run of `words` words of the item (all words of a shorter item) with at most
    `edits` edits shares enough grams within one band of diagonals; such bands are verified by a banded local alignment.
    doc_start and doc_end are code points of the text, run_words the longest run of words that both share exactly within
    the band's stretch, score the alignment's.

    Null texts and items of fewer than `least_words` words match nothing; repeated rows count once; an empty table on
    either side gives no rows. Whole texts are searched, whatever their length.
    """
    spark = documents.sparkSession
    docs = documents.where(F.octet_length(text_col) >= 2 * params.least_words - 1).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    )
    tests = items.where(F.col(item_text).isNotNull()).select(
        F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")
    ).distinct()
    chars = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars * BYTES_PER_CHAR // params.index_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = None
    for n in range(blocks):
        rows = tests.where(block == n).toArrow()
        index = ItemIndex(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), params)
        if not len(index.ids):
            continue
        sent = spark.sparkContext.broadcast(index)
        part = docs.mapInArrow(_searcher(sent), _FOUND)
        if blocks > 1:
            part = shared_checkpoint(part)
            sent.destroy()
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], _FOUND) if found is None else found.distinct()


def _searcher(sent):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    names = [f.split()[0] for f in _FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for at, texts in grouped(enumerate(_strings(batch.column(1)))):
                rows += find(sent.value, [ids[i] for i in at], texts)
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

    return run


def _strings(column: pa.Array) -> Iterator[str | None]:
    for x in column:
        yield x.as_py()


def exhaustive_pairs(documents: DataFrame, items: DataFrame, words: int = 13) -> DataFrame:
    """doc_id, item_id of all pairs with a run of `words` words of the item, but for one character added, left out or
    changed. By trying every run of every item: its first or its second half stands in the document as it is.

    For measuring on some documents: items are collected, and each is looked for on its own.
    """
    runs: dict[str, set[int]] = {}
    for r in items.where(F.col("text").isNotNull()).select("item_id", "text").distinct().collect():
        own = [w.lower() for w in _WORD.findall(r.text)]
        for k in range(len(own) - words + 1):
            runs.setdefault(" ".join(own[k : k + words]), set()).add(r.item_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [
                (d, i)
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for text in [_normal(t).tobytes().decode("utf-32-le", "surrogatepass")]
                for wanted, ids in runs.items()
                if _nearly_in(wanted, text)
                for i in ids
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["doc_id", "item_id"]
            )

    docs = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id bigint, item_id bigint").distinct()


def _nearly_in(wanted: str, text: str) -> bool:
    half = len(wanted) // 2
    for mine, other, ahead in ((wanted[:half], wanted[half:], True), (wanted[half:], wanted[:half], False)):
        at = text.find(mine)
        while at >= 0:
            rest = text[at + half : at + len(wanted) + 1] if ahead else text[max(0, at - half - 1) : at][::-1]
            if _starts_nearly(rest, other if ahead else other[::-1]):
                return True
            at = text.find(mine, at + 1)
    return False


def _starts_nearly(text: str, wanted: str) -> bool:
    """Whether text starts with what is wanted, but for one character."""
    k = next((k for k, (a, b) in enumerate(zip(text, wanted)) if a != b), min(len(text), len(wanted)))
    if k >= len(wanted) - 1:
        return True
    return any(text[x:].startswith(wanted[y:]) for x, y in ((k + 1, k + 1), (k + 1, k), (k, k + 1)))


def leaked_items(passages: DataFrame, words: int = 13) -> DataFrame:
    """Of each leaked item: the number of documents with a run of `words` words of it, and its longest run."""
    return passages.where(F.col("run_words") >= words).groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("documents"), F.max("run_words").alias("longest_run")
    )

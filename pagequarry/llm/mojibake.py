"""Texts that were decoded with the wrong character encoding: finding the stretches and restoring them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.codepoints import LIMIT, codepoints, grouped, joined

# Encodings in which UTF-8 bytes are often misread.
MISREAD_UTF8 = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1250")
# Of these, the ones that show UTF-8 as letters that also make words.
TOO_LIKE_WORDS = ("cp866", "cp1250")
# Pairs of single-byte encodings, the text's own and the one it was misread in.
MISREAD_BYTES = (
    ("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("koi8-r", "cp1252"), ("cp866", "cp1252"), ("koi8-r", "cp866"), ("cp1252", "cp1251"), ("cp1252", "mac_roman"),
    ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp850", "cp1252"),
    ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("cp1251", "mac_roman"), ("cp1251", "cp437"),
)
REPLACEMENT = 0xFFFD

#: Pairs with a character beyond ASCII are counted in so many slots, by hash: the table's size doesn't grow with data.
SLOTS = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CODE = re.compile(r"`[^`\n]*`")
_BEYOND = re.compile(r"[^\x00-\x7f]+")
_RUNS = re.compile(r"[^\x00-\x7f]{2,}")
#: Characters that Western encodings show bytes as, where text of another script follows.
_WESTERN = re.compile(r"[\x80-\u02ff\u2010-\u2122]{2,}(?=[\u0370-\u1fff\u2e80-\uffff])")


@dataclass(frozen=True)
class GarbleParams:
    #: Bits of improbability that a stretch must gather before inverse mappings are tried in it.
    least_bits: float = 4.4
    #: Bits by which each pair of a stretch that is bytes of UTF-8 throughout is improbable at least: so few characters are
    #: such bytes that three of them in their order are rarer than that by chance.
    utf8_pair_bits: float = 2.5
    #: The same of a pair with a character that stands for lost bytes: by itself that is enough.
    lost_bits: float = 4.5
    #: Bits a restored stretch must gain over the garbled one, in all and by pair.
    gain_bits: float = 6.0
    gain_by_pair: float = 1.5
    #: In all, where the stretch throughout is bytes of UTF-8: that alone says much.
    gain_utf8_bits: float = 3.0
    #: Bits by which a pair may move the sum.
    clip_bits: float = 8.0
    #: How often text may have been misread.
    rounds: int = 3


def _decode_table(encoding: str) -> list[str]:
    """The character of each byte; a byte that the encoding leaves out is the control character of its number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@cache
def _utf8_inverses() -> list[tuple[str, re.Pattern, dict[str, int]]]:
    found = []
    for name in MISREAD_UTF8:
        table = _decode_table(name)
        lead = lambda lo, hi: "[" + re.escape("".join(table[lo:hi])) + "]"  # noqa: E731, B023
        tail = "[" + re.escape("".join(table[0x80:0xC0])) + "]"
        pattern = f"(?:{lead(0xC2, 0xE0)}{tail}|{lead(0xE0, 0xF0)}{tail}{{2}}|{lead(0xF0, 0xF5)}{tail}{{3}})+"
        bytes_of = {c: b for b, c in reversed(list(enumerate(table)))}
        if name == "cp1252":  # a reader may also have kept the controls that it leaves unused elsewhere
            bytes_of = {chr(b): b for b in range(0x80, 0xA0)} | bytes_of
            tail2 = "[" + re.escape("".join(dict.fromkeys([*table[0x80:0xC0], *map(chr, range(0x80, 0xC0))]))) + "]"
            pattern = pattern.replace(tail, tail2)
        found.append((name, re.compile(pattern), bytes_of))
    return found


@cache
def _byte_inverses() -> list[tuple[str, np.ndarray, dict[int, str]]]:
    """Of each pair: the garbled character's original, as an array over code points and as a str.translate table."""
    found = []
    for own, wrong in MISREAD_BYTES:
        right, misread = _decode_table(own), _decode_table(wrong)
        table = {ord(misread[b]): right[b] for b in range(0x80, 256) if ord(misread[b]) > 127}
        array = np.arange(LIMIT, dtype=np.uint32)
        for k, v in table.items():
            array[k] = ord(v)
        found.append((f"{own} as {wrong}", array, table))
    return found


def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((a.astype(np.uint64) * np.uint64(LIMIT) + b.astype(np.uint64)) * _ODD) >> np.uint64(44)


@cache
def _sound_cache() -> dict[str, bool]:
    return {}


def _decodable(run: str) -> bool:
    """Whether a run beyond ASCII consists of bytes of UTF-8 as some encoding shows them."""
    known = _sound_cache()
    if (found := known.get(run)) is None:
        if len(known) > 200_000:
            known.clear()
        found = known[run] = len(run) > 1 and any(
            _strict(pattern, bytes_of, run)
            for name, pattern, bytes_of in _utf8_inverses()
            if name not in TOO_LIKE_WORDS
        )
    return found


def _strict(pattern: re.Pattern, bytes_of: dict[str, int], run: str) -> bool:
    m = pattern.search(run)
    if not m or len(m.group()) * 2 < len(run) or len(m.group()) < len(run) <= 3:
        return False
    try:
        return bytes(bytes_of[c] for c in m.group()).decode("utf-8") != m.group()
    except UnicodeDecodeError:
        return False


def count_pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of pairs with a character beyond ASCII and their counts; code points and their counts.

    Stretches that are UTF-8 misread, and quoted code, count as characters but not as pairs: so the pairs' counts are
    those of sound text, and a pair that garbling brings about is improbable however many texts are garbled.
    """
    whole, _ = joined(texts)
    chars, n_chars = np.unique(whole[whole > 127], return_counts=True)
    low = np.bincount(whole[whole < 128], minlength=128)[1:]
    masked = [_BEYOND.sub(lambda m: "\0" * len(m.group()) if _decodable(m.group()) else m.group(), t) for t in texts]
    codes, _ = joined(masked)
    slots, n = np.unique(_slots_of(codes)[0], return_counts=True)
    return slots, n, np.concatenate([np.arange(1, 128), chars]), np.concatenate([low, n_chars])


def _slots_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = codes[:-1], codes[1:]
    at = np.flatnonzero(((a > 127) | (b > 127)) & (a > 0) & (b > 0))
    return _slot(a[at], b[at]), at


@dataclass
class PairModel:
    """log2 counts of pairs of sound text by slot, of characters, and of all characters."""

    pairs: np.ndarray
    chars: np.ndarray
    total: float

    @property
    def common(self) -> float:
        """Bits of a pair within ASCII."""
        return self.total - 12.0

    def joint(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits of a pair's count. Pairs within ASCII count as common."""
        return np.where((a < 128) & (b < 128), self.common, self.pairs[_slot(a, b)])

    def information(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pointwise mutual information of adjacent characters, in bits."""
        return self.joint(a, b) + self.total - self.chars[a] - self.chars[b]

    def mean_bits(self, text: str) -> float:
        """Mean bits of a text's pairs; one without a pair is as good as plain ASCII."""
        c = codepoints(text)
        return float(self.joint(c[:-1], c[1:]).mean()) if len(c) > 1 else self.common


def pair_improbability(model: PairModel, a: np.ndarray, b: np.ndarray, params: GarbleParams) -> np.ndarray:
    """Of each pair with a character beyond ASCII: bits by which it is improbable.

    The largest of: how far its mutual information lies below none, whether sound text has no such pair, and how much more common the pair would be
    after one of the inverse mappings of single bytes (there, garbled pairs keep whatever information sound ones have).
    """
    own = model.joint(a, b)
    # Of rare characters no pair is expected, so a missing one says little: a bit and a half.
    score = np.maximum(-model.information(a, b) - 1.0, -0.5 - own)
    for _, array, _ in _byte_inverses():
        x, y = array[a], array[b]
        changed = (x != a) | (y != b)
        score = np.maximum(score, np.where(changed, model.joint(x, y) - own, -99))
    return np.clip(score, -params.clip_bits, params.clip_bits)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [begin, end) of a sequence with their sums, in linear time (Ruzzo and Tompa)."""
    stack: list[tuple[int, int, float, float]] = []  # begin, end, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        begin, left, right = i, before, total
        while True:
            # The nearest segment to the left that starts lower; those in between can't extend any more.
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k -= 1
            if k < 0 or stack[k][3] >= right:
                stack.append((begin, i + 1, left, right))
                break
            begin, left = stack[k][0], stack[k][2]
            del stack[k:]
    return [(b, e, right - left) for b, e, left, right in stack]


def restore(model: PairModel, text: str, before: str, after: str, params: GarbleParams) -> tuple[str, str] | None:
    """What a garbled stretch was, and by which mapping, if some inverse gains enough; before and after are context.

    Mappings are tried again on their own result, as text may have been misread more than once.
    """
    start = model.mean_bits(before + text + after)
    top = (start, text, "")
    now, names, least = text, [], params.gain_bits
    for _ in range(params.rounds):
        best = None
        for name, pattern, bytes_of in _utf8_inverses():
            new = pattern.sub(lambda m, b=bytes_of: _decoded(m.group(), b), now)
            if new != now:
                # A byte-order mark may stand before anything.
                value = model.mean_bits((before + new + after).replace("\ufeff", ""))
                # The mapping that takes up most bytes; of equal ones, the better text.
                if best is None or (len(new), -value) < (len(best[1]), -best[0]):
                    best = (value, new, name)
        # Where bytes of UTF-8 fit throughout, what they give may need another round; else a mapping must gain at once.
        strict = best is not None and 2 * _beyond(best[1]) <= 1.1 * _beyond(now)
        if not strict and not names:
            value, name, table = _best_byte_inverse(model, before + now + after)
            if best is None or value > best[0]:
                best = (value, now.translate(table), name)
        if best is None or not strict and best[0] < top[0] + params.gain_by_pair:
            break
        least = min(least, params.gain_utf8_bits) if strict else params.gain_bits
        now, names = best[1], [*names, best[2]]
        if best[0] > top[0]:
            top = (best[0], now, ", then ".join(names))
        if now.isascii():
            break
    gain = top[0] - start
    if top[2] and gain >= params.gain_by_pair and gain * (len(text) + 1) >= least:
        return top[1], top[2]
    return None


def _beyond(text: str) -> int:
    return len(text) - len(text.encode("ascii", "ignore"))


def _decoded(run: str, bytes_of: dict[str, int]) -> str:
    try:
        return bytes(bytes_of[c] for c in run).decode("utf-8")
    except (UnicodeDecodeError, KeyError):
        return run


def _best_byte_inverse(model: PairModel, text: str) -> tuple[float, str, dict[int, str]]:
    """The mapping of single bytes after which a text's pairs are likeliest, and their mean bits."""
    c = codepoints(text)
    pair, n = np.unique(c[:-1].astype(np.uint64) * np.uint64(LIMIT) + c[1:], return_counts=True)
    a, b = (pair // np.uint64(LIMIT)).astype(np.int64), (pair % np.uint64(LIMIT)).astype(np.int64)
    best = None
    for name, array, table in _byte_inverses():
        value = float((model.joint(array[a], array[b]) * n).sum()) / max(1, len(c) - 1)
        if best is None or value > best[0]:
            best = (value, name, table)
    return best


class Repairer:
    def __init__(self, model: PairModel, params: GarbleParams) -> None:
        self.model, self.params = model, params
        self.known: dict[tuple[str, str, str], tuple[str, str] | None] = {}

    def scores(self, texts: list[str]) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
        """Of each text with improbable pairs: places and scores wherever they add up to least_bits."""
        masked = [_CODE.sub(lambda m: m.group() if m.group().isascii() else "\0" * len(m.group()), t) for t in texts]
        codes, starts = joined(masked)
        slots, at = _slots_of(codes)
        pair = codes[at].astype(np.uint64) * np.uint64(LIMIT) + codes[at + 1]
        kinds, which = np.unique(pair, return_inverse=True)
        a, b = (kinds // np.uint64(LIMIT)).astype(np.int64), (kinds % np.uint64(LIMIT)).astype(np.int64)
        score = pair_improbability(self.model, a, b, self.params)[which]
        bytes_of_utf8 = np.zeros(len(codes), bool)
        for start, text in zip(starts.tolist(), masked):
            for runs in (_RUNS, _WESTERN):
                for m in runs.finditer(text):
                    if _decodable(m.group()):
                        bytes_of_utf8[start + m.start() : start + m.end() - 1] = True
        score = np.where(bytes_of_utf8[at], np.maximum(score, self.params.utf8_pair_bits), score)
        lost = (codes[at] == REPLACEMENT) | (codes[at + 1] == REPLACEMENT)
        score = np.where(lost, np.maximum(score, self.params.lost_bits), score)
        bounds = np.searchsorted(at, starts)
        for k in range(len(texts)):
            lo, hi = bounds[k], bounds[k + 1]
            if lo == hi:
                continue
            place, own = at[lo:hi] - starts[k], score[lo:hi]
            # Characters of ASCII in between wear a stretch down, a bit each.
            total = np.cumsum(own - np.maximum(np.diff(place, prepend=place[0]) - 1, 0))
            above = total - np.minimum.accumulate(total - own)
            # Maximal segments lie within the sum's excursions above its lowest value so far.
            up = np.flatnonzero(np.diff((above > 0).astype(np.int8), prepend=0, append=0))
            if len(up):
                high = np.maximum.reduceat(above, up[::2])
                worth = np.flatnonzero(high >= self.params.least_bits)
                yield k, [(place[up[2 * w] : up[2 * w + 1]], own[up[2 * w] : up[2 * w + 1]]) for w in worth]

    def segments(self, excursions: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
        for place, score in excursions:
            sequence: list[float] = []
            spots: list[int] = []
            last = place[0]
            for p, s in zip(place.tolist(), score.tolist()):
                if p > last + 1:
                    sequence.append(-float(p - last - 1))
                    spots.append(last)
                sequence.append(s)
                spots.append(p)
                last = p
            for b, e, total in sorted(maximal_segments(sequence)):
                if total >= self.params.least_bits:
                    yield spots[b], spots[e - 1] + 2

    def repair(self, text: str, excursions: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, int, int, str, str]:
        """Restored stretches, characters in them, lost characters in those that can't be restored, the text, the commonest
        mapping used. A text that was cut off within a character has lost nothing but its end."""
        pieces, done, n, chars, lost, names = [], 0, 0, 0, 0, {}
        end = len(text.rstrip().rstrip("�"))
        for lo, hi in self.segments(excursions):
            # To the ends of the runs beyond ASCII that it cuts into.
            while lo > done and ord(text[lo]) > 127 and ord(text[lo - 1]) > 127:
                lo -= 1
            while hi < len(text) and ord(text[hi - 1]) > 127 and ord(text[hi]) > 127:
                hi += 1
            while lo < hi and ord(text[lo]) < 128:
                lo += 1
            while hi > lo and ord(text[hi - 1]) < 128:
                hi -= 1
            if lo < done or lo >= hi:
                continue
            fixed = self._fix(text[lo:hi], text[lo - 1 : lo], text[hi : hi + 1])
            if fixed is None:
                lost += text.count("�", lo, min(hi, end))
                continue
            lost += fixed[0].count("�", 0, len(fixed[0]) - max(0, hi - end))
            pieces += [text[done:lo], fixed[0]]
            done, n, chars = hi, n + 1, chars + hi - lo
            names[fixed[1]] = names.get(fixed[1], 0) + 1
        pieces.append(text[done:])
        return n, chars, lost, "".join(pieces), max(names, key=names.get) if names else ""

    def _fix(self, stretch: str, before: str, after: str) -> tuple[str, str] | None:
        key = (stretch, before, after)
        if len(stretch) > 64:
            return restore(self.model, *key, self.params)
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = restore(self.model, *key, self.params)
        return self.known[key]


def pair_statistics(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts over all texts: slot (pairs below SLOTS, characters from there on) and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, chars = np.zeros(SLOTS, np.int64), np.zeros(LIMIT, np.int64)
        for batch in batches:
            for _, texts in grouped(enumerate(x.as_py() for x in batch.column(0))):
                slots, n, codes, m = count_pairs(texts)
                pairs[slots] += n
                chars[codes] += m
        every = np.concatenate([pairs, chars])
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at])], names=["slot", "n"])

    texts = documents.select(text_col).where(F.col(text_col).isNotNull())
    return texts.mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))


def fit_pairs(documents: DataFrame, text_col: str = "text") -> PairModel:
    """The pair model of a corpus. What reaches the driver has SLOTS + 1,114,112 numbers at most, whatever the corpus."""
    rows = pair_statistics(documents, text_col).toArrow()
    every = np.zeros(SLOTS + LIMIT)
    every[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    pairs, chars = every[:SLOTS], every[SLOTS:]
    return PairModel(
        np.log2(pairs + 0.25).astype(np.float32), np.log2(chars + 0.5).astype(np.float32), float(np.log2(chars.sum() + 1))
    )


def garbled_texts(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: GarbleParams = GarbleParams()
) -> DataFrame:
    """Documents with garbled stretches: id, text_hash, restored_stretches, restored_chars, lost_chars, mapping,
    restored_text.

    lost_chars counts replacement characters in improbable stretches, whose bytes can't be had back. mapping is the commonest inverse used.
    restored_text has every restorable stretch replaced and is otherwise the text as it was. Texts with nothing garbled,
    null and empty texts yield no row; repeated rows yield one, different texts of one id each their own. Samples quoted between backticks are left alone.

    Two passes: one gathers the pair statistics of all texts into a table of fixed size, one scores the texts that
    have characters beyond ASCII (the filter runs in the JVM).
    """
    model = fit_pairs(documents, text_col)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    picked = documents.where(F.col(text_col).rlike(r"[^\x00-\x7F]")).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(sent.value, params)
        for batch in batches:
            ids, hashes, rows = batch.column(0), batch.column(2), []
            for at, texts in grouped(enumerate(x.as_py() for x in batch.column(1))):
                spots = dict(repairer.scores(texts))
                for k, found in spots.items():
                    n, chars, lost, fixed, name = repairer.repair(texts[k], found)
                    if n or lost:
                        rows.append((ids[at[k]].as_py(), hashes[at[k]].as_py(), n, chars, lost, name, fixed))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            cols = list(zip(*rows)) if rows else [()] * 7
            names = ["id", "text_hash", "restored_stretches", "restored_chars", "lost_chars", "mapping", "restored_text"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)

    out = picked.mapInArrow(
        run, "id bigint, text_hash bigint, restored_stretches int, restored_chars int, lost_chars int, mapping string, restored_text string"
    )
    return out.dropDuplicates(["id", "text_hash"]).withColumnRenamed("id", id_col)

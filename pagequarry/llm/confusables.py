"""Texts that look alike but are written with other characters: finding them, and one form for all."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.session import BROADCAST_BYTES, content_bytes, shared_checkpoint

# Characters that show nothing.
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e"
    "\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
)
# Spaces and hyphens that stand for the plain ones.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\ufe63\uff0d"


@cache
def plain_forms() -> dict[str, str]:
    """Characters that are another form of letters or digits or of ASCII, by Unicode's own mappings, and the usual form.

    Of compatibility mappings, those of width and font, and of ligatures and letters that stand for several, are
    such. Superscripts, fractions, circled signs and the like have a look of their own and aren't.
    """
    found = {c: " " for c in SPACES} | {c: "-" for c in HYPHENS} | {c: "" for c in INVISIBLE}
    for n in range(0x80, 0x110000):
        ch = chr(n)
        kind, _, _ = unicodedata.decomposition(ch).partition(" ")
        if ch in found or not kind.startswith("<"):
            continue
        plain = unicodedata.normalize("NFKC", ch)
        letters = all(c.isalnum() for c in plain)
        if kind in ("<wide>", "<narrow>") or kind == "<font>" and letters:
            found[ch] = plain
        elif kind == "<compat>" and letters and len(plain) > 1 and unicodedata.category(ch) in ("Ll", "Lu", "Lt", "Nl"):
            found[ch] = plain
        elif kind == "<compat>" and letters and (ch == "ſ" or unicodedata.category(ch) == "Nl" and plain.isascii()):
            found[ch] = plain
    return found


_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0250-\u02af\u1e00-\u1e99\u1e9b-\u1eff"
#: Letters of other scripts that words are made of.
_OTHER = "\u0370-\u03ff\u0400-\u052f\u0531-\u058f\u13a0-\u13fd"
#: Cyrillic letters that make a word surely Cyrillic; those beyond them are of other languages than the texts here.
_RUSSIAN = "\u0410-\u044f\u0401\u0451"
_HAS_LATIN = re.compile(f"[{_LATIN}]")
_HAS_OTHER = re.compile(f"[{_OTHER}]")
_LETTERS = re.compile(f"[{_LATIN}{_OTHER}]+")
#: Words and identifiers: parts joined by anything but hyphens and spaces.
_IDENTIFIER = re.compile(r"[\w.]*\w")
_CYRILLIC = re.compile("[Ѐ-ԯ]")
#: Letters of texts in which a dotless i is one.
_TURKISH = re.compile("[ğşĞŞİ]")
_RARE_CYRILLIC = re.compile(f"[^{_RUSSIAN}\x00-\u03ff\u0530-\U0010ffff]")
_SCRIPTS = tuple(re.compile(f"[{c}]+") for c in (_LATIN, "\u0370-\u03ff", "\u0400-\u052f", "\u0531-\u058f", "\u13a0-\u13fd"))


def _plain(text: str) -> str:
    forms = plain_forms()
    return unicodedata.normalize("NFC", text.translate({ord(c): forms[c] for c in set(text) if c in forms}))


def _nfd(text: str) -> str:
    return unicodedata.normalize("NFD", text)


def _is_rare(word: str) -> bool:
    return _RARE_CYRILLIC.search(word) is not None


class Confusables:
    """Unicode's table of confusable characters, and what follows from it.

    prototypes: of every character that looks like others, the one that stands for all; several characters where it
    looks like several. Differences within ASCII are real, so ASCII characters stand for themselves: what looks like
    several of them (I, l, 1, |) stands for the one of its own category.
    """

    def __init__(self, prototypes: dict[str, str]) -> None:
        ascii_of: dict[str, dict[str, str]] = {}
        for c in map(chr, range(32, 127)):
            ascii_of.setdefault(prototypes.get(c, c), {})[unicodedata.category(c)] = c
        table = {}
        for c, p in prototypes.items():
            if not c.isascii():
                among = ascii_of.get(p)
                table[c] = among.get(unicodedata.category(c)) or among.get("Ll") or next(iter(among.values())) if among else p
        # Forms that Unicode maps itself: width, font, ligatures, spaces and hyphens, and what shows nothing.
        for c, plain in plain_forms().items():
            table[c] = "".join(table.get(x, x) for x in _nfd(plain))
        self.prototypes = {ord(c): _nfd(p) for c, p in table.items()}
        # Latin letters as they are usually written: ASCII, also with marks, and two ligatures that are letters.
        usual = {c: c for c in "æœÆŒ"} | {c: c for c in map(chr, range(0x41, 0x250)) if c.isalpha() and _nfd(c)[0].isascii()}
        by_look: dict[tuple[str, str], str] = {}
        for c in usual:
            by_look.setdefault((self.skeleton(c), unicodedata.category(c)), c)
        #: Letters that look like a usual Latin one of their case, and that: of other scripts, and phonetic ones of Latin.
        self.look_alike: dict[str, str] = {}
        self.phonetic: dict[str, str] = {}
        for n in self.prototypes.keys() | {n for n in range(0x370, 0x590) if _HAS_OTHER.match(chr(n))}:
            c = chr(n)
            like = by_look.get((self.skeleton(c), unicodedata.category(c)))
            if like and _HAS_OTHER.match(c):
                self.look_alike[c] = like
            elif like and like.isascii() and (0x250 <= n < 0x2B0 or c == "ı"):
                self.phonetic[c] = like
        #: The other way round; Cyrillic only, and its usual letters first.
        rare = lambda x: (_is_rare(x[0]), x[0])
        self.cyrillic: dict[str, str] = {}
        for c, p in sorted(self.look_alike.items(), key=rare):
            if _CYRILLIC.match(c):
                self.cyrillic.setdefault(p, c)
        shapes = sorted({x for p in self.look_alike.values() for x in _nfd(p)} | {x for p in self.look_alike.values() for x in self.skeleton(p)})
        #: Skeletons of words that can be written in several scripts: prototypes and marks only.
        self.open = "^[" + "".join(shapes) + "\u0300-\u036f]+$"

    def skeleton(self, text: str) -> str:
        """What a text looks like: decomposed, each character replaced by its prototype, decomposed again.

        Texts that read alike have the same skeleton. It is for comparing and not for reading: Cyrillic words come out in
        Latin letters where these look alike.
        """
        return text if text.isascii() else _nfd(_nfd(text).translate(self.prototypes))

    def _to_latin(self, word: str) -> str | None:
        out = [self.look_alike.get(c, c) for c in word]
        return "".join(out) if all(_HAS_LATIN.match(c) or not _HAS_OTHER.match(c) for c in out) else None

    def _to_cyrillic(self, word: str) -> str | None:
        out = [self.cyrillic.get(c, c) if _HAS_LATIN.match(c) else c for c in word]
        return "".join(out) if all(_CYRILLIC.match(c) or not _LETTERS.match(c) for c in out) else None

    def _own_script(self, word: str) -> str:
        """A word of several scripts in that of most of its letters that have no look-alike, if all others have one there."""
        latin, cyrillic = self._to_latin(word), self._to_cyrillic(word)
        if latin is None or cyrillic is None:
            return latin or cyrillic or word
        n_latin = len(_HAS_LATIN.findall(word))
        return latin if n_latin >= len(word) - n_latin else cyrillic

    def is_sure(self, word: str) -> bool:
        """Whether a word is surely of another script than Latin."""
        return bool(_HAS_OTHER.search(word)) and self._to_latin(word) is None

    def one_form(self, text: str, usual: Mapping[str, str] | None = None) -> str:
        """A text with the usual character for whatever the reader sees.

        Precomposed, plain width, plain spaces and hyphens, no invisible characters, ligatures as letters; words that
        `usual` has in the spelling it gives. The other ones by script: words of mixed scripts in their own one. A word all
        in look-alikes of another script could be of either: it becomes Latin where it stands in an identifier with Latin
        letters, or in a text with Latin and without any word surely of its script.
        """
        if text.isascii() and not usual:
            return text
        usual = usual or {}
        plain = _plain(text)
        if any(c in self.phonetic for c in plain) and not ("ı" in plain and _TURKISH.search(plain)):
            plain = unicodedata.normalize("NFC", _LETTERS.sub(self._spell_phonetic, plain))
        if not _HAS_OTHER.search(plain) and not usual:
            return plain
        settled = set(usual.values())
        plain = _LETTERS.sub(lambda m: self._spelled(m, usual) or self._fix_word(m.group()), plain)
        sure = any(self.is_sure(w) for w in _LETTERS.findall(plain))
        if not sure and _HAS_LATIN.search(plain):
            plain = _LETTERS.sub(lambda m: m.group() if m.group() in settled else self._as_latin(m.group()), plain)
        else:
            plain = _IDENTIFIER.sub(self._fix_identifier, plain)
        return unicodedata.normalize("NFC", plain)

    def _spell_phonetic(self, m: re.Match) -> str:
        # A word with other letters beside them that words aren't made of is a transcription.
        word = "".join(self.phonetic.get(c, c) for c in m.group())
        return m.group() if len(word) == 1 or any("\u0250" <= c < "\u02b0" for c in word) else word

    def _spelled(self, m: re.Match, usual: Mapping[str, str]) -> str | None:
        word = m.group()
        if word in usual and not _HAS_OTHER.search(word) and _HAS_OTHER.search(usual[word]):
            # A Latin name in code or in an identifier stays.
            before, after = m.string[max(0, m.start() - 1) : m.start()], m.string[m.end() : m.end() + 1]
            return None if re.search(r"[\w.`/-]", before + after) else usual[word]
        return usual.get(word)

    def _as_latin(self, word: str) -> str:
        return (self._to_latin(word) or word) if _HAS_OTHER.search(word) else word

    def _fix_word(self, word: str) -> str:
        if not _HAS_OTHER.search(word):
            return word
        foreign = {"c" if _CYRILLIC.match(c) else "o" for c in word if _HAS_OTHER.match(c)}
        if _HAS_LATIN.search(word):
            return self._own_script(word)
        return self._as_latin(word) if len(foreign) > 1 or _is_rare(word) else word

    def _fix_identifier(self, m: re.Match) -> str:
        word = m.group()
        if not _HAS_OTHER.search(word) or not _HAS_LATIN.search(word):
            return word
        return _LETTERS.sub(lambda p: self._as_latin(p.group()), word)

    def usual_spellings(self, words: set[str], groups: Groups) -> dict[str, str]:
        """Of a row's words, in plain form, those whose group has a usual spelling, and that.

        It is the one more rows have, first of the rows that also have, or haven't, words surely of another script, then of
        all; the row itself doesn't count. Without a difference the word is left open. So are single letters beside words of
        another script: they are words of one and names of the other. Latin words leave their script only if no text in
        Latin has them.
        """
        lows, found = Counter(w.lower() for w in words), {}
        other = any(map(self.is_sure, words))
        for word in words:
            if len(word) == 1 if other else word.isascii():
                continue
            ranks = []
            for spelling, n_plain, n_other in groups.get(self.skeleton(word), []):
                own = lows[spelling.lower()]
                near = (n_other if other else n_plain) - own
                ranks.append(((near, n_plain + n_other - own), spelling, n_plain))
            ranks.sort(reverse=True)
            if not ranks or ranks[0][0] == (ranks[1][0] if len(ranks) > 1 else (0, 0)):
                continue
            best = ranks[0][1]
            if not _HAS_OTHER.search(word) and (not _HAS_OTHER.search(best) or any(n for _, w, n in ranks if w == word)):
                continue
            found[word] = best
        return found


_known: dict[str, Confusables] = {}


def confusables(spark: SparkSession) -> Confusables:
    """The table of the session's own Unicode library (ICU, which Spark brings along), read once.

    All assigned characters go through its skeleton in one call, each on a line of its own.
    """
    context = spark.sparkContext
    icu = context._jvm.com.ibm.icu  # Spark has no public way to it
    key = context.applicationId
    if key not in _known:
        checker = getattr(icu.text, "SpoofChecker$Builder")().build()
        chars = [c for c in map(chr, range(32, 0x110000)) if unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs", "Zl", "Zp")]
        looks = checker.getSkeleton(0, "\n".join(chars)).split("\n")
        _known.clear()
        _known[key] = Confusables({c: p for c, p in zip(chars, looks, strict=True) if p != _nfd(c)})
    return _known[key]


#: Of each skeleton, the spellings: word, rows that have it without and with words surely of another script than Latin.
Groups = Mapping[str, list[tuple[str, int, int]]]


def may_differ(text: Column) -> Column:
    """Whether a text may have characters other than the usual ones; false for null. Runs in the JVM.

    Lets pass what plain_forms and one_form leave alone: ASCII, precomposed Latin letters, common signs.
    """
    return F.coalesce(text.rlike(_SUSPECT), F.lit(False))


# ASCII comes first, so that most characters need no further ranges.
_SUSPECT = (
    r"[[^\x00-\x7F]&&[^\u00a1-\u00ac\u00ae-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0180-\u01c3\u01cd-\u01f0\u01f4-\u024f"
    r"\u1e00-\u1e99\u1e9b-\u1eff\u2012-\u2027\u2030-\u205e\u20a0-\u20bf\u2116\u2122\u2190-\u2328\u232b-\u2adb\u2add-\u2bff\u3001-\u30ff\u4e00-\u9fff\uac00-\ud7a3\ufffd]]"
)


def _of_one_script(word: str) -> bool:
    return any(x.fullmatch(word) for x in _SCRIPTS) and not _is_rare(word)


def _suspect(columns: list[str]) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | may_differ(F.col(c))
    return found


def spelling_groups(rows: DataFrame, odd: DataFrame, columns: list[str], table: Confusables) -> Groups:
    """The words of all rows grouped by equal skeleton, where a group has letters of several scripts.

    odd are the distinct ones of the rows that have a suspect character. Only groups of words that can be written in several scripts, and only their spellings in one script are kept: of
    other words there is but one such spelling. So this is part of a language's vocabulary and small. A spelling counts
    in any letter case. Rows without a suspect character are split into words in the JVM.
    """
    text = F.concat_ws("\n", *columns)
    found = F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"([{_LATIN}]+)"), F.lit(1)))).alias("word")
    plain = rows.where(~_suspect(columns)).select(found).groupBy("word").agg(F.count(F.lit(1)).alias("plain"), F.lit(0).cast("bigint").alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[bool, Counter] = {False: Counter(), True: Counter()}
            for value in batch.column(0).to_pylist():
                words = set(_LETTERS.findall(_plain(value)))
                counts[any(map(table.is_sure, words))].update(words)
            words = sorted(counts[False].keys() | counts[True].keys())
            cols = [pa.array(words, pa.string()), *[pa.array([counts[k][w] for w in words], pa.int64()) for k in (False, True)]]
            yield pa.RecordBatch.from_arrays(cols, names=["word", "plain", "other"])

    others = odd.select(text.alias("t")).mapInArrow(run, "word string, plain bigint, other bigint")
    sums = [F.sum(c).alias(c) for c in ("plain", "other")]
    counted = shared_checkpoint(plain.unionByName(others).groupBy("word").agg(*sums))
    words = skeletons(counted, "word").where(F.col("skeleton").rlike(table.open))
    cased = counted.groupBy(F.lower("word").alias("low")).agg(*sums)
    mixed = words.groupBy("skeleton").agg(F.max(F.col("word") != F.col("skeleton")).alias("mixed")).where("mixed").select("skeleton")
    members = words.join(mixed, "skeleton").withColumn("low", F.lower("word")).join(cased, "low")
    groups: dict[str, list[tuple[str, int, int]]] = {}
    for r in members.select("skeleton", "word", "plain", "other").toLocalIterator():
        if _of_one_script(r.word):
            groups.setdefault(r.skeleton, []).append((r.word, r.plain, r.other))
    return groups


def look_alikes(
    sections: DataFrame, key: tuple[str, ...] = ("path", "sec_no"), columns: tuple[str, ...] = ("heading", "body")
) -> DataFrame:
    """Rows with text that is written other than it looks: the key, and each text column in one form.

    A row is reported if any of its columns differs from its one form. The form of a word is the usual spelling of its
    group of equal skeletons over all columns and rows; script rules decide what the groups leave open. Null columns
    stay null, empty ones empty. Repeated rows are reported once per different text. Only rows that may differ, by a
    test in the JVM, go to Python; other columns may have any name.
    """
    names = [f"k{i}" for i in range(len(key))] + [f"t{i}" for i in range(len(columns))]
    picked = sections.select(*[F.col(c).alias(n) for c, n in zip([*key, *columns], names)])
    # Few rows, read twice: written once, as the test for them costs more than the rest.
    odd = shared_checkpoint(picked.where(_suspect(names[len(key) :])).distinct())
    table = confusables(sections.sparkSession)
    groups = spelling_groups(picked, odd, names[len(key) :], table)
    schema = odd.schema

    def forms_of(row: tuple[str | None, ...]) -> tuple[str | None, ...]:
        words = {w for t in row if t is not None for w in _LETTERS.findall(_plain(t))}
        usual = table.usual_spellings(words, groups)
        return tuple(None if t is None else table.one_form(t, usual) for t in row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*[batch.column(len(key) + i).to_pylist() for i in range(len(columns))]))
            forms = [forms_of(row) for row in rows]
            keep = pa.array([a != b for a, b in zip(rows, forms)], pa.bool_())
            cols = [batch.column(i) for i in range(len(key))] + [pa.array([f[i] for f in forms], pa.string()) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in cols], names=names)

    out = odd.mapInArrow(run, schema).distinct()
    return out.select(*[F.col(n).alias(c) for c, n in zip([*key, *columns], names)])


def skeletons(texts: DataFrame, column: str) -> DataFrame:
    """column, skeleton of the distinct non-null values of a column. ASCII is its own skeleton and stays in the JVM."""
    table = confusables(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [table.skeleton(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], names=["t", "skeleton"])

    distinct = texts.select(F.col(column).alias("t")).where(F.col("t").isNotNull()).distinct()
    ascii_only = ~F.col("t").rlike(r"[^\x00-\x7F]")
    rest = distinct.where(~ascii_only).mapInArrow(run, "t string, skeleton string")
    return distinct.where(ascii_only).select("t", F.col("t").alias("skeleton")).unionByName(rest).withColumnRenamed("t", column)


def equal_looking(texts: DataFrame, column: str) -> DataFrame:
    """Groups of two or more different texts that look alike: skeleton, spellings (how many), one (the least of them)."""
    grouped = skeletons(texts, column).groupBy("skeleton").agg(
        F.count(F.lit(1)).alias("spellings"), F.min(column).alias("one")
    )
    return grouped.where(F.col("spellings") > 1)


#: What is grouped: whole texts by their MD5, so that they aren't gathered, and words as they are.
_IDS = {"text": F.md5, "word": F.col}


def _places(sections: DataFrame, unit: str, key: tuple[str, ...], columns: tuple[str, ...], once: bool = False) -> DataFrame:
    """k0.., column, original, id: the non-empty texts of the columns, or each different word of theirs.

    With once=True repeated keys don't repeat them; texts are gathered by key before they become many words.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("original")) for c in columns])
    names = [f"k{i}" for i in range(len(key))]
    texts = sections.select(*[F.col(k).alias(n) for k, n in zip(key, names)], F.explode(pairs).alias("e")).select(*names, "e.*")
    texts = texts.where("original <> ''")
    if once:
        texts = texts.groupBy(*names, "column").agg(F.collect_set("original").alias("s"))
        texts = texts.select(*names, "column", (F.explode("s") if unit == "text" else F.concat_ws("\n", "s")).alias("original"))
    if unit == "word":
        # Characters that show nothing are part of the word they stand in.
        found = F.regexp_extract_all("original", F.lit(r"([\p{L}\p{M}\p{N}\p{Cf}]+)"), F.lit(1))
        texts = texts.withColumn("original", F.explode(F.array_distinct(found)))
    return texts.withColumn("id", _IDS[unit]("original"))


def _members(places: DataFrame, unit: str) -> DataFrame:
    """id, group (MD5 of the skeleton), spellings of the originals that have others of equal skeleton; runs at once."""
    table = confusables(places.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [hashlib.md5(table.skeleton(t).encode()).hexdigest() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], names=["id", "group"])

    ascii_only = ~F.col("original").rlike(r"[^\x00-\x7F]")
    # ASCII is its own skeleton and stays in the JVM.
    plain = places.where(ascii_only).select("id").distinct().withColumn("group", F.col("id") if unit == "text" else F.md5("id"))
    odd = places.where(~ascii_only).select("id", "original")
    odd = (odd if unit == "text" else odd.distinct()).mapInArrow(run, "id string, group string").distinct()
    spelt = shared_checkpoint(plain.unionByName(odd))
    several = spelt.groupBy("group").agg(F.count(F.lit(1)).alias("spellings")).where("spellings > 1")
    found = shared_checkpoint(spelt.join(several, "group"))
    return F.broadcast(found) if content_bytes(found, "id") + content_bytes(found, "group") <= BROADCAST_BYTES else found


def equal_looking_places(
    sections: DataFrame, key: tuple[str, ...] = ("path", "sec_no"), columns: tuple[str, ...] = ("heading", "body")
) -> DataFrame:
    """Where the originals of groups of two or more that look alike stand: the key, column, unit, group, original.

    unit: "text" for the whole value of a column, "word" for a word in it; group: the MD5 of the skeleton, unique with
    unit. Groups are over all columns and rows; every original of a group comes out with every place that has it,
    repeated rows and repeats within a text once.
    """
    found = None
    for unit in _IDS:
        members = _members(_places(sections, unit, (), columns), unit)
        part = _places(sections, unit, key, columns, once=True).join(members, "id").withColumn("unit", F.lit(unit))
        found = part if found is None else found.unionByName(part)
    return found.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(key)], "column", "unit", "group", "original")


def equal_looking_groups(sections: DataFrame, columns: tuple[str, ...] = ("heading", "body")) -> DataFrame:
    """One row for each group of equal_looking_places: unit, group, skeleton, spellings (how many), one (the least)."""
    found = None
    for unit in _IDS:
        places = _places(sections, unit, (), columns)
        spelt = places.join(_members(places, unit).select("id"), "id", "left_semi").select("original")
        part = equal_looking(spelt, "original").withColumn("unit", F.lit(unit))
        found = part if found is None else found.unionByName(part)
    return found.select("unit", F.md5("skeleton").alias("group"), "skeleton", "spellings", "one")

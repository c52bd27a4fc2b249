"""One consistent form of visually identical text (problem 4).

Three steps per text: ignorable characters are deleted; widths, ligatures, radicals, kinds of blanks and hyphens are
mapped by compatibility normalisation (raised, lowered and circled characters, which are visibly different, are not),
and the rest is composed (NFC); then each token is read as a lattice that has, at each position, the look-alike letters
of all scripts, and Viterbi picks the path with the best score: for each letter, the probability of its trigram among the
trigrams of one script and that of its script in this text. The lattice is made from look-alike classes, not from the
characters found, so that all texts that look the same have the same lattice and thus the same form, and texts that
differ visibly never meet.

The counts are taken over all texts. Only trigrams within a script are counted, so that a path that changes its script
gets what unseen trigrams get. Bigrams are counted exactly (the square of the letters of four scripts), trigrams in a
table of 2**TRIGRAM_BITS cells: both have a fixed size, whatever the size of the corpus.

Defined results: a null text has a null form; a blank one has a form but is no case of `lookalike_pairs`; re-delivered
rows count once; tables may be empty and have further columns.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.runtime import cut_lineage
from .records import spread

# Look-alike letters, in each row those of one look. L Latin, C Cyrillic, G Greek, A Armenian.
CLASSES = """
L:A C:А G:Α
L:B C:В G:Β
L:C C:С
L:E C:Е G:Ε
L:G C:Ԍ
L:H C:Н G:Η
L:I C:І G:Ι
L:J C:Ј
L:K C:К G:Κ
L:M C:М G:Μ
L:N G:Ν
L:O C:О G:Ο A:Օ
L:P C:Р G:Ρ
L:Q C:Ԛ
L:S C:Ѕ A:Տ
L:T C:Т G:Τ
L:U A:Ս
L:V C:Ѵ
L:W C:Ԝ
L:X C:Х G:Χ
L:Y C:Ү G:Υ
L:Z G:Ζ
L:a C:а
L:c C:с G:ϲ
L:d C:ԁ
L:e C:е
L:g A:ց
L:h C:һ A:հ
L:i C:і
L:j C:ј G:ϳ
L:l C:ӏ
L:n A:ո
L:o C:о G:ο A:օ
L:p C:р
L:q C:ԛ A:զ
L:s C:ѕ
L:u A:ս
L:v C:ѵ G:ν
L:w C:ԝ
L:x C:х
L:y C:у
C:Г G:Γ
C:П G:Π
C:Ф G:Φ
"""
# Letters and hyphens of other blocks with the look of a common one.
SAME = {"ɡ": "g", "ı": "ı", "‐": "-", "‑": "-", "‒": "-", "−": "-", "⁃": "-", "˗": "-", "﹣": "-", "﹘": "-", "K": "K", "Å": "Å", "\r\n": "\n"}
BLANKS = " \t               　"
#: Ranges of characters that have no look (Unicode's default ignorables).
IGNORABLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]
TRIGRAM_BITS = 20
_BLOCKS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")

_classes: list[dict[str, str]] = [dict(x.split(":") for x in row.split()) for row in CLASSES.split("\n") if row]
#: Prototype (first letter of the row) -> script -> letter.
ALTERNATIVES = {next(iter(c.values())): c for c in _classes}
_PROTO = {letter: next(iter(c.values())) for c in _classes for letter in c.values()}


def _compatible(c: str) -> str:
    """What a character looks like in plain characters; itself, if that would change its look."""
    if c in SAME:
        return SAME[c]
    if c in BLANKS:
        return " "
    tag, _, _ = unicodedata.decomposition(c).partition("> ")
    plain = unicodedata.normalize("NFKC", c)
    if tag in ("<wide", "<narrow", "<font", "<initial", "<medial", "<final", "<isolated"):
        return plain
    if tag == "<compat" and (unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo", "Nl") or 0x2E80 <= ord(c) <= 0x2FDF):
        return plain
    return c


class _Table(dict):
    """Translation table filled as characters are met."""

    def __missing__(self, code: int) -> str:
        if any(a <= code <= b for a, b in IGNORABLE):
            out = ""
        else:
            out = "".join(_PROTO.get(x, x) for x in _compatible(chr(code)))
        self[code] = out
        return out


_table = _Table()
_OTHERS = re.compile(r"[\u0370-\u058f\u1f00-\u1fff]")
#: Tokens of the lattices: runs of letters of the scripts of CLASSES. Other letters have no look-alikes here and part tokens.
_WORD = re.compile(r"[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u02af\u0370-\u058f\u1e00-\u1fff]+")


def skeleton(text: str) -> str:
    """Every letter as the prototype of its look; the same for all texts that look the same."""
    if not text.isascii():
        # composed first: an accent may stand apart from a look-alike base
        text = unicodedata.normalize("NFC", text.translate(_table))
        if _OTHERS.search(text) is not None:  # accented Latin letters are what they are
            text = unicodedata.normalize("NFC", "".join(map(_compose, text)))
    return text.replace("\t", " ").replace("\r\n", "\n")


@lru_cache(maxsize=65536)
def _compose(c: str) -> str:
    """An accented letter on the prototype of its base, so that a Cyrillic base under an accent is seen too."""
    parts = unicodedata.normalize("NFD", c)
    return "".join(_PROTO.get(x, x) for x in parts) if len(parts) > 1 and parts[0] in _PROTO else c


def script_of(c: str) -> str:
    """L, C, G, A, or "" for letters of other scripts."""
    name = unicodedata.name(c, "")
    return next((b[0] for b in _BLOCKS if name.startswith(b)), "")


#: Letters that only one script has, in the order of SCRIPTS.
SCRIPTS = "LCGA"
_ANCHORS = ["bfkmrtzDFLR", "\u0400-\u052f", "\u0370-\u03ff", "\u0530-\u058f"]
#: More letters than this are no stronger evidence.
_ENOUGH = 3
_ONE, _PLENTY = [re.compile(f"[{a}]") for a in _ANCHORS], [re.compile(f"[{a}]" + f"[^{a}]*[{a}]" * (_ENOUGH - 1)) for a in _ANCHORS]


def _evidence(skel: str) -> tuple[int, ...]:
    """How many letters of each script a text has that no other script has, up to _ENOUGH."""
    counts = (_ENOUGH if plenty.search(skel) is not None else len(one.findall(skel)) for one, plenty in zip(_ONE, _PLENTY))
    return (next(counts), 0, 0, 0) if skel.isascii() else tuple(counts)


@lru_cache(maxsize=65536)
def _choices(c: str) -> tuple[tuple[str, str], ...]:
    """(letter, script) that may stand for a prototype. Accented prototypes have the accented letters of their base."""
    parts = unicodedata.normalize("NFD", c)
    base = ALTERNATIVES.get(parts[0])
    if base is None:
        return ((c, script_of(c)),)
    return tuple((unicodedata.normalize("NFC", letter + parts[1:]), script) for script, letter in base.items())


_LETTERS = [chr(c) for c in range(0x600) if chr(c).isalpha() and script_of(chr(c))]
_N = len(_LETTERS) + 1
_place = np.zeros(0x600, np.int64)
_place[[ord(c) for c in _LETTERS]] = np.arange(1, _N)
_script = np.array([0, *("LCGA".index(script_of(c)) + 1 for c in _LETTERS)])
_PRIME = 0x9E3779B97F4A7C15


def _cell(a, b, c):  # noqa: ANN001, ANN202
    """Cell of a trigram of places; numbers or arrays of them."""
    code = (a * _N + b) * _N + c
    if isinstance(code, np.ndarray):
        return ((code.astype(np.uint64) * np.uint64(_PRIME)) >> np.uint64(64 - TRIGRAM_BITS)).astype(np.int64)
    return ((code * _PRIME) & (2**64 - 1)) >> (64 - TRIGRAM_BITS)


class Speller:
    """Best paths through the lattices of tokens, many at once. bigrams and trigrams are count tables (see `ngram_counts`); place 0 is what stands before a token."""

    def __init__(self, bigrams: np.ndarray, trigrams: np.ndarray):
        bigrams = bigrams.reshape(_N, _N).astype(np.float64)
        #: Probability of a letter behind another, and the denominators of trigrams. Pairs of two scripts were never counted.
        self.pair = ((bigrams + 0.1) / (bigrams.sum(1, keepdims=True) + 100.0)).ravel()
        self.under = (bigrams + 2.0).ravel()
        self.trigrams = trigrams
        self.memo: dict[tuple[str, tuple[int, ...]], str] = {}
        #: Evidence -> tokens that are read as they stand.
        self.kept: dict[tuple[int, ...], set[str]] = {}
        #: Characters met, and their rows: a column per script; place, whether there is such a letter, whether its script counts.
        self.rows: dict[str, int] = {}
        self.letters: list[list[str]] = []
        self.place, self.there, self.counts = np.zeros((256, 4), np.int64), np.zeros((256, 4), bool), np.zeros((256, 4), bool)

    def _row(self, c: str) -> int:
        row = self.rows.get(c)
        if row is None:
            row = self.rows[c] = len(self.letters)
            if row >= len(self.place):
                self.place, self.there, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.place, self.there, self.counts))
            letters = [""] * 4
            for letter, script in _choices(c):
                k = SCRIPTS.index(script) if script else 0
                letters[k] = letter
                self.place[row, k] = _place[ord(letter)] if len(letter) == 1 and ord(letter) < 0x600 else 0
                self.there[row, k], self.counts[row, k] = True, bool(script)
            self.letters.append(letters)
        return row

    def _score(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Log probability of letters behind two others: their trigram, smoothed by their bigram."""
        pair = self.pair[b * _N + c]
        return np.log(np.where((a == 0) & (b == 0), pair, (self.trigrams[_cell(a, b, c)] + 2.0 * pair) / self.under[a * _N + b]))

    def learn(self, wanted: Iterable[tuple[str, tuple[int, ...]]]) -> None:
        """Reads (token, evidence) that are not known yet, longer ones first, in batches of bounded size."""
        if len(self.memo) > 500_000:
            self.memo.clear()
            self.kept.clear()
        new = sorted({x for x in wanted if x not in self.memo}, key=lambda x: (-len(x[0]), x))
        while new:
            n = max(1, min(len(new), 400_000 // len(new[0][0])))
            self._viterbi(new[:n])
            new = new[n:]

    def _viterbi(self, wanted: list[tuple[str, tuple[int, ...]]]) -> None:
        """Longer tokens first. The state is the letters at the last two positions, as columns of scripts; ties go to the earlier columns."""
        rows = [[self._row(c) for c in token] for token, _ in wanted]
        size = np.array([len(r) for r in rows])
        evidence = np.array([e for _, e in wanted], np.float64)
        of_script = np.log((evidence + 0.5) / (evidence.sum(1, keepdims=True) + 2.0))
        at = np.zeros((len(rows), size[0]), np.int64)
        for k, r in enumerate(rows):
            at[k, : len(r)] = r
        # before a token there is place 0, in the first column
        best = np.full((len(rows), 4, 4), -np.inf)
        best[:, 0, 0] = 0.0
        a = b = np.zeros((len(rows), 4), np.int64)
        came = []
        for s in range(size[0]):
            n = int(np.searchsorted(-size, -s, side="left"))  # tokens that have this position
            here = at[:n, s]
            c, there = self.place[here], self.there[here]
            value = best[:n, :, :, None] + self._score(a[:n, :, None, None], b[:n, None, :, None], c[:, None, None, :]) + np.where(self.counts[here], of_script[:n], 0.0)[:, None, None, :]
            value = np.where(there[:, None, None, :], value, -np.inf)
            came.append(value.argmax(1).astype(np.int8))
            best[:n] = value.max(1)
            a, b = b[:n], c
        state = best.reshape(len(rows), 16).argmax(1)
        y, z = state // 4, state % 4
        paths: list[list[str]] = [[] for _ in rows]
        for s in range(size[0] - 1, -1, -1):
            n = len(came[s])
            for k, column in enumerate(z[:n].tolist()):
                paths[k].append(self.letters[rows[k][s]][column])
            x = came[s][np.arange(n), y[:n], z[:n]]
            z[:n], y[:n] = y[:n], x
        for key, path in zip(wanted, paths):
            form = self.memo[key] = "".join(reversed(path))
            if form == key[0]:
                self.kept.setdefault(key[1], set()).add(form)

    def texts(self, texts: Iterable[str]) -> list[str]:
        """The forms of texts."""
        skeletons = [skeleton(t) for t in texts]
        evidence = [_evidence(t) for t in skeletons]
        tokens = [set(_WORD.findall(t)) for t in skeletons]
        kept = self.kept
        self.learn((token, e) for own, e in zip(tokens, evidence) for token in own.difference(kept.get(e, ())))
        return [t if own.issubset(kept.get(e, ())) else _WORD.sub(lambda m, e=e: self.memo[m.group(), e], t) for t, own, e in zip(skeletons, tokens, evidence)]

    def text(self, text: str) -> str:
        """The form of a text."""
        return self.texts([text])[0]


def _count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigrams and trigrams of letters of one script, place 0 before the first, by numpy over the code points of whole batches. Trigram cells follow the bigrams."""
    total = np.zeros(_N * _N + (1 << TRIGRAM_BITS), np.int64)
    for batch in batches:
        texts = [t for t in batch.column("text").to_pylist() if t]
        points = np.frombuffer(("\n\n" + "\n\n".join(texts)).encode("utf-32-le", "replace"), "<u4")
        at = _place[np.where(points < 0x600, points, 0)]
        a, b, c = at[:-2], at[1:-1], at[2:]
        alike = (_script[b] == _script[c]) | (b == 0)
        pair = (c > 0) & alike
        total[: _N * _N] += np.bincount((b * _N + c)[pair], minlength=_N * _N)
        a = np.where(b == 0, 0, a)
        three = pair & ((a == 0) | (_script[a] == _script[b]))
        total[_N * _N :] += np.bincount(_cell(a[three], b[three], c[three]), minlength=1 << TRIGRAM_BITS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["cell", "n"])


def ngram_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(bigrams, trigrams) over all texts, summed by Spark. The driver gets one row per cell that is not empty; the number of cells is fixed."""
    rows = texts.select("text").where("text is not null").mapInArrow(_count_ngrams, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(_N * _N + (1 << TRIGRAM_BITS), np.float32)
    total[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return total[: _N * _N], total[_N * _N :]


def _forms(counts: Broadcast, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller, memo = Speller(*counts.value), {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if len(memo) > 100_000:
                memo.clear()
            new = [t for t in dict.fromkeys(texts) if t is not None and t not in memo]
            memo.update(zip(new, speller.texts(new)))
            forms = [None if t is None else memo[t] for t in texts]
            keys = [batch.column(c) for c in ("record_kind", "media_id", "record_idx")]
            if not digest:
                yield pa.RecordBatch.from_arrays([*keys, batch.column("text"), pa.array(forms, pa.string())], names=["record_kind", "media_id", "record_idx", "text", "form"])
                continue
            keep = [i for i, f in enumerate(forms) if f and not f.isspace()]
            hashed = {f: blake2b(f.encode("utf-8", "replace"), digest_size=16).digest() for f in {f for f in forms if f is not None}}
            raw = {t: blake2b(t.encode("utf-8", "replace"), digest_size=8).digest() for t in {t for t in texts if t is not None}}
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(k.take(at) for k in keys), pa.array([hashed[forms[i]] for i in keep], pa.binary()), pa.array([raw[texts[i]] for i in keep], pa.binary())], names=["record_kind", "media_id", "record_idx", "form", "raw"])

    return run


_FORMS = T.StructType([T.StructField("record_kind", T.StringType()), T.StructField("media_id", T.StringType()), T.StructField("record_idx", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("form", T.StringType())])
_DIGESTS = T.StructType([*_FORMS.fields[:3], T.StructField("form", T.BinaryType()), T.StructField("raw", T.BinaryType())])


def _counts(texts: DataFrame) -> Broadcast:
    return texts.sparkSession.sparkContext.broadcast(ngram_counts(texts))


def consistent_forms(records: DataFrame) -> DataFrame:
    """record_kind, media_id, record_idx, text, form of every row of records."""
    texts = spread(records.select("record_kind", "media_id", "record_idx", "text"))
    return texts.mapInArrow(_forms(_counts(texts), False), _FORMS)


_CLASS = ["record_kind", "media_id", "form"]


def _mixed_rows(records: DataFrame) -> DataFrame:
    """record_kind, media_id, record_idx, form, raw (digests) and members (rows of the class) of rows whose class has several texts.

    Only digests are shuffled; they are made once and kept in the checkpoint folder. Rows without a media item have no partners. Classes in which all texts are equal, however large, drop out before the join.
    """
    texts = spread(records.select("record_kind", "media_id", "record_idx", "text"))
    rows = cut_lineage(texts.mapInArrow(_forms(_counts(texts), True), _DIGESTS).where("media_id is not null")).distinct()
    mixed = rows.groupBy(*_CLASS).agg(F.min("raw").alias("least"), F.max("raw").alias("most"), F.count("*").alias("members")).where("least <> most").select(*_CLASS, "members")
    return rows.join(mixed, _CLASS)


#: Rows of a class that meet all its rows in one task.
_PART = 1024


def lookalike_pairs(records: DataFrame) -> DataFrame:
    """record_kind, media_id, idx_a < idx_b: rows of a media item with the same form and different texts.

    What is joined has the size of the result: a class is split into parts of some _PART rows, each of which meets the whole class in a task of its own, so that a class of any size spreads over tasks.
    """
    parts = F.ceil(F.col("members") / _PART).cast("int")
    some = _mixed_rows(records)
    a = some.withColumn("part", F.pmod(F.xxhash64("record_idx"), parts).cast("int")).drop("members").withColumnsRenamed({"record_idx": "idx_a", "raw": "raw_a"})
    b = some.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("members").withColumnsRenamed({"record_idx": "idx_b", "raw": "raw_b"})
    return a.join(b, [*_CLASS, "part"]).where("idx_a < idx_b and raw_a <> raw_b").select("record_kind", "media_id", "idx_a", "idx_b")


def lookalike_classes(records: DataFrame) -> DataFrame:
    """record_kind, media_id, record_idx, class_id, links: one row per row that looks like another with a different text; class_id is the digest of the table, the media item and their form, links the number of such partners."""
    some = _mixed_rows(records)
    same = some.groupBy(*_CLASS, "raw").agg(F.count("*").alias("same"))
    links: Column = (F.col("members") - F.col("same")).cast("bigint")
    return some.join(same, [*_CLASS, "raw"]).select("record_kind", "media_id", "record_idx", F.md5(F.concat_ws("\x00", "record_kind", "media_id", F.hex("form"))).alias("class_id"), links.alias("links"))

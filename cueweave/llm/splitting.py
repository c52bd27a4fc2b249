"""Oversized texts cut into overlapping pieces (problem 5).

A text is cut into tokens (words, blanks, marks); the prefix sums of their lengths are the places where it may be cut.
Three sorted arrays hold the boundaries that suit: ends of paragraphs and sentences, ends of clauses, ends of words.
For each piece, a binary search finds the last boundary of the best kind that the limit allows; the next piece starts
`overlap_chars` before the end of the last. A better kind must not make the piece much shorter; where that leaves none,
the last boundary of any kind is taken. Where no boundary is in reach the text is cut hard, between characters as a
reader sees them if possible (not before combining marks, joiners or variation selectors).

Defined results: null texts and texts within the limit have no pieces; blank ones are cut like any other text; an
overlap of half the limit or more is taken as one less than half; a limit below 1 or null excludes the kind; a
re-delivered row counts once; whole texts are cut, whatever their length; tables may be empty or have more columns.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = regex.compile(r"\r?\n|[^\S\n]+|[\p{L}\p{M}\p{N}_'’-]+|\X")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
SENTENCE_END = ".!?…。！？؟।॥;"
CLAUSE_END = ",;:，、；：،—–"
_CLOSING = "\"'”’»」』）)]】》"


def boundaries(text: str) -> tuple[list[int], list[int], list[int]]:
    """Sorted code point offsets at which a piece may end: sentences and lines, clauses, words."""
    tokens = _TOKEN.findall(text)
    sentence, clause, word = [], [], []
    last = ""
    for token, end in zip(tokens, accumulate(map(len, tokens))):
        if "\n" in token:
            sentence.append(end)
            last = ""
        elif token.isspace():
            (sentence if last and last in SENTENCE_END else clause if last and last in CLAUSE_END else word).append(end)
            last = ""
        elif token in _CLOSING:
            if last and last in "。！？":
                sentence.append(end)
        else:
            if token in "。！？।॥":
                sentence.append(end)
            elif token in "，、；：،":
                clause.append(end)
            elif _CJK.search(token) is None:
                word.append(end)
            last = token[-1]
    return sentence, clause, word


def _hard(text: str, start: int, end: int) -> int:
    """The last place up to `end` that does not part a character from its marks; `end` if there is none."""
    at = end
    while at > start and (unicodedata.combining(text[at]) or text[at] in "\u200d\ufe0f\ufe0e" or text[at - 1] == "\u200d" or unicodedata.category(text[at]) in ("Mn", "Mc", "Me")):
        at -= 1
    return at if at > start else end


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text: at most `limit` long, each but the first starting `overlap` before the end of the one before."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    overlap = max(0, min(overlap, (limit - 1) // 2))
    levels = boundaries(text)
    # a better boundary is worth a shorter piece: down to half the limit for sentences, a third less for clauses
    least = [max(overlap, limit // 2), max(overlap, limit * 2 // 3), max(overlap, limit // 3)]
    out, start = [], 0
    while n - start > limit:
        end = 0
        for level, short in zip(levels, least):
            k = bisect_right(level, start + limit) - 1
            if k >= 0 and level[k] > start + short:
                end = level[k]
                break
        if not end:  # however short the piece gets, as long as the next one starts behind this one
            end = max((level[k] for level in levels if (k := bisect_right(level, start + limit) - 1) >= 0), default=0)
            end = end if end > start + overlap else 0
        end = end or _hard(text, start + overlap, start + limit)
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ("record_kind", "media_id", "record_idx")
    for batch in batches:
        rows, number, starts, ends, texts = [], [], [], [], []
        limits, overlaps = batch.column("max_chars").to_pylist(), batch.column("overlap_chars").to_pylist()
        for i, t in enumerate(batch.column("text").to_pylist()):
            for k, (a, b) in enumerate(pieces(t, limits[i], overlaps[i] or 0)):
                rows.append(i)
                number.append(k)
                starts.append(a)
                ends.append(b)
                texts.append(t[a:b])
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keys), pa.array(number, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string())], names=[*keys, "piece", "piece_start", "piece_end", "piece_text"])


PIECES = T.StructType([T.StructField("record_kind", T.StringType()), T.StructField("media_id", T.StringType()), T.StructField("record_idx", T.IntegerType()), T.StructField("piece", T.IntegerType()), T.StructField("piece_start", T.IntegerType()), T.StructField("piece_end", T.IntegerType()), T.StructField("piece_text", T.StringType())])


def oversized_pieces(records: DataFrame, limits: DataFrame) -> DataFrame:
    """record_kind, media_id, record_idx, piece, piece_start, piece_end, piece_text of every row over its limit.

    Only rows over the limit leave the JVM. Repeated deliveries are told by the digest of their text, so that the text is
    no key of the one shuffle. limits has one row per record kind; Spark broadcasts it if it is as small as it should be; of
    repeated kinds the smallest limit holds.
    """
    own = limits.where("max_chars >= 1").groupBy("record_kind").agg(F.min("max_chars").cast("int").alias("max_chars"), F.min("overlap_chars").cast("int").alias("overlap_chars"))
    over = records.select("record_kind", "media_id", "record_idx", "text").join(own, "record_kind").where(F.length("text") > F.col("max_chars"))
    once = over.withColumn("digest", F.md5("text")).dropDuplicates(["record_kind", "media_id", "record_idx", "digest"]).drop("digest")
    return once.mapInArrow(_cut, PIECES)

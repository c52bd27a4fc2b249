"""Words and segments in time: interval joins, coverage, clipping, cutting and rebuilding.

Inputs are clean tables with whole milliseconds. Interval joins have the keys (media_id, time bucket): a media item with
a third of all rows is spread over its buckets, and there is no join without an equality. A pair that meets in several
buckets is kept in the one where the later of the two begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import kernels as K
from .base import with_neighbours, with_previous, with_running_sum

BUCKET_MS = 60_000


def _spread(df: DataFrame, start: str, end: str) -> DataFrame:
    at = lambda c: F.floor(c / BUCKET_MS).cast("bigint")
    return df.withColumn("bucket", F.explode(F.sequence(at(F.col(start)), at(F.greatest(F.col(end) - 1, F.col(start))))))


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Pairs of rows of one media item with l_start < r_end and r_start < l_end. left has l_start, l_end; right r_start, r_end."""
    a, b = _spread(left, "l_start", "l_end"), _spread(right, "r_start", "r_end")
    meet = (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.floor(F.greatest("l_start", "r_start") / BUCKET_MS) == F.col("bucket"))
    return a.join(b, ["media_id", "bucket"]).where(meet).drop("bucket")


def words_in_segments(words: DataFrame, segments: DataFrame) -> DataFrame:
    """media_id, seg_idx, word_idx: a word on an edge belongs to both neighbours."""
    a = words.select("media_id", "word_idx", F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))
    b = segments.select("media_id", "seg_idx", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    return overlap_join(a, b).select("media_id", "seg_idx", "word_idx")


def word_coverage(words: DataFrame, segments: DataFrame) -> DataFrame:
    """media_id, seg_idx, dur_ms, covered_ms: time of a segment under words; words that overlap count each."""
    a = words.select("media_id", F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))
    b = segments.select("media_id", "seg_idx", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    met = overlap_join(a, b).groupBy("media_id", "seg_idx").agg(F.sum(F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).alias("covered_ms"))
    return segments.join(met, ["media_id", "seg_idx"], "left").select("media_id", "seg_idx", (F.col("end_ms") - F.col("start_ms")).alias("dur_ms"), F.coalesce("covered_ms", F.lit(0)).cast("bigint").alias("covered_ms"))


def coverage_holes(words: DataFrame, segments: DataFrame, least_ms: int = 1500, share: float = 0.15, hole_ms: int = 3000, hole_share: float = 0.05) -> DataFrame:
    """media_id, qualifying, hole_ms, total_ms, has_holes: whether long segments with hardly any word make up too much of an item."""
    d = word_coverage(words, segments)
    long = F.col("dur_ms") >= least_ms
    hole = long & (F.col("covered_ms").cast("double") / F.col("dur_ms") < share)
    d = d.groupBy("media_id").agg(F.count_if(long).alias("qualifying"), F.coalesce(F.sum(F.when(hole, F.col("dur_ms"))), F.lit(0)).cast("bigint").alias("hole_ms"))
    total = segments.groupBy("media_id").agg(F.max("end_ms").alias("total_ms"))
    d = d.join(total, "media_id")
    return d.withColumn("has_holes", (F.col("hole_ms") > 0) & ((F.col("hole_ms") >= hole_ms) | (F.col("hole_ms") >= hole_share * F.col("total_ms"))))


def clip(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows cut to a range; what lies outside is gone."""
    cut = df.withColumns({"start_ms": F.greatest("start_ms", start.cast("bigint")), "end_ms": F.least("end_ms", end.cast("bigint"))})
    return cut.where("end_ms > start_ms")


def shift_words(words: DataFrame, offset_ms: Column) -> DataFrame:
    """Words moved in time, as those heard in a cut-out range are moved back to where it begins."""
    return words.withColumns({"start_ms": (F.col("start_ms") + offset_ms).cast("bigint"), "end_ms": (F.col("end_ms") + offset_ms).cast("bigint")})


def clamp_words(words: DataFrame, start: Column, end: Column) -> DataFrame:
    """Words cut to a range (start, end: columns of the words or literals); those outside it, without length or blank are gone."""
    return clip(words, start, end).where((start < end) & ~X.is_blank(F.col("word")))


def range_replace(segments: DataFrame, new: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """media_id, seg_idx, part, start_ms, end_ms, text: segments outside the range stay, those across its edges keep their
    outer parts with the full text, what is inside gives way to the new rows (seg_idx, start_ms, end_ms, text) cut to the range."""
    rows = segments.select("media_id", "seg_idx", "start_ms", "end_ms", "text")
    across = (F.col("start_ms") < end_ms) & (F.col("end_ms") > start_ms)
    part = lambda d, name: d.select("media_id", "seg_idx", F.lit(name).alias("part"), "start_ms", "end_ms", "text")
    keep = part(rows.where(~across), "kept")
    left = part(rows.where(across & (F.col("start_ms") < start_ms)).withColumn("end_ms", F.lit(start_ms).cast("bigint")), "left")
    right = part(rows.where(across & (F.col("end_ms") > end_ms)).withColumn("start_ms", F.lit(end_ms).cast("bigint")), "right")
    fresh = part(clip(new.select("media_id", "seg_idx", "start_ms", "end_ms", "text"), F.lit(start_ms), F.lit(end_ms)).where(~X.is_blank(F.col("text"))), "new")
    return keep.unionByName(left).unionByName(right).unionByName(fresh)


def word_reliability(words: DataFrame, least: int = 30) -> DataFrame:
    """media_id, words, bad_words, median_ms, reliable: enough words, few of no or absurd length, and a plausible exact median."""
    dur = F.col("end_ms") - F.col("start_ms")
    bad = (dur <= 0) | (dur > 8000)
    d = words.groupBy("media_id").agg(F.count("*").alias("words"), F.count_if(bad).alias("bad_words"), F.median(F.when(~bad, dur)).alias("median_ms"))
    ok = (F.col("words") >= least) & (F.col("bad_words").cast("double") / F.col("words") <= 0.2) & (F.coalesce("median_ms", F.lit(1e9)) <= 1200)
    return d.withColumn("reliable", ok)


def pause_flags(words: DataFrame, pause_ms: int = 650) -> DataFrame:
    """media_id, word_idx, gap_ms, pause, strong, soft of every word that has a next one."""
    d = with_previous(words, "word_idx", ["start_ms"], "next_", backwards=True).where("next_start_ms is not null")
    mark = F.right(X.strip(F.col("word")), F.lit(1))
    strong = mark.isin(*"。.!?？！")
    gap = F.col("next_start_ms") - F.col("end_ms")
    return d.select("media_id", "word_idx", gap.alias("gap_ms"), (gap >= pause_ms).alias("pause"), strong.alias("strong"), (~strong & mark.isin(*"，,、；;:：…")).alias("soft"))


def segments_from_cuts(words: DataFrame, cut: Column) -> DataFrame:
    """media_id, seg_no, start_ms, end_ms, n_words: a segment ends with each word for which cut holds, and at the end."""
    d = with_running_sum(words.withColumn("cut", F.coalesce(cut, F.lit(False)).cast("bigint")), "word_idx", "cut", "seg_no")
    return d.groupBy("media_id", "seg_no").agg(F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "word_idx").alias("end_ms"), F.count("*").alias("n_words"))


def punct_split(words: DataFrame, segments: DataFrame, least_ms: int = 2500, hard_ms: int = 15000, least_chars: int = 4) -> DataFrame:
    """media_id, seg_idx, piece, start_ms, end_ms, text: segments cut behind words with an end mark if both sides are long enough.

    Pieces over the hard limit or without length are dropped, as the reference drops them; segments with fewer than two
    words or no cut stay whole if they have text. Relational throughout: an interval join, windows within a segment, a
    running count of cuts and an aggregation; no key is larger than a segment.
    """
    # all that the windows need goes through the interval join, so that nothing is fetched again
    a = words.select("media_id", "word_idx", F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"), "word")
    b = segments.where("end_ms > start_ms").select("media_id", "seg_idx", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    met = overlap_join(a, b).withColumnsRenamed({"l_start": "w0", "l_end": "w1", "r_start": "s0"}).drop("r_end")
    seg = Window.partitionBy("media_id", "seg_idx")
    order = seg.orderBy("word_idx")
    d = met.withColumn("tail", F.coalesce(F.sum(X.reading_chars(F.col("word"))).over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)))
    d = d.withColumn("n", F.count("*").over(seg)).withColumn("last", F.max("w1").over(seg)).withColumn("is_last", F.lead("word_idx").over(order).isNull())
    cut = F.col("word").rlike("[。！？!?；;…]") & ~F.col("is_last") & (F.col("w1") - F.col("s0") >= least_ms) & (F.col("last") - F.col("w1") >= least_ms) & (F.col("tail") >= least_chars)
    d = d.withColumn("cut", cut.cast("bigint")).withColumn("piece", F.coalesce(F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")).withColumn("cuts", F.sum("cut").over(seg))
    pieces = d.where("n >= 2 and cuts > 0").groupBy("media_id", "seg_idx", "piece").agg(F.min("w0").alias("start_ms"), F.max_by("w1", "word_idx").alias("end_ms"), F.array_sort(F.collect_list(F.struct("word_idx", "word"))).alias("ws"))
    pieces = pieces.where((F.col("end_ms") > F.col("start_ms")) & (F.col("end_ms") - F.col("start_ms") <= hard_ms)).select("media_id", "seg_idx", "piece", "start_ms", "end_ms", X.strip(F.array_join(F.transform("ws", lambda w: w["word"]), "")).alias("text"))
    split = d.where("n >= 2 and cuts > 0").select("media_id", "seg_idx").distinct()
    whole = segments.where("end_ms > start_ms").where(~X.is_blank(F.col("text"))).join(split, ["media_id", "seg_idx"], "left_anti").select("media_id", "seg_idx", F.lit(0).cast("bigint").alias("piece"), "start_ms", "end_ms", "text")
    return pieces.unionByName(whole)


def repair_candidates(segments: DataFrame) -> DataFrame:
    """media_id, seg_idx, trigger, from_ms, to_ms: segments to listen to again and the range, by the first of four triggers that holds.

    The first segment of an item is never one; the range is bounded by the neighbours and the end of the item. One exchange
    finds both neighbours; the triggers are the kernel of `kernels.repair`, over Arrow batches.
    """
    d = with_neighbours(segments, "seg_idx", ["start_ms", "end_ms", "text"], ["start_ms"]).where("prev_end_ms is not null")
    names = ["start_ms", "end_ms", "text", "prev_start_ms", "prev_end_ms", "prev_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in names))
            found = [K.trigger((0, ps, pe, pt, None), (0, s, e, t, None)) for s, e, t, ps, pe, pt in rows]
            at = pa.array([i for i, f in enumerate(found) if f], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("media_id", "seg_idx")), pa.array([f for f in found if f], pa.string()), *(batch.column(c).take(at) for c in ("end_ms", "prev_end_ms", "next_start_ms"))], names=["media_id", "seg_idx", "trigger", "end_ms", "prev_end_ms", "next_start_ms"])

    found = d.select("media_id", "seg_idx", *names, "next_start_ms").mapInArrow(run, "media_id string, seg_idx bigint, trigger string, end_ms bigint, prev_end_ms bigint, next_start_ms bigint")
    total = segments.groupBy("media_id").agg(F.max("end_ms").alias("total_ms"))
    lo = F.greatest(F.col("prev_end_ms") - 1000, F.lit(0))
    hi = F.least(F.greatest(F.col("end_ms") + 1500, F.coalesce(F.col("next_start_ms") + 200, F.lit(0))), F.col("total_ms"))
    return found.join(total, "media_id").select("media_id", "seg_idx", "trigger", lo.cast("bigint").alias("from_ms"), hi.cast("bigint").alias("to_ms"))


def low_info(text: Column, dur_ms: Column) -> Column:
    """Long, but with one word, two letters, or hardly a word per five seconds."""
    words = X.word_count(text)
    return (dur_ms >= 6000) & ((words <= 1) | (X.letter_count(text) <= 2) | (words * 1000 / dur_ms <= 0.2))


def suspect(text: Column, dur_ms: Column, cps: float = 6.0) -> Column:
    """Long, and empty or slow."""
    return (dur_ms >= 10_000) & (X.is_blank(text) | (F.length(X.strip(text)).cast("double") * 1000 / dur_ms <= cps))


def repeats(before: Column, text: Column, gap_ms: Column) -> Column:
    """Says again what the segment before says."""

    def body(f: Column) -> Column:
        a, b = f["a"], f["b"]
        same = (a.contains(b) | b.contains(a)) & (F.least(F.length(a), F.length(b)) >= 50)
        return (a != "") & (b != "") & (same | ((gap_ms <= 2000) & (X.repair_similarity(a, b) >= 0.92)))

    enough = (F.length(X.strip(before)) >= 12) & (F.length(X.strip(text)) >= 12)
    return enough & X.let(F.struct(X.normalize_repair(before).alias("a"), X.normalize_repair(text).alias("b")), body)


def stuck(text: Column) -> Column:
    """A word three times in a row, or one word as most of a text. Linear in the words, but for a sort."""

    def body(w: Column) -> Column:
        n = F.size(w)
        head = F.slice(w, 1, 80)
        often = (n >= 6) & X.let(X.longest_run(F.array_sort(w)), lambda top: (top >= 6) & (top / n >= 0.70))
        most = (n >= 12) & (X.longest_run(F.array_sort(head)) / F.least(n, F.lit(80)) >= 0.45)
        return (X.longest_run(w) >= 3) | often | most

    return F.coalesce(X.let(F.filter(F.split(X.normalize_repair(text), " "), lambda x: x != ""), body), F.lit(False))


def translate_context(segments: DataFrame, k: int = 2) -> DataFrame:
    """media_id, seg_idx, before, after: the texts of up to k segments before (without blank ones) and the first 80 characters of the next."""
    # the row before carries its own row before: k steps, each one window
    out = segments.select("media_id", "seg_idx", "text")
    chain = ["text"]
    for i in range(k):
        out = with_previous(out, "seg_idx", [chain[-1]], f"b{i}_")
        chain.append(f"b{i}_{chain[-1]}")
    out = with_previous(out, "seg_idx", ["text"], "next_", backwards=True)
    earlier = F.filter(F.array(*(F.col(c) for c in reversed(chain[1:]))), lambda t: t.isNotNull() & ~X.is_blank(t))
    return out.select("media_id", "seg_idx", F.array_join(earlier, "\n").alias("before"), F.substring(F.coalesce("next_text", F.lit("")), 1, 80).alias("after"))


def segment_stats(segments: DataFrame) -> DataFrame:
    """media_id, avg_ms, short_share, tiny_share: mean duration, share under 1.2 s, share under 2 s with at most six characters."""
    dur = F.col("end_ms") - F.col("start_ms")
    share = lambda c: F.sum(c.cast("bigint")).cast("double") / F.count("*")
    return segments.groupBy("media_id").agg((F.sum(dur).cast("double") / F.count("*")).alias("avg_ms"), share(dur < 1200).alias("short_share"), share((dur < 2000) & (F.length(X.strip(F.col("text"))) <= 6)).alias("tiny_share"))


def share_time(segments: DataFrame) -> DataFrame:
    """media_id, seg_idx, piece, start_ms, end_ms, text: the sentence pieces of a segment with its time in proportion to their characters. Segments without time or text have none."""
    d = segments.where("end_ms > start_ms").select("media_id", "seg_idx", "start_ms", "end_ms", F.posexplode(X.sentence_pieces(F.col("text"))).alias("piece", "text"))
    seg = Window.partitionBy("media_id", "seg_idx")
    n = X.reading_chars(F.col("text"))
    d = d.withColumn("n", n).withColumn("upto", F.sum("n").over(seg.orderBy("piece"))).withColumn("total", F.sum("n").over(seg))
    at = lambda c: (F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * c / F.col("total"))).cast("bigint")
    return d.select("media_id", "seg_idx", F.col("piece").cast("bigint").alias("piece"), at(F.col("upto") - F.col("n")).alias("start_ms"), at(F.col("upto")).alias("end_ms"), "text")

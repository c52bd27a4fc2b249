"""The ordered folds over DataFrames: kernels streamed per media item (see `base.fold`)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.runtime import cut_lineage
from . import kernels as K
from .base import BUCKET, fold, with_islands, with_number
from .quality import Profile, summary
from .words import punct_split

_CUE = "cue_index bigint, start_ms bigint, end_ms bigint, text string"
_SEGMENT = "seg_idx bigint, start_ms bigint, end_ms bigint, text string, confidence double"
_NEW = "seg_no bigint, start_ms bigint, end_ms bigint, text string"


def _cues(df: DataFrame) -> DataFrame:
    return df.select("media_id", "cue_index", "start_ms", "end_ms", "text")


def _segments(df: DataFrame) -> DataFrame:
    return df.select("media_id", "seg_idx", "start_ms", "end_ms", "text", "confidence")


#: Files are fixed in the order of start, end and index, as they are when sorted on reading.
_SORTED, _BY_TIME = ["start_ms", "end_ms", "cue_index"], ["start_ms", "end_ms", "seg_idx"]


def _roomy(cues: DataFrame, need: Column, overlap: int, push: int = 1000) -> DataFrame:
    """Islands of the fixes that give cues time: a cue whose earliest start, had it all the time it may need before it, lies behind the latest end of every cue before it neither pushes nor is pushed."""
    reach = F.greatest(F.col("end_ms"), F.col("start_ms") + push + need) + overlap + 1
    return with_islands(_cues(cues), _SORTED, reach, lambda seen, _: F.col("start_ms") - F.col("need") > seen, {"need": need})


def fix_cps(cues: DataFrame, max_cps: float = 16.0, overlap: int = 0) -> DataFrame:
    """Cues that are read too fast get more time."""
    need = F.ceil(X.reading_chars(F.col("text")) / max_cps * 1000.0).cast("bigint") if max_cps > 0 else F.lit(0)
    return fold(_roomy(cues, need, overlap), _SORTED, partial(K.speed, max_cps=max_cps, overlap=overlap), _CUE, island=True).drop("island")


def fix_duration(cues: DataFrame, min_ms: int = 900, overlap: int = 0) -> DataFrame:
    """Cues that are too short get more time."""
    return fold(_roomy(cues, F.lit(max(min_ms, 0)), overlap), _SORTED, partial(K.duration, min_ms=min_ms, overlap=overlap), _CUE, island=True).drop("island")


def fix_loop(cues: DataFrame, passes: int = 3, texts: bool = True, profile: Profile = Profile()) -> DataFrame:
    """media_id, cue_index, start_ms, end_ms, text: cues sorted by time and numbered anew, fixed in items that break a rule; the passes are chained in one stream."""
    ranked, bad = _ranked_bad(cues, profile)
    limits = dict(max_cps=profile.max_cps, min_ms=profile.min_dur_ms, overlap=profile.max_overlap_ms, width=profile.max_line_len, most=profile.max_lines)
    fixed = fold(_far_apart(ranked.join(bad, "media_id", "left_semi"), passes, profile), ["cue_index"], partial(K.fix_loop, passes=passes, texts=texts, **limits), _CUE, island=True).drop("island")
    return ranked.join(bad, "media_id", "left_anti").unionByName(fixed)


def _ranked_bad(cues: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """Cues numbered by time, and the media items that break a rule. Both are kept: the checks, the cuts and the fixes read them."""
    ranked = with_number(_cues(cues), _SORTED, "n").drop("cue_index").withColumnRenamed("n", "cue_index").select("media_id", "cue_index", "start_ms", "end_ms", "text")
    ranked = cut_lineage(ranked)
    return ranked, cut_lineage(summary(ranked, profile).where("not ok").select("media_id"))


def _far_apart(cues: DataFrame, passes: int, profile: Profile) -> DataFrame:
    """Islands of the fix loop. In a pass, two steps give a cue at most the time it needs, behind or before it; what lies farther apart than all steps together can reach never meets."""
    chars = X.reading_chars(F.col("text"))
    need = F.greatest(F.ceil(chars / profile.max_cps * 1000.0) if profile.max_cps > 0 else F.lit(0), F.lit(max(profile.min_dur_ms, 1))).cast("bigint")
    steps = 2 * passes * (need + 1)
    reach = F.greatest("start_ms", "end_ms") + steps + abs(profile.max_overlap_ms) + 1
    return with_islands(cues, _SORTED, reach, lambda seen, _: F.col("start_ms") - F.col("steps") > seen, {"steps": steps})


def fix_actions(cues: DataFrame, passes: int = 3, profile: Profile = Profile()) -> DataFrame:
    """media_id, pass, step, name, cue_index, start_before, end_before, start_after, end_after, text_before, text_after, delta_ms, note: every action of `fix_loop`, one row each."""
    limits = dict(max_cps=profile.max_cps, min_ms=profile.min_dur_ms, overlap=profile.max_overlap_ms, width=profile.max_line_len, most=profile.max_lines)
    schema = "pass int, step int, name string, cue_index bigint, start_before bigint, end_before bigint, start_after bigint, end_after bigint, text_before string, text_after string, delta_ms bigint, note string"
    ranked, bad = _ranked_bad(cues, profile)
    return fold(_far_apart(ranked.join(bad, "media_id", "left_semi"), passes, profile), ["cue_index"], partial(K.fix_actions, passes=passes, **limits), schema, island=True).drop("island")


def subtitle_fixes(cues: DataFrame, **limits: float | None) -> DataFrame:
    """One round of fixes: overlaps, duration (min_ms), speed (max_cps), wrapping (width, most); steps without a limit are left out."""
    return fold(_cues(cues), _SORTED, partial(K.fix_once, **limits), _CUE)


def wrap_lines(cues: DataFrame, width: int = 42, most: int = 2) -> DataFrame:
    """Texts wrapped row by row, in batches; no shuffle."""
    import pyarrow as pa

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            own = [K.wrap(t, width, most) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("media_id"), batch.column("cue_index"), pa.array(own, pa.string())], names=["media_id", "cue_index", "text"])

    return cues.select("media_id", "cue_index", "text").mapInArrow(run, "media_id string, cue_index bigint, text string")


def wrap_two_lines(cues: DataFrame, width: int = 42) -> DataFrame:
    """media_id, cue_index, line_1, line_2: the split of a text's words in two lines that fit with the shortest longer line, as expressions; texts without such a split are left out."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    at = lambda i: F.array_join(F.slice("w", F.lit(1), i), " ")
    rest = lambda i: F.array_join(F.slice("w", i + 1, F.size("w")), " ")
    d = cues.select("media_id", "cue_index", words.alias("w")).where("size(w) >= 2")
    splits = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.greatest(F.length(at(i)), F.length(rest(i))).alias("longest"), at(i).alias("a"), rest(i).alias("b")))
    d = d.select("media_id", "cue_index", F.array_min(splits).alias("best")).where(F.col("best.longest") <= width)
    return d.select("media_id", "cue_index", F.col("best.a").alias("line_1"), F.col("best.b").alias("line_2"))


def _numbered(df: DataFrame) -> DataFrame:
    """seg_no over the whole item of rows that are numbered within their island: the rows of all islands before are added. The rows come from a fold, so they are kept."""
    rows = cut_lineage(df)
    count = rows.groupBy("media_id", "island").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("media_id").orderBy("island").rowsBetween(Window.unboundedPreceding, -1))
    before = count.select("media_id", "island", F.coalesce(before, F.lit(0)).alias("seen"))
    return rows.join(before, ["media_id", "island"]).withColumn("seg_no", F.col("seg_no") + F.col("seen")).drop("island", "seen")


def rule_segments(words: DataFrame, **limits: int) -> DataFrame:
    """Words to segments by soft and hard limits, marks and pauses. A word that begins more than the hard limit behind all before it begins a segment; the one before looks at it, no other does."""
    rows = words.select("media_id", "word_idx", "start_ms", "end_ms", "word")
    islands = with_islands(rows, ["word_idx"], F.greatest("start_ms", "end_ms"), lambda seen, _: F.col("low") - seen > limits.get("hard", 15_000), {"low": F.least("start_ms", "end_ms")}, size=BUCKET, lookahead=True)
    return _numbered(fold(islands.select(*rows.columns, "ahead", "island"), ["word_idx"], partial(K.rule_segments, **limits), _NEW, island=True))


def window_segments(words: DataFrame, cutter: K.Cutter = K.no_cuts, keep_tail: bool = False) -> DataFrame:
    """Words to segments by overlapping windows with cuts from a provider; without one, by the rules."""
    return fold(words.select("media_id", "word_idx", "start_ms", "end_ms", "word"), ["start_ms", "end_ms", "word_idx"], partial(K.window_segments, cutter=cutter, keep_tail=keep_tail), _NEW)


def repair(segments: DataFrame, listen: K.Listener) -> DataFrame:
    """Doubtful segments replaced by what a provider hears: listen(media_id, from_ms, to_ms) gives words."""
    total = segments.groupBy("media_id").agg(F.max("end_ms").alias("total_ms"))
    d = _segments(segments).join(total, "media_id").withColumn("source", F.col("media_id"))
    return fold(d, _BY_TIME, partial(K.repair, listen=listen), _SEGMENT)


def wrap_zh(segments: DataFrame, width: int = 18, most: int = 2) -> DataFrame:
    """media_id, seg_idx, text: texts wrapped as Chinese lines, without splitting."""
    import pyarrow as pa

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            own = [K.wrap_zh(t, width, most) if t and t.strip() else t for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("media_id"), batch.column("seg_idx"), pa.array(own, pa.string())], names=["media_id", "seg_idx", "text"])

    return segments.select("media_id", "seg_idx", "text").mapInArrow(run, "media_id string, seg_idx bigint, text string")


def greedy_units(words: DataFrame, **limits: int) -> DataFrame:
    """Words to segments, greedily. A word that begins more than the hard limit behind all before it begins a segment whatever they are."""
    order = ["start_ms", "end_ms", "word_idx"]
    rows = words.select("media_id", "word_idx", "start_ms", "end_ms", "word")
    islands = with_islands(rows, order, F.greatest("start_ms", "end_ms"), lambda seen, _: F.least("start_ms", "end_ms") - seen > limits.get("hard", 15_000))
    return _numbered(fold(islands, order, partial(K.greedy_units, **limits), _NEW, island=True))


def _apart(segments: DataFrame) -> DataFrame:
    """Islands of segments that overlap; a blank segment begins none."""
    return with_islands(_segments(segments), _BY_TIME, F.col("end_ms"), lambda seen, _: (F.col("start_ms") > seen) & ~F.col("blank"), {"blank": X.is_blank(F.col("text"))})


def one_of_each(segments: DataFrame) -> DataFrame:
    """The better of segments that cover each other."""
    return fold(_apart(segments), _BY_TIME, K.one_of_each, _SEGMENT, island=True).drop("island")


def no_overlap(segments: DataFrame) -> DataFrame:
    """Segments that don't overlap."""
    return fold(_apart(segments), _BY_TIME, K.no_overlap, _SEGMENT, island=True).drop("island")


def _strong(segments: DataFrame, least_ms: int, min_ms: int = 2500, min_chars: int = 8) -> DataFrame:
    """Islands of merging: a segment that is long enough by itself, behind one that is so too and at least least_ms long, joins nothing before it, whatever that has become."""
    dur = F.col("end_ms") - F.col("start_ms")
    given = {"strong": (dur >= min_ms) & (F.length(X.strip(F.col("text"))) >= min_chars), "dur": dur}
    return with_islands(_segments(segments), _BY_TIME, F.col("end_ms"), lambda _, before: F.col("strong") & before["strong"] & (before["dur"] >= least_ms), given)


def coalesce(segments: DataFrame, min_ms: int = 2500, min_chars: int = 8, target: int = 7000, hard: int = 15000) -> DataFrame:
    """Weak segments merged, then near duplicates resolved: two folds with islands of their own."""
    limits = dict(min_ms=min_ms, min_chars=min_chars, target=target, hard=hard)
    # the second fold takes the rows in the order in which the first one gives them
    kernel = lambda rows: ((*s, k) for k, s in enumerate(K.coalesce(rows, **limits)))
    merged = cut_lineage(fold(_strong(segments, -(-target * 6 // 10), min_ms, min_chars), _BY_TIME, kernel, f"{_SEGMENT}, place bigint", island=True))
    return _near_duplicates(merged.withColumnRenamed("island", "part"), ["start_ms", "part", "place"])


def absorb(segments: DataFrame) -> DataFrame:
    """The first pass of coalescing alone: weak segments join the one before."""
    return fold(_strong(segments, 0), _BY_TIME, partial(K._absorb, min_ms=2500, min_chars=8, hard=15000), _SEGMENT, island=True).drop("island")


def near_duplicates(segments: DataFrame, window: int = 30_000, gap: int = 2000) -> DataFrame:
    """One of each group of near duplicates. A segment out of the window of all before it, and behind their ends by more than the gap of neighbours, meets none of them."""
    return _near_duplicates(_segments(segments), _BY_TIME, window, gap)


def _near_duplicates(segments: DataFrame, order: list[str], window: int = 30_000, gap: int = 2000) -> DataFrame:
    reach = F.greatest(F.col("start_ms") + window, F.col("end_ms") + gap)
    islands = with_islands(segments, order, reach, lambda seen, _: F.col("start_ms") > seen)
    kernel = lambda rows: K.near_duplicates((r[:5] for r in rows), window=window, gap=gap)
    return fold(islands, order, kernel, _SEGMENT, island=True).drop("island")


def layout_zh(segments: DataFrame, width: int = 18, most: int = 2) -> DataFrame:
    """Segments laid out as cues of at most `most` lines; row by row, so no shuffle."""
    import pyarrow as pa

    names = ["seg_idx", "start_ms", "end_ms", "text", "confidence"]

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            media, rows = [], []
            for m, row in zip(batch.column("media_id").to_pylist(), zip(*(batch.column(c).to_pylist() for c in names))):
                for out in K.layout_zh(iter([row]), width, most):
                    media.append(m)
                    rows.append(out)
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(media, pa.string()), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], names=["media_id", "seg_idx", "part", "start_ms", "end_ms", "text"])

    return _segments(segments).mapInArrow(run, "media_id string, seg_idx bigint, part bigint, start_ms bigint, end_ms bigint, text string")


def postprocess(words: DataFrame, segments: DataFrame) -> DataFrame:
    """Sentence splitting, then coalescing; seg_idx numbers the pieces of a media item."""
    pieces = punct_split(words, segments)
    ranked = with_number(cut_lineage(pieces), ["seg_idx", "piece"], "n", BUCKET).select("media_id", F.col("n").alias("seg_idx"), "start_ms", "end_ms", "text", F.lit(None).cast("double").alias("confidence"))
    return coalesce(ranked)

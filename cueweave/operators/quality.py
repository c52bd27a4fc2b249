"""Checks of cues: metrics, violations, summaries, and the overlap fix.

Input is `clean_cues`. Every result is defined for empty tables (no rows); a cue with no text has no lines and no speed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .base import with_previous


@dataclass(frozen=True)
class Profile:
    """Limits of the checks (fixed defaults)."""

    name: str = "default"
    max_cps: float = 16.0
    max_line_len: int = 18
    max_lines: int = 1
    min_dur_ms: int = 900
    max_dur_ms: int = 6500
    max_overlap_ms: int = 0


TYPES = ("BAD_TIMECODE_ORDER", "EMPTY_TEXT", "TOO_SHORT_DURATION", "TOO_LONG_DURATION", "TOO_FAST_CPS", "LINE_TOO_LONG", "TOO_MANY_LINES", "OVERLAP")


def cue_metrics(cues: DataFrame) -> DataFrame:
    """media_id, cue_index, start_ms, end_ms, duration_ms, char_count, cps, max_line_len, line_count."""
    own = X.lines(F.col("text"))
    d = cues.select("media_id", "cue_index", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), X.reading_chars(F.col("text")).alias("char_count"), own.alias("lines"))
    return d.select(
        "media_id", "cue_index", "start_ms", "end_ms", "duration_ms", "char_count",
        (F.col("char_count").cast("double") / F.greatest(F.col("duration_ms") / F.lit(1000.0), F.lit(1e-6))).alias("cps"),
        F.coalesce(F.array_max(F.transform("lines", F.length)), F.lit(0)).cast("bigint").alias("max_line_len"), F.size("lines").cast("bigint").alias("line_count"),
    )


def pair_metrics(cues: DataFrame) -> DataFrame:
    """media_id, cue_index, prev_end_ms, cur_start_ms, gap_ms, overlap_ms of every cue but the first of an item."""
    d = with_previous(cues.select("media_id", "cue_index", "start_ms", "end_ms"), "cue_index", ["end_ms"]).where("prev_end_ms is not null")
    gap = F.col("start_ms") - F.col("prev_end_ms")
    return d.select("media_id", "cue_index", "prev_end_ms", F.col("start_ms").alias("cur_start_ms"), gap.alias("gap_ms"), F.greatest(-gap, F.lit(0).cast("bigint")).alias("overlap_ms"))


def bad_timecode_order(cues: DataFrame) -> DataFrame:
    """Cues that start before the cue before them."""
    d = with_previous(cues.select("media_id", "cue_index", "start_ms"), "cue_index", ["start_ms"])
    return d.where("start_ms < coalesce(prev_start_ms, -1)").select("media_id", "cue_index", "prev_start_ms", F.col("start_ms").alias("cur_start_ms"))


def _wide(cues: DataFrame) -> DataFrame:
    """All that the checks look at, one row per cue: one scan, one window."""
    d = with_previous(cues, "cue_index", ["start_ms", "end_ms"])
    m = X.lines(F.col("text"))
    d = d.withColumn("dur", F.col("end_ms") - F.col("start_ms")).withColumn("chars", X.reading_chars(F.col("text"))).withColumn("lines", m)
    d = d.withColumn("cps", F.col("chars").cast("double") / F.greatest(F.col("dur") / F.lit(1000.0), F.lit(1e-6)))
    d = d.withColumn("longest", F.coalesce(F.array_max(F.transform("lines", F.length)), F.lit(0)).cast("bigint")).withColumn("n_lines", F.size("lines").cast("bigint"))
    return d.withColumn("overlap", F.greatest(F.col("prev_end_ms") - F.col("start_ms"), F.lit(0)))


def _checks(limit: dict[str, Column]) -> list[tuple[str, int, Column, Column, Column]]:
    """(type, phase, condition, value, limit)."""
    c = F.col
    return [
        ("BAD_TIMECODE_ORDER", 0, c("start_ms") < F.coalesce(c("prev_start_ms"), F.lit(-1)), c("start_ms"), c("prev_start_ms")),
        ("EMPTY_TEXT", 1, X.is_blank(c("text")), F.lit(0), F.lit(0)),
        ("TOO_SHORT_DURATION", 1, c("dur") < limit["min_dur_ms"], c("dur"), limit["min_dur_ms"]),
        ("TOO_LONG_DURATION", 1, c("dur") > limit["max_dur_ms"], c("dur"), limit["max_dur_ms"]),
        ("TOO_FAST_CPS", 1, c("cps") > limit["max_cps"], c("cps"), limit["max_cps"]),
        ("LINE_TOO_LONG", 1, c("longest") > limit["max_line_len"], c("longest"), limit["max_line_len"]),
        ("TOO_MANY_LINES", 1, c("n_lines") > limit["max_lines"], c("n_lines"), limit["max_lines"]),
        ("OVERLAP", 2, c("overlap") > limit["max_overlap_ms"], c("overlap"), limit["max_overlap_ms"]),
    ]


def _limits(profile: Profile) -> dict[str, Column]:
    return {k: F.lit(getattr(profile, k)) for k in ("max_cps", "max_line_len", "max_lines", "min_dur_ms", "max_dur_ms", "max_overlap_ms")}


def violations(cues: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """media_id, cue_index, phase, type, severity, value, threshold: one row per broken rule, from one pass over the cues."""
    rows = [F.when(cond, F.struct(F.lit(phase).alias("phase"), F.lit(name).alias("type"), F.lit("minor" if name == "TOO_LONG_DURATION" else "major").alias("severity"), value.cast("double").alias("value"), limit.cast("double").alias("threshold"))) for name, phase, cond, value, limit in _checks(_limits(profile))]
    d = _wide(cues).select("media_id", "cue_index", F.explode(F.array_compact(F.array(*rows))).alias("v"))
    return d.select("media_id", "cue_index", "v.*")


def violation_details(cues: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """media_id, cue_index, type, severity, start_ms, end_ms, what the rule looked at (dur_ms, cps, char_count, max_line_len, line_count, lines, prev_start_ms, prev_end_ms, overlap_ms; null where it doesn't look) and its threshold, and message: the full rows of a report."""
    c, limits = F.col, _limits(profile)
    seen = {
        "BAD_TIMECODE_ORDER": ("prev_start_ms",), "EMPTY_TEXT": (), "TOO_SHORT_DURATION": ("dur_ms",), "TOO_LONG_DURATION": ("dur_ms",), "TOO_FAST_CPS": ("cps", "char_count", "dur_ms"), "LINE_TOO_LONG": ("max_line_len", "lines"),
        "TOO_MANY_LINES": ("line_count", "lines"), "OVERLAP": ("overlap_ms", "prev_end_ms"),
    }
    values = {
        "prev_start_ms": c("prev_start_ms"), "dur_ms": c("dur"), "cps": c("cps"), "char_count": c("chars"), "max_line_len": c("longest"), "line_count": c("n_lines"), "lines": F.array_join("lines", "\n"), "overlap_ms": c("overlap"), "prev_end_ms": c("prev_end_ms"),
    }
    text = lambda x: x.cast("string")
    said = {
        "BAD_TIMECODE_ORDER": F.concat(F.lit("Timecode order not monotonic at cue "), text(c("cue_index"))), "EMPTY_TEXT": F.lit("Empty subtitle text"),
        "TOO_SHORT_DURATION": F.concat(F.lit("Duration "), text(c("dur")), F.lit("ms < min "), text(limits["min_dur_ms"]), F.lit("ms")), "TOO_LONG_DURATION": F.concat(F.lit("Duration "), text(c("dur")), F.lit("ms > max "), text(limits["max_dur_ms"]), F.lit("ms")),
        "TOO_FAST_CPS": F.concat(F.lit("CPS "), F.format_string("%.2f", c("cps")), F.lit(" > max "), text(limits["max_cps"])), "LINE_TOO_LONG": F.concat(F.lit("Line length "), text(c("longest")), F.lit(" > max "), text(limits["max_line_len"])),
        "TOO_MANY_LINES": F.concat(F.lit("Line count "), text(c("n_lines")), F.lit(" > max "), text(limits["max_lines"])),
        "OVERLAP": F.concat(F.lit("Overlap "), text(c("overlap")), F.lit("ms > max "), text(limits["max_overlap_ms"]), F.lit("ms (with previous cue)")),
    }
    rows = []
    for name, _, cond, _, limit in _checks(limits):
        own = [(v if k in seen[name] else F.lit(None).cast("string" if k == "lines" else "double" if k == "cps" else "bigint")).alias(k) for k, v in values.items()]
        severity = F.lit("minor" if name == "TOO_LONG_DURATION" else "major")
        rows.append(F.when(cond, F.struct(F.lit(name).alias("type"), severity.alias("severity"), *own, F.when(F.lit(name not in ("EMPTY_TEXT", "BAD_TIMECODE_ORDER")), limit.cast("double")).alias("threshold"), said[name].alias("message"))))
    d = _wide(cues).select("media_id", "cue_index", "start_ms", "end_ms", F.explode(F.array_compact(F.array(*rows))).alias("v"))
    return d.select("media_id", "cue_index", "start_ms", "end_ms", "v.*")


def summary(cues: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """media_id, total_cues, violation_count, major_count, minor_count, ok: one row per media item, clean ones included.

    Counts are summed per cue before the shuffle by media item.
    """
    major = sum((F.coalesce(cond, F.lit(False)).cast("bigint") for name, _, cond, _, _ in _checks(_limits(profile)) if name != "TOO_LONG_DURATION"), F.lit(0).cast("bigint"))
    minor = (F.col("dur") > profile.max_dur_ms).cast("bigint")
    d = _wide(cues).select("media_id", major.alias("major"), minor.alias("minor"))
    d = d.groupBy("media_id").agg(F.count("*").alias("total_cues"), F.sum(F.col("major") + F.col("minor")).alias("violation_count"), F.sum("major").alias("major_count"), F.sum("minor").alias("minor_count"))
    return d.withColumn("ok", F.col("major_count") == 0)


def by_type(cues: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """media_id, type, severity, n."""
    return violations(cues, profile).groupBy("media_id", "type", "severity").agg(F.count("*").alias("n"))


def by_profile(cues: DataFrame, profiles: list[Profile]) -> DataFrame:
    """profile, total_cues, violation_count, major_count over all items, for several profiles in one pass (a profile is a set of literals, not a join)."""
    wide = _wide(cues)
    sums = []
    for k, p in enumerate(profiles):
        checks = _checks(_limits(p))
        count = lambda names: sum((F.coalesce(c, F.lit(False)).cast("bigint") for n, _, c, _, _ in checks if n in names), F.lit(0).cast("bigint"))  # noqa: B023, E731
        sums += [F.sum(count(TYPES)).alias(f"v{k}"), F.sum(count([t for t in TYPES if t != "TOO_LONG_DURATION"])).alias(f"m{k}")]
    one = wide.agg(F.count("*").alias("total_cues"), *sums)
    each = F.array(*(F.struct(F.lit(p.name).alias("profile"), F.col("total_cues"), F.col(f"v{k}").alias("violation_count"), F.col(f"m{k}").alias("major_count")) for k, p in enumerate(profiles)))
    return one.select(F.explode(each).alias("x")).select("x.*")


def report(cues: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """media_id, report: the JSON report of an item (counts by type; the rows are in `violations`)."""
    kinds = by_type(cues, profile).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("type", "n"))).alias("by_type"))
    d = summary(cues, profile).join(kinds, "media_id", "left")
    body = F.struct(F.lit("1.1").alias("version"), F.lit(profile.name).alias("profile"), "total_cues", "violation_count", "major_count", "minor_count", "ok", F.coalesce("by_type", F.array().cast("array<struct<type:string,n:bigint>>")).alias("by_type"))
    return d.select("media_id", F.to_json(body).alias("report"))


def fix_overlaps(cues: DataFrame, max_overlap_ms: int = 0) -> DataFrame:
    """media_id, cue_index, start_ms, end_ms, changed: starts moved behind the end of the cue before (as it was); a start at or behind the own end becomes the end less 1."""
    d = with_previous(cues.select("media_id", "cue_index", "start_ms", "end_ms"), "cue_index", ["end_ms"])
    least = F.col("prev_end_ms") - max_overlap_ms
    moved = F.when(F.col("start_ms") < least, F.when(least >= F.col("end_ms"), F.greatest(F.col("end_ms") - 1, F.lit(0).cast("bigint"))).otherwise(least)).otherwise(F.col("start_ms"))
    return d.select("media_id", "cue_index", moved.alias("start_ms"), "end_ms", (moved != F.col("start_ms")).alias("changed"))

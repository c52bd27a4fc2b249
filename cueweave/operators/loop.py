"""The closed loop of checking and fixing, as data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import folds, quality


def check_and_fix(cues: DataFrame, profile: quality.Profile = quality.Profile(), passes: int = 3) -> tuple[DataFrame, DataFrame]:
    """(fixed cues, one row per media item: media_id, cues, ok_before, major_before, ok_after, major_after, changed, passes, stop).

    `passes` is how often the fixers ran; `stop` says why they stopped: ok_before (nothing to do), ok (all rules hold), no_progress (a pass without action), budget.

    `ok` is apart from whether the loop ran: an item that can't be fixed has ok_after false.
    """
    fixed = folds.fix_loop(cues, passes, profile=profile)
    before, after = quality.summary(cues, profile), quality.summary(fixed, profile)
    a = before.select("media_id", F.col("total_cues").alias("cues"), F.col("ok").alias("ok_before"), F.col("major_count").alias("major_before"))
    b = after.select("media_id", F.col("ok").alias("ok_after"), F.col("major_count").alias("major_after"))
    # rows on either side only are changes: one for each changed cue is counted on the fixed side
    row = ["media_id", "start_ms", "end_ms", "text"]
    changed = fixed.select(*row).exceptAll(cues.select(*row)).groupBy("media_id").agg(F.count("*").alias("changed"))
    acted = folds.fix_actions(cues, passes, profile).groupBy("media_id").agg(F.max("pass").alias("acted"))
    report = a.join(b, "media_id", "left").join(changed, "media_id", "left").join(acted, "media_id", "left").withColumn("changed", F.coalesce("changed", F.lit(0)).cast("bigint"))
    # a pass that finds nothing more to do is one too, unless all is well or the budget is spent
    done, spent = F.coalesce("acted", F.lit(0)), F.lit(passes)
    ran = F.when(F.col("ok_before"), 0).when(F.col("ok_after"), done).otherwise(F.least(done + 1, spent)).cast("bigint")
    stop = F.when(F.col("ok_before"), "ok_before").when(F.col("ok_after"), "ok").when(done < spent, "no_progress").otherwise("budget")
    return fixed, report.withColumns({"passes": ran, "stop": stop}).drop("acted")

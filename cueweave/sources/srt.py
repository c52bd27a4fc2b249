"""SRT files: rendering, parsing, reading and writing.

A file is one row of text, which is as large as a subtitle file; media items are many. Malformed timecodes fail in mode
FAILFAST and give null bounds in mode PERMISSIVE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.base import with_number

#: Fixed value: the line of times; what follows them behind a blank is ignored. White space and digits are those of Unicode. Hours may exceed two digits, as in what is rendered.
TIMECODE = r"(?U)^\s*(\d{2,}):(\d{2}):(\d{2}),(\d{3})\s*-->\s*(\d{2,}):(\d{2}):(\d{2}),(\d{3})(?:\s.*)?$"
_INDEX = r"(?U)^[^\S\n]*\d+[^\S\n]*"


def render(cues: DataFrame) -> DataFrame:
    """media_id, number, block of each cue (media_id, cue_index, start_ms, end_ms, text), numbered from 1 by start, end and index; a blank text has no line."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"\n+$", "")
    times = F.concat(X.timecode(F.col("start_ms")), F.lit(" --> "), X.timecode(F.col("end_ms")))
    d = with_number(cues, ["start_ms", "end_ms", "cue_index"], "number").withColumn("number", F.col("number") + 1)
    return d.select("media_id", "number", F.concat(F.col("number").cast("string"), F.lit("\n"), times, F.when(X.strip(body) != "", F.concat(F.lit("\n"), body)).otherwise("")).alias("block"))


def documents(cues: DataFrame) -> DataFrame:
    """media_id, srt: one file text per media item."""
    d = render(cues).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("number", "block"))).alias("b"))
    return d.select("media_id", F.concat(F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"), F.lit("\n")).alias("srt"))


def parse(files: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """media_id, cue_index, start_ms, end_ms, text of file texts (media_id, srt): blocks between empty lines, without their line of an index.

    A block with nothing but an index is none; lines of white space at the end of a text are no part of it.
    """
    text = F.regexp_replace(F.regexp_replace(F.col("srt"), "^﻿+", ""), "\r\n?", "\n")
    blocks = files.select("media_id", F.posexplode(F.filter(F.split(text, "\n\n"), lambda b: (X.strip(b) != "") & ~b.rlike(_INDEX + r"\z"))).alias("k", "block"))
    rest = F.regexp_replace("block", _INDEX + r"\n", "")
    head, body = F.substring_index(rest, "\n", 1), F.when(rest.contains("\n"), F.regexp_replace(rest, r"^[^\n]*\n", "")).otherwise("")
    part = lambda i: F.regexp_extract(head, TIMECODE, i).try_cast("bigint")
    # hours beyond what a bigint of milliseconds holds are malformed, no error of arithmetic
    hours = lambda i: F.try_multiply(part(i), F.lit(3_600_000))
    ms = lambda i: F.try_add(hours(i), (part(i + 1) * 60 + part(i + 2)) * 1000 + part(i + 3))
    d = blocks.select("media_id", F.col("k").cast("bigint").alias("cue_index"), ms(1).alias("start_ms"), ms(5).alias("end_ms"), F.regexp_replace(F.regexp_replace(body, r"(?U)(?:(?:^|\n)[^\S\n]*)+\z", ""), r"^\n+", "").alias("text"), head.alias("head"))
    bad = F.col("start_ms").isNull() | F.col("end_ms").isNull() | (F.col("end_ms") < F.col("start_ms"))
    if mode == "FAILFAST":
        d = d.withColumn("start_ms", F.when(bad, F.raise_error(F.concat(F.lit("invalid timecode: "), "head"))).otherwise(F.col("start_ms")))
    return d.drop("head")


def transcript_srt(segments: DataFrame) -> DataFrame:
    """media_id, srt: the text of transcripts in list order (seg_idx), numbered from 1; texts without white space at their ends, a blank one as one space, an empty line behind each."""
    text = X.strip(F.coalesce("text", F.lit("")))
    times = F.concat(X.timecode(F.col("start_ms")), F.lit(" --> "), X.timecode(F.col("end_ms")))
    row = F.struct("seg_idx", F.concat(times, F.lit("\n"), F.when(text == "", F.lit(" ")).otherwise(text), F.lit("\n")).alias("block"))
    d = segments.groupBy("media_id").agg(F.array_sort(F.collect_list(row)).alias("b"))
    return d.select("media_id", F.array_join(F.transform("b", lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["block"])), "\n").alias("srt"))


def read_srt(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Cues of SRT files; media_id is the file's path. Bytes that are no UTF-8 become replacement marks."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("media_id"), F.col("value").alias("srt"))
    return parse(raw, mode)


def write_srt(cues: DataFrame, folder: str) -> None:
    """One folder per media item with one text file in it."""
    # the writer ends each text with one line break
    documents(cues).withColumn("srt", F.regexp_replace("srt", "\n$", "")).write.mode("overwrite").partitionBy("media_id").text(folder)


def bilingual(source: DataFrame, target: DataFrame) -> DataFrame:
    """media_id, cue_index, start_ms, end_ms, text: pairs by index; times are the source's, unpaired rows are left out."""
    s = source.select("media_id", "cue_index", "start_ms", "end_ms", F.col("text").alias("s"))
    t = target.select("media_id", "cue_index", F.col("text").alias("t"))
    return s.join(t, ["media_id", "cue_index"]).select("media_id", "cue_index", "start_ms", "end_ms", F.concat("s", F.lit("\n"), "t").alias("text"))

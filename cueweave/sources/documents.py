"""JSON documents: transcripts, glossaries, job directories, reports, and audio headers."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSCRIPT = "language string, segments array<struct<start:double,end:double,text:string,confidence:double>>, words array<struct<start:double,end:double,word:string>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """media_id (the file's path), language, segments, words of transcript files; one JSON document per file."""
    return spark.read.schema(TRANSCRIPT).json(path, multiLine=True).withColumn("media_id", F.col("_metadata.file_path"))


def segments_of(transcripts: DataFrame) -> DataFrame:
    """media_id, seg_idx, start_ms, end_ms, text, confidence in list order; times are rounded half to even, as the exporters round."""
    ms = lambda c: F.bround(F.col(c) * 1000).cast("bigint")
    d = transcripts.select("media_id", F.posexplode("segments").alias("seg_idx", "s"))
    return d.select("media_id", F.col("seg_idx").cast("bigint"), ms("s.start").alias("start_ms"), ms("s.end").alias("end_ms"), F.coalesce("s.text", F.lit("")).alias("text"), F.col("s.confidence").alias("confidence"))


def words_of(transcripts: DataFrame) -> DataFrame:
    """media_id, word_idx, start_ms, end_ms, word in order of time; blank words are left out."""
    from ..operators.base import with_number

    ms = lambda c: F.bround(F.col(c) * 1000).cast("bigint")
    d = transcripts.select("media_id", F.posexplode("words").alias("k", "w")).where("trim(w.word) <> ''")
    d = with_number(d.select("media_id", "k", "w.*"), ["start", "end", "k"], "word_idx", 3600)  # an hour, in seconds
    return d.select("media_id", "word_idx", ms("start").alias("start_ms"), ms("end").alias("end_ms"), "word")


def write_transcripts(segments: DataFrame, folder: str, language: str = "unknown") -> None:
    """One JSON document per media item."""
    own = F.struct((F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "text", "confidence")
    d = segments.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", own.alias("s")))).alias("x"))
    body = F.to_json(F.struct(F.lit(language).alias("language"), F.transform("x", lambda r: r["s"]).alias("segments")))
    d.select("media_id", body.alias("value")).write.mode("overwrite").partitionBy("media_id").text(folder)


def read_glossary(path: str) -> list[tuple[str, str]]:
    """Ordered terms of a JSON object. A glossary is a small file that a person writes; order counts when terms are applied."""
    with open(path, encoding="utf-8") as f:
        return [(str(k), str(v)) for k, v in json.load(f).items()]


def read_job_documents(spark: SparkSession, root: str, name: str = "spec") -> DataFrame:
    """job_dir, payload: the raw documents <root>/<job>/<name>.json, forward compatible as text."""
    d = spark.read.text(f"{root}/*/{name}.json", wholetext=True)
    return d.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("job_dir"), F.col("value").alias("payload"))


def job_directories(spark: SparkSession, root: str) -> DataFrame:
    """job_dir, has_spec, has_status, has_result of the folders of a job store that have any of the three; only names are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "{spec,status,result}.json").option("recursiveFileLookup", "true").load(root).select("path")
    part = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)\.json$", i)
    d = files.select(part(1).alias("job_dir"), part(2).alias("name")).groupBy("job_dir")
    return d.agg(*(F.bool_or(F.col("name") == n).alias(f"has_{n}") for n in ("spec", "status", "result")))


def _json(path: str) -> Column:
    return F.get_json_object("payload", f"$.{path}")


def job_specs(documents: DataFrame) -> DataFrame:
    """file_id, line_no, job_id, kind, job_root, timeout_sec, valid of JobSpec documents (payload): known fields wherever they are, kinds by value or enum name, timeouts with their default."""
    from ..operators.jobs import job_kind, positive_timeout

    valid = F.coalesce(F.schema_of_json(F.lit("{}")).isNotNull() & F.try_parse_json("payload").isNotNull() & F.trim("payload").startswith("{"), F.lit(False))
    d = documents.where("payload is not null")
    pick = lambda c: F.when(valid, c)
    return d.select("file_id", "line_no", pick(_json("job_id")).alias("job_id"), pick(job_kind(_json("kind"))).alias("kind"), pick(_json("job_root")).alias("job_root"), pick(positive_timeout(_json("inputs.pipeline_args.timeout_sec"))).alias("timeout_sec"), valid.alias("valid"))


def quality_counts(documents: DataFrame) -> DataFrame:
    """file_id, line_no, total_cues, violation_count, major_count, minor_count of QualityReport documents; 0 stays 0, what is missing or no number is null."""
    number = lambda c: _json(f"summary.{c}").try_cast("bigint").alias(c)
    return documents.where("payload is not null").select("file_id", "line_no", *(number(c) for c in ("total_cues", "violation_count", "major_count", "minor_count")))


def primary_srt(primary: Column, paths: Column, outputs: Column) -> Column:
    """The SRT that a result points to: the primary path, else the first listed, else the first output that is one."""
    return F.coalesce(F.when(primary != "", primary), F.get(paths, 0), F.get(F.filter(F.map_values(outputs), lambda p: p.endswith(".srt")), 0))


def wav_duration_ms(files: DataFrame) -> DataFrame:
    """path, duration_ms of binary files (path, content): from the chunk headers, wherever `data` is; null for what is no WAV.

    The first 4 KB of a file go to Python; the whole of it only where these are RIFF and end before the header of `data`.
    """

    @F.pandas_udf("bigint")
    def duration(content: pd.Series) -> pd.Series:
        return pd.Series([_wav_ms(c) for c in content], dtype="Int64")

    head = F.expr("substring(content, 1, 4096)")
    more = F.col("duration_ms").isNull() & (F.length("content") > 4096) & F.expr("substring(content, 1, 4) = X'52494646'")
    d = files.select("path", "content", duration(head).alias("duration_ms"))
    return d.select("path", F.coalesce("duration_ms", duration(F.when(more, F.col("content")))).alias("duration_ms"))


def _wav_ms(head: bytes | None) -> int | None:
    if not head or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, rate, block = 12, 0, 0
    while at + 8 <= len(head):
        name, size = head[at : at + 4], struct.unpack("<I", head[at + 4 : at + 8])[0]
        if name == b"fmt " and at + 22 <= len(head):
            rate, block = struct.unpack("<I", head[at + 12 : at + 16])[0], struct.unpack("<H", head[at + 20 : at + 22])[0]
        if name == b"data":
            return round(size / block / rate * 1000) if rate and block else None
        at += 8 + size + size % 2
    return None

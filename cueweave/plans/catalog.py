"""Queries of the core, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.runtime import read_table
from ..operators import folds, interval_runs, jobs, loop, nearest, quality, schema_drift
from ..operators import words as W
from ..operators.base import clean_cues, clean_segments, words_of
from ..sources import documents, srt


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.schema_changes(read_table(spark, d, "raw_job_docs")).select("file_id", "change_kind", "old_path", "new_path")


def p1_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.field_alternatives(read_table(spark, d, "raw_job_docs"))


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.unified_table(read_table(spark, d, "raw_job_docs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return interval_runs.run_intervals(interval_runs.cue_and_segment_intervals(read_table(spark, d, "cues"), read_table(spark, d, "segments")))



def _cues(spark: SparkSession, d: str) -> DataFrame:
    return clean_cues(read_table(spark, d, "cues"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return clean_segments(read_table(spark, d, "segments"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    return words_of(_segments(spark, d))


PROFILES = [quality.Profile(), quality.Profile("loose", 22.0, 42, 2, 700, 8000, 50), quality.Profile("strict", 12.0, 16, 1, 1200, 6000, 0)]
GLOSSARY = [("studio", "atelier"), ("atelier near", "atelier by"), ("camera", "camera unit"), ("OpenAI", "OpenAI"), ("Tokyo", "东京")]
ZH_TERMS = ["话筒", "胶片", "studio", "", "studio"]
ROUTES = ["all", "literal", "zh-only", "bilingual-only", "bilingual", "none", "other"]


def cue_metrics(spark: SparkSession, d: str) -> DataFrame:
    return quality.cue_metrics(_cues(spark, d))


def pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    return quality.pair_metrics(_cues(spark, d))


def bad_timecode_order(spark: SparkSession, d: str) -> DataFrame:
    return quality.bad_timecode_order(_cues(spark, d))


def violations(spark: SparkSession, d: str) -> DataFrame:
    return quality.violations(_cues(spark, d))


def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.summary(_cues(spark, d))


def violations_by_type(spark: SparkSession, d: str) -> DataFrame:
    return quality.by_type(_cues(spark, d))


def quality_by_profile(spark: SparkSession, d: str) -> DataFrame:
    return quality.by_profile(_cues(spark, d), PROFILES)


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.report(_cues(spark, d))


def fix_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return quality.fix_overlaps(_cues(spark, d))


def fix_cps(spark: SparkSession, d: str) -> DataFrame:
    return folds.fix_cps(_cues(spark, d))


def fix_duration(spark: SparkSession, d: str) -> DataFrame:
    return folds.fix_duration(_cues(spark, d))


def fix_loop_final(spark: SparkSession, d: str) -> DataFrame:
    return folds.fix_loop(_cues(spark, d))


def fix_loop_times(spark: SparkSession, d: str) -> DataFrame:
    return folds.fix_loop(_cues(spark, d), texts=False).drop("text")


def fix_loop_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.summary(folds.fix_loop(_cues(spark, d)))


def fix_loop_report(spark: SparkSession, d: str) -> DataFrame:
    return loop.check_and_fix(_cues(spark, d))[1]


def fix_actions(spark: SparkSession, d: str) -> DataFrame:
    return folds.fix_actions(_cues(spark, d))


def subtitle_fixes(spark: SparkSession, d: str) -> DataFrame:
    return folds.subtitle_fixes(_cues(spark, d), min_ms=900, max_cps=16.0)


def violation_details(spark: SparkSession, d: str) -> DataFrame:
    return quality.violation_details(_cues(spark, d)).drop("message")


def transcript_srt(spark: SparkSession, d: str) -> DataFrame:
    return srt.transcript_srt(_segments(spark, d))


def range_words(spark: SparkSession, d: str) -> DataFrame:
    """The words of every segment, heard as if cut out with a second before and a second and a half behind, moved back and cut to the segment."""
    bounds = _segments(spark, d).select("media_id", "seg_idx", F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1"))
    cut = F.greatest(F.col("s0") - 1000, F.lit(0))
    heard = W.shift_words(_words(spark, d).join(bounds, ["media_id", "seg_idx"]), -cut)
    return W.clamp_words(W.shift_words(heard, cut + 250), F.col("s0"), F.col("s1")).select("media_id", "seg_idx", "word_idx", "start_ms", "end_ms", "word")


def _replay(source: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
    """A deterministic listener: it hears a word in every half second of the range."""
    return [(a, a + 400, f" w{a // 500}") for a in range(-(-lo // 500) * 500, hi - 400, 500)]


def repair_replayed(spark: SparkSession, d: str) -> DataFrame:
    return folds.repair(_segments(spark, d), _replay)


def wrap_lines(spark: SparkSession, d: str) -> DataFrame:
    return folds.wrap_lines(_cues(spark, d))


def wrap_two_lines(spark: SparkSession, d: str) -> DataFrame:
    return folds.wrap_two_lines(_cues(spark, d))


def timecode_format(spark: SparkSession, d: str) -> DataFrame:
    return _cues(spark, d).select("media_id", "cue_index", X.timecode(F.col("start_ms")).alias("start_tc"), X.timecode(F.col("end_ms")).alias("end_tc"))


def srt_render(spark: SparkSession, d: str) -> DataFrame:
    return srt.render(_cues(spark, d))


def srt_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return srt.parse(srt.documents(_cues(spark, d)))


def bilingual_zip(spark: SparkSession, d: str) -> DataFrame:
    seg = _segments(spark, d).select("media_id", F.col("seg_idx").alias("cue_index"), "text")
    return srt.bilingual(_cues(spark, d), seg)


def words_from_text(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d)


def pause_and_mark_flags(spark: SparkSession, d: str) -> DataFrame:
    return W.pause_flags(_words(spark, d))


def rule_segments(spark: SparkSession, d: str) -> DataFrame:
    return folds.rule_segments(_words(spark, d))


def greedy_units(spark: SparkSession, d: str) -> DataFrame:
    return folds.greedy_units(_words(spark, d))


def _marked(c: Column) -> Column:
    return X.strip(c).rlike(r"[.!?]$")


def window_segments(spark: SparkSession, d: str) -> DataFrame:
    return folds.window_segments(_words(spark, d))


def wrap_zh(spark: SparkSession, d: str) -> DataFrame:
    return folds.wrap_zh(_segments(spark, d))


def segments_from_cuts(spark: SparkSession, d: str) -> DataFrame:
    return W.segments_from_cuts(_words(spark, d), _marked(F.col("word")))


def time_overlap_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return folds.one_of_each(_segments(spark, d))


def no_overlap_clamp(spark: SparkSession, d: str) -> DataFrame:
    return folds.no_overlap(_segments(spark, d))


def words_in_segments(spark: SparkSession, d: str) -> DataFrame:
    return W.words_in_segments(_words(spark, d), _segments(spark, d))


def _cues_as_segments(spark: SparkSession, d: str) -> DataFrame:
    return _cues(spark, d).withColumnRenamed("cue_index", "seg_idx")


def segment_word_coverage(spark: SparkSession, d: str) -> DataFrame:
    return W.word_coverage(_words(spark, d), _cues_as_segments(spark, d))


def coverage_holes(spark: SparkSession, d: str) -> DataFrame:
    return W.coverage_holes(_words(spark, d), _cues_as_segments(spark, d))


def clip_to_range(spark: SparkSession, d: str) -> DataFrame:
    return W.clip(_segments(spark, d).select("media_id", "seg_idx", "start_ms", "end_ms"), F.lit(20_000), F.lit(90_000))


def word_reliability(spark: SparkSession, d: str) -> DataFrame:
    return W.word_reliability(_words(spark, d))


def punct_split(spark: SparkSession, d: str) -> DataFrame:
    return W.punct_split(_words(spark, d), _segments(spark, d))


def coalesce(spark: SparkSession, d: str) -> DataFrame:
    return folds.coalesce(_segments(spark, d))


def coalesce_absorb(spark: SparkSession, d: str) -> DataFrame:
    return folds.absorb(_segments(spark, d))


def alloc_times(spark: SparkSession, d: str) -> DataFrame:
    return W.share_time(_segments(spark, d))


def dedupe_full(spark: SparkSession, d: str) -> DataFrame:
    return folds.near_duplicates(_segments(spark, d))


def postprocess(spark: SparkSession, d: str) -> DataFrame:
    return folds.postprocess(_words(spark, d), _segments(spark, d))


def repair_candidates(spark: SparkSession, d: str) -> DataFrame:
    return W.repair_candidates(_segments(spark, d))


def repair_flags(spark: SparkSession, d: str) -> DataFrame:
    dur = F.col("end_ms") - F.col("start_ms")
    return _segments(spark, d).select("media_id", "seg_idx", W.low_info(F.col("text"), dur).alias("low_info"), W.suspect(F.col("text"), dur).alias("suspect"), W.stuck(F.col("text")).alias("stuck"))


def range_replace(spark: SparkSession, d: str) -> DataFrame:
    return W.range_replace(_segments(spark, d), _cues_as_segments(spark, d), 30_000, 60_000)


def risk_flags(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _segments(spark, d).select("media_id", "seg_idx", X.number_count(t).alias("numbers"), X.glossary_hits(t, ZH_TERMS).alias("hits"), X.mt_stiff(X.strip(t)).alias("stiff"), X.high_risk(t, F.col("confidence"), ZH_TERMS).alias("high_risk"))


def glossary_apply(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.md5(X.apply_glossary(F.col("text"), GLOSSARY)).alias("text_md5"))


def normalized_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _segments(spark, d).select("media_id", "seg_idx", X.normalize_repair(t).alias("repair_form"), X.normalize_zh(t).alias("zh_form"), X.word_count(t).alias("words"), X.letter_count(t).alias("letters"), X.looks_cjk(t).alias("cjk"))


def zh_sentence_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("media_id", "seg_idx", F.posexplode(X.sentence_pieces(F.col("text"))).alias("piece", "text")).withColumn("piece", F.col("piece").cast("bigint"))


def zh_layout_split(spark: SparkSession, d: str) -> DataFrame:
    return folds.layout_zh(_segments(spark, d))


def zh_naturalize(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("media_id", "seg_idx", X.naturalize_zh(F.col("text")).alias("text"))


def translate_context(spark: SparkSession, d: str) -> DataFrame:
    return W.translate_context(_segments(spark, d))


def segment_stats(spark: SparkSession, d: str) -> DataFrame:
    return W.segment_stats(_segments(spark, d))


def translator_routes(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", jobs.translator_route(F.col("lang")).alias("translator"), jobs.language_code(F.col("lang")).alias("code"))


def kb_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = read_table(spark, d, "embeddings")
    first = vectors.agg(F.min_by("embedding", "vec_id")).first()[0]
    found = nearest.nearest_to_one(vectors, first or [])
    return found.withColumn("score", F.round("score", 6))


def kb_topk_all(spark: SparkSession, d: str) -> DataFrame:
    return nearest.nearest_to_each(read_table(spark, d, "embeddings")).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def asr_cache_key(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "media").select("media_id", jobs.asr_cache_key(F.sha1("source_path"), F.lit("small"), F.coalesce("lang", F.lit("auto")), preprocess=F.col("channel_code"), beam_size=F.length("media_id"), vad=F.col("duration_ms") > 600_000).alias("cache_key"))


def audio_commands(spark: SparkSession, d: str) -> DataFrame:
    mode = F.element_at(F.array(*(F.lit(m) for m in jobs.AUDIO_MODES)), (F.pmod(F.length("source_path"), F.lit(3)) + 1).cast("int"))
    steps = F.posexplode(jobs.audio_steps(F.col("source_path"), mode, F.lit("/work"))).alias("number", "s")
    return read_table(spark, d, "media").where("source_path is not null").select("media_id", steps).select("media_id", F.col("number").cast("bigint").alias("number"), "s.step", F.array_join("s.args", " ").alias("args"))


def job_latest(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latest_states(read_table(spark, d, "job_status"))


def job_status_reconcile(spark: SparkSession, d: str) -> DataFrame:
    snap = read_table(spark, d, "job_status")
    disk = jobs.latest_states(snap.where("worker_id is not null")).select("job_id", "job_state")
    stage = F.when(F.col("finished_at").isNotNull(), "finished").when(F.col("started_at").isNotNull(), "started").otherwise("queued")
    queue = snap.where("enqueued_at is not null and job_id is not null").groupBy("job_id").agg(F.max(stage).alias("queue_state"))
    return jobs.reconcile(disk, queue)


def job_transitions(spark: SparkSession, d: str) -> DataFrame:
    return jobs.transitions(read_table(spark, d, "job_status"))


def job_specs(spark: SparkSession, d: str) -> DataFrame:
    return documents.job_specs(read_table(spark, d, "raw_job_docs").where("doc_type = 'job_spec'").select("file_id", "line_no", "payload"))


def quality_counts(spark: SparkSession, d: str) -> DataFrame:
    return documents.quality_counts(read_table(spark, d, "raw_job_docs").where("doc_type = 'quality_report'").select("file_id", "line_no", "payload"))


def path_policy(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("source_path")
    return read_table(spark, d, "media").select("media_id", jobs.path_allowed(path, ["/data/media"]).alias("allowed"), jobs.path_allowed(F.replace(path, F.lit("/main"), F.lit("/../main")), ["/data"]).alias("tricked"))


def counters_prometheus(spark: SparkSession, d: str) -> DataFrame:
    counted = jobs.counters(read_table(spark, d, "job_status"), F.lit("jobs_total"), {"state": F.col("job_state"), "kind": jobs.job_kind(F.col("job_kind"))})
    return jobs.prometheus_lines(counted)


def device_decisions(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, dev, ct, gpu) for i, (dev, ct, gpu) in enumerate((a, b, g) for a in (" CuDa:0 ", "cpu", "auto", None) for b in (" FP16 ", "float16", "int8", None) for g in (True, False))]
    t = spark.createDataFrame(rows, "id int, device string, compute string, gpu boolean")
    dev, ct = jobs.device_decision(F.col("device"), F.col("compute"), F.col("gpu"))
    return t.select(F.col("id").cast("bigint").alias("id"), dev.alias("device"), ct.alias("compute"))


def newest_candidate(spark: SparkSession, d: str) -> DataFrame:
    return jobs.newest_by(read_table(spark, d, "media").where("channel_code is not null"), ["channel_code"], ["created_at", "media_id"], ["source_path"])


def path_helpers(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.col("source_path"), F.lit(".fixed.fixed.srt"))
    return read_table(spark, d, "media").select("media_id", jobs.stable_stem(path).alias("stem"), jobs.burn_filter_escape(F.concat(F.lit("C:"), F.col("source_path"))).alias("escaped"), jobs.positive_timeout(F.regexp_extract("media_id", r"(\d\d)$", 1)).alias("timeout"))


def emit_routing(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(x,) for x in ROUTES], "mode string")
    primary, written = jobs.emit_route(F.col("mode"))
    return t.select("mode", primary.alias("primary_output"), F.array_join(written, ",").alias("outputs"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_alternatives, p1_table, p3_found, cue_metrics, pair_metrics, bad_timecode_order, violations, quality_summary, violations_by_type, quality_by_profile, quality_report, fix_overlaps, fix_cps, fix_duration,
        fix_loop_final, fix_loop_times, fix_loop_summary, fix_loop_report, fix_actions, subtitle_fixes, violation_details, transcript_srt, range_words, repair_replayed, wrap_lines, wrap_two_lines, timecode_format, srt_render, srt_roundtrip, bilingual_zip, words_from_text, pause_and_mark_flags, rule_segments, window_segments, greedy_units, segments_from_cuts, time_overlap_dedupe,
        no_overlap_clamp, words_in_segments, segment_word_coverage, coverage_holes, clip_to_range, word_reliability, punct_split, coalesce, coalesce_absorb, alloc_times, dedupe_full, postprocess, repair_candidates, repair_flags, range_replace, risk_flags, glossary_apply,
        normalized_texts, zh_sentence_pieces, zh_layout_split, wrap_zh, zh_naturalize, translate_context, segment_stats, translator_routes, kb_topk, kb_topk_all, asr_cache_key, audio_commands, job_latest, job_status_reconcile, job_transitions, job_specs, quality_counts, path_policy, counters_prometheus, device_decisions,
        newest_candidate, path_helpers, emit_routing,
    )
}

from .oracles import ORACLES  # noqa: E402, F401

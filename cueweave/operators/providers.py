"""External models behind small interfaces, with deterministic stand-ins, and the pipeline that composes the operators.

A provider is called once per batch of rows in a Python worker (a per-worker instance, made lazily). Results of real
models should be written to a table keyed by the cache key before they are used, so that retries never call twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.runtime import cut_lineage
from . import folds, quality
from .base import BUCKET, with_number
from .words import translate_context


class Recogniser(Protocol):
    """Speech to words: one call per media path."""

    def words(self, path: str) -> Iterator[tuple[int, int, str]]:
        """(start_ms, end_ms, word) in order."""
        ...


class Translator(Protocol):
    """Texts to texts, with the context before and after each."""

    def translate(self, texts: Sequence[str], before: Sequence[str], after: Sequence[str]) -> Sequence[str]: ...


class Preprocessor(Protocol):
    """Audio to audio; returns the path to go on with."""

    def run(self, path: str) -> str: ...


class SilentRecogniser:
    """Stand-in: hears nothing."""

    def words(self, path: str) -> Iterator[tuple[int, int, str]]:
        return iter(())


class EchoTranslator:
    """Stand-in: returns the texts."""

    def translate(self, texts: Sequence[str], before: Sequence[str], after: Sequence[str]) -> Sequence[str]:
        return list(texts)


class KeepAudio:
    """Stand-in: the audio as it is."""

    def run(self, path: str) -> str:
        return path


PREPROCESSORS: dict[str, Callable[[], Preprocessor]] = {"none": KeepAudio, "noop": KeepAudio}


def preprocessor(name: str | None) -> Preprocessor:
    """By name; unknown and falsy names mean none."""
    key = (name or "").strip().lower()
    return PREPROCESSORS.get("none" if key in ("", "0", "false", "no", "off") else key, KeepAudio)()


def recognise(media: DataFrame, make: Callable[[], Recogniser] = SilentRecogniser, prepare: str = "none") -> DataFrame:
    """media_id, word_idx, start_ms, end_ms, word of media (media_id, source_path); words are streamed, not collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ears, audio = make(), preprocessor(prepare)
        for batch in batches:
            for m, path in zip(batch.column("media_id").to_pylist(), batch.column("source_path").to_pylist()):
                rows = [(m, i, *w) for i, w in enumerate(ears.words(audio.run(path)))] if path else []
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array(columns[4], pa.string())], names=["media_id", "word_idx", "start_ms", "end_ms", "word"])

    return media.select("media_id", "source_path").mapInArrow(run, "media_id string, word_idx bigint, start_ms bigint, end_ms bigint, word string")


def translate(segments: DataFrame, make: Callable[[], Translator] = EchoTranslator, k: int = 2, keep_blank: bool = False) -> DataFrame:
    """Segments with translated texts; blank ones are dropped unless keep_blank, as the translators drop them."""
    whole = segments.join(translate_context(segments, k), ["media_id", "seg_idx"])
    whole = whole if keep_blank else whole.where(~X.is_blank(F.col("text")))
    d = whole.select("media_id", "seg_idx", "start_ms", "end_ms", "text", "confidence", "before", "after")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tongue = make()
        for batch in batches:
            texts = tongue.translate(*(batch.column(c).to_pylist() for c in ("text", "before", "after")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("media_id", "seg_idx", "start_ms", "end_ms")), pa.array(list(texts), pa.string()), batch.column("confidence")], names=["media_id", "seg_idx", "start_ms", "end_ms", "text", "confidence"])

    return d.mapInArrow(run, "media_id string, seg_idx bigint, start_ms bigint, end_ms bigint, text string, confidence double")


def rewrite_smart(segments: DataFrame, targets: Sequence[str] = (), rewrite: Callable[[str], str] | None = None) -> DataFrame:
    """media_id, seg_idx, text, high_risk: low-risk texts are cleaned by rule, high-risk ones by `rewrite`, whose empty, failed or overlong results give way."""
    t = F.col("text")
    d = segments.select("media_id", "seg_idx", "text", X.naturalize_zh(t).alias("rule"), X.high_risk(t, F.col("confidence"), targets).alias("high_risk"))
    if rewrite is None:
        return d.select("media_id", "seg_idx", F.col("rule").alias("text"), "high_risk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, rule, risky in zip(*(batch.column(c).to_pylist() for c in ("text", "rule", "high_risk"))):
                new = rule
                if risky and text:
                    try:
                        made = rewrite(text)
                        new = rule if len(made) > max(90, 2 * len(text)) else made or text
                    except Exception:  # noqa: BLE001 - a provider's failure keeps the rule's text
                        new = rule
                out.append(new)
            yield pa.RecordBatch.from_arrays([batch.column("media_id"), batch.column("seg_idx"), pa.array(out, pa.string()), batch.column("high_risk")], names=["media_id", "seg_idx", "text", "high_risk"])

    return d.mapInArrow(run, "media_id string, seg_idx bigint, text string, high_risk boolean")


@dataclass(frozen=True)
class PipelineConfig:
    """What a run does; the defaults are those of the reference's pipeline, in milliseconds."""

    soft_ms: int = 7000
    hard_ms: int = 15_000
    glossary: tuple[tuple[str, str], ...] = ()
    target: str = "zh"
    zh_width: int = 18
    zh_lines: int = 2
    profile: quality.Profile = field(default_factory=quality.Profile)
    passes: int = 3


def run_pipeline(words: DataFrame, config: PipelineConfig = PipelineConfig(), translator: Callable[[], Translator] = EchoTranslator) -> dict[str, DataFrame]:
    """words to segments, translations, cues, fixed cues and a summary. What a fold has made is kept in the shared folder, so that nothing runs twice however many of the results are used; the rest is lazy."""
    segments = folds.rule_segments(words, soft=config.soft_ms, hard=config.hard_ms).select("media_id", F.col("seg_no").alias("seg_idx"), "start_ms", "end_ms", "text", F.lit(None).cast("double").alias("confidence"))
    merged = cut_lineage(folds.coalesce(cut_lineage(segments)))
    translated = translate(merged, translator).withColumn("text", X.apply_glossary(F.col("text"), config.glossary))
    if config.target.startswith("zh"):
        laid = with_number(folds.layout_zh(translated, config.zh_width, config.zh_lines), ["seg_idx", "part"], "cue_index", BUCKET).select("media_id", "cue_index", "start_ms", "end_ms", "text")
    else:
        laid = translated.select("media_id", F.col("seg_idx").alias("cue_index"), "start_ms", "end_ms", "text")
    laid = cut_lineage(laid)
    fixed = folds.fix_loop(laid, config.passes, profile=config.profile)
    return {"segments": merged, "translated": translated, "cues": laid, "fixed": fixed, "summary": quality.summary(fixed, config.profile)}

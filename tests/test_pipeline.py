"""Providers, the composed pipeline, streams and the driver's contract."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cueweave.operators import providers as P
from cueweave.operators.base import clean_segments, words_of
from cueweave.streaming.jobs import state_counts


class Shout:
    def translate(self, texts, before, after):
        return [t.upper() for t in texts]


class TwoWords:
    def words(self, path):
        yield 0, 500, "hello"
        yield 500, 900, " world"


def test_pipeline(spark, sf):
    w = words_of(clean_segments(spark.read.parquet(f"{sf}/segments.parquet")))
    out = P.run_pipeline(w, P.PipelineConfig(glossary=(("LAMP", "Lampe"),)), Shout)
    cues = out["fixed"].toPandas()
    assert len(cues) and (cues.end_ms > cues.start_ms).all()
    summary = out["summary"].toPandas()
    assert set(summary.media_id) == set(cues.media_id)


def test_pipeline_numbers_every_part(spark):
    class Long:
        def translate(self, texts, before, after):
            return ["他们今天都在这里等着看。" * 2500 for _ in texts]

    w = spark.createDataFrame([("m", i, i * 3_000_000, (i + 1) * 3_000_000, f" word{i}.") for i in range(2)], "media_id string, word_idx bigint, start_ms bigint, end_ms bigint, word string")
    cues = P.run_pipeline(w, P.PipelineConfig(), Long)["cues"].orderBy("start_ms", "cue_index").collect()
    assert len(cues) > 1000
    assert [c.cue_index for c in cues] == list(range(len(cues)))


def test_postprocess_numbers_every_piece(spark, monkeypatch):
    from cueweave.operators import folds

    pieces = spark.createDataFrame([("m", i // 1500, i % 1500, i * 5000, i * 5000 + 4000, f"sentence number {i} of a long list") for i in range(1600)], "media_id string, seg_idx bigint, piece bigint, start_ms bigint, end_ms bigint, text string")
    monkeypatch.setattr(folds, "punct_split", lambda words, segments: pieces)
    monkeypatch.setattr(folds, "coalesce", lambda ranked: ranked)
    assert [r.seg_idx for r in folds.postprocess(None, None).orderBy("start_ms").collect()] == list(range(1600))


def test_providers(spark):
    media = spark.createDataFrame([("m", "/a.mp4"), ("n", None)], "media_id string, source_path string")
    assert [tuple(r) for r in P.recognise(media, TwoWords).collect()] == [("m", 0, 0, 500, "hello"), ("m", 1, 500, 900, " world")]
    assert P.recognise(media).collect() == []
    assert isinstance(P.preprocessor("unknown"), P.KeepAudio) and isinstance(P.preprocessor(None), P.KeepAudio)
    segs = spark.createDataFrame([("m", 0, 0, 1, "a", None), ("m", 1, 1, 2, " ", None), ("m", 2, 2, 3, "b", 0.1)], "media_id string, seg_idx bigint, start_ms bigint, end_ms bigint, text string, confidence double")
    assert sorted(r.text for r in P.translate(segs, Shout).collect()) == ["A", "B"]
    assert P.translate(segs, Shout, keep_blank=True).count() == 3

    def broken(text):
        raise ValueError

    assert {r.seg_idx: (r.text, r.high_risk) for r in P.rewrite_smart(segs, ["b"], broken).collect()}[2] == ("b", True)
    assert {r.seg_idx: r.text for r in P.rewrite_smart(segs, ["b"], lambda t: "").collect()}[2] == "b"


def test_stream_of_states(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/job_status.parquet")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/job_status.parquet*")
    q = state_counts(stream, late="9000 days").writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    want = src.where("updated_at is not null").select("job_id", "job_state", "attempt").distinct().count()
    assert spark.sql("select sum(n) from states").first()[0] == want


def test_contract(spark, sf):
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60
    assert __spark_entry__.entry(spark).count() > 0


def test_small_queries_have_rows(spark, sf):
    q = __spark_entry__.queries()
    for name in ("device_decisions", "emit_routing", "path_helpers", "quality_report", "postprocess", "zh_naturalize", "repair_flags"):
        assert q[name](spark, sf).select(F.lit(1)).count() > 0


def test_sql_functions(spark):
    from cueweave.functions.sql import register

    names = register(spark)
    assert "cw_zh_layout" in names
    row = spark.sql("select cw_reading_chars(' a b '), cw_dedupe_form('Ａb, c'), cw_repair_form('A - b!'), cw_text_similarity('abcd', 'abcx'), cw_timecode(3723004), cw_overlap_ms(0, 10, 5, 20), cw_strip(' x '), cw_reading_chars(null)").first()
    assert tuple(row) == (2, "abc", "a-b", 0.75, "01:02:03,004", 5, "x", None)
    got = spark.sql("select t.text from (values (0L, 9000L, '第一句很长很长很长很长很长很长很长很长很长。第二句！')) v(a, b, c), lateral cw_zh_layout(a, b, c) t").collect()
    assert len(got) == 2


def test_closed_loop(spark, sf):
    from cueweave.operators import folds, loop
    from cueweave.operators.base import clean_cues

    cues = clean_cues(spark.read.parquet(f"{sf}/cues.parquet"))
    fixed, report = loop.check_and_fix(cues)
    r = report.toPandas()
    assert (r.major_after <= r.major_before).all() and (r.changed > 0).any()
    assert ((r.passes == 0) == r.ok_before).all() and (r.stop == "ok").eq(r.ok_after & ~r.ok_before).all() and (r.passes <= 3).all()
    # the actions of a cue, in their order, lead from what it was to what it is
    actions = folds.fix_actions(cues).toPandas().sort_values(["media_id", "cue_index", "pass", "step", "name"], ascending=[True, True, True, True, False])
    last = {(a.media_id, a.cue_index): a for a in actions[actions.name == "wrap_lines"].itertuples()}
    final = {(c.media_id, c.cue_index): c for c in fixed.collect()}
    assert last and all(final[k].text == a.text_after for k, a in last.items())
    assert set(actions.name) <= {"fix_overlaps", "fix_too_fast_cps", "fix_too_short_duration", "shift_next_start_for_cps", "shift_next_start_for_min_duration", "wrap_lines"}
    assert loop.check_and_fix(cues.limit(0))[1].collect() == [] and folds.fix_actions(cues.limit(0)).collect() == []


def test_fix_actions_by_hand():
    """Every kind of action with its note, in the order in which it is done."""
    from cueweave.operators import kernels as K

    cues = [(0, 0, 100, "a" * 16), (1, 100, 2100, "b"), (2, 2000, 2500, "c d"), (3, 2600, 9000, "one  two")]
    got = [a[:8] + a[10:] for a in K.fix_actions(iter(cues), passes=1, width=42, most=2)]
    by_name = {(a[2], a[3]): a for a in got}
    assert by_name["fix_too_fast_cps", 0][4:8] == (0, 100, 0, 1000) and by_name["fix_too_fast_cps", 0][9] == "shifted_next_start_then_extended_end"
    assert by_name["shift_next_start_for_cps", 1][4:9] == (100, 2100, 1000, 2100, 900)
    assert by_name["fix_overlaps", 2][4:8] == (2000, 2500, 2100, 2500)


def test_one_round_of_fixes():
    """Steps without a limit are left out; the order is overlaps, duration, speed, wrapping."""
    from cueweave.operators import kernels as K

    cues = [(0, 0, 100, "a b"), (1, 50, 2000, "x" * 60), (2, 5000, 5100, "")]
    plain = list(K.fix_once(iter(cues)))
    assert [c[1:3] for c in plain] == [(0, 100), (100, 2000), (5000, 5100)] and plain[1][3] == "x" * 42 + "\n" + "x" * 18
    full = list(K.fix_once(iter(cues), min_ms=900, max_cps=16.0))
    want = list(K.wrapped(K.speed(K.duration(K.overlaps(iter(cues)), 900))))
    assert full == want and full[2][1:3] == (5000, 5900)
    assert list(K.fix_once(iter([]))) == []


def test_stem_outputs(spark):
    """The stem's own folder before newer ones, then the newest; siblings by priority."""
    from cueweave.operators import jobs

    files = spark.createDataFrame(
        [
            ("r", "m1/song/vocals.wav", 5, 1), ("r", "m2/song/vocals.wav", 6, 1), ("r", "m2/other/vocals.wav", 9, 1), ("r", "m2/song/accompaniment.wav", 1, 1), ("r", "m2/song/drums.wav", 1, 1), ("r", "m1/song/no_vocals.wav", 1, 1),
            ("q", "a/b/c/vocals.wav", 2, 1), ("q", "a/x/vocals.wav", 2, 2), ("q", "a/x/no_vocals.wav", 0, 0), ("q", "a/x/accompaniment.wav", 0, 0), ("p", "notes.txt", 1, 1),
        ],
        "root string, path string, mtime long, ctime long",
    )
    stems = spark.createDataFrame([("r", "song"), ("q", "song"), ("p", "song"), ("none", "song")], "root string, input_stem string")
    got = {r.root: (r.vocals, r.other) for r in jobs.stem_outputs(files, stems).collect()}
    assert got == {"r": ("m2/song/vocals.wav", "m2/song/accompaniment.wav"), "q": ("a/x/vocals.wav", "a/x/no_vocals.wav"), "p": (None, None), "none": (None, None)}


def test_foreign_srt(spark):
    """A byte order mark, other line ends, an index alone, no index, blank last lines, text behind the times."""
    from cueweave.sources import srt

    text = "\ufeff1\r\n00:00:01,000 --> 00:00:02,500 X1:40\r\nHello\r\n  \r\n\r\n7\r\n\r\n00:00:03,000-->00:00:04,000\r\n two \r\nlines\u00a0\r\n\u3000\r\n\r\n3\r\n00:00:05,000 --> 00:00:06,000"
    files = spark.createDataFrame([("m", text)], "media_id string, srt string")
    got = [(r.cue_index, r.start_ms, r.end_ms, r.text) for r in srt.parse(files).orderBy("cue_index").collect()]
    assert got == [(0, 1000, 2500, "Hello"), (1, 3000, 4000, " two \nlines\u00a0"), (2, 5000, 6000, "")]
    bad = spark.createDataFrame([("m", "1\n00:00:01,000 --> 00:00:02,500abc\nx")], "media_id string, srt string")
    assert srt.parse(bad, "PERMISSIVE").first().start_ms is None
    blank = spark.createDataFrame([("m", 0, 0, 5, "\u00a0")], "media_id string, cue_index long, start_ms long, end_ms long, text string")
    assert srt.documents(blank).first().srt == "1\n00:00:00,000 --> 00:00:00,005\n"


def test_messages_of_violations(spark):
    from cueweave.operators import quality

    cues = spark.createDataFrame([("m", 0, 0, 100, "x" * 20), ("m", 1, 50, 9000, "")], "media_id string, cue_index long, start_ms long, end_ms long, text string")
    got = {(r.cue_index, r.type): r.message for r in quality.violation_details(cues).collect()}
    assert got == {
        (0, "TOO_SHORT_DURATION"): "Duration 100ms < min 900ms", (0, "TOO_FAST_CPS"): "CPS 200.00 > max 16.0", (0, "LINE_TOO_LONG"): "Line length 20 > max 18", (1, "EMPTY_TEXT"): "Empty subtitle text",
        (1, "TOO_LONG_DURATION"): "Duration 8950ms > max 6500ms", (1, "OVERLAP"): "Overlap 50ms > max 0ms (with previous cue)",
    }


def test_translator_modes(spark):
    from cueweave.operators import jobs
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("en-GB",), ("hi",), (None,), ("",)], "lang string")
    assert [r[0] for r in d.select(jobs.translator_route(F.col("lang"))).collect()] == ["nllb", "openai", "openai", "openai"]
    assert {r[0] for r in d.select(jobs.translator_route(F.col("lang"), "nllb")).collect()} == {"nllb"}
    with pytest.raises(ValueError):
        jobs.translator_route(F.col("lang"), "other")


def test_job_directories(spark, tmp_path):
    from cueweave.sources import documents

    for job, names in (("a", ("spec", "status")), ("b", ("result", "spec", "other"))):
        (tmp_path / job).mkdir()
        for name in names:
            (tmp_path / job / f"{name}.json").write_text("{}")
    got = {r.job_dir: (r.has_spec, r.has_status, r.has_result) for r in documents.job_directories(spark, str(tmp_path)).collect()}
    assert got == {"a": (True, True, False), "b": (True, False, True)}


def test_audio_steps_of_unknown_modes(spark):
    from cueweave.operators import jobs

    d = spark.createDataFrame([("/m/x.y.mp4", None), ("x", "other")], "path string, mode string")
    got = [r[0] for r in d.select(jobs.audio_steps(F.col("path"), F.col("mode"), F.lit("/w"))).collect()]
    assert [[s.step for s in steps] for steps in got] == [["extract"], ["extract"]] and got[0][0].args[-1] == "/w/x.y.audio.wav"

"""Relational operators on fixtures: empty tables, nulls, ties, repeated rows and clashing names."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cueweave.functions import text as X
from cueweave.operators import folds, interval_runs, jobs, nearest, quality, schema_drift
from cueweave.operators import words as W
from cueweave.operators.base import clean_cues, clean_segments, with_previous, with_running_sum, words_of
from cueweave.sources import srt

CUES = "media_id string, cue_index int, start_ms bigint, end_ms bigint, text string, ingested_at timestamp, extra string"
SEGMENTS = "media_id string, seg_idx int, start_sec double, end_sec double, text string, confidence double, ingested_at timestamp, bucket string"
T0, T1 = datetime(2026, 1, 1), datetime(2026, 1, 2)


def cues(spark, *rows):
    return spark.createDataFrame([(m, i, a, b, t, at, "x") for m, i, a, b, t, at in rows], CUES)


def segments(spark, *rows):
    return spark.createDataFrame([(m, i, a, b, t, None, T0, "x") for m, i, a, b, t in rows], SEGMENTS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_clean_cues(spark):
    d = cues(spark, ("m", 0, 0, 10, "a", T1), ("m", 0, 0, 10, "a", T0), ("m", 1, None, 10, "b", T0), ("m", 2, 10, 5, "c", T0), ("m", 3, -1, 5, "d", T0), (None, 0, 0, 1, "e", T0), ("m", 4, 5, 5, None, T0))
    assert rows(clean_cues(d)) == [("m", 0, 0, 10, "a"), ("m", 4, 5, 5, "")]
    assert rows(clean_cues(d.limit(0))) == []


def test_neighbours_across_buckets(spark):
    d = spark.range(0, 9000, 3).select(F.lit("m").alias("media_id"), F.col("id").alias("i"), (F.col("id") * 2).alias("v"))
    got = with_previous(d, "i", ["v"]).where("i > 0 and prev_v <> v - 6").count()
    assert got == 0
    assert with_previous(d, "i", ["v"], "next_", backwards=True).where("i < 8997 and next_v <> v + 6").count() == 0
    assert with_running_sum(d.withColumn("one", F.lit(1)), "i", "one", "n").where("n * 3 <> i").count() == 0


def test_violations_golden(spark):
    text = "This is a very very very very very very very very very long line that should be wrapped."
    d = clean_cues(cues(spark, ("m", 0, 1000, 2000, text, T0), ("m", 1, 1800, 2200, "OVERLAP here.", T0), ("m", 2, 3000, 3300, "Hi", T0)))
    kinds = sorted((r.type, r.cue_index) for r in quality.violations(d).collect())
    assert kinds == [("LINE_TOO_LONG", 0), ("OVERLAP", 1), ("TOO_FAST_CPS", 0), ("TOO_FAST_CPS", 1), ("TOO_SHORT_DURATION", 1), ("TOO_SHORT_DURATION", 2)]
    s = quality.summary(d).first()
    assert (s.total_cues, s.violation_count, s.major_count, s.minor_count, s.ok) == (3, 6, 6, 0, False)
    fixed = folds.fix_loop(d, passes=2)
    assert sorted((r.start_ms, r.end_ms) for r in fixed.collect()) == [(0, 2000), (2000, 2900), (3000, 3900)]
    assert json.loads(quality.report(d).first().report)["major_count"] == 6


def test_empty_tables(spark):
    c, s = clean_cues(cues(spark)), clean_segments(segments(spark))
    w = words_of(s)
    for df in (quality.cue_metrics(c), quality.pair_metrics(c), quality.violations(c), quality.summary(c), quality.report(c), quality.fix_overlaps(c), folds.fix_cps(c), folds.fix_loop(c), folds.wrap_lines(c), folds.wrap_two_lines(c),
               folds.rule_segments(w), folds.coalesce(s), folds.near_duplicates(s), folds.layout_zh(s), W.words_in_segments(w, s), W.word_coverage(w, s), W.coverage_holes(w, s), W.punct_split(w, s), W.repair_candidates(s),
               W.translate_context(s), W.segment_stats(s), W.word_reliability(w), srt.documents(c), srt.parse(srt.documents(c)), interval_runs.run_intervals(interval_runs.cue_and_segment_intervals(cues(spark), segments(spark)))):
        assert df.collect() == []


def test_one_pass_equals_window_fix(spark, sf):
    c = clean_cues(spark.read.parquet(f"{sf}/cues.parquet"))
    assert quality.fix_overlaps(c).where("end_ms < start_ms").count() == 0


def test_intervals_over_many_shards(spark):
    """Very long intervals, before 0 and far away, overlapping and touching short ones: like a sweep over all bounds."""
    import random

    r = random.Random(3)
    shard = interval_runs.SHARD_MS
    iv = [("cue", "m", a, a + r.choice([5, 900, shard, 3 * shard + 17, 9 * shard])) for a in (r.randrange(-20 * shard, 60 * shard) for _ in range(25))]
    iv += [("cue", "n", 5, 10**15), ("cue", "n", 10**15, 10**15 + 7), ("cue", "n", 10**15 + 100, 10**15 + 200), ("cue", "n", -(10**15), -(10**15) + 3), ("cue", None, 0, 3 * shard), ("cue", None, shard + 5, shard + 9), ("cue", "p", shard, 3 * shard), ("cue", "p", 3 * shard + 4, 4 * shard), ("cue", "q", 0, 2**62), ("cue", "q", 1, 2)]
    want = []
    for key in {x[:2] for x in iv}:
        merged = []
        for a, b in sorted(x[2:] for x in iv if x[:2] == key):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        want += [(*key, "period", a, b) for a, b in merged] + [(*key, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:]) if y[0] - x[1] <= interval_runs.BREAK_MS]
    d = spark.createDataFrame(iv, "record_kind string, media_id string, start_ms long, end_ms long")
    assert rows(interval_runs.run_intervals(d)) == sorted(want, key=repr)


def test_intervals(spark):
    big = 1 << 22
    d = cues(spark, ("m", 0, 0, 10, "", T0), ("m", 0, 0, 10, "", T1), ("m", 1, 10, 20, "", T0), ("m", 2, 5, 12, "", T0), ("m", 3, 30, 40, "", T0), ("m", 4, big - 5, big + 5, "", T0), ("m", 5, big + 5, 3 * big, "", T0), ("m", 6, 3 * big + 7, 3 * big + 9, "", T0), ("m", 7, None, 5, "", T0), ("m", 8, 9, 9, "", T0), (None, 0, 1, 2, "", T0))
    s = segments(spark, ("m", 0, 0.0004, 1.0004, ""), ("m", 1, 1.0, 2.0, ""), ("m", 2, float("nan"), 2.0, ""), ("m", 3, 2.0, 2.0003, ""))
    got = rows(interval_runs.run_intervals(interval_runs.cue_and_segment_intervals(d, s)))
    assert got == sorted([("cue", "m", "period", 0, 20), ("cue", "m", "period", 30, 40), ("cue", "m", "gap", 20, 30), ("cue", "m", "period", big - 5, 3 * big), ("cue", "m", "period", 3 * big + 7, 3 * big + 9), ("cue", "m", "gap", 3 * big, 3 * big + 7), ("cue", None, "period", 1, 2), ("segment", "m", "period", 0, 2000)], key=repr)


def test_run_bitmaps_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        n = rng.integers(1, 40)
        code = rng.integers(0, 3, n)
        lo = rng.integers(0, 300, n)
        hi = lo + rng.integers(1, 40, n)
        c, a, b = interval_runs.union_runs(code, lo, hi)
        for k in range(3):
            want = set().union(*(set(range(x, y)) for z, x, y in zip(code, lo, hi) if z == k))
            own = c == k
            assert set().union(*(set(range(x, y)) for x, y in zip(a[own], b[own]))) == want
            assert (a[own][1:] > b[own][:-1]).all()
            if own.any():
                x, y = interval_runs.decode(interval_runs.encode(a[own], b[own]))
                assert (x == a[own]).all() and (y == b[own]).all()


RAW = "file_id bigint, file_name string, feed string, doc_type string, file_seq int, line_no int, received_at timestamp, payload string"


def raw(spark, *files):
    out = []
    for k, (feed, seq, docs) in enumerate(files):
        out += [(k, "f", feed, "job_spec", seq, i, T0, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(docs)]
    return spark.createDataFrame(out, RAW)


def test_schema_changes(spark):
    a = [{"job_id": f"j{i}", "root": f"/r/{i}", "at": f"2026-{i}", "v": "1.0", "in": {"n": i, "list": [i], "flag": i % 2 == 0}, "gone": None} for i in range(6)]
    b = [{"job_id": f"j{i}", "root": f"/r/{i}", "at": f"2026-{i}", "meta": {"v": "1.0"}, "in": {"n": str(i), "list": [i], "flag": i % 2 == 0}, "extra": {}} for i in range(4, 9)]
    d = raw(spark, ("f", 0, [*a, None, "", "{broken", "[1]", "7", a[0]]), ("f", 1, b), ("g", 5, [{"x": 1}]), ("f", 3, [{"y": 1}]))
    got = rows(schema_drift.schema_changes(d).select("file_id", "change_kind", "old_path", "new_path"))
    assert got == sorted([(1, "renamed", "v", "meta.v"), (1, "type_changed", "in.n", "in.n")], key=repr)
    u = schema_drift.unified_table(d)
    assert {"in__n", "in__n__number", "in__n__string", "meta__v"} <= set(u.columns) and "v" not in u.columns
    assert u.where("meta__v = '1.0'").count() == 12
    assert rows(schema_drift.schema_changes(d.limit(0))) == []


def test_unified_table_has_every_valid_document(spark):
    line = lambda file_id, feed, seq, no, payload, kind="job_spec": (file_id, "f", feed, kind, seq, no, T0, payload)
    d = spark.createDataFrame([
        line(1, "f", 0, 0, '{"a": 1}'), line(1, "f", 0, 0, '{"a": 1}'), line(1, "f", 0, 1, "{}", "empty"), line(1, "f", 0, 2, '{"a": null, "o": {}}'), line(1, "f", 0, 3, "[1]"), line(1, "f", 0, 4, None),
        line(2, None, 0, 0, '{"a": 2}'), line(3, "f", None, 0, '{"a": 3, "own": "x"}'), line(None, "f", 0, None, '{"a": 4}', "x"), line(None, "f", 0, None, '{"a": 5}', "y"), line(None, "f", 0, None, '{"a": 5}', "y"), line(1, "f", 0, 0, '{"a": 6}', None),
    ], RAW)
    got = rows(schema_drift.unified_table(d).select("file_id", "line_no", "feed", "doc_type", "a", "own"))
    assert got == sorted([
        (1, 0, "f", "job_spec", 1.0, None), (1, 1, "f", "empty", None, None), (1, 2, "f", "job_spec", None, None), (2, 0, None, "job_spec", 2.0, None), (3, 0, "f", "job_spec", 3.0, "x"),
        (None, None, "f", "x", 4.0, None), (None, None, "f", "y", 5.0, None), (1, 0, "f", None, 6.0, None),
    ], key=repr)


def test_schema_values_that_differ_are_no_rename(spark):
    a = [{"job_id": f"j{i}", "root": f"/r/{i}", "at": f"2026-{i}", "old": i} for i in range(6)]
    b = [{"job_id": f"j{i}", "root": f"/r/{i}", "at": f"2026-{i}", "new": i + 1} for i in range(3, 9)]
    got = rows(schema_drift.schema_changes(raw(spark, ("f", 0, a), ("f", 1, b))).select("change_kind", "old_path", "new_path"))
    assert got == [("added", "", "new"), ("removed", "old", "")]


def _plain_values(seed, feeds=8, docs=14):
    """Files of documents in which no value is unique: they are known by their combinations only, and many are equally alike."""
    import random

    rng, out, pick = random.Random(seed), [], lambda n: rng.randrange(n)
    for f in range(feeds):
        base = [{"kind": pick(3), "mode": f"m{pick(3)}", "lang": rng.choice(["de", "é", 'a"b', None]), "flag": pick(2) == 0, "n": {"x": rng.choice([1, 1.0, 2.5, 1e20, -3]), "y": pick(3)}, "tags": [pick(2), "t\n"], "name": f"v{pick(6)}", **{f"e{k}": pick(3) for k in range(f)}} for _ in range(docs)]
        for seq in (0, 1):
            own = [{**d, "mode": f"m{pick(3)}"} if pick(5) == 0 else dict(d) for d in base if pick(4)]
            for d in own if seq else ():
                d["title"] = d.pop("name")
            out.append((f"f{f}", seq, own))
    return out


def test_schema_renames_of_documents_without_unique_values(spark, tmp_path, monkeypatch):
    from cueweave.plans import catalog
    from sqlcheck import agree

    a = [{"job": j, "day": d, "at": t, "old": j * 9 + d * 3 + t} for j in range(3) for d in range(3) for t in range(3)]
    b = [{"job": x["job"], "day": x["day"], "at": x["at"], "new": x["old"]} for x in a]
    got = rows(schema_drift.schema_changes(raw(spark, ("f", 0, a), ("f", 1, b))).select("change_kind", "old_path", "new_path"))
    assert got == [("renamed", "old", "new")]
    files = str(tmp_path / "raw")
    raw(spark, *_plain_values(3)).coalesce(1).write.parquet(files)
    (tmp_path / "sf").mkdir()
    next((tmp_path / "raw").glob("*.parquet")).rename(tmp_path / "sf/raw_job_docs.parquet")
    assert agree(spark, str(tmp_path / "sf"), catalog.p1_found, catalog.ORACLES["p1_found"])
    # the same in tiles of a few documents, and with small tables that aren't broadcast
    monkeypatch.setattr(schema_drift, "TILE", 5)
    monkeypatch.setattr(schema_drift, "_STRIP", 3)
    monkeypatch.setattr(schema_drift, "MAX_SENT", 0)
    assert agree(spark, str(tmp_path / "sf"), catalog.p1_found, catalog.ORACLES["p1_found"])


def test_srt_round_trip_and_errors(spark, tmp_path):
    c = clean_cues(cues(spark, ("m", 0, 0, 1500, "one\ntwo", T0), ("m", 1, 360_000_000, 360_000_001, "", T0)))
    assert "100:00:00,000" in srt.documents(c).first().srt
    c = clean_cues(cues(spark, ("m", 0, 0, 1500, "one\ntwo", T0), ("m", 1, 2000, 2500, "", T0)))
    assert rows(srt.parse(srt.documents(c))) == [("m", 0, 0, 1500, "one\ntwo"), ("m", 1, 2000, 2500, "")]
    srt.write_srt(c, str(tmp_path / "out"))
    assert [r[1:] for r in rows(srt.read_srt(spark, str(tmp_path / "out/*/*.txt")))] == [(0, 0, 1500, "one\ntwo"), (1, 2000, 2500, "")]
    bad = spark.createDataFrame([("m", "﻿1\r\n0:00 --> x\r\nhi\r\n")], "media_id string, srt string")
    assert rows(srt.parse(bad, "PERMISSIVE")) == [("m", 0, None, None, "hi")]
    with pytest.raises(Exception, match="invalid timecode"):
        srt.parse(bad).collect()


def test_srt_of_more_than_99_hours(spark):
    c = clean_cues(cues(spark, ("m", 0, 0, 1500, "one", T0), ("m", 1, 359_999_999, 360_000_001, "two", T0), ("m", 2, 4_320_000_000, 4_320_000_500, "three", T0)))
    want = [("m", 0, 0, 1500, "one"), ("m", 1, 359_999_999, 360_000_001, "two"), ("m", 2, 4_320_000_000, 4_320_000_500, "three")]
    assert rows(srt.parse(srt.documents(c))) == want
    endless = spark.createDataFrame([("m", "1\n00:00:00,000 --> 9999999999999:00:00,000\nx"), ("n", f"1\n{'9' * 40}:00:00,000 --> {'9' * 40}:00:01,000\nx")], "media_id string, srt string")
    assert [r[1:] for r in rows(srt.parse(endless, "PERMISSIVE"))] == [(0, 0, None, "x"), (0, None, None, "x")]


def test_text_functions(spark):
    d = spark.createDataFrame([("　a b ", "￥"), ("", None), (None, ""), ("x" * 100_000, "y")], "t string, u string")
    assert [r[0] for r in d.select(X.strip(F.col("t"))).collect()][:3] == ["a b", "", None]
    assert [r[0] for r in d.select(X.reading_chars(F.col("t"))).collect()] == [2, 0, None, 100_000]
    with pytest.raises(ValueError):
        X.apply_glossary(F.col("t"), [("", "x")])
    sim = spark.createDataFrame([("abcdef", "abcxyz"), ("abc", "abcabc"), ("", "a"), ("a", "a")], "a string, b string").select(X.repair_similarity(F.col("a"), F.col("b")))
    assert [r[0] for r in sim.collect()] == [0.5, 0.5, 0.0, 1.0]


def test_stuck_and_repeats(spark):
    d = spark.createDataFrame([("go go go",), ("a b a b a b",), ("x y x z x x w x x q x x",), ("plain words here",), ("",)], "t string").select(W.stuck(F.col("t")))
    assert [r[0] for r in d.collect()] == [True, False, True, False, False]


def test_job_states(spark):
    disk = spark.createDataFrame([("a", "queued"), ("b", "running"), ("c", "succeeded"), ("d", "running")], "job_id string, job_state string")
    queue = spark.createDataFrame([("a", "started"), ("b", "finished"), ("c", "failed"), ("e", "finished"), ("f", "odd")], "job_id string, queue_state string")
    assert rows(jobs.reconcile(disk, queue)) == [("a", "started", "both"), ("b", "running", "both"), ("c", "succeeded", "both"), ("d", "running", "disk"), ("e", "succeeded", "queue"), ("f", "queued", "queue")]
    t = spark.createDataFrame([("120",), ("bad",), (None,), ("-3",), ("0",)], "x string")
    assert [r[0] for r in t.select(jobs.positive_timeout(F.col("x"))).collect()] == [120, 5400, 5400, 5400, 5400]


def test_nearest_like_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(120, 8)).astype("float32")
    d = spark.createDataFrame([(i, v[i].tolist()) for i in range(120)], "vec_id bigint, embedding array<float>")
    got = {(r.query_id, r.rank): r.vec_id for r in nearest.nearest_to_each(d, block=16).collect()}
    for q in (0, 50, 100):
        dist = ((v.astype("float64") - v[q]) ** 2).sum(1)
        dist[q] = np.inf
        assert [got[(q, k + 1)] for k in range(6)] == np.argsort(dist)[:6].tolist()


def test_json_sources(spark, tmp_path):
    from cueweave.sources import documents as D

    (tmp_path / "a.json").write_text(json.dumps({"language": "en", "segments": [{"start": 0.0, "end": 1.0005, "text": "hi"}], "words": [{"start": 1.0, "end": 2.0, "word": " b"}, {"start": 0.0, "end": 1.0, "word": "a"}, {"start": 0, "end": 1, "word": " "}]}))
    t = D.read_transcripts(spark, str(tmp_path / "a.json"))
    assert [tuple(r)[1:] for r in D.segments_of(t).collect()] == [(0, 0, 1000, "hi", None)]
    assert sorted(tuple(r)[1:] for r in D.words_of(t).collect()) == [(0, 0, 1000, "a"), (1, 1000, 2000, " b")]
    D.write_transcripts(D.segments_of(t).withColumn("media_id", F.lit("m")), str(tmp_path / "out"))
    back = D.read_transcripts(spark, str(tmp_path / "out/*/*.txt"))
    assert back.first().segments[0].text == "hi"
    (tmp_path / "g.json").write_text('{"b": "1", "a": 2}')
    assert D.read_glossary(str(tmp_path / "g.json")) == [("b", "1"), ("a", "2")]
    (tmp_path / "jobs/j1").mkdir(parents=True)
    (tmp_path / "jobs/j1/spec.json").write_text('{"job_id": "j1"}')
    assert [tuple(r) for r in D.read_job_documents(spark, str(tmp_path / "jobs")).collect()] == [("j1", '{"job_id": "j1"}')]
    docs = spark.createDataFrame([(1, 1, '{"job_id":"x","kind":"FIX","inputs":{"pipeline_args":{"timeout_sec":"bad"}}}'), (1, 2, "{oops"), (1, 3, None)], "file_id bigint, line_no int, payload string")
    assert sorted(tuple(r) for r in D.job_specs(docs).collect()) == [(1, 1, "x", "subtitles.fix", None, 5400, True), (1, 2, None, None, None, None, False)]


def test_wav_header(spark):
    import io
    import wave

    from cueweave.sources import documents as D

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(b"\x00\x00" * 24000)
    d = spark.createDataFrame([("a", bytearray(out.getvalue())), ("b", bytearray(b"nope")), ("c", None)], "path string, content binary")
    assert {r.path: r.duration_ms for r in D.wav_duration_ms(d).collect()} == {"a": 1500, "b": None, "c": None}


def test_wav_header_behind_long_metadata(spark):
    import struct

    from cueweave.sources import documents as D

    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16)
    data = b"data" + struct.pack("<I", 48000) + b"\x00" * 48000
    wav = lambda *chunks: bytearray(b"RIFF" + struct.pack("<I", 4 + sum(map(len, chunks))) + b"WAVE" + b"".join(chunks))
    extra = lambda n: b"LIST" + struct.pack("<I", n) + b"data" * (n // 4)
    files = {"short": wav(fmt, data), "long": wav(fmt, extra(5000), data), "first": wav(extra(300_000), fmt, data), "none": wav(fmt, extra(5000)), "edge": wav(fmt, extra(4096 - 12 - 24 - 8 - 4), data)}
    d = spark.createDataFrame(list(files.items()), "path string, content binary")
    assert {r.path: r.duration_ms for r in D.wav_duration_ms(d).collect()} == {"short": 1500, "long": 1500, "first": 1500, "none": None, "edge": 1500}


def test_paths_and_hashes(spark):
    d = spark.createDataFrame([("/data/x",), ("/data",), ("/data/../etc",), ("data/x",), ("/database/x",), ("",), (None,), ("/data/./x",)], "p string")
    assert [r[0] for r in d.select(jobs.path_allowed(F.col("p"), ["/data/"])).collect()] == [True, True, False, False, False, False, False, False]
    assert jobs.stable_hash({"b": 1, "a": 2}) == jobs.stable_hash({"a": 2, "b": 1})


@pytest.mark.parametrize("name", ["fix_cps", "fix_duration", "one_of_each", "no_overlap", "near_duplicates", "coalesce", "absorb", "greedy_units"])
def test_folds_over_islands(spark, monkeypatch, name):
    """A fold over islands, parted in short stretches, gives what its kernel gives over the whole item."""
    import random
    from functools import partial

    from cueweave.operators import base
    from cueweave.operators import kernels as K

    monkeypatch.setattr(base, "STRETCH_MS", 20_000)
    r = random.Random(name)
    rows_, at = [], 0
    for i in range(400):
        at += r.choice([0, 10, 300, 900, 2000, 4000, 16_000, 40_000])
        text = r.choice(["", " ", "yes", "no no", "the lamp is on", "the lamp is on again", "a long text that takes its time to read aloud, word by word", "好的"])
        rows_.append(("mn"[i % 7 == 0], i, at, at + r.choice([0, 1, 200, 900, 2600, 4300, 7000]), text, r.choice([None, 0.2, 0.9])))
    d = spark.createDataFrame(rows_, "media_id string, seg_idx long, start_ms long, end_ms long, text string, confidence double")
    kernels = {
        "fix_cps": K.speed, "fix_duration": K.duration, "one_of_each": K.one_of_each, "no_overlap": K.no_overlap, "near_duplicates": K.near_duplicates, "coalesce": lambda x: K.near_duplicates(K.coalesce(x)),
        "absorb": partial(K._absorb, min_ms=2500, min_chars=8, hard=15000), "greedy_units": K.greedy_units,
    }
    short = name in ("fix_cps", "fix_duration", "greedy_units")
    frame = d.drop("confidence").withColumnRenamed("seg_idx", "cue_index") if name.startswith("fix") else d.withColumnsRenamed({"seg_idx": "word_idx", "text": "word"}) if short else d
    want = []
    for m in "mn":
        own = sorted(((s, e, i, t, c) for k, i, s, e, t, c in rows_ if k == m), key=lambda x: x[:3])
        want += [(m, *x) for x in kernels[name]((i, s, e, t) if short else (i, s, e, t, c) for s, e, i, t, c in own)]
    got = getattr(folds, name)(frame)
    order = ["media_id", "seg_no", "start_ms", "end_ms", "text"] if name == "greedy_units" else got.columns
    assert rows(got.select(*order)) == sorted(want, key=repr)


def test_expressions_equal_kernels(spark):
    """What exists as a Column expression and as a Python kernel is the same."""
    import random

    from cueweave.functions import text as X
    from cueweave.functions.sql import register
    from cueweave.operators import kernels as K

    register(spark)
    r = random.Random(6)
    bits = ["yes", "yes", "no", " ", "  ", "\n", "\u00a0", "\u3000", "-", " - ", "。", "！", "，", ",", ".", "灯", "地图", "A", "\ufffd", "long word here ", "…", "12"]
    rows_ = []
    for i in range(400):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 40))) if i % 3 else " ".join(r.choice(["yes", "no", "lamp"]) for _ in range(r.randint(0, 30)))
        start = i * 9000
        rows_.append(("m", i, start, start + r.choice([0, 900, 2000, 6500, 11_000]), text, None))
    rows_ = [(m, i, s, e, rows_[i - 1][4] if i % 5 == 4 else t, c) for m, i, s, e, t, c in rows_]
    d = spark.createDataFrame(rows_, "media_id string, seg_idx long, start_ms long, end_ms long, text string, confidence double")
    t, dur = F.col("text"), F.col("end_ms") - F.col("start_ms")
    d.createOrReplaceTempView("pairs_of_logic")
    sql = {x.seg_idx: (x.n, x.f) for x in spark.sql("select seg_idx, cw_reading_chars(text) n, cw_repair_form(text) f from pairs_of_logic").collect()}
    got = d.select("seg_idx", X.normalize_zh(t).alias("zh"), X.normalize_repair(t).alias("form"), W.stuck(t).alias("stuck"), W.low_info(t, dur).alias("low"), W.suspect(t, dur).alias("suspect"), X.sentence_pieces(t).alias("parts")).collect()
    shared = {}
    for x in W.share_time(d).collect():
        shared.setdefault(x.seg_idx, []).append((x.piece, x.start_ms, x.end_ms))
    for x in got:
        _, i, s, e, text, _ = rows_[x.seg_idx]
        assert x.zh == K.normal_zh(text) and x.form == K.repair_form(text) == sql[i][1] and sql[i][0] == K.spoken_chars(text), repr(text)
        quiet = (0, s - 60_000, s - 50_000, "", None)
        reason = "STUCK_OR_INVALID" if x.stuck or "\ufffd" in text else "SHORT_LOW_INFO" if x.low else "SUSPECT" if x.suspect else None
        assert K.trigger(quiet, (i, s, e, text, None)) == reason, repr(text)
        parts = list(x.parts)
        if e - s >= 2 * len(parts) > 0 and all(K.spoken_chars(p) for p in parts):
            want = [(k, a, b) for k, (a, b) in enumerate(K.share_time(s, e, parts))]
            if all(b - a > 1 for _, a, b in want):
                assert sorted(shared[i]) == want, repr(text)

"""Job states, counters, cache keys and decision tables as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds by their enum names, states, what a queue's state means, and the translator's codes of languages.
KINDS = {"GENERATE": "subtitles.generate", "FIX": "subtitles.fix", "BURN": "subtitles.burn", "SUBTITLES_GENERATE": "subtitles.generate", "SUBTITLES_FIX": "subtitles.fix", "SUBTITLES_BURN": "subtitles.burn"}
TERMINAL = ("succeeded", "failed", "canceled")
LANGUAGES = {
    "en": "eng_Latn", "ja": "jpn_Jpan", "ko": "kor_Hang", "fr": "fra_Latn", "de": "deu_Latn", "es": "spa_Latn", "pt": "por_Latn", "it": "ita_Latn", "ru": "rus_Cyrl", "ar": "arb_Arab",
    "th": "tha_Thai", "vi": "vie_Latn", "id": "ind_Latn", "tr": "tur_Latn", "hi": "hin_Deva", "zh": "zho_Hans", "zh-cn": "zho_Hans", "zh-tw": "zho_Hant",
}


def job_kind(c: Column) -> Column:
    """A kind by value or by enum name."""
    out = F.lower(c)
    for name, value in KINDS.items():
        out = F.when(F.upper(c) == name, value).otherwise(out)
    return out


def latest_states(snapshots: DataFrame) -> DataFrame:
    """job_id, job_kind, job_state, progress, attempt, error_code of each job's last snapshot. A partial maximum is taken before the shuffle."""
    rank = F.when(F.col("job_state").isin(*TERMINAL), 1).otherwise(0)
    row = F.struct("updated_at", rank.alias("rank"), F.coalesce("progress", F.lit(-1.0)).alias("p"), "job_state", F.coalesce("attempt", F.lit(0)).alias("attempt"), "error_code", job_kind(F.col("job_kind")).alias("job_kind"))
    d = snapshots.where("job_id is not null and updated_at is not null").groupBy("job_id").agg(F.max(row).alias("r"))
    return d.select("job_id", "r.job_kind", "r.job_state", F.when(F.col("r.p") >= 0, F.col("r.p")).alias("progress"), "r.attempt", "r.error_code")


def reconcile(disk: DataFrame, queue: DataFrame) -> DataFrame:
    """job_id, job_state, origin: states on disk (job_id, job_state) joined with those of the queue (job_id, queue_state).

    The disk wins; end states never change; queued, started (only from queued), failed and canceled of the queue move an
    open job on; a job that only the queue knows is what the queue says, queued by default.
    """
    q, s = F.col("queue_state"), F.col("job_state")
    moved = F.when(s.isin(*TERMINAL), s).when(q == "queued", "queued").when((q == "started") & (s == "queued"), "started").when(q == "failed", "failed").when(q == "canceled", "canceled").otherwise(s)
    alone = F.when(q == "finished", "succeeded").when(q.isin("started", "failed", "canceled"), q).otherwise("queued")
    d = disk.select("job_id", "job_state").join(queue.select("job_id", "queue_state"), "job_id", "full_outer")
    return d.select("job_id", F.when(s.isNull(), alone).otherwise(moved).alias("job_state"), F.when(s.isNull(), "queue").when(q.isNull(), "disk").otherwise("both").alias("origin"))


def counters(events: DataFrame, name: Column, labels: dict[str, Column]) -> DataFrame:
    """name, labels (key and value pairs, sorted by key), value: counts by name and labels; a null label is empty."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(labels[k].cast("string"), F.lit("")).alias("v")) for k in sorted(labels))) if labels else F.array().cast("array<struct<k:string,v:string>>")
    return events.groupBy(name.alias("name"), pairs.alias("labels")).agg(F.count("*").alias("value"))


def prometheus_lines(counted: DataFrame) -> DataFrame:
    """number, line: the text form of counters in the order of (name, labels). Their number is that of the label sets, whatever the events."""
    inner = F.array_join(F.transform("labels", lambda x: F.concat(x["k"], F.lit('="'), x["v"], F.lit('"'))), ",")
    line = F.concat(F.col("name"), F.when(F.size("labels") > 0, F.concat(F.lit("{"), inner, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string"))
    rows = counted.agg(F.array_sort(F.collect_list(F.struct("name", "labels", line.alias("line")))).alias("all"))
    return rows.select(F.posexplode("all").alias("number", "x")).select((F.col("number") + 1).cast("bigint").alias("number"), F.col("x.line").alias("line"))


def asr_cache_key(
    content_sha1: Column, model: Column, language: Column, preprocess: Column | None = None, device: Column | None = None, compute_type: Column | None = None, beam_size: Column | None = None, best_of: Column | None = None, vad: Column | None = None
) -> Column:
    """SHA-1 of all that changes what a recogniser gives: the content hash of the audio and eight labelled settings; missing ones have the defaults (none, auto, auto, 1, 1, off)."""
    given = lambda c, default: F.lit(default) if c is None else F.coalesce(F.when(c.cast("string") != "", c.cast("string")), F.lit(default))
    parts = {"model": model.cast("string"), "lang": language.cast("string"), "pre": given(preprocess, "none"), "dev": given(device, "auto"), "ct": given(compute_type, "auto"), "beam": given(beam_size, "1"), "best_of": given(best_of, "1")}
    flag = F.lit("0") if vad is None else F.coalesce(vad.cast("int"), F.lit(0)).cast("string")
    return F.sha1(F.concat_ws("|", content_sha1, *(F.concat(F.lit(f"{k}="), F.coalesce(v, F.lit(""))) for k, v in parts.items()), F.concat(F.lit("vad="), flag)))


def device_decision(device: Column, compute: Column, has_gpu: Column) -> tuple[Column, Column]:
    """(device, compute type) that a recogniser runs with: automatic devices, short names, and no half precision on a CPU."""
    d = F.lower(F.trim(F.coalesce(device, F.lit("auto"))))
    t = F.lower(F.trim(F.coalesce(compute, F.lit("float16"))))
    d = F.when(d.isin("", "auto"), F.when(has_gpu, "cuda").otherwise("cpu")).when(d.startswith("cuda") & ~has_gpu, "cpu").otherwise(d)
    t = F.when(t.isin("fp16", "half"), "float16").when(t == "fp32", "float32").otherwise(t)
    return d, F.when((d == "cpu") & (t == "float16"), "int8").otherwise(t)


def positive_timeout(c: Column, default: int = 5400) -> Column:
    """A whole number above 0, else the default."""
    n = F.trim(c.cast("string")).try_cast("int")
    return F.when(n > 0, n).otherwise(default).cast("bigint")


def stable_stem(c: Column) -> Column:
    """A file's stem without any `.fixed` at its end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"\.[^.]*$", ""), r"(\.fixed)+$", "")


def emit_route(c: Column) -> tuple[Column, Column]:
    """(primary output, list of subtitle outputs) of an emit mode; a mode without subtitles, `none` or unknown, has the literal transcript's JSON as primary."""
    written = F.array_compact(F.array(F.when(c.isin("zh-only", "all"), "zh"), F.when(c == "literal", "literal"), F.when(c.isin("all", "bilingual", "bilingual-only"), "bilingual")))
    return F.coalesce(F.try_element_at(written, F.lit(-1)), F.lit("literal_json")), written


def language_code(c: Column) -> Column:
    """The translator's code of a language, English by default."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.coalesce(c, F.lit("")))), F.lit("eng_Latn"))


def translator_route(lang: Column, mode: str = "auto_non_en") -> Column:
    """Which translator a language goes to: by default English to the many-language model and all others, unknown (null) ones too, to the general one; the other modes name one for all."""
    if mode in ("openai", "nllb"):
        return F.lit(mode)
    if mode != "auto_non_en":
        raise ValueError(f"unknown translator: {mode}")
    return F.when(F.lower(F.coalesce(lang, F.lit("unknown"))).startswith("en"), "nllb").otherwise("openai")


def logprob_confidence(c: Column) -> Column:
    """exp of a mean log probability, clamped to 0..1; null stays null."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(c)))


def burn_filter_escape(c: Column) -> Column:
    """A path as a value of a filter graph."""
    out = F.replace(c, F.lit("\\"), F.lit("/"))
    for mark in ":',[]":
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return out


def stem_outputs(files: DataFrame, stems: DataFrame) -> DataFrame:
    """root, input_stem, vocals, other of separated audio: files (root, path below it, mtime, ctime) chosen for stems (root, input_stem).

    The newest `vocals.wav` in `<model>/<input_stem>/` counts, else the newest anywhere below the root (ties by ctime, then
    path). Beside it `no_vocals.wav` is preferred, then `accompaniment.wav`, then any other WAV (the first by name). A root
    without vocals has nulls.
    """
    name, folder = F.regexp_extract("path", r"([^/]*)$", 1), F.regexp_replace("path", r"[^/]*$", "")
    known = files.select("root", "path", "mtime", "ctime", name.alias("name"), folder.alias("folder"))
    own = F.col("folder").rlike("^[^/]+/[^/]+/$") & (F.regexp_extract("folder", r"^[^/]+/([^/]+)/$", 1) == F.col("input_stem"))
    vocals = stems.select("root", "input_stem").distinct().join(known.where("name = 'vocals.wav'"), "root", "left")
    best = vocals.groupBy("root", "input_stem").agg(F.max(F.when(F.col("path").isNotNull(), F.struct(own.alias("own"), "mtime", "ctime", "path", "folder"))).alias("v"))
    best = best.select("root", "input_stem", F.col("v.path").alias("vocals"), F.col("v.folder").alias("folder"))
    rank = F.when(F.col("name") == "no_vocals.wav", 0).when(F.col("name") == "accompaniment.wav", 1).otherwise(2)
    siblings = known.where("name like '%.wav' and name <> 'vocals.wav'").groupBy("root", "folder").agg(F.min(F.struct(rank.alias("rank"), "path")).alias("o"))
    return best.join(siblings, ["root", "folder"], "left").select("root", "input_stem", "vocals", F.col("o.path").alias("other"))


def newest_by(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The row of each key with the greatest order columns, by a maximum with partial aggregation, not a sort."""
    return df.groupBy(*key).agg(F.max(F.struct(*order, *columns)).alias("r")).select(*key, *(f"r.{c}" for c in columns))


#: What a state may become (fixed): every job is queued, started, running, and ends once.
NEXT = {"queued": ("queued", "started", "running", *TERMINAL), "started": ("started", "running", *TERMINAL), "running": ("running", *TERMINAL), **{t: (t,) for t in TERMINAL}}


def transitions(snapshots: DataFrame) -> DataFrame:
    """job_id, updated_us, from_state, to_state, allowed of every two snapshots of a job that follow each other; repeated snapshots count once."""
    from pyspark.sql import Window

    order = F.element_at(F.create_map(*(F.lit(x) for s, i in (("queued", 0), ("started", 1), ("running", 2), ("succeeded", 3), ("failed", 3), ("canceled", 3)) for x in (s, i))), F.col("job_state"))
    d = snapshots.where("job_id is not null and updated_at is not null and job_state is not null").select("job_id", "updated_at", "job_state").distinct()
    w = Window.partitionBy("job_id").orderBy("updated_at", order, "job_state")
    d = d.withColumn("from_state", F.lag("job_state").over(w)).where("from_state is not null")
    ok = F.lit(False)
    for state, nxt in NEXT.items():
        ok = ok | ((F.col("from_state") == state) & F.col("job_state").isin(*nxt))
    return d.select("job_id", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"), "from_state", F.col("job_state").alias("to_state"), ok.alias("allowed"))


# Fixed value: the filter chain that makes speech clearer (rumble and harsh highs cut, loudness evened, mild noise reduction).
SPEECH_FILTER = "highpass=f=80,lowpass=f=8000,dynaudnorm=f=150:g=15,afftdn=nf=-25"
AUDIO_MODES = ("none", "speech_filter", "demucs")


def audio_steps(path: Column, mode: Column, folder: Column, rate: int = 16_000, model: str = "htdemucs") -> Column:
    """What has to run so that a media file becomes mono audio for a recogniser: an array of (step, args), in order; args are a command line (extract, filter) or the input, folder and model of a separation. An unknown or null mode is none."""
    stem = F.concat(folder, F.lit("/"), F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", ""), F.lit(".audio"))
    raw, speech, vocals = (F.concat(stem, F.lit(end)) for end in (".wav", ".speech.wav", ".vocals.speech.wav"))
    lit = lambda *words: [F.lit(w) for w in words]
    step = lambda name, *args: F.struct(F.lit(name).alias("step"), F.array(*args).alias("args"))
    extract = lambda out, *extra: step("extract", *lit("ffmpeg", "-y", "-i"), path, *lit("-vn", "-ac", "1", "-ar", str(rate), *extra, "-f", "wav"), out)
    separated = F.concat(folder, F.lit(f"/{model}/"), F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", ""), F.lit(".audio/vocals.wav"))
    cleaned = step("filter", *lit("ffmpeg", "-y", "-i"), separated, *lit("-af", SPEECH_FILTER, "-f", "wav"), vocals)
    several = F.array(extract(raw), step("separate", raw, folder, F.lit(model)), cleaned)
    return F.when(mode == "speech_filter", F.array(extract(speech, "-af", SPEECH_FILTER))).when(mode == "demucs", several).otherwise(F.array(extract(raw)))


def path_allowed(c: Column, roots: list[str]) -> Column:
    """Whether a path is absolute, without empty, dot or parent parts or a NUL, and under one of the roots."""
    under = F.lit(False)
    for root in roots:
        under = under | (c == root.rstrip("/")) | c.startswith(root.rstrip("/") + "/")
    return F.coalesce((c != "") & ~c.contains("\x00") & c.startswith("/") & ~c.rlike(r"(^|/)\.{1,2}(/|$)") & under, F.lit(False))


def stable_hash(value: object, length: int = 12) -> str:
    """The head of the SHA-1 of a value's sorted compact JSON; a driver helper for cache tags."""
    import hashlib
    import json

    return hashlib.sha1(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:length]

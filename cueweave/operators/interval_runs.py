"""Continuous periods and gaps of overlapping intervals per entity (problem 3).

Time is discretised to whole milliseconds. Each entity and time shard (2**22 ms, some 70 minutes) has one run bitmap: the
sorted, disjoint runs of set milliseconds, stored as delta-coded 32-bit integers. Map tasks union what they read, so a
shuffle carries at most one bitmap per task, entity and shard whatever the number of rows; the bitmaps of a shard are
united after the shuffle; set runs are periods, clear runs between them gaps. A last step joins runs over shard borders;
it sees two runs per shard, never the rows. An interval over many shards goes to the bitmaps of its first and its last
shard; the whole shards between are one stretch, kept as a number of them that begin or end at a shard. Stretches take
part in the last step, and what the bitmaps of shards under a stretch say is passed over.

Defined results: rows with a null, NaN or infinite bound, one that no 64-bit number of milliseconds holds, or an end not
after the start (after rounding) don't count; a null entity is an entity of its own; repeated rows change nothing; an
empty table has no rows; extra columns are ignored. The length of an interval does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD_BITS = 22
SHARD_MS = 1 << SHARD_BITS
#: Pauses longer than this are breaks, not gaps.
BREAK_MS = 600_000

_KEYS = [T.StructField("record_kind", T.StringType()), T.StructField("media_id", T.StringType()), T.StructField("shard", T.LongType())]
_BITMAPS = T.StructType([*_KEYS, T.StructField("bitmap", T.BinaryType())])
_RUNS = T.StructType([*_KEYS, T.StructField("interval_kind", T.StringType()), T.StructField("from_ms", T.LongType()), T.StructField("to_ms", T.LongType()), T.StructField("first", T.BooleanType())])
_KEY_FIELDS = [("record_kind", pa.string()), ("media_id", pa.string()), ("shard", pa.int64())]


def union_runs(code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of runs [lo, hi) within each code; runs that touch are one. 0 <= lo < hi <= SHARD_MS. Returns code, lo, hi, sorted."""
    if not len(lo):
        return code, lo, hi
    base = code.astype(np.int64) << (SHARD_BITS + 1)
    start, end = base + lo, base + hi
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    head = np.r_[True, start[1:] > end[:-1]]
    at = np.flatnonzero(head)
    stop = end[np.r_[at[1:] - 1, len(end) - 1]]
    out = start[at] >> (SHARD_BITS + 1)
    return out, start[at] - (out << (SHARD_BITS + 1)), stop - (out << (SHARD_BITS + 1))


def encode(lo: np.ndarray, hi: np.ndarray) -> bytes:
    """Runs as 32-bit deltas: clear length, set length, clear length, ..."""
    edges = np.empty(2 * len(lo), np.int64)
    edges[0::2], edges[1::2] = lo, hi
    return np.diff(edges, prepend=0).astype("<i4").tobytes()


def decode(bitmap: bytes) -> tuple[np.ndarray, np.ndarray]:
    edges = np.cumsum(np.frombuffer(bitmap, "<i4").astype(np.int64))
    return edges[0::2], edges[1::2]


def _codes(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Code of each row's (record_kind, media_id, shard) and a row of each code."""
    parts = []
    for name in ("record_kind", "media_id"):
        column = table.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        codes = column.dictionary_encode(null_encoding="encode")
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        parts.append(codes.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    shard = np.asarray(table.column("shard").to_numpy())
    key = np.stack([*parts, shard], axis=1)
    _, first, inverse = np.unique(key, axis=0, return_index=True, return_inverse=True)
    return inverse.reshape(-1), first


def _bitmaps(table: pa.Table, code: np.ndarray, first: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    code, lo, hi = union_runs(code, lo, hi)
    cuts = np.searchsorted(code, np.arange(len(first) + 1))
    packed = [encode(lo[a:b], hi[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    keys = [table.column(n).take(pa.array(first)) for n, _ in _KEY_FIELDS]
    keys = [k.combine_chunks() if isinstance(k, pa.ChunkedArray) else k for k in keys]
    return pa.RecordBatch.from_arrays([*keys, pa.array(packed, pa.binary())], schema=pa.schema([*_KEY_FIELDS, ("bitmap", pa.binary())]))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: the union of what a task reads, in steps of bounded size."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        held.clear()
        code, first = _codes(table)
        return _bitmaps(table, code, first, table.column("lo").to_numpy(), table.column("hi").to_numpy())

    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= 1_000_000:
            yield flush()
            rows = 0
    if held:
        yield flush()


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    code, first = _codes(table)
    parts = [decode(b) for b in table.column("bitmap").to_pylist()]
    count = np.array([len(p[0]) for p in parts])
    return np.repeat(code, count), first, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _runs(table: pa.Table) -> pa.RecordBatch:
    """Set runs and clear runs of whole bitmaps. The first and the last run of a shard may go on elsewhere: they are `edge`."""
    code, first, lo, hi = _unpack(table)
    code, lo, hi = union_runs(code, lo, hi)
    shard = np.asarray(table.column("shard").to_numpy())[first][code]
    base = shard << SHARD_BITS
    lo, hi = lo + base, hi + base
    head, tail = np.r_[True, code[1:] != code[:-1]], np.r_[code[1:] != code[:-1], True]
    inner = np.flatnonzero(~head)
    kind = np.where(head | tail, "edge", "period")
    row = np.r_[first[code], first[code[inner]]]
    keys = [table.column(n).take(pa.array(row)) for n in ("record_kind", "media_id")]
    keys = [k.combine_chunks() if isinstance(k, pa.ChunkedArray) else k for k in keys]
    return pa.RecordBatch.from_arrays(
        [*keys, pa.array(np.r_[shard, shard[inner]], pa.int64()), pa.array(np.r_[kind, np.full(len(inner), "gap")].astype(object), pa.string()), pa.array(np.r_[lo, hi[inner - 1]], pa.int64()), pa.array(np.r_[hi, lo[inner]], pa.int64()), pa.array(np.r_[head, np.zeros(len(inner), bool)], pa.bool_())],
        schema=pa.schema([*_KEY_FIELDS, ("interval_kind", pa.string()), ("from_ms", pa.int64()), ("to_ms", pa.int64()), ("first", pa.bool_())]),
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side, sorted by key: the last key of a batch is kept, united, for the next."""
    carry: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([carry, table]) if carry is not None else table
        same = np.ones(table.num_rows, bool)
        for name, _ in _KEY_FIELDS:
            column = table.column(name).to_pylist()
            same &= np.fromiter((x == column[-1] for x in column), bool, len(column))
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield _runs(table.slice(0, cut))
        rest = table.slice(cut)
        if rest.num_rows > 64:
            code, first, lo, hi = _unpack(rest)
            rest = pa.Table.from_batches([_bitmaps(rest, code, first, lo, hi)])
        carry = rest
    if carry is not None and carry.num_rows:
        yield _runs(carry)


def millis(seconds: Column) -> Column:
    """Whole milliseconds of seconds; null for null, NaN and values that no 64-bit number holds."""
    ms = F.round(seconds.cast("double") * 1000)
    return F.when(F.abs(ms) < 2.0**63, ms).try_cast("bigint")


def run_intervals(intervals: DataFrame, break_ms: int = BREAK_MS) -> DataFrame:
    """record_kind, media_id, interval_kind (period, gap), from_ms, to_ms of intervals (record_kind, media_id, start_ms, end_ms)."""
    lo, hi = F.col("start_ms"), F.col("end_ms")
    shard = lambda c: F.shiftright(c, SHARD_BITS)
    sound = intervals.select(F.col("record_kind").cast("string"), F.col("media_id").cast("string"), lo.cast("bigint"), hi.cast("bigint")).where(lo < hi)
    sound = sound.withColumns({"s0": shard(lo), "s1": shard(hi - 1)})
    entity, keys = ["record_kind", "media_id"], ["record_kind", "media_id", "shard"]
    # the first and the last shard of each interval, which may be the same
    piece = lambda s, a, b: F.struct(s.alias("shard"), a.cast("bigint").alias("lo"), b.cast("bigint").alias("hi"))
    s0, s1, whole = F.col("s0"), F.col("s1"), F.lit(SHARD_MS)
    base = lambda s: F.shiftleft(s, SHARD_BITS)
    ends = F.when(s0 == s1, F.array(piece(s0, lo - base(s0), hi - base(s0)))).otherwise(F.array(piece(s0, lo - base(s0), whole), piece(s1, F.lit(0), hi - base(s1))))
    pieces = sound.select(*entity, F.explode(ends).alias("x")).select(*entity, "x.*")
    runs = pieces.mapInArrow(_partial, _BITMAPS).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge, _RUNS)

    # whole shards between: how many intervals begin and end to cover at each; where the sum is above zero, a stretch goes on
    turn = lambda s, n: F.struct(s.alias("shard"), F.lit(n).alias("n"))
    turns = sound.where(s1 - s0 > 1).select(*entity, F.explode(F.array(turn(s0 + 1, 1), turn(s1, -1))).alias("x")).groupBy(*entity, F.col("x.shard").alias("shard")).agg(F.sum("x.n").alias("n"))
    order = Window.partitionBy(*entity).orderBy("shard")
    open_now = turns.withColumn("covers", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("to", F.lead("shard").over(order)).where("covers > 0")
    stretches = open_now.select(*entity, F.lit(None).cast("bigint").alias("shard"), F.lit("edge").alias("interval_kind"), base(F.col("shard")).alias("from_ms"), base(F.col("to")).alias("to_ms"), F.lit(True).alias("first"), base(F.col("to")).alias("covered"))

    # two runs a shard at most, and the stretches: joined over shard borders
    edges = runs.where("interval_kind = 'edge'").withColumn("covered", F.lit(None).cast("bigint")).unionByName(stretches)
    time = Window.partitionBy(*entity).orderBy("from_ms", F.desc("to_ms"))
    earlier = time.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumns({"before": F.max("to_ms").over(earlier), "under": F.max("covered").over(earlier)})
    edges = edges.withColumn("opens", F.col("before").isNull() | (F.col("from_ms") > F.col("before"))).withColumn("island", F.count_if("opens").over(time.rowsBetween(Window.unboundedPreceding, 0)))
    passed = edges.where("shard is not null and from_ms < under").select(*keys).distinct()
    a, b = runs.where("interval_kind <> 'edge'").alias("a"), passed.alias("b")
    alike = F.col("a.shard") == F.col("b.shard")
    for c in entity:
        alike = alike & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    inner = a.join(b, alike, "left_anti").select(*entity, "interval_kind", "from_ms", "to_ms")
    period = edges.groupBy(*entity, "island").agg(F.min("from_ms").alias("from_ms"), F.max("to_ms").alias("to_ms"))
    period = period.select(*entity, F.lit("period").alias("interval_kind"), "from_ms", "to_ms")
    gap = edges.where("opens and first and before is not null").select(*entity, F.lit("gap").alias("interval_kind"), F.col("before").alias("from_ms"), F.col("from_ms").alias("to_ms"))
    out = inner.unionByName(period).unionByName(gap)
    return out.where((F.col("interval_kind") == "period") | (F.col("to_ms") - F.col("from_ms") <= break_ms))


def cue_and_segment_intervals(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """Both record kinds as intervals in whole milliseconds."""
    a = cues.select(F.lit("cue").alias("record_kind"), "media_id", F.col("start_ms").cast("bigint").alias("start_ms"), F.col("end_ms").cast("bigint").alias("end_ms"))
    b = segments.select(F.lit("segment").alias("record_kind"), "media_id", millis(F.col("start_sec")).alias("start_ms"), millis(F.col("end_sec")).alias("end_ms"))
    return a.unionByName(b)

"""Clean inputs, neighbours that skew can't hurt, and ordered folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of one key that a window sorts at once.
BUCKET = 4096


def clean_cues(cues: DataFrame) -> DataFrame:
    """media_id, cue_index, start_ms, end_ms, text: one row per cue, the first delivery; cues without sound bounds are no cues, null texts are empty."""
    # ties go by a hash of the text, so that steps that don't want the text needn't shuffle it
    own = cues.select("media_id", F.col("cue_index").cast("bigint"), F.col("start_ms").cast("bigint"), F.col("end_ms").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"), "ingested_at", F.xxhash64("text").alias("tie"))
    own = own.where("media_id is not null and cue_index is not null")
    first = F.row_number().over(Window.partitionBy("media_id", "cue_index").orderBy("ingested_at", "start_ms", "end_ms", "tie"))
    return own.withColumn("rn", first).where("rn = 1 and start_ms >= 0 and end_ms >= start_ms").drop("rn", "ingested_at", "tie")


def clean_segments(segments: DataFrame) -> DataFrame:
    """media_id, seg_idx, start_ms, end_ms, text, confidence: one row per segment, as `clean_cues`; times in whole milliseconds, which takes the float noise out."""
    ms = lambda c: F.when(F.abs(F.col(c)) < 1e15, F.round(F.col(c) * 1000)).cast("bigint")
    own = segments.select("media_id", F.col("seg_idx").cast("bigint"), ms("start_sec").alias("start_ms"), ms("end_sec").alias("end_ms"), F.coalesce("text", F.lit("")).alias("text"), F.col("confidence").cast("double"), "ingested_at", F.xxhash64("text").alias("tie"))
    own = own.where("media_id is not null and seg_idx is not null")
    first = F.row_number().over(Window.partitionBy("media_id", "seg_idx").orderBy("ingested_at", "start_ms", "end_ms", "tie"))
    return own.withColumn("rn", first).where("rn = 1 and start_ms >= 0 and end_ms >= start_ms").drop("rn", "ingested_at", "tie")


def words_of(segments: DataFrame) -> DataFrame:
    """media_id, seg_idx, word_idx, start_ms, end_ms, word of clean segments: tokens in equal slices of the segment's time.

    The first word of a media item has no leading space, all others do. Word numbers count through the media item.
    """
    from ..functions.text import WS

    tokens = segments.withColumn("tokens", F.filter(F.split("text", f"{WS}+"), lambda t: t != "")).withColumn("n", F.size("tokens").cast("bigint")).where("n > 0")
    before = with_running_sum(tokens, "seg_idx", "n", "offset")
    each = before.select("media_id", "seg_idx", "start_ms", "end_ms", "n", "offset", F.posexplode("tokens").alias("k", "token"))
    span = F.col("end_ms") - F.col("start_ms")
    at = lambda k: F.col("start_ms") + F.floor(span * k / F.col("n")).cast("bigint")
    idx = (F.col("offset") + F.col("k")).cast("bigint")
    return each.select("media_id", "seg_idx", idx.alias("word_idx"), at(F.col("k")).alias("start_ms"), at(F.col("k") + 1).alias("end_ms"), F.concat(F.when(idx > 0, " ").otherwise(""), "token").alias("word"))


def _bucketed(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("_bucket", F.floor(F.col(order) / BUCKET).cast("bigint"))


def with_previous(df: DataFrame, order: str, columns: list[str], prefix: str = "prev_", backwards: bool = False) -> DataFrame:
    """df with the values of the row before (or after) of the same media item.

    Windows run over buckets of the order column, so that a media item with a third of all rows is spread over many
    tasks; the neighbour across a bucket's edge comes from the bucket summary, which has one row per BUCKET rows.
    """
    d = _bucketed(df, order)
    sort = F.col(order).desc() if backwards else F.col(order)
    inside = Window.partitionBy("media_id", "_bucket").orderBy(sort)
    row = F.struct(F.col(order), *(F.col(c) for c in columns))
    d = d.withColumn("_near", F.lag(row).over(inside))
    edge = d.groupBy("media_id", "_bucket").agg((F.min_by if backwards else F.max_by)(row, order).alias("_last"))
    across = Window.partitionBy("media_id").orderBy(F.col("_bucket").desc() if backwards else "_bucket")
    edge = edge.withColumn("_edge", F.lag("_last").over(across)).drop("_last")
    d = d.join(edge, ["media_id", "_bucket"]).withColumn("_near", F.coalesce("_near", "_edge"))
    return d.select(*df.columns, *(F.col(f"_near.{c}").alias(prefix + c) for c in columns))


def with_neighbours(df: DataFrame, order: str, before: list[str], after: list[str]) -> DataFrame:
    """df with values of the row before (prev_...) and of the row after (next_...) of the same media item, in buckets as `with_previous`, by one exchange of the rows."""
    d = _bucketed(df, order)
    old, new = F.struct(*(F.col(c) for c in before)), F.struct(*(F.col(c) for c in after))
    inside = Window.partitionBy("media_id", "_bucket").orderBy(order)
    d = d.withColumns({"_old": F.lag(old).over(inside), "_new": F.lead(new).over(inside)})
    edge = d.groupBy("media_id", "_bucket").agg(F.max_by(old, order).alias("_last"), F.min_by(new, order).alias("_first"))
    across = Window.partitionBy("media_id").orderBy("_bucket")
    edge = edge.select("media_id", "_bucket", F.lag("_last").over(across).alias("_last"), F.lead("_first").over(across).alias("_first"))
    d = d.join(edge, ["media_id", "_bucket"]).withColumns({"_old": F.coalesce("_old", "_last"), "_new": F.coalesce("_new", "_first")})
    return d.select(*df.columns, *(F.col(f"_old.{c}").alias(f"prev_{c}") for c in before), *(F.col(f"_new.{c}").alias(f"next_{c}") for c in after))


def with_running_sum(df: DataFrame, order: str, column: str, name: str) -> DataFrame:
    """df with the sum of a column over all rows before of the same media item; in buckets as `with_previous`."""
    d = _bucketed(df, order)
    inside = Window.partitionBy("media_id", "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_own", F.coalesce(F.sum(column).over(inside), F.lit(0)))
    total = d.groupBy("media_id", "_bucket").agg(F.sum(column).alias("_total"))
    across = Window.partitionBy("media_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumn("_before", F.coalesce(F.sum("_total").over(across), F.lit(0))).drop("_total")
    return d.join(total, ["media_id", "_bucket"]).withColumn(name, (F.col("_own") + F.col("_before")).cast("bigint")).drop("_own", "_before", "_bucket")


#: Rows of one media item that begin within so many milliseconds are put in order together; islands and numbers are found over these stretches.
STRETCH_MS = 3_600_000


def with_number(df: DataFrame, order: list[str], name: str, size: int = STRETCH_MS) -> DataFrame:
    """df with the place of each row in its media item, from 0, in the order given: counted within stretches of `size` of the first order column, to which the counts of the stretches before are added."""
    d = df.withColumn("_stretch", F.floor(F.col(order[0]) / size).cast("bigint"))
    own = F.row_number().over(Window.partitionBy("media_id", "_stretch").orderBy(*order))
    across = Window.partitionBy("media_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    count = d.groupBy("media_id", "_stretch").agg(F.count("*").alias("_n")).select("media_id", "_stretch", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_n"))
    return d.withColumn("_own", own - 1).join(count, ["media_id", "_stretch"]).withColumn(name, (F.col("_own") + F.col("_n")).cast("bigint")).drop("_own", "_n", "_stretch")


def with_islands(df: DataFrame, order: list[str], reach: Column, cut: Callable[[Column, Column], Column], given: dict[str, Column] | None = None, size: int | None = None, lookahead: bool = False) -> DataFrame:
    """df with `island`, a number of stretches of a media item that no fold need look across.

    cut(seen, before) says whether a fold can begin anew at a row: seen is the greatest reach of all rows before it in the
    item, in the order given, before a struct of the row just before; both it and the row have the columns `given`. An item
    is parted at the first cut of each stretch of `size` of the first order column (STRETCH_MS by default), so that an item
    with a third of all rows spreads over many tasks. The cuts are found on narrow rows, within stretches, with what came
    before carried over their edges by one row a stretch; the rows themselves only meet the small table of cuts. With
    lookahead, the first row of an island also stands at the end of the one before, marked in a column `ahead`.
    """
    at, place = F.floor(F.col(order[0]) / (size or STRETCH_MS)).cast("bigint"), F.struct(*order)
    own = given or {"one": F.lit(1)}
    carried = F.struct(*(F.col(c) for c in own))
    narrow = df.select("media_id", *order, at.alias("_stretch"), reach.alias("_reach"), *(c.alias(n) for n, c in own.items() if n not in order))
    keys = ["media_id", "_stretch"]
    inside, across = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy("media_id").orderBy("_stretch")
    so_far = across.rowsBetween(Window.unboundedPreceding, -1)
    edge = narrow.groupBy(*keys).agg(F.max("_reach").alias("_r"), F.max_by(carried, place).alias("_b"))
    edge = edge.select(*keys, F.max("_r").over(so_far).alias("_r"), F.lag("_b").over(across).alias("_b"))
    d = narrow.withColumns({"_seen": F.max("_reach").over(inside.rowsBetween(Window.unboundedPreceding, -1)), "_before": F.lag(carried).over(inside)}).join(edge, keys)
    seen = F.greatest("_seen", "_r")
    new = seen.isNull() | F.coalesce(cut(seen, F.coalesce("_before", "_b")), F.lit(False))
    cuts = d.groupBy(*keys).agg(F.min(F.when(new, place)).alias("_cut"))
    cuts = cuts.withColumn("_last", F.max(F.when(F.col("_cut").isNotNull(), F.col("_stretch"))).over(so_far))
    d = df.withColumn("_stretch", at).join(cuts, keys)
    here = F.when(place >= F.col("_cut"), F.col("_stretch")).otherwise(F.col("_last"))
    if not lookahead:
        return d.withColumn("island", here).drop("_stretch", "_cut", "_last")
    twice = (place == F.col("_cut")) & F.col("_last").isNotNull()
    stand = lambda island, ahead: F.struct(island.alias("island"), F.lit(ahead).alias("ahead"))
    both = F.when(twice, F.array(stand(here, False), stand(F.col("_last"), True))).otherwise(F.array(stand(here, False)))
    return d.withColumn("_x", F.explode(both)).withColumns({"island": F.col("_x.island"), "ahead": F.col("_x.ahead")}).drop("_x", "_stretch", "_cut", "_last")


Kernel = Callable[[Iterator[tuple]], Iterator[tuple]]


def fold(df: DataFrame, order: list[str], kernel: Kernel, schema: T.StructType | str, key: str = "media_id", island: bool = False) -> DataFrame:
    """An ordered fold per media item: kernel gets the rows (without the key) in order and yields rows (without the key).

    Rows are streamed in sorted order, batch by batch; a kernel sees an iterator and holds only its state, so that even
    the largest media item is never in memory as a whole. schema is that of the kernel's rows. With `island`, df has a
    column of that name, and the fold runs over each island of an item alone (see `with_islands`); the kernel doesn't see it,
    its rows get it as a last column `island`.
    """
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    part = ["island"] if island else []
    whole = T.StructType([T.StructField(key, T.StringType()), *out.fields, *(T.StructField(c, T.LongType()) for c in part)])
    arrow = to_arrow_schema(whole)
    rest = [c for c in df.columns if c != key and c not in part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in (key, *part, *rest)))

        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*held)) if held else [() for _ in arrow]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        width = 1 + len(part)
        for k, group in groupby(rows(), key=lambda r: r[:width]):
            for r in kernel(x[width:] for x in group):
                held.append((k[0], *r, *k[1:]))
                if len(held) >= 10_000:
                    yield flush()
        if held:
            yield flush()

    return df.repartition(key, *part).sortWithinPartitions(key, *part, *order).mapInArrow(run, whole)

"""Mixing sources to target weights (problem 7).

Sizes are tokens of a public tokenizer. The size of the mix is the largest at which each source can hold its share
without any document being used more than max_repeats times. Every document of a source is used the same whole number
of times; the rest of the source's budget is filled by the documents with the smallest hashes. Their threshold is found
by hash histograms: tokens are summed by source and the top bits of the hash, the bucket in which the budget ends is
refined by the next bits, and so on to the last bit. The documents are then filtered by the threshold, never sorted.

The driver learns one boundary per source and level (sources are those of the targets, at most MAX_SOURCES).

Defined results: targets of sources without tokens can't be met: their shares are spread over the others in proportion,
and the report says so; documents of null or untargeted sources are not chosen; documents without tokens are used as
often as those around them by hash; null or non-positive shares and repeats below 1 exclude a source; a source listed
twice has the sum of its shares and the least of its repeats; empty tables give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runtime import cut_lineage
from .tokenizing import token_counts

MAX_SOURCES = 10_000
#: Bits of a document's hash, and those that each level looks at.
HASH_BITS, LEVEL_BITS = 48, 16


def _hash(seed: int) -> Column:
    """The hash of a document, 0 to 2**HASH_BITS - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 64 - HASH_BITS)


def _budgets(sized: DataFrame, targets: DataFrame) -> list[dict]:
    """Per targeted source: available tokens, share among those available, budget, whole repeats and remainder, and whether it is the one that bounds the mix."""
    own = targets.where("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("repeats"))
    have = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    rows = [r.asDict() for r in own.join(have, "source", "left").limit(MAX_SOURCES + 1).collect()]
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    able = [r for r in rows if r["tokens"]]
    whole = sum(r["share"] for r in able)
    # the largest mix that every source can serve
    total = min((r["tokens"] * r["repeats"] * whole / r["share"] for r in able), default=0.0)
    for r in rows:
        r["binding"] = bool(r["tokens"]) and r["tokens"] * r["repeats"] * whole / r["share"] == total
        r["tokens"], r["docs"] = r["tokens"] or 0, r["docs"] or 0
        r["adjusted"] = r["share"] / whole if r in able else 0.0
        r["budget"] = int(total * r["adjusted"] + 1e-6)
        r["full"] = r["budget"] // r["tokens"] if r["tokens"] else 0
        r["rest"] = r["budget"] - r["full"] * r["tokens"] if r["tokens"] else 0
    return rows


def _thresholds(hashed: DataFrame, budgets: list[dict]) -> dict[str, int]:
    """Per source, the hash below which documents are used once more than `full` times."""
    spark = hashed.sparkSession
    open_: dict[str, tuple[int, int]] = {r["source"]: (0, r["rest"]) for r in budgets if r["rest"] > 0}
    done: dict[str, int] = {}
    for level in range(HASH_BITS // LEVEL_BITS):
        if not open_:
            break
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        bounds = spark.createDataFrame([(s, prefix, rest) for s, (prefix, rest) in open_.items()], "source string, prefix bigint, rest bigint")
        inside = hashed.join(F.broadcast(bounds), "source").where(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        # at most 2**LEVEL_BITS buckets a source are left of all documents
        buckets = inside.groupBy("source", "rest", F.shiftright("h", shift).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
        run = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        edge = buckets.withColumn("run", run).where("run > rest").groupBy("source").agg(F.min(F.struct("bucket", "run", "tokens")).alias("e")).select("source", "e.*")
        found = {r["source"]: r for r in edge.collect()}
        for s, (prefix, rest) in list(open_.items()):
            if s in found:
                open_[s] = (found[s]["bucket"], rest - (found[s]["run"] - found[s]["tokens"]))
            else:  # all that is inside fits
                del open_[s]
                done[s] = (prefix + 1) << (shift + LEVEL_BITS)
    # what is left is one hash each, whose documents would exceed the budget
    return done | {s: prefix for s, (prefix, _) in open_.items()}


def choose(sized: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens, repeats) of the chosen documents, and the report of the shares by source. sized: doc_id, source, tokens; it is read several times."""
    spark = sized.sparkSession
    budgets = _budgets(sized, targets)
    names = [r["source"] for r in budgets]
    hashed = sized.where(F.col("source").isin(names) if names else F.lit(False)).withColumn("h", _hash(seed))
    below = _thresholds(hashed, budgets)
    rows = [(r["source"], r["share"], r["adjusted"], r["repeats"], r["tokens"], r["docs"], r["budget"], r["binding"], r["full"], below.get(r["source"], 0)) for r in budgets]
    plan = spark.createDataFrame(rows, "source string, target_share double, adjusted_share double, max_repeats int, available_tokens bigint, available_docs bigint, budget bigint, binding boolean, full int, below bigint")
    own = hashed.join(F.broadcast(plan.select("source", "full", "below")), "source")
    repeats = (F.col("full") + (F.col("h") < F.col("below")).cast("int")).cast("int")
    chosen = own.withColumn("repeats", repeats).where("repeats > 0").select("doc_id", "source", "tokens", "repeats")
    used = chosen.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    everything = Window.partitionBy()
    report = plan.drop("full", "below").join(F.broadcast(used), "source", "left").na.fill(0, ["docs", "tokens", "most_repeats"])
    report = report.withColumn("actual_share", F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(everything)))
    return chosen, report


def mix(documents: DataFrame, targets: DataFrame, path: str | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """`choose` over documents, which are tokenized once; their sizes are kept in the checkpoint folder."""
    return choose(cut_lineage(token_counts(documents, path)), targets, seed)

"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a queue of its documents in a fixed shuffled order, gone through up to ``repeats``
times. A copy of a document finishes at the virtual time (words its source has sent up to and
with it) / (the source's weight). All copies in order of that time, cut where the total budget is
reached, are the mix: at any time the sources that have something left have sent words in
proportion to their weights, and a source that runs dry leaves its share to the others.

Sums along a queue are taken in two steps, within buckets of the shuffled order and over the
buckets, so a source with a third of all rows is spread over thousands of groups. The same holds
for the global order: only the bucket of virtual time in which the budget ends is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm._common import free_name, ROW, WORD, materialise, row_by_row, text_of, with_row_key

#: Rows a bucket should hold; there are 16 to 16 ** 4 buckets of a source.
BUCKET_ROWS = 1_000
REPEATS = 3
SEED = "mix-1:"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """sizes: source (unique), source_size and any other columns. Adds ordinal, weight, level and target.

    Weights go round by the sources' order by code point, null last. Targets share the sum of all
    sizes by weight; none exceeds ``repeats`` times its source's size, and what is over is shared
    anew among the rest: a common ``level`` (words per unit of weight) at which each source has
    min(cap, level * weight). The windows run over the list of sources, not over documents.
    """
    every = Window.partitionBy()
    numbered = sizes.withColumn("ordinal", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("ordinal") % len(weights) + 1).cast("int"))
    )
    capped = numbered.withColumns({"cap": repeats * F.col("source_size"), "total": F.sum("source_size").over(every)})
    by_ratio = Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), "ordinal")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levelled = capped.withColumns(
        {"if_uncapped": (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after), "own": F.col("cap") / F.col("weight")}
    )
    level = F.min(F.when(F.col("if_uncapped") <= F.col("own"), F.struct("own", "ordinal", "if_uncapped"))).over(every)["if_uncapped"]
    return (
        levelled.withColumn("level", F.coalesce(level, F.max("own").over(every)))
        .withColumn("target", F.when(F.col("own") <= F.col("level"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")))
        .drop("cap", "total", "if_uncapped", "own")
    )


def mix(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", keep: tuple[str, ...] = (), weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """One row per row of ``df``: doc_id, source, size, source_size, target, copies, taken and the
    columns in ``keep``. taken is size times copies, 0 to ``repeats``.

    Null text has size 0; null sources form one source, the last. Rows with the same id take
    places by size. The taken words of all sources together reach the sum of all sizes but for
    less than a document; those of a source are off its target by less than one of its documents. The shuffle is
    md5 of ``seed`` and the id, so reruns agree. An empty table gives no rows.
    """
    base = row_by_row(
        df,
        df.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("queue"),
            F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("place"), *keep,
        ),
        "sizes",
    )
    digits = min(4, max(1, math.ceil(math.log(max(1, base.count()) / BUCKET_ROWS + 1, 16))))
    base = base.withColumn("bucket", F.substring("place", 1, digits))
    sums = materialise(base.groupBy("queue", "source", "bucket").agg(F.sum("size").alias("words"), F.max("size").alias("longest")), "bucket-sums")
    targets = source_targets(sums.groupBy("queue", "source").agg(F.sum("words").alias("source_size")), weights, repeats)
    earlier = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select("queue", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset")).join(targets.drop("source"), "queue")
    own = Window.partitionBy("queue", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = base.withColumn("run", F.sum("size").over(own)).join(start, ["queue", "bucket"]).withColumn("sent", F.col("offset") + F.col("run"))
    queued = materialise(queued.drop("queue", "bucket", "offset", "run"), "queued")
    # Where the budget ends: first the bucket of virtual time, then the copy.
    budget, longest = sums.select(F.sum("words"), F.max("longest")).first()
    finish = [(r * F.col("source_size") + F.col("sent")) / F.col("weight") for r in range(repeats)]
    if not budget:
        return queued.select("doc_id", "source", "size", "source_size", "target", F.lit(0).alias("copies"), F.lit(0).cast("long").alias("taken"), *keep)
    span = targets.select(F.max("level")).first()[0] + longest + 1  # by then every source has sent its target
    n = 16**digits
    copies = queued.where("size > 0").select(
        "size", "ordinal", "place", "doc_id", F.explode(F.array(*finish)).alias("finish")
    ).where(F.col("finish") <= span).withColumn("slot", F.floor(F.col("finish") / F.lit(span) * n))
    slots = copies.groupBy("slot").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy().orderBy("slot")
    ends = slots.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") >= budget).orderBy("slot").select("slot", F.col("upto") - F.col("words")).first()
    order = Window.partitionBy("slot").orderBy("finish", "ordinal", "place", "doc_id", "size")
    cut = (
        copies.where(F.col("slot") == ends[0]).withColumn("upto", ends[1] + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .where(F.col("upto") > budget).orderBy("finish", "ordinal", "place").select("finish", "ordinal").first()
    )
    inside = [F.lit(True) if cut is None else (f < cut[0]) | ((f == cut[0]) & (F.col("ordinal") < cut[1])) for f in finish]
    if cut is None:
        inside = [F.floor(f / F.lit(span) * n) <= ends[0] for f in finish]
    taken = sum((x.cast("long") for x in inside[1:]), inside[0].cast("long"))
    taken = F.when(F.col("size") > 0, taken).otherwise(0)
    return queued.select("doc_id", "source", "size", "source_size", "target", taken.alias("copies"), (taken * F.col("size")).alias("taken"), *keep)


def take(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mix itself: each row of ``df`` as often as ``mix`` takes it, with the columns of ``df``.

    Rows keep their place in their file as a key, so repeated rows and null ids are told apart.
    Texts of size 0 are never taken, as they add no words.
    """
    keyed = with_row_key(df)
    copies, turn = (free_name(keyed, x) for x in ("copies", "turn"))
    wanted = mix(keyed, text, doc_id, source, keep=ROW, **options).where("copies > 0").select(*ROW, F.col("copies").alias(copies))
    each = keyed.join(wanted.hint("merge"), list(ROW)).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return each.select(*(F.col(f"`{c}`") for c in df.columns))

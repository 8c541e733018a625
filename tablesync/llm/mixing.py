"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source is cut into blocks of ``block_rows`` documents in a shuffled order. Weights become the smallest integer shares
that have exactly their proportions, and the period is the sum of the shares;
block ``c`` of a source with share ``p`` of period ``P`` is released at slot ``floor(c * P / p)`` and due by
``ceil((c + 1) * P / p)``. Earliest deadline first among the released blocks fills one period; the shares add up to the
period, so the windows are always met, and at every slot each source is less than one block away from its weight. The
schedule repeats with the period, so one period is all that is ever computed, however many blocks there are. Only weights
whose exact period is longer than ``MAX_PERIOD`` are rounded, to whole slots of about that many.

Sources of one share have the same windows and are served in turn, so the schedule looks at one candidate a share.

When a source ends, its slots stay empty and the others keep their proportions. No row is dropped or repeated.

Defined cases: a null source is a source of its own; sources without a positive weight get one slot each
of a period, which is made so long that all of them have one slot of ``PERIOD`` together; sources and weights may tie (order of the source's text decides); documents that repeat an id and a source are
interchangeable; an empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesync.llm.common import restored, shielded, written

#: Slots among which all sources without a positive weight have one.
PERIOD = 1000
#: Slots of the longest period that is computed. Weights that need a longer one are rounded, at least one slot a source.
MAX_PERIOD = 1 << 18
#: Slots that are appended one by one; longer periods are lists of such stretches.
STRETCH = 1024
#: Digits of given weights that count, from the first of the largest weight on.
DIGITS = 10
#: Rows of (source, slots) that a join may broadcast; beyond it Spark joins by its own choice, same rows.
BROADCAST_SOURCES = 100_000


def source_key(source: Column) -> Column:
    """A key that is never null: sources that are null stay apart from all texts."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def shares(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """Integer shares of a period, in the proportions of the weights: (key, share) from (key, weight long); at least 1."""
    known = weights.select("key", F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0)).cast("long").alias("weight"))
    euclid = """aggregate(sequence(1, 92), struct(g AS a, x AS b),
        (s, i) -> if(s.b = 0, s, struct(s.b AS a, s.a % s.b AS b)), s -> s.a)"""
    found = known.agg(
        F.sum(F.col("weight").cast("decimal(38,0)")).alias("total"), F.collect_set("weight").alias("w"),
        F.count_if(F.col("weight") == 0).alias("idle"), F.count(F.lit(1)).alias("n"),
    )
    found = found.select("total", "idle", "n", F.expr(f"aggregate(w, 0L, (g, x) -> {euclid})").alias("divisor")).first()
    total, divisor = int(found["total"] or 0), found["divisor"] or 1
    # Idle sources: the others take as many slots as they need to keep all but one of ``period``.
    exact = total // divisor
    times = max(1, -(-period * found["idle"] // exact)) if exact else 1
    if exact * times + found["idle"] <= max(MAX_PERIOD, found["n"]):
        share = F.expr(f"weight div {divisor}L * {times}L")
    else:
        slots = max(MAX_PERIOD - found["idle"], 1)
        share = F.expr(f"cast((2 * cast(weight as decimal(20,0)) * {slots} + {total}) div (2 * cast({total} as decimal(38,0))) as long)")
    return known.select("key", F.greatest(F.lit(1).cast("long"), share).alias("share"))


def schedule(parts: DataFrame) -> DataFrame:
    """One period by earliest deadline first: (key, share, slots array<int>, period), slots in order."""
    row = parts.agg(F.array_sort(F.collect_list(F.struct("key", F.col("share").cast("long").alias("share")))).alias("s"))
    sources = row.select(F.posexplode("s").alias("i", "x")).select("i", "x.key", "x.share")
    alike = sources.groupBy("share").agg(F.sort_array(F.collect_list("i")).alias("members"))
    row = alike.agg(
        F.sort_array(F.collect_list(F.struct("share", "members"))).alias("k"), F.sum(F.col("share") * F.size("members")).alias("n")
    ).where("n > 0")

    def candidate(j: str, g: str) -> str:
        """The next block of a share of which ``g`` blocks are placed: members in turn, then their next blocks."""
        c, p = f"({g} div size(k[{j}].members))", f"k[{j}].share"
        return f"""struct((({c} + 1) * n + {p} - 1) div {p} AS due, k[{j}].members[cast({g} % size(k[{j}].members) as int)] AS i,
            {j} AS j, {g} AS g, ({c} * n) div {p} AS released)"""

    # State: the next block of each share, and the picks. The inner aggregate over one element binds the pick.
    step = f"""
        aggregate(array(array_min(filter(st.ahead, x -> x.released <= t))), st, (a, b) -> struct(
            transform(a.ahead, x -> if(x.j = b.j, {candidate("x.j", "(x.g + 1)")}, x)) AS ahead, concat(a.picks, array(b.i)) AS picks))"""
    stretch = f"""
        aggregate(sequence(u * {STRETCH}, least(n, (u + 1) * {STRETCH}) - 1), struct(o.ahead AS ahead, cast(array() AS array<int>) AS picks),
            (st, t) -> {step}, st -> struct(st.ahead AS ahead, concat(o.picks, array(st.picks)) AS picks))"""
    row = row.select("n", F.expr(f"""
        flatten(aggregate(sequence(0L, (n - 1) div {STRETCH}),
            struct(transform(k, (x, j) -> {candidate("j", "0L")}) AS ahead, cast(array() AS array<array<int>>) AS picks),
            (o, u) -> {stretch}, o -> o.picks))""").alias("picks"))
    slots = row.select("n", F.posexplode("picks").alias("slot", "i")).groupBy("i").agg(
        F.sort_array(F.collect_list("slot")).alias("slots"), F.first("n").alias("period")
    )
    return sources.join(slots, "i").select("key", "share", "slots", "period")


def numbered(rows: DataFrame, total: int, bucket_rows: int) -> DataFrame:
    """Column ``__index``: place of a row within its key, in the order of ``__order`` (hexadecimal digest) and ``__id``.

    A key may hold a third of all rows, so rows are numbered within buckets of the uniform digest, and the buckets of a
    key are added up.
    """
    buckets = max(1, -(-total // bucket_rows))
    digits = F.conv(F.substring("__order", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("__bucket", F.shiftright(digits * F.lit(buckets), 32))
    sizes = rows.groupBy("__key", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("__key").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("__key", "__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(W.partitionBy("__key", "__bucket").orderBy("__order", "__id"))
    rows = rows.join(sizes, ["__key", "__bucket"])
    return rows.withColumn("__index", F.col("__before") + place - 1).drop("__bucket", "__before")


def mix(
    docs: DataFrame, weights: DataFrame | None = None, doc_id: str = "doc_id", source: str = "source", block_rows: int = 16,
    period: int = PERIOD, bucket_rows: int = 4096,
) -> DataFrame:
    """All documents with their place in the mix: ``block`` of the source, ``slot`` of the block, ``pos`` in the block.

    Read in the order of (slot, pos), every stretch has the sources in their target weights. ``weights`` has rows
    (source, weight); by default a source weighs the whole part of the square root of its number of documents. Columns of
    these three names are replaced.
    """
    named, (key, origin) = shielded(docs, doc_id, source)
    rows = named.withColumns({
        "__key": source_key(F.col(origin)), "__id": F.col(key),
        "__order": F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")),
    })
    counts = written(rows.groupBy(F.col("__key").alias("key")).agg(F.count(F.lit(1)).alias("n")), "mix-sources")
    if weights is None:
        weights = counts.select("key", F.floor(F.sqrt("n")).alias("weight"))
    else:
        given = weights.select(source_key(F.col("source")).alias("key"), F.col("weight").cast("double").alias("weight"))
        given = given.groupBy("key").agg(F.max("weight").alias("weight"))
        # Any positive unit will do for weights: a power of ten keeps the proportions of decimal numbers.
        top = given.where("weight > 0").agg(F.max("weight")).first()[0]
        power = math.floor(math.log10(top)) if top else 0
        unit = F.round(F.col("weight") / F.lit(10.0**power) * F.lit(10.0 ** (DIGITS - 1))).cast("long")
        unit = F.when(F.col("weight") > 0, F.greatest(F.lit(1).cast("long"), unit))
        weights = counts.select("key").join(given, "key", "left").select("key", unit.alias("weight"))
    plan = written(schedule(shares(weights, period)), "mix-schedule")
    n_sources, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    plan = plan.withColumnRenamed("key", "__key")
    rows = numbered(rows, total, bucket_rows).join(F.broadcast(plan) if n_sources <= BROADCAST_SOURCES else plan, "__key")
    rows = rows.withColumn("block", F.expr(f"__index div {block_rows}"))
    slot = F.expr("block div share * period + slots[cast(block % share as int)]")
    return restored(rows, docs.columns, {"block": F.col("block"), "slot": slot, "pos": F.col("__index") % block_rows})


def in_order(mixed: DataFrame) -> DataFrame:
    """The mix as files: range-partitioned and sorted by slot and place, so that reading files in turn gives the mix."""
    return mixed.repartitionByRange("slot", "pos").sortWithinPartitions("slot", "pos")

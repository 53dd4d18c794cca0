"""Ranks, order statistics and cuts over whole tables or large groups without gathering them in one task.

Order statistics come from histograms that are refined: a pass counts the rows of each bin of a range, the next
looks only into the bins that hold the wanted ranks, until a bin holds one value.  Each pass shuffles at most
``BINS`` counts a range and task, whatever the number of rows, and the answer is exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize

_ROWS = 33  # bits of a row's number within its partition, as monotonically_increasing_id gives it


def numbered(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``df`` with each row's number (from 1) in ``order``, stored in the shared folder.

    Rows are dealt by ranges of ``order`` and sorted within; a row's number is its place in its partition and the
    rows of the partitions before it, of which the driver holds one number each.  Rows that tie in all of
    ``order`` come in any order; an empty table gives an empty one.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    stored = materialize(placed, "numbered")
    part = F.shiftright("__at", _ROWS)
    before, bases = 0, []
    for p, n in sorted(stored.groupBy(part.alias("part")).count().collect()):
        bases.append((p, before))
        before += n
    base = F.broadcast(df.sparkSession.createDataFrame(bases, "__part long, __before long"))
    ranked = stored.join(base, part == F.col("__part")).withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << _ROWS) - 1)) + 1)
    out = ranked.drop("__at", "__part", "__before")
    out.stored_at = stored.stored_at
    return out


def value_ranks(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """keys, ``value``, ``rank`` (average rank of the rows of that value within ``keys``) and ``n`` (rows of the group); nulls take no part.

    A row for each value of a group.  Values are dealt over tasks by ranges, so a group of any size is no task of its
    own: a value's rank is the rows before it in its part of the group and those of the parts before.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    stored = materialize(counts.repartitionByRange(*keys, value).withColumn("__part", F.spark_partition_id()), "values")
    group, order = Window.partitionBy(*[f"__{k}" for k in keys]), Window.partitionBy("__part", *keys).orderBy(value)
    parts = stored.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__at")).agg(F.sum("__c").alias("__all"))
    parts = parts.withColumns({"__before": F.sum("__all").over(group.orderBy("__at")) - F.col("__all"), "n": F.sum("__all").over(group)})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("__part") == F.col("__at"))
    rank = F.col("__before") + F.col("__to") - F.col("__c") + (F.col("__c") + 1) / 2.0
    return stored.withColumn("__to", F.sum("__c").over(order)).join(parts, same).select(*keys, value, rank.alias("rank"), "n")


BINS = 1024


def order_statistics(df: DataFrame, value: str, ranks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``ranks`` (keys, rank from 1) with the value of that rank among the group's rows; nulls take no part.

    Ranges are halved on the plain scale and on that of the inverse hyperbolic sine in turn, so that values of any
    spread are told apart in few passes.  Ranks outside the group are left out.
    """
    keys = ["__g", *keys]
    rows = df.where(F.col(value).isNotNull()).withColumn("__g", F.lit(0)).select(*keys, F.col(value).alias("__v"))
    ends = rows.groupBy(*keys).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count("*").alias("__n"))
    asked = ranks.withColumn("__g", F.lit(0)).join(ends, keys).where(F.col("rank").between(1, F.col("__n"))).withColumn("below", F.lit(0).cast("long")).drop("__n")
    state, turn = materialize(asked, "ranks"), 0
    while not state.where("lo < hi").isEmpty():
        scale = (lambda c: F.asinh(F.col(c).cast("double"))) if turn % 2 else (lambda c: F.col(c) / 2.0)
        span = scale("hi") - scale("lo")
        # ends that the scale cannot tell apart are told apart themselves
        place = F.when(F.col("__v") == F.col("lo"), 0).when(F.col("__v") == F.col("hi"), BINS - 1).when(span > 0, F.least(F.floor((scale("__v") - scale("lo")) / span * BINS), F.lit(BINS - 1))).otherwise(BINS // 2)
        ranges = state.where("lo < hi").select(*keys, "lo", "hi").distinct()
        met = rows.join(ranges, keys).where(F.col("__v").between(F.col("lo"), F.col("hi")))
        bins = met.groupBy(*keys, "lo", "hi", place.cast("int").alias("__bin")).agg(F.count("*").alias("n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        up_to = F.sum("n").over(Window.partitionBy(*keys, "lo", "hi").orderBy("__bin"))
        hit = state.where("lo < hi").join(bins.withColumn("__to", up_to), [*keys, "lo", "hi"]).where((F.col("rank") > F.col("below") + F.col("__to") - F.col("n")) & (F.col("rank") <= F.col("below") + F.col("__to")))
        closer = hit.select(*[c for c in state.columns if c not in ("lo", "hi", "below")], F.col("__low").alias("lo"), F.col("__high").alias("hi"), (F.col("below") + F.col("__to") - F.col("n")).alias("below"))
        before, state = state, materialize(state.where("lo >= hi").unionByName(closer), "ranks")
        discard(before)
        turn += 1
    out = state.withColumn("value", F.col("lo")).drop("__g", "lo", "hi", "below")
    out.stored_at = state.stored_at
    return out


def quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """keys and ``q``, an array of the group's quantiles, between neighbours in proportion; groups without values are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("__n"))
    each = counts.select(*keys, "__n", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("__i", "__p"))
    at = (F.col("__n") - 1) * F.col("__p")
    wanted = materialize(each.select(*keys, "__i", F.floor(at).alias("__f"), F.ceil(at).alias("__c"), (at - F.floor(at)).alias("__share")), "wanted")
    ranks = wanted.select(*keys, (F.col("__f") + 1).alias("rank")).union(wanted.select(*keys, F.col("__c") + 1)).distinct()
    found = order_statistics(df, value, ranks, keys)
    low, high = (found.select(*keys, (F.col("rank") - 1).alias(c), F.col("value").cast("double").alias(f"{c}v")) for c in ("__f", "__c"))
    both = wanted.join(low, [*keys, "__f"]).join(high, [*keys, "__c"])
    mixed = (1 - F.col("__share")) * F.col("__fv") + F.col("__share") * F.col("__cv")
    return both.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", mixed.alias("v")))), lambda s: s["v"]).alias("q")).where(F.size("q") > 0)


def first_rows(df: DataFrame, n: int, key: Column, tie: str) -> DataFrame:
    """The ``n`` rows of ``df`` that come first by ``key`` (a number), ties by ``tie``: a filter at the cut's value.

    Only rows that tie with the cut are put in order.
    """
    keyed = df.withColumn("__key", key)
    cut = order_statistics(keyed, "__key", df.sparkSession.createDataFrame([(n,)], "rank long")).first()
    if cut is None:  # no more rows than that
        return df
    top = cut["value"]
    less = keyed.where(F.col("__key") < top)
    room = n - less.count()
    ties = numbered(keyed.where(F.col("__key") == top), tie, name="__place").where(F.col("__place") <= room)
    return less.drop("__key").unionByName(ties.drop("__key", "__place"))


def repeatable_draw(id_col: str | Column, seed: int = 0) -> Column:
    """A number from MD5 of seed and id, so that other engines repeat a draw."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")

"""Validity in time: the as-of filter, supersession, and the as-of join over dyadic time nodes.

All intervals are half-open, [from, to); an open end is null. Times are timestamps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import micros

#: Time is cut into 2**LEVELS base cells of 2**CELL_BITS microseconds (38 hours) each, from 1970 to 2112.
CELL_BITS = 37
LEVELS = 15
#: Supersession cuts the timeline of an entity into blocks of 2**BLOCK_BITS microseconds (51 days).
BLOCK_BITS = 42


def as_of(df: DataFrame, at: Column, start: str = "available_at", end: str = "superseded_at") -> DataFrame:
    """Rows in force at an instant: start <= at and (end null or end > at). A null start is never in force."""
    return df.filter((F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at)))


def superseded_by(df: DataFrame, entity: list[str], time: str, out: str) -> DataFrame:
    """Add `out`: the least `time` of the same entity that is strictly greater, null if there is none.

    Equal times do not supersede each other. Rows with a null time get null; null entity values form an
    entity of their own. An entity may hold any share of the rows: the search runs over distinct times in
    blocks of the entity's timeline, so no task sees more than one block, and blocks are linked by their
    first times alone.
    """
    names = [f"__e{i}" for i in range(len(entity))]
    block = F.shiftright(micros(F.col("__t")), BLOCK_BITS)
    times = df.filter(F.col(time).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(entity, names)], F.col(time).alias("__t"))
    times = times.distinct().withColumn("__b", block)
    within = Window.partitionBy(*names, "__b").orderBy("__t")
    heads = times.groupBy(*names, "__b").agg(F.min("__t").alias("__first"))
    heads = heads.withColumn("__next_block", F.lead("__first").over(Window.partitionBy(*names).orderBy("__b"))).select(*[F.col(n).alias("h" + n) for n in names], F.col("__b").alias("h__b"), "__next_block")
    linked = times.withColumn("__next", F.lead("__t").over(within))
    on = [F.col(n).eqNullSafe(F.col("h" + n)) for n in names] + [F.col("__b") == F.col("h__b")]
    linked = linked.join(heads, on, "left").select(*names, "__t", F.coalesce("__next", "__next_block").alias(out))
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(entity, names)] + [F.col(time) == F.col("__t")]
    return df.join(linked, on, "left").drop(*names, "__t")


def _cell(t: Column) -> Column:
    """The base cell of an instant; instants outside the covered span fall into its first or last cell."""
    return F.greatest(F.lit(0), F.least(F.lit(2**LEVELS - 1), F.shiftright(micros(t), CELL_BITS).cast("int")))


def dyadic_cover(lo: Column, hi: Column) -> Column:
    """The dyadic nodes, as level * 2**32 + index, that tile the base cells [lo, hi): at most two a level."""

    def at(level: Column) -> Column:
        # the cells [a, b) remain at this level: an odd a gives the node a, an odd b the node b - 1
        size = F.call_function("shiftleft", F.lit(1), level)
        a = F.call_function("shiftright", lo + size - 1, level)
        b = F.call_function("shiftright", hi, level)
        key = level.cast("long") * F.lit(2**32)
        left = F.when((a < b) & (a % 2 == 1), key + a)
        right = F.when((a < b) & (b % 2 == 1) & ~((a % 2 == 1) & (a == b - 1)), key + b - 1)
        return F.array(left, right)

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at)))


def dyadic_ancestors(cell: Column) -> Column:
    """The nodes that enclose a base cell, one a level."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda level: level.cast("long") * F.lit(2**32) + F.call_function("shiftright", cell, level))


def as_of_join(events: DataFrame, facts: DataFrame, event_keys: list[str], fact_keys: list[str], at: str, start: str, end: str, keep: list[str], until: str | None = None) -> DataFrame:
    """Each event with every fact of its key in force at the event's time.

    Facts are decomposed into dyadic time nodes and events look up all nodes that enclose their instant, so
    the join is an equi-join on (key, node); an exact half-open check follows. `until` names a second end of
    the interval (a later version's start), `keep` the columns of the facts to return; columns of the events
    keep their names, and a kept column must not clash with one of them. Events or facts with a null key or
    time match nothing; ties all match. A key that holds most of the rows is spread over its time nodes, and
    within a node adaptive execution splits it.
    """
    stop = F.col(end) if until is None else F.least(F.col(end), F.col(until))
    f = facts.filter(F.col(start).isNotNull()).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(fact_keys)], F.col(start).alias("__from"), stop.alias("__to"), *keep)
    # the cell in which the interval ends counts too, as it may hold earlier instants
    f = f.filter(F.col("__to").isNull() | (F.col("__from") < F.col("__to")))
    f = f.withColumns({"__lo": _cell(F.col("__from")), "__hi": F.when(F.col("__to").isNull(), F.lit(2**LEVELS)).otherwise(_cell(F.col("__to")) + 1)})
    f = f.withColumn("__node", F.explode(dyadic_cover(F.col("__lo"), F.col("__hi")))).drop("__lo", "__hi")
    e = events.filter(F.col(at).isNotNull()).withColumn("__cell", _cell(F.col(at)))
    e = e.withColumn("__enode", F.explode(dyadic_ancestors(F.col("__cell")))).drop("__cell")
    on = [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(event_keys)] + [F.col("__enode") == F.col("__node"), F.col("__from") <= F.col(at), F.col("__to").isNull() | (F.col("__to") > F.col(at))]
    return e.join(f, on, "inner").drop("__enode", "__node", "__from", "__to", *[f"__k{i}" for i in range(len(fact_keys))])


def latest_fact(matches: DataFrame, event: list[str], precedence: list[Column]) -> DataFrame:
    """One match an event: the first in the given order, which must be total to be deterministic."""
    w = Window.partitionBy(*event).orderBy(*precedence)
    return matches.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")

"""Problem 8: filling containers of fixed capacity, by hierarchical multi-length packing.

Documents are routed by length to tiers of context windows: the capacity, its half, quarter and eighth. Each tier
is packed on its own into windows of its size: its documents open them, and the gaps of the long windows are filled
from the same and the shorter tiers. A document whose window would stay too empty moves up to the longest windows.
Windows then make up containers, two halves or four quarters each, and containers are dealt to step groups so that
the groups' work is balanced.

Only lengths decide, and there are no more of them than the capacity: the counts by length go to the driver and
come back as a short list of window patterns with multiplicities. Documents find their place in it by their rank
within their length, counted in parts whose number follows from the count, so no length, however common, is
gathered in one task.
"""

from __future__ import annotations

import bisect
import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import Scratch
from ..sources.tables import read
from .arrow import map_rows
from .tokens import VOCABULARY, count_tokens

CAPACITY = 2_048
#: Windows of the tiers, as fractions of the capacity: one by each of these.
TIERS = (1, 2, 4, 8)
#: A window of a shorter tier is closed only if such a share of it is filled; else its document moves up.
FULL = 0.995
#: Containers of a step group, whose work is balanced over the groups.
STEP = 64
#: Items of a length that are ranked in one part at most, on average.
PART = 200_000


class Pool:
    """Items left by length, and the lengths there are in order."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: n for k, n in counts.items() if n > 0}
        self.lengths = sorted(self.left)

    def take(self, k: int, n: int) -> None:
        self.left[k] -= n
        if self.left[k] == 0:
            del self.left[k]
            self.lengths.pop(bisect.bisect_left(self.lengths, k))

    def fill(self, first: int, room: int) -> dict[int, int]:
        """A pattern that begins with one item and takes the longest lengths that fit, again and again."""
        pattern = {first: 1}
        room -= first
        top = len(self.lengths)
        while room > 0:
            i = bisect.bisect_right(self.lengths, room, 0, top) - 1
            if i < 0:
                break
            k = self.lengths[i]
            top = i
            free = self.left[k] - pattern.get(k, 0)
            if free > 0:
                n = min(free, room // k)
                pattern[k] = pattern.get(k, 0) + n
                room -= n * k
        return pattern


def pack_windows(counts: dict[int, int], capacity: int, tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Patterns (window size, multiplicity, [(length, times), ...]) that place every item of 1 to capacity tokens once."""
    pool = Pool({k: n for k, n in counts.items() if 0 < k <= capacity})
    out = []
    sizes = sorted({capacity // t for t in tiers if capacity // t > 0} | {capacity}, reverse=True)
    up: dict[int, int] = {}

    def close(size: int, pattern: dict[int, int]) -> None:
        times = min(pool.left[k] // n for k, n in pattern.items())
        out.append((size, times, sorted(pattern.items(), reverse=True)))
        for k, n in pattern.items():
            pool.take(k, n * times)

    for size, below in zip(sizes, [*sizes[1:], 0]):
        while (i := bisect.bisect_right(pool.lengths, size) - 1) >= 0 and pool.lengths[i] > below:
            k = pool.lengths[i]
            pattern = pool.fill(k, size)
            if size < capacity and sum(j * n for j, n in pattern.items()) < FULL * size:
                up[k] = pool.left[k]
                pool.take(k, pool.left[k])
            else:
                close(size, pattern)
    pool = Pool(up)
    while pool.lengths:
        close(capacity, pool.fill(pool.lengths[-1], capacity))
    return out


class Plan:
    """Where the n-th item of each length goes: its container, position, window and step group."""

    def __init__(self, patterns: list, capacity: int, step: int = STEP):
        slots: dict[int, list] = {}
        used: dict[int, int] = {}
        self.tails: dict[tuple[int, int], tuple[int, int]] = {}
        base, tail = 0, []
        order = sorted(patterns, key=lambda p: (-p[0], -sum(k * k * n for k, n in p[2])))
        for size, group in itertools.groupby(order, key=lambda p: p[0]):
            each, at = capacity // size, 0
            for _, times, pattern in group:
                pos = 0
                for k, n in pattern:
                    slots.setdefault(k, []).append((used.get(k, 0), n, at, pos, size, each, base))
                    used[k] = used.get(k, 0) + times * n
                    pos += n
                at += times
            # what is left of a tier beyond whole containers shares containers with what is left of the others
            whole = at // each
            tail += [(size, i, base) for i in range(whole * each, at)]
            base += whole
        room = 0
        for size, i, start in tail:
            if size > room:
                base, room = base + 1, capacity
            self.tails[size, i] = (base - 1, capacity - room)
            room -= size
        self.containers = base
        self.groups = max(1, -(-base // step))
        self.capacity = capacity
        self.table = {k: (np.array([s[0] for s in v]), v) for k, v in slots.items()}
        #: Windows of each size that stand in whole containers.
        self.whole: dict[int, int] = {}
        for size, times, _ in patterns:
            self.whole[size] = self.whole.get(size, 0) + times
        self.whole = {size: n - n % (capacity // size) for size, n in self.whole.items()}

    def place(self, length: int, rank: int) -> tuple[int, int, int, int, int]:
        """(container, where its window starts, position in the window, window size, step group)."""
        starts, rows = self.table[length]
        start, n, at, pos, size, each, base = rows[int(np.searchsorted(starts, rank, side="right")) - 1]
        window, turn = divmod(rank - start, n)
        window += at
        if window < self.whole[size]:
            container, offset = base + window // each, window % each * size
        else:
            container, offset = self.tails[size, window]
        # containers stand in the order of tier and work: dealt back and forth, the groups' sums differ little
        lap, seat = divmod(container, self.groups)
        return container, offset, pos + turn, size, int(seat if lap % 2 == 0 else self.groups - 1 - seat)


def items(sizes: DataFrame, capacity: int) -> DataFrame:
    """Rows (doc_id, piece, token_start, length): one a document, several for one longer than the capacity."""
    whole = F.floor(F.col("tokens") / capacity).cast("int")
    over = F.when(F.col("tokens") <= capacity, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), whole - F.when(F.col("tokens") % capacity == 0, 1).otherwise(0)))
    p = sizes.select("doc_id", "tokens", F.explode(over).alias("piece"))
    start = F.col("piece") * capacity
    return p.select("doc_id", "piece", start.alias("token_start"), F.least(F.lit(capacity), F.col("tokens") - start).cast("int").alias("length"))


def pack(spark: SparkSession, documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Rows (doc_id, piece, token_start, length, container, window_start, position, tier, step_group), one an item.

    `documents` has doc_id and text. tier is the size of the item's window, window_start where that stands in the
    container, position the item's place in the window. Items of no tokens (null or empty texts) need no room:
    these columns are null. Only a document longer than the capacity is split, into full pieces and one rest; rows
    that repeat a doc_id are packed as they come.
    """
    scratch = Scratch(spark, "packing")
    it = scratch.keep(items(count_tokens(documents, "text", ["doc_id"], vocabulary), capacity))
    full = it.filter("length > 0")
    counts = {r["length"]: r["n"] for r in full.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    split = {k: -(-n // PART) for k, n in counts.items() if n > PART}
    parts = F.lit(1)
    for pieces in sorted(set(split.values())):
        parts = F.when(F.col("length").isin([k for k, p in split.items() if p == pieces]), pieces).otherwise(parts)
    full = full.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), parts).cast("int"))
    offset = {(k, 0): 0 for k in counts}
    before: dict[int, int] = {}
    if split:  # a row a part, of PART items each
        for r in sorted(full.filter(F.col("length").isin(list(split))).groupBy("length", "part").agg(F.count("*").alias("n")).collect()):
            offset[r["length"], r["part"]] = before.get(r["length"], 0)
            before[r["length"]] = before.get(r["length"], 0) + r["n"]
    plan = Plan(pack_windows(counts, capacity, tiers), capacity)

    def place(doc_id, piece, token_start, length, part, rank):
        yield (doc_id, piece, token_start, length, *plan.place(length, offset[length, part] + rank))

    w = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    ranked = full.withColumn("rank", (F.row_number().over(w) - 1).cast("bigint")).select("doc_id", "piece", "token_start", "length", "part", "rank")
    schema = "doc_id bigint, piece int, token_start int, length int, container bigint, window_start int, position int, tier int, step_group int"
    placed = map_rows(ranked, schema, place)
    return placed.unionByName(it.filter("length = 0"), allowMissingColumns=True)


def utilisation(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, tokens, containers, and the share of their room that is filled."""
    p = packed.filter("container is not null").groupBy("container").agg(F.count("*").alias("items"), F.sum("length").alias("tokens"))
    return p.agg(F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("containers"), F.coalesce(F.max("tokens"), F.lit(0)).alias("fullest")).withColumn("filled", F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity)))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(spark, read(spark, d, "documents", "doc_id", "text"))


def p8_utilisation(spark: SparkSession, d: str) -> DataFrame:
    return utilisation(p8_containers(spark, d))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must be nought of a packing, and how many texts it holds: containers and windows beyond their size, places taken
    twice, texts missing, texts split without need."""
    packed = Scratch(spark, "checked").keep(p8_containers(spark, d))
    live = packed.filter("container is not null")
    boxes = live.groupBy("container").agg(F.sum("length").alias("n")).agg(F.count_if(F.col("n") > CAPACITY).alias("overfull_containers"))
    windows = live.groupBy("container", "window_start").agg(F.sum("length").alias("n"), F.max("tier").alias("tier"), F.count("*").alias("items"), F.count_distinct("position").alias("places"))
    windows = windows.agg(F.count_if(F.col("n") > F.col("tier")).alias("overfull_windows"), F.coalesce(F.sum(F.col("items") - F.col("places")), F.lit(0)).alias("places_taken_twice"))
    texts = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("length").alias("n"))
    texts = texts.agg(F.count("*").alias("texts"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= CAPACITY)).alias("split_without_need"))
    rows = [f.first().asDict() for f in (boxes, windows, texts)]  # one row each
    return spark.createDataFrame([tuple(int(v) for r in rows for v in r.values())], ", ".join(f"{k} bigint" for r in rows for k in r))


SQL = {
    "p8_checks": "select 0 as overfull_containers, 0 as overfull_windows, 0 as places_taken_twice, count(distinct doc_id) as texts, 0 as split_without_need from documents",
}

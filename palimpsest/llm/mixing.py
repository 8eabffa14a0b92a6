"""Problem 9: mixing sources to target weights of tokens, under caps on repetition.

Temperature mixing exponentiates the sources' token shares. With one exponent it cannot give each source a share of
its own, so what is exponentiated is each source's token share over its target share: weights are the targets times
(token share / target share) to the exponent, scaled to one, tokens counting as often as they may be repeated. The
exponent 0 gives the targets, 1 the sources as they are; bisection finds the least one whose weights keep every source within its cap at the budget, or the one of a
target entropy. Without a budget the largest is sought, by bisection too, at which the exponent is still 0. Weights
become documents by block permutations: each pass over a source is a fresh permutation in nested blocks, whole passes
use every document once, and the last pass is cut where the source's budget ends. What is left of a budget there, less
than a document, is topped up with the largest later documents that fit.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import Scratch
from ..sources.tables import read
from .tokens import VOCABULARY, count_tokens

#: Blocks of a permutation, and how deep they nest: only in the innermost block in which a budget ends documents are summed one by one.
BLOCKS, NESTED = 1024, 2
#: Documents a source that may fill what a whole next document would overfill, largest first.
TOP_UP = 8
#: A source is filled if no more than this share of its budget is left.
FILLED = 1e-5
#: Halvings of a bisection.
STEPS = 100


def clean_source(source: Column) -> Column:
    """Feed names without case and surrounding white space; empty ones are null."""
    s = F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))
    return F.when(s != "", s)


def tempered(tokens: dict[str, float], targets: dict[str, float], exponent: float) -> dict[str, float]:
    """Weights between the targets (exponent 0) and the sources' shares of the tokens (1); sources without either have none."""
    live = {k: v for k, v in targets.items() if v > 0 and tokens.get(k, 0) > 0}
    total = sum(tokens[k] for k in live)
    raw = {k: v * (tokens[k] / total / v) ** exponent for k, v in live.items()}
    z = sum(raw.values())
    return {k: v / z for k, v in raw.items()}


def temperature_weights(tokens: dict[str, float], entropy: float | None = None, max_repeats: dict[str, float] | None = None, budget: float | None = None, targets: dict[str, float] | None = None) -> tuple[float, dict[str, float]]:
    """(exponent, weights), the exponent found by bisection between 0 (the targets, or equal weights) and 1 (as the tokens are).

    With `entropy` (in nats) the exponent that gives it; with `budget` and `max_repeats` the least exponent whose
    weights keep every source within its cap. The nearest end where none does.
    """
    live = {k: v * (max_repeats or {}).get(k, 1) for k, v in tokens.items() if v > 0 and (targets is None or targets.get(k, 0) > 0)}
    live = {k: v for k, v in live.items() if v > 0}
    total = sum(live.values())
    if not live:
        return 1.0, {}
    aim = targets or dict.fromkeys(live, 1.0)

    def entropy_of(x: float) -> float:
        return -sum(p * math.log(p) for p in tempered(live, aim, x).values() if p > 0)

    def enough(x: float) -> bool:
        """Whether an exponent is as high as asked, or higher."""
        if entropy is not None:
            # from the targets to the tokens the entropy falls or rises; which of them, its ends tell
            return entropy_of(x) <= entropy if entropy_of(0.0) >= entropy_of(1.0) else entropy_of(x) >= entropy
        w = tempered(live, aim, x)
        return all(w[k] * (total if budget is None else budget) <= v * (1 + 1e-12) for k, v in live.items())

    lo, hi = 0.0, 1.0
    if enough(lo) or not enough(hi):
        hi = lo if enough(lo) else hi
    else:
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if enough(mid) else (mid, hi)
    return hi, tempered(live, aim, hi)


def largest_budget(tokens: dict[str, int], targets: dict[str, float], max_repeats: dict[str, int]) -> int:
    """The most tokens that a mix of the targets can hold, the exponent being 0: found by bisection; 0 if a source with a target has none."""
    if any(v > 0 and tokens.get(k, 0) * max_repeats.get(k, 0) <= 0 for k, v in targets.items()):
        return 0
    lo, hi = 0, sum(tokens.get(k, 0) * max_repeats.get(k, 0) for k in targets)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if temperature_weights(tokens, max_repeats=max_repeats, budget=mid, targets=targets)[0] == 0 else (lo, mid - 1)
    return lo


def realise(scratch: Scratch, sizes: DataFrame, budgets: dict[str, int], totals: dict[str, int], seed: int = 0) -> DataFrame:
    """Rows (doc_id, source, tokens, pass, place): the uses of each document that fill the budgets, never beyond them.

    sizes has (doc_id, source, tokens). The documents of a pass stand in the order of a hash of document, pass
    and seed, grouped into nested blocks by it. Whole passes take all documents. For the last pass, sums by block
    decide which blocks are in; the block that the budget ends in is cut into blocks again, and only the innermost
    is summed document by document. place is the one order of the mix: in it all sources advance in proportion.
    """
    spark = scratch.spark
    plan = [(s, int(b // totals[s]), int(b % totals[s]), b / totals[s]) for s, b in budgets.items() if totals.get(s, 0) > 0 and b > 0]
    if not plan:
        return sizes.limit(0).select("doc_id", "source", "tokens", F.lit(0).alias("pass"), F.lit(0.0).alias("place"))
    p = F.broadcast(spark.createDataFrame(plan, "source string, passes int, rest bigint, laps double"))  # one row a target
    used = _passes(sizes, p, seed).filter("pass < passes or rest > 0")
    cols = ["doc_id", "source", "tokens", "pass", "place"]
    out = [used.filter("pass < passes").select(*cols)]
    edge = used.filter("pass = passes")
    for level in range(NESTED):
        # the first bits of the hash first, so that blocks follow its order
        edge = edge.withColumn("block", F.shiftrightunsigned("h", 64 - 10 * (level + 1)).bitwiseAND(F.lit(BLOCKS - 1)).cast("int"))
        # at most BLOCKS rows a target source
        w = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sums = edge.groupBy("source", "block").agg(F.sum("tokens").alias("sum"))
        j = edge.join(F.broadcast(sums.withColumn("before", F.coalesce(F.sum("sum").over(w), F.lit(0)))), ["source", "block"])
        out.append(j.filter(F.col("before") + F.col("sum") <= F.col("rest")).select(*cols))
        edge = j.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("sum") > F.col("rest")))
        edge = edge.withColumn("rest", F.col("rest") - F.col("before")).drop("sum", "before", "block")
    run = Window.partitionBy("source").orderBy(F.shiftrightunsigned("h", 1), "h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out.append(edge.withColumn("upto", F.sum("tokens").over(run)).filter(F.col("upto") <= F.col("rest")).select(*cols))
    uses = scratch.keep(reduce(DataFrame.union, out))
    more = _topped_up(_passes(sizes, p, seed).filter("pass = passes and rest > 0"), uses, {s: (n, rest, budgets[s]) for s, n, rest, _ in plan})
    return uses.unionByName(spark.createDataFrame(more, uses.schema)) if more else uses


def _passes(sizes: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Every document with each pass over its source that the plan (source, passes, rest, laps) begins, its hash in it and its place in the mix."""
    s = sizes.filter("tokens > 0").join(plan, "source")
    s = s.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes")))).withColumn("h", F.xxhash64("doc_id", "pass", F.lit(seed)))
    return s.withColumn("place", (F.col("pass") + F.shiftrightunsigned("h", 11) / float(1 << 53)) / F.col("laps"))


def _topped_up(last: DataFrame, uses: DataFrame, plan: dict[str, tuple[int, int, int]]) -> list[tuple]:
    """Uses (doc_id, source, tokens, pass, place) that bring each source nearer to its budget, from the unused rest of its last pass.

    A row a source comes to the driver in each turn; gaps close fast, as a turn takes the largest document that fits.
    """
    spark = last.sparkSession
    done = {r["source"]: r for r in uses.filter(F.col("pass") == F.coalesce(*[F.when(F.col("source") == s, n) for s, (n, *_) in plan.items()], F.lit(-1))).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("place").alias("cut")).collect()}
    gaps = {s: rest - (done[s]["tokens"] if s in done else 0) for s, (_, rest, _) in plan.items() if rest > 0}
    taken: list[tuple] = []
    for _ in range(TOP_UP):
        open_ = [(s, int(g), float(done[s]["cut"]) if s in done else -1.0) for s, g in gaps.items() if g > FILLED * plan[s][2]]
        if not open_:
            break
        g = F.broadcast(spark.createDataFrame(open_, "source string, gap bigint, cut double"))  # one row a target
        fit = last.join(g, "source").filter((F.col("place") > F.col("cut")) & (F.col("tokens") <= F.col("gap")))
        for s in {t[1] for t in taken}:
            fit = fit.filter((F.col("source") != s) | F.col("doc_id").isNull() | ~F.col("doc_id").isin([t[0] for t in taken if t[1] == s]))
        best = fit.filter("doc_id is not null").groupBy("source").agg(F.max(F.struct("tokens", (-F.col("place")).alias("early"), "doc_id", "pass", "place")).alias("x")).collect()
        if not best:
            break
        for r in best:
            x = r["x"]
            taken.append((x["doc_id"], r["source"], x["tokens"], x["pass"], x["place"]))
            gaps[r["source"]] -= x["tokens"]
    return taken


def mix(spark: SparkSession, documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, budget: int | None = None, entropy: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(uses, report) for documents (doc_id, text, source) and targets (source, target_share, max_repeats).

    Uses are rows (doc_id, source, tokens, pass, place), place being the order of the mix. The report has a row a
    target: its tokens, the exponent, its weight and budget, uses, most uses of a document, target and actual share.
    Without `budget` the mix is as large as the caps let the targets be held; with more, the exponent leaves the
    targets as far as the caps make it; `entropy` (in nats) asks for the exponent that gives it. Sources are compared by their clean names; documents of none or of an unknown source, and documents without
    tokens, are not used. Targets are few: they and the token sums by target come to the driver.
    """
    scratch = Scratch(spark, "mixing")
    t = [(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null").distinct().collect()]
    d = documents.select("doc_id", "text", clean_source(F.col("source")).alias("source")).filter(F.col("source").isin([s for s, _, _ in t]))
    sizes = scratch.keep(count_tokens(d, "text", ["doc_id", "source"], vocabulary))
    totals = {r["source"]: int(r["tokens"]) for r in sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    z = sum(x for _, x, _ in t) or 1.0
    shares, caps = {s: x / z for s, x, _ in t}, {s: m for s, _, m in t}
    tokens = {s: totals.get(s, 0) for s in shares}
    if budget is None:
        budget = largest_budget(tokens, shares, caps)
    exponent, weights = temperature_weights(tokens, entropy, caps, budget, shares)
    # at the exponent's end even the tokens as they are may be beyond a cap
    budgets = {s: min(int(weights.get(s, 0.0) * budget), caps[s] * tokens[s]) for s in shares}
    uses = realise(scratch, sizes, budgets, totals)
    plan = spark.createDataFrame([(s, x, m, tokens[s], float(exponent), float(weights.get(s, 0.0)), budgets[s]) for s, x, m in t] or [("", 0.0, 0, 0, 0.0, 0.0, 0)], "source string, target_share double, max_repeats int, source_tokens bigint, exponent double, weight double, budget bigint").filter("source <> ''")
    got = uses.groupBy("source").agg(F.count("*").alias("uses"), F.max(F.col("pass") + 1).alias("most_uses"), F.sum("tokens").alias("tokens"))
    r = plan.join(got, "source", "left").fillna(0, ["uses", "most_uses", "tokens"])
    # one row a target: a window over all of them is small
    every = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    r = r.withColumn("actual_share", F.coalesce(F.col("tokens") / F.nullif(every, F.lit(0)), F.lit(0.0)))
    return uses, r


def _mix(spark: SparkSession, d: str):
    return mix(spark, read(spark, d, "documents", "doc_id", "text", "source"), read(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """A row a target: whether its share is reached within a thousandth, and no document used beyond its cap or twice in a pass."""
    uses, report = _mix(spark, d)
    twice = uses.groupBy("source", "doc_id", "pass").agg(F.count("*").alias("n")).groupBy("source").agg(F.max("n").alias("in_a_pass"))
    r = report.join(twice, "source", "left")
    return r.select("source", (F.abs(F.col("actual_share") - F.col("target_share")) <= 0.001).alias("share_reached"), ((F.col("most_uses") <= F.col("max_repeats")) & (F.coalesce("in_a_pass", F.lit(1)) == 1)).alias("caps_kept"))


def p9_temperature(spark: SparkSession, d: str) -> DataFrame:
    """The mix of a budget half-way between what the targets and what the caps allow: the bisected exponent and the shares it gives, one row a target."""
    docs, targets = read(spark, d, "documents", "doc_id", "text", "source"), read(spark, d, "mix_targets")
    report = mix(spark, docs, targets)[1]
    most = report.agg(F.sum(F.col("budget") + F.col("max_repeats") * F.col("source_tokens"))).first()[0] or 0
    return mix(spark, docs, targets, budget=most // 2)[1]


SQL = {
    "p9_checks": "select distinct lower(trim(source)) as source, true as share_reached, true as caps_kept from mix_targets where trim(source) <> ''",
}

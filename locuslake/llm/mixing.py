"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Every source gets a target number of words. Among all rates r >= 0 of a source's documents with
r <= max_copies that take the target, sum(r * size) = target, the ones closest to 1 in relative entropy
are exponentially tilted: r = min(max_copies, exp(lambda * size / scale)). lambda, one number for each
source, minimises the convex dual and is found by Newton's method; an iteration is one distributed sum over
the (source, size) classes, as documents of equal size have equal rates. The rates, laid end to end by
falling size, are then rounded so that each document is taken a whole number of times and the words taken
stay within half the largest document of the target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuslake.llm.shared import attach, null_safe, park, ranks, row_hash, sorted_parts, starts, unit_hash, word_count

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_COPIES = 2
SEED = 4
TOLERANCE = 1e-9
#: Newton rounds after which it is an error not to have met all targets.
MAX_ROUNDS = 200


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = MAX_COPIES) -> DataFrame:
    """sizes (key, source, source_size; a row for each source) with target.

    Sources in code point order, null last, weigh `weights` in turn and share budget * all sizes; a target
    stops at cap * source_size and the rest is shared again by weight. The level per unit of weight at which
    this ends is the greatest of the levels (rest / remaining weight) met when sources fill up in order of
    cap * size / weight.
    """
    last = F.col("source").isNull()
    weighed = with_running(sizes.withColumn("_one", F.lit(1)), [last, "source"], {"_rank": F.col("_one")})
    weighed = weighed.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int"))).drop("_one", "_rank")
    weighed = with_running(weighed, [F.col("source_size") / F.col("_w"), "key"], {"_taken": cap * F.col("source_size"), "_passed": F.col("_w")})
    whole = weighed.agg(F.sum("source_size").alias("words"), F.sum("_w").alias("weight")).first()
    level = weighed.select(((F.lit(float(budget * (whole["words"] or 0))) - F.col("_taken")) / (F.lit(float(whole["weight"] or 0.0)) - F.col("_passed"))).alias("level")).agg(F.max("level")).first()[0] or 0.0
    return weighed.withColumn("target", F.least(cap * F.col("source_size").cast("double"), F.lit(level) * F.col("_w"))).drop("_w", "_taken", "_passed")


def with_running(rows: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """rows with sums over those before in the order, which no two rows share; parts of the order are added up first,
    so that no task orders all rows."""
    parts = sorted_parts(rows.withColumns({f"_own{name}": x for name, x in sums.items()}), order)
    own = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    for name in sums:
        counts = parts.groupBy("_part").agg(F.sum(f"_own{name}").alias("_n"))
        parts = parts.join(starts(counts, [], "_part", "_n", f"_at{name}").drop("_n"), "_part")
        parts = parts.withColumn(name, F.col(f"_at{name}") + F.coalesce(F.sum(f"_own{name}").over(own), F.lit(0)))
    return parts.select(*rows.columns, *sums)


def solve(classes: DataFrame, goals: DataFrame, cap: float = MAX_COPIES) -> DataFrame:
    """(key, tilt, scale): the dual solution of each source.

    classes: (key, size > 0, n); goals: (key, target, source_size > 0). Newton steps that leave the bracket
    around the root are replaced by its middle. Sums are exact decimals, so that reruns give equal bits. A target
    that is not met to TOLERANCE after MAX_ROUNDS is an error.
    """
    spread = classes.groupBy("key").agg(F.min("size").alias("least"), (F.sum(F.col("n") * F.col("size").cast("decimal(20,0)") * F.col("size")).cast("double")).alias("squares"))
    scale = F.col("squares") / F.col("source_size")
    # at `high` all rates reach the cap, at `low` the smallest document's rate takes too little already;
    # a target at the cap is met at `high` and nowhere below
    high = math.log(cap) * F.col("scale") / F.col("least")
    at_cap = F.col("target") >= cap * F.col("source_size") * (1 - TOLERANCE)
    state = park(
        goals.join(spread, "key").withColumn("scale", scale).select(
            "key", "target", "scale", F.when(at_cap, high).otherwise(0.0).alias("tilt"), high.alias("high"),
            F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) * F.col("scale") / F.col("least")).alias("low"),
        )
    )
    for _ in range(MAX_ROUNDS):
        rate = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(700.0)))
        words = F.col("n") * F.col("size")
        exact = lambda x: F.sum(x.cast("decimal(38,9)")).cast("double")
        sums = (
            classes.join(state.select("key", "tilt", "scale"), "key").groupBy("key")
            .agg(
                exact(words * F.least(rate, F.lit(float(cap)))).alias("taken"),
                exact(F.when(rate < cap, words * rate * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"),
            )
        )
        over = F.col("taken") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - F.try_divide(F.col("taken") - F.col("target"), F.col("slope"))
        miss = F.abs(F.col("taken") / F.col("target") - 1)
        moved = F.when(miss <= TOLERANCE, F.col("tilt")).when(step.isNotNull() & (step >= low) & (step <= high), step).otherwise((low + high) / 2)
        state = park(state.join(sums, "key").select("key", "target", "scale", moved.alias("tilt"), high.alias("high"), low.alias("low"), miss.alias("miss")))
        worst = state.agg(F.max("miss")).first()[0] or 0.0
        state = state.drop("miss")
        if worst <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"targets were not met in {MAX_ROUNDS} rounds; the worst misses by {worst:.1e} of itself")
    return state.select("key", "tilt", "scale")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """One row for each input row: doc_id, size (words), source_size, target, rate, copies and tie.

    Null texts and texts without words have size 0, rate 1 and one copy. A null source is a source, ordered
    last. Repeated rows are taken independently of each other. tie is a hash of the whole input row; other columns
    are ignored, whatever their names. An empty table gives none.
    """
    own = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), null_safe(F.col(source)).alias("key"),
        unit_hash(seed, F.col(doc_id).cast("string"), F.xxhash64(text)).alias("at"), row_hash(docs).alias("tie"),
    )
    own = park(own)
    classes = park(own.groupBy("key", "size").agg(F.first("source").alias("source"), F.count("*").alias("n")))
    goals = park(targets(classes.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, budget, cap))
    positive = classes.filter("size > 0")
    tilts = solve(positive, goals.filter("source_size > 0"), cap)
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(700.0)))))
    before = W.partitionBy("key").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    rated = classes.select("key", "size", "n").join(tilts, "key", "left").withColumn("rate", rate)
    rated = rated.withColumn("so_far", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(before), F.lit(0.0)))
    # one row for each class, with all that its documents need
    rated = park(rated.join(goals.select("key", "source_size", "target"), "key").select("key", "size", "n", "rate", "so_far", "source_size", "target"))
    # copies end where the running total of rates passes a whole number and a half
    upto = lambda k: F.floor(F.col("so_far") + k * F.col("rate") + 0.5)
    copies = F.least(F.lit(cap), F.greatest(F.lit(0), upto(F.col("k")) - upto(F.col("k") - 1)))
    placed = attach(ranks(own.drop("source"), ["key", "size"], "at", ["doc_id", "tie"], "k"), rated, ["key", "size"], "n", own.count(), "at")
    return placed.select("doc_id", "size", "source_size", "target", "rate", F.when(F.col("size") == 0, 1).otherwise(copies).cast("int").alias("copies"), "tie")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of docs, with all its columns, as often as it is taken."""
    taken = mix(docs, doc_id, text, source, weights, budget, cap, seed).groupBy("doc_id", "tie").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows"))
    taken = park(taken.withColumnsRenamed({"doc_id": "taken_id", "tie": "taken_tie"}))
    # wholly repeated rows are interchangeable: one of them stands for all, with their copies added up
    rows = docs.select(F.col(doc_id).alias("own_id"), row_hash(docs).alias("own_tie"), F.struct("*").alias("row"))
    rows = rows.dropDuplicates(["own_id", "own_tie"]) if taken.filter("rows > 1").limit(1).count() else rows
    joined = rows.join(taken.filter("copies > 0"), F.col("own_id").eqNullSafe(F.col("taken_id")) & (F.col("own_tie") == F.col("taken_tie")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")

"""Controls for a strategy: exposure-matched buy and hold, and random placements of its low-weight segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BISECT_MAX, COST, MATCH_OK, MATCH_STOP, N_SHUFFLE, SEED
from .ledger import let

KEYS = ("period", "symbol")


def segments(paths: DataFrame, keys=KEYS) -> DataFrame:
    """keys, seg (from 0), s, e, n: maximal runs of targets below 1 as [s, e); a run that lasts to the end has e = n + 1."""
    order = Window.partitionBy(*keys).orderBy("t")
    low = paths.where((F.col("t") >= 1) & (F.col("target") < 1)).withColumn("island", F.col("t") - F.row_number().over(order))
    runs = low.groupBy(*keys, "island", "n").agg(F.min("t").alias("s"), (F.max("t") + 1).alias("e"))
    return runs.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("s")) - 1).alias("seg"), "s", "e", "n")


def low_level(paths: DataFrame, keys=KEYS) -> DataFrame:
    """keys, low: the one target below 1 (null if there is none); more than one is an error."""
    found = paths.where(F.col("t") >= 1).groupBy(*keys).agg(F.min(F.when(F.col("target") < 1, F.col("target"))).alias("low"), F.max(F.when(F.col("target") < 1, F.col("target"))).alias("top"))
    ok = F.col("low").isNull() | (F.col("low") == F.col("top"))
    return found.select(*keys, F.when(ok, F.col("low")).otherwise(F.raise_error(F.lit("targets below 1 take more than one value")).cast("double")).alias("low"))


def buyhold(paths: DataFrame, weight: Column, cost: float = COST, keys=KEYS) -> DataFrame:
    """keys, t, v, w, paid, trades: all invested at t = 0, brought to `weight` at the first open, no trades after."""
    whole = Window.partitionBy(*keys)
    c0, o1 = F.max(F.when(F.col("t") == 0, F.col("c"))).over(whole), F.max(F.when(F.col("t") == 1, F.col("o"))).over(whole)
    out = paths.withColumns({"_c0": c0, "_o1": o1}).withColumn("_sold", F.greatest(1 - weight, F.lit(0.0)) * F.col("_o1") / F.col("_c0"))
    held, traded = F.least(weight, F.lit(1.0)) / F.col("_c0") * F.col("c"), F.col("t") >= 1
    value = F.when(traded, held + F.col("_sold") * (1 - cost)).otherwise(1.0)
    return out.select(*keys, "t", value.alias("v"), F.when(traded, held / value).otherwise(1.0).alias("w"), F.when(traded, cost * F.col("_sold")).otherwise(0.0).alias("paid"), (traded & (F.col("_sold") > 0)).cast("int").alias("trades"))


def baseline(paths: DataFrame, keys=KEYS) -> DataFrame:
    """Buy and hold without trades."""
    first = F.max(F.when(F.col("t") == 0, F.col("c"))).over(Window.partitionBy(*keys))
    return paths.select(*keys, "t", (F.col("c") / first).alias("v"), F.lit(1.0).alias("w"), F.lit(0.0).alias("paid"), F.lit(0).alias("trades"))


def matched(residual: Column) -> Column:
    return F.abs(residual) <= MATCH_OK


def solve_matched(paths: DataFrame, goals: DataFrame, cost: float = COST, keys=KEYS) -> DataFrame:
    """keys, c, residual, iterations, matched: the weight of buy and hold whose mean weight is nearest to `goal`.

    goals: keys and goal. Bisection on (0, 1), in one fold per path: of the middles tried, the first with the least
    absolute residual, never an end; it stops at MATCH_STOP or after BISECT_MAX steps.
    """
    day = F.struct("t", "o", "c")
    own = paths.groupBy(*keys).agg(F.sort_array(F.collect_list(day)).alias("days")).join(goals, list(keys))
    own = own.select(*keys, "goal", (F.col("days")[1]["o"] * (1 - cost)).alias("k"), F.transform(F.slice("days", 2, F.size("days") - 1), lambda d: d["c"]).alias("cs"))

    def mean_weight(mid: Column) -> Column:
        total = F.aggregate("cs", F.lit(0.0), lambda s, c: s + mid * c / (mid * c + (1 - mid) * F.col("k")))
        return total / F.size("cs")

    nothing = F.lit(None).cast("double")
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), nothing.alias("c"), nothing.alias("rho"), F.lit(0).alias("it"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        def tried(x: Column) -> Column:
            mid, rho = x["mid"], x["rho"]
            better = s["c"].isNull() | (F.abs(rho) < F.abs(s["rho"]))
            return F.struct(
                F.when(rho < 0, mid).otherwise(s["lo"]).alias("lo"), F.when(rho < 0, s["hi"]).otherwise(mid).alias("hi"), F.when(better, mid).otherwise(s["c"]).alias("c"),
                F.when(better, rho).otherwise(s["rho"]).alias("rho"), (s["it"] + 1).alias("it"), (F.abs(rho) <= MATCH_STOP).alias("done"),
            )

        middle = let((s["lo"] + s["hi"]) / 2, lambda mid: F.struct(mid.alias("mid"), (mean_weight(mid) - F.col("goal")).alias("rho")))
        return F.when(s["done"], s).otherwise(let(middle, tried))

    found = own.select(*keys, F.aggregate(F.sequence(F.lit(1), F.lit(BISECT_MAX)), start, step).alias("x"))
    return found.select(*keys, F.col("x.c").alias("c"), F.col("x.rho").alias("residual"), F.col("x.it").alias("iterations"), matched(F.col("x.rho")).alias("matched"))


def shuffle_layout(segs: DataFrame, keys=KEYS) -> DataFrame:
    """keys, n, k (movable segments), lengths, range_end, free days, tail (start of a segment that lasts to the end), unique."""
    movable = F.col("e") <= F.col("n")
    out = segs.groupBy(*keys, "n").agg(
        F.count_if(movable).cast("int").alias("k"), F.transform(F.sort_array(F.collect_list(F.when(movable, F.struct("s", (F.col("e") - F.col("s")).alias("len"))))), lambda x: x["len"]).alias("lengths"),
        F.max(F.when(~movable, F.col("s"))).alias("tail"), F.coalesce(F.sum(F.when(movable, F.col("e") - F.col("s") + 1)), F.lit(0)).cast("int").alias("taken"),
    )
    out = out.withColumn("range_end", F.coalesce(F.col("tail") - 1, "n")).withColumn("free", F.col("range_end") - F.col("taken"))
    unique = (F.col("k") == 0) | ((F.col("free") == 0) & (F.size(F.array_distinct("lengths")) <= 1))
    return out.select(*keys, "n", "k", "lengths", "range_end", "free", "tail", unique.alias("unique"))


def draw(*parts) -> Column:
    """A hash of the parts as text, to order by: the same in every engine."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def shuffles(segs: DataFrame, n_shuffle: int = N_SHUFFLE, seed: int = SEED, keys=KEYS) -> DataFrame:
    """r, keys, s, e, n: for each draw r a random order of the movable segments in random free places; a tail stays.

    Order and places are by hash, so nothing depends on the partitioning. One row per draw and segment, one per draw
    and free day in between; all of a path's draws are independent groups.
    """
    spark_range = segs.sparkSession.range(n_shuffle).select(F.col("id").cast("int").alias("r"))
    lay = shuffle_layout(segs, keys).select(*keys, "k", "free").where("k > 0")
    moved = segs.where(F.col("e") <= F.col("n")).select(*keys, "n", F.col("s").alias("s0"), (F.col("e") - F.col("s")).alias("len"))
    draws = F.broadcast(spark_range)
    name = [F.lit(str(seed)), F.col("r").cast("string"), *[F.col(k) for k in keys]]
    group = Window.partitionBy("r", *keys)
    blocks = moved.crossJoin(draws).withColumn("j", F.row_number().over(group.orderBy(draw(F.lit("block"), *name, F.col("s0").cast("string")), "s0")) - 1)
    blocks = blocks.withColumn("used", F.coalesce(F.sum(F.col("len") + 1).over(group.orderBy("j").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    places = lay.crossJoin(draws).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("free") + F.col("k") - 1)))
    chosen = places.withColumn("rank", F.row_number().over(group.orderBy(draw(F.lit("place"), *name, F.col("q").cast("string")), "q"))).where("rank <= k")
    chosen = chosen.select("r", *keys, "q", (F.row_number().over(group.orderBy("q")) - 1).alias("j"))
    start = 1 + F.col("q") - F.col("j") + F.col("used")
    placed = blocks.join(chosen, ["r", *keys, "j"]).select("r", *keys, start.cast("int").alias("s"), (start + F.col("len")).cast("int").alias("e"), "n")
    tails = segs.where(F.col("e") > F.col("n")).crossJoin(draws).select("r", *keys, "s", "e", "n")
    return placed.unionByName(tails)


def numpy_shuffles(segs: DataFrame, n_shuffle: int = N_SHUFFLE, seed: int = SEED, order: list[tuple] | None = None, keys=KEYS) -> DataFrame:
    """shuffles() with NumPy's generator: one per draw, seeded seed + r, which serves the paths in the given order.

    The generator's state goes from path to path, so each draw is one sequential unit; draws run in parallel. The order of
    the generator's calls is fixed: it makes the same draws as a plain loop over paths in that order.
    """
    rows = segs.groupBy(*keys, "n").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("segs")).collect()  # one row per path
    lay = {tuple(row[k] for k in keys): (row["n"], [(x["s"], x["e"]) for x in row["segs"]]) for row in rows}
    path_order = [k for k in (order or sorted(lay)) if k in lay]

    def run(batches):
        for batch in batches:
            out = []
            for r in batch["r"]:
                rng = np.random.default_rng(seed + int(r))
                for key in path_order:
                    n, segs_ = lay[key]
                    full, tail = [x for x in segs_ if x[1] <= n], [x for x in segs_ if x[1] > n]
                    k = len(full)
                    if k:
                        length = np.array([e - s for s, e in full])
                        free = (tail[0][0] - 1 if tail else n) - int((length + 1).sum())
                        own = length[rng.permutation(k)]
                        slot = np.sort(rng.choice(free + k, size=k, replace=False))
                        s = 1 + slot - np.arange(k) + np.concatenate([[0], np.cumsum(own[:-1] + 1)])
                        out += [(int(r), *key, int(a), int(b), n) for a, b in zip(s, s + own)]
                    out += [(int(r), *key, a, b, n) for a, b in tail]
            yield pd.DataFrame(out, columns=["r", *keys, "s", "e", "n"])

    draws = segs.sparkSession.range(n_shuffle).select(F.col("id").cast("int").alias("r"))
    return draws.mapInPandas(run, "r int, " + ", ".join(f"{k} string" for k in keys) + ", s int, e int, n int")

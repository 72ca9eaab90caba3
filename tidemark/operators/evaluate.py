"""Evaluation of a weight rule over periods: strategy against its control, effects, grading."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import COST, N_BOOT, N_SHUFFLE, SEED
from ..shared import materialise
from . import controls, ledger, stats

KEYS = ["period", "symbol"]
METRIC_NAMES = ("mdd", "sharpe", "calmar")
MATCHED, SHUFFLED = "exposure_matched", "segment_shuffle"
SINGLE_PERIOD = "not_applicable (single period)"


@dataclass(frozen=True)
class Cell:
    """One hypothesis: a metric's effect against a control, its least size (percentage points for mdd) and its sign."""

    name: str
    metric: str
    control: str
    min_effect: float
    predicted_sign: int = 1


OVERLAY_CELLS = (Cell("MDD", "mdd", MATCHED, 1.0), Cell("Sharpe", "sharpe", MATCHED, 0.05))
SEGMENT_CELLS = (Cell("MDD", "mdd", SHUFFLED, 1.0), Cell("Calmar", "calmar", SHUFFLED, 0.05))


def check_cells(cells, control: str) -> None:
    if not cells:
        raise ValueError("no cells")
    for c in cells:
        if c.control != control or c.metric not in METRIC_NAMES:
            raise ValueError(f"{c.name}: control {c.control!r} or metric {c.metric!r} does not fit")
    if len({c.name for c in cells}) < len(cells):
        raise ValueError("cell names repeat")


def cells_table(spark: SparkSession, cells) -> DataFrame:
    rows = [(i, *asdict(c).values()) for i, c in enumerate(cells)]
    return spark.createDataFrame(rows, "ord int, name string, metric string, control string, min_effect double, predicted_sign int")


def members(paths: DataFrame) -> DataFrame:
    """symbol, member_idx from 0 in order of the symbols."""
    return paths.select("symbol").distinct().withColumn("member_idx", F.row_number().over(Window.orderBy("symbol")) - 1)


def effect(metric: Column, own: Column, control: Column) -> Column:
    """How much better the strategy is: for drawdowns in percentage points."""
    return F.when(metric == "mdd", (control - own) * 100).otherwise(own - control)


def unpivot(df: DataFrame, name: str) -> DataFrame:
    """keys, metric, value of METRIC_NAMES."""
    return df.unpivot([*KEYS, *[c for c in ("informative",) if c in df.columns]], list(METRIC_NAMES), "metric", name)


def overlay_controls(paths: DataFrame, strategy: DataFrame, cost: float = COST) -> tuple[DataFrame, DataFrame]:
    """The matched weights, and the metrics of buy and hold at them."""
    c = controls.solve_matched(paths, strategy.select(*KEYS, F.col("avg_w").alias("goal")), cost)
    weighted = paths.join(c.select(*KEYS, F.col("c").alias("weight")), KEYS)
    return c, ledger.metrics(controls.buyhold(weighted, F.col("weight"), cost))


def overlay_effects(strategy: DataFrame, matched: DataFrame, control: DataFrame, cells: DataFrame) -> DataFrame:
    """cell, period, symbol, g, h: not informative without trades, unmatched, or with an undefined metric."""
    own = unpivot(strategy.join(matched.select(*KEYS, "matched"), KEYS).withColumn("informative", (F.col("trades") >= 1) & F.col("matched")), "own")
    both = own.join(unpivot(control, "control_value"), [*KEYS, "metric"]).join(F.broadcast(cells.select("name", "metric")), "metric")
    g = effect(F.col("metric"), F.col("own"), F.col("control_value"))
    return both.select(F.col("name").alias("cell"), *KEYS, F.when(F.col("informative"), g).alias("g"), (F.col("informative") & g.isNotNull()).alias("h"))


def shuffled_metrics(paths: DataFrame, placed: DataFrame, low: DataFrame, cost: float = COST) -> DataFrame:
    """r, keys and metrics of every draw's segment ledger."""
    keys = ["r", *KEYS]
    draws = placed.select("r", *KEYS).distinct()
    fanned = draws.join(paths.select(*KEYS, "t", "n", "o", "c"), KEYS).join(F.broadcast(low), KEYS)
    nav = ledger.segment_nav_with_low(fanned, placed, cost, keys)
    return ledger.metrics(nav, keys)


def shuffle_summary(metrics: DataFrame) -> DataFrame:
    """keys, draws, the means of the metrics over draws (undefined sharpe and calmar are left out), and the fewest and most trades."""
    return metrics.groupBy(*KEYS).agg(F.count("*").alias("draws"), *[F.avg(m).alias(m) for m in METRIC_NAMES], F.min("trades").alias("fewest_trades"), F.max("trades").alias("most_trades"))


def segment_effects(strategy: DataFrame, segs: DataFrame, summary: DataFrame, cells: DataFrame) -> DataFrame:
    """cell, period, symbol, g, h: not informative without segments or with an undefined metric."""
    some = segs.select(*KEYS).distinct().withColumn("some", F.lit(True))
    own = unpivot(strategy.join(some, KEYS, "left").withColumn("informative", F.coalesce("some", F.lit(False))), "own")
    both = own.join(unpivot(summary, "control_value"), [*KEYS, "metric"], "left").join(F.broadcast(cells.select("name", "metric")), "metric")
    g = effect(F.col("metric"), F.col("own"), F.col("control_value"))
    return both.select(F.col("name").alias("cell"), *KEYS, F.when(F.col("informative"), g).alias("g"), (F.col("informative") & g.isNotNull()).alias("h"))


def grade(effects: DataFrame, cells: DataFrame, names: DataFrame, periods: list[str], n_members: int, n_boot: int = N_BOOT, seed: int = SEED, subset: DataFrame | None = None, source: str = "md5") -> DataFrame:
    """One row per cell with statistics, verdict, Holm-adjusted p over all cells, and the state of the subset check.

    With one period there is no bootstrap and no verdict. names: symbol and member_idx; subset: symbol.
    """
    own = effects.join(F.broadcast(names), "symbol")
    inside = None if subset is None else names.join(subset.select("symbol").distinct(), "symbol", "left_semi").select("member_idx")
    if len(periods) == 1:
        stat = stats.period_stat(own)
        nothing = lambda kind: F.lit(None).cast(kind)
        return cells.join(stat, cells["name"] == stat["cell"]).select(
            "ord", "name", "metric", "control", F.array("d").alias("d"), nothing("double").alias("t"), nothing("double").alias("p"), nothing("double").alias("p_holm"), F.lit(False).alias("reject"),
            F.array("informative").alias("h_count"), F.lit(SINGLE_PERIOD).alias("verdict"), nothing("string").alias("direction"), F.lit("skipped").alias("subset_check"),
        )
    boot = stats.boot_weights(effects.sparkSession, n_members, n_boot, seed, source)
    out = stats.cell_stats(own, cells, boot, periods, n_boot, inside)
    empty = F.exists("wl_count", lambda n: n == 0)
    agrees = F.forall("wl", lambda x: F.coalesce(F.signum(x) == F.signum(F.get("d", 0)), F.lit(False)))
    out = out.withColumn("subset_check", F.when(F.col("wl_count").isNull(), "skipped").when(empty, "no informative members").when(agrees, "passed").otherwise("failed"))
    forced = F.col("subset_check") == "no informative members"
    out = out.withColumns({"direction": F.when(~forced, F.col("direction")), "verdict": F.when(forced, "inconclusive").otherwise(F.col("verdict"))})
    adjusted = stats.holm(out.select("ord", "p")).select("ord", "p_holm")
    return out.join(adjusted, "ord").withColumn("reject", stats.rejects(F.col("p_holm")))


def evaluate_overlay(paths: DataFrame, periods: list[str], cells=OVERLAY_CELLS, rebalance: str = "threshold", subset: DataFrame | None = None, seed: int = SEED, n_boot: int = N_BOOT, cost: float = COST, source: str = "md5") -> dict[str, DataFrame]:
    """A rule against exposure-matched buy and hold."""
    check_cells(cells, MATCHED)
    table, names = cells_table(paths.sparkSession, cells), members(paths)
    strategy = materialise(ledger.metrics(ledger.ledger(paths, rebalance, cost)), "strategy")
    matched, control = overlay_controls(paths, strategy, cost)
    matched = materialise(matched, "matched")
    effects = materialise(overlay_effects(strategy, matched, control, table), "effects")
    return {"strategy": strategy, "baseline": ledger.metrics(controls.baseline(paths)), "c_dagger": matched, "control": control, "effects": effects, "cells": grade(effects, table, names, periods, names.count(), n_boot, seed, subset, source)}


def evaluate_segments(paths: DataFrame, periods: list[str], cells=SEGMENT_CELLS, n_shuffle: int = N_SHUFFLE, subset: DataFrame | None = None, seed: int = SEED, n_boot: int = N_BOOT, cost: float = COST, source: str = "md5") -> dict[str, DataFrame]:
    """A two-level rule against random placements of its low segments. A draw with another number of trades is an error."""
    check_cells(cells, SHUFFLED)
    table, names = cells_table(paths.sparkSession, cells), members(paths)
    segs = materialise(controls.segments(paths), "segments")
    low = controls.low_level(paths).select(*KEYS, F.coalesce("low", F.lit(1.0)).alias("low"))
    strategy = materialise(ledger.metrics(ledger.segment_nav_with_low(paths.join(low, KEYS), segs, cost, KEYS)), "strategy")
    order = None
    if source == "numpy":
        order = [tuple(r) for r in paths.select("ord", *KEYS).distinct().orderBy("ord", "symbol").select(*KEYS).collect()]
    placed = controls.numpy_shuffles(segs, n_shuffle, seed, order) if source == "numpy" else controls.shuffles(segs, n_shuffle, seed)
    every = shuffled_metrics(paths, placed, low, cost)
    summary = materialise(shuffle_summary(every), "summary")
    wrong = summary.join(strategy.select(*KEYS, "trades"), KEYS).where("fewest_trades <> trades or most_trades <> trades").select(*KEYS).head()
    if wrong:
        raise ValueError(f"{tuple(wrong)}: a shuffled ledger has another number of trades than the strategy's")
    effects = materialise(segment_effects(strategy, segs, summary, table), "effects")
    return {"strategy": strategy, "segments": segs, "shuffles": every, "summary": summary, "effects": effects, "cells": grade(effects, table, names, periods, names.count(), n_boot, seed, subset, source)}


def trade_mismatch(shuffled: DataFrame, strategy: DataFrame) -> DataFrame:
    """Draws whose number of trades is not the strategy's: none, or something is wrong."""
    return shuffled.select("r", *KEYS, F.col("trades").alias("drawn")).join(strategy.select(*KEYS, "trades"), KEYS).where("drawn <> trades")

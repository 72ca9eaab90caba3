"""Grading statistics over effects: (cell, period, member_idx, g, h), g a stock's effect, h whether it is informative.

Undefined numbers are null. Means over periods are undefined if one period is; means over shuffles skip undefined ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import HOLM_ALPHA, MAX_UNDEFINED, MIN_INFORMATIVE, MIN_STOCKS, N_BOOT, SEED, TOLERANCE


def boot_weights(spark: SparkSession, members: int, draws: int = N_BOOT, seed: int = SEED, source: str = "md5") -> DataFrame:
    """b, member_idx, k: how often each of `members` stocks is drawn in each of `draws` samples of that size.

    `md5` draws by hash, equal in every engine; `numpy` with NumPy's generator, made on the driver (draws x members
    numbers, a fixed size).
    """
    if source == "numpy":
        drawn = np.random.default_rng(seed).integers(0, members, size=(draws, members))
        rows = [(b, int(i), int(k)) for b, own in enumerate(drawn) for i, k in zip(*np.unique(own, return_counts=True))]
        return spark.createDataFrame(rows, "b int, member_idx int, k long")
    if source != "md5":
        raise ValueError(source)
    each = spark.range(draws * members).select((F.col("id") / members).cast("int").alias("b"), (F.col("id") % members).cast("int").alias("i"))
    text = F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col("i").cast("string"))
    member = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % members
    return each.groupBy("b", member.cast("int").alias("member_idx")).agg(F.count("*").alias("k"))


def ratio(weight: Column, g: Column, h: Column) -> Column:
    """sum(weight g) / sum(weight) over informative members."""
    return F.try_divide(F.sum(F.when(h, weight * g)), F.sum(F.when(h, weight)))


def period_stat(effects: DataFrame) -> DataFrame:
    """cell, period, d, informative: the plain mean effect and the number of informative stocks."""
    return effects.groupBy("cell", "period").agg(ratio(F.lit(1.0), F.col("g"), F.col("h")).alias("d"), F.count_if("h").alias("informative"))


def over_periods(stat: DataFrame, keys: list[str], value: str, n_periods: int) -> DataFrame:
    """The mean over periods; undefined if a period's value is."""
    return stat.groupBy(*keys).agg(F.when(F.count(value) == n_periods, F.avg(value)).alias("t"))


def t_point(effects: DataFrame, n_periods: int) -> DataFrame:
    return over_periods(period_stat(effects), ["cell"], "d", n_periods)


def t_boot(effects: DataFrame, boot: DataFrame, n_periods: int) -> DataFrame:
    """cell, b, t: the statistic of each sample; a sample's multiplicities are the same in all periods and cells."""
    own = effects.join(boot, "member_idx")
    each = own.groupBy("cell", "b", "period").agg(ratio(F.col("k").cast("double"), F.col("g"), F.col("h")).alias("d"))
    return over_periods(each, ["cell", "b"], "d", n_periods)


def confirm(effects: DataFrame, boot: DataFrame, n_periods: int, draws: int) -> DataFrame:
    """cell, t, valid, tail, p_raw, t_lo, t_hi, t_sd, untestable, p.

    The shift p-value is (1 + samples at least |t| away from t) / (valid samples + 1), and 1 if t is 0 or undefined.
    Any untestable rule makes p 1: 1 too few stocks, 3 too many undefined samples, 4 too few informative stocks, 5 samples
    without spread.
    """
    point = t_point(effects, n_periods)
    low = period_stat(effects).groupBy("cell").agg(F.min("informative").alias("fewest"))
    star = t_boot(effects, boot, n_periods).withColumnRenamed("t", "ts")
    each = star.join(F.broadcast(point), "cell").groupBy("cell").agg(
        F.first("t").alias("t"), F.count("ts").alias("valid"), F.count_if(F.abs(F.col("ts") - F.col("t")) >= F.abs("t")).alias("far"),
        F.percentile("ts", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"), F.stddev_pop("ts").alias("t_sd"), (F.max("ts") - F.min("ts")).alias("range"),
    )
    undefined = F.col("t").isNull() | (F.col("t") == 0)
    each = each.join(low, "cell").withColumn("tail", F.when(undefined, F.col("valid")).otherwise(F.col("far")))
    p = F.when(undefined, 1.0).otherwise((1 + F.col("tail")) / (F.col("valid") + 1))
    rule = lambda number, hit: F.when(hit, number)
    rules = F.array_compact(F.array(
        rule(1, F.col("fewest") < MIN_STOCKS), rule(3, draws - F.col("valid") > MAX_UNDEFINED * draws), rule(4, F.col("fewest") < MIN_INFORMATIVE),
        rule(5, (F.col("valid") == 0) | (F.col("range") == 0)),
    ))
    each = each.withColumns({"p_raw": p, "untestable": rules})
    return each.select("cell", "t", "valid", "tail", "p_raw", F.col("ci")[0].alias("t_lo"), F.col("ci")[1].alias("t_hi"), "t_sd", "untestable", F.when(F.size("untestable") > 0, 1.0).otherwise(F.col("p_raw")).alias("p"))


def shift_p(star: DataFrame, point: DataFrame) -> DataFrame:
    """cell, p, tail of samples `star` (cell, b, t) about `point` (cell, t)."""
    own = star.withColumnRenamed("t", "ts").join(point, "cell").groupBy("cell").agg(F.first("t").alias("t"), F.count("ts").alias("valid"), F.count_if(F.abs(F.col("ts") - F.col("t")) >= F.abs("t")).alias("far"))
    none = F.col("t").isNull() | (F.col("t") == 0)
    return own.select("cell", F.when(none, 1.0).otherwise((1 + F.col("far")) / (F.col("valid") + 1)).alias("p"), F.when(none, F.col("valid")).otherwise(F.col("far")).alias("tail"))


def reaches(x: Column, least: Column) -> Column:
    return x.isNotNull() & (F.abs(x) >= least - TOLERANCE)


def verdict(d: Column, wl: Column, untestable: Column, least: Column, sign: Column) -> tuple[Column, Column]:
    """Verdict and direction. d, wl: effects by period (wl of a subset, null for none). The sign test reads the first two."""
    a, b = F.get(d, 0), F.get(d, 1)
    defined = ~F.exists(d, lambda x: x.isNull())
    big = F.forall(d, lambda x: F.coalesce(reaches(x, least), F.lit(False)))
    same = (F.signum(a) == F.signum(b)) & (F.signum(a) != 0)
    subset = wl.isNull() | F.forall(F.coalesce(wl, F.array().cast("array<double>")), lambda x: F.coalesce(F.signum(x) == F.signum(a), F.lit(False)))
    ok = F.coalesce(defined & big & same & subset, F.lit(False))
    apart = F.coalesce(defined & big & (F.signum(a) * F.signum(b) < 0), F.lit(False))
    testable = F.size(untestable) == 0
    said = F.when(testable & ok, "consistent").when(testable & apart, "inconsistent").otherwise("inconclusive")
    return said, F.when(testable & ok, F.when(F.signum(a) == sign, "as_predicted").otherwise("opposite"))


def holm(pvalues: DataFrame) -> DataFrame:
    """ord, p, p_holm: step-down adjustment over all rows. One partition: a family is a handful of hypotheses."""
    order = Window.orderBy("p", "ord")
    m = F.count("*").over(Window.partitionBy())
    stepped = pvalues.withColumn("x", (m - F.row_number().over(order) + 1) * F.col("p"))
    return stepped.select("ord", "p", F.least(F.lit(1.0), F.max("x").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("p_holm"))


def cell_stats(effects: DataFrame, cells: DataFrame, boot: DataFrame, periods: list[str], draws: int = N_BOOT, subset: DataFrame | None = None) -> DataFrame:
    """One row per cell: confirm()'s columns, d and wl (arrays in period order), counts, verdict and direction.

    subset: member_idx of the members of the subset check.
    """
    order = F.array(*[F.lit(p) for p in periods])
    listed = lambda df, value, name: df.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("period", value))).alias("m")).select("cell", F.transform(order, lambda p: F.get(F.array(F.try_element_at("m", p)), 0)).alias(name))
    stat = period_stat(effects)
    out = cells.join(confirm(effects, boot, len(periods), draws), cells["name"] == F.col("cell")).join(listed(stat, "d", "d"), "cell").join(listed(stat, "informative", "h_count"), "cell")
    if subset is None:
        out = out.withColumns({"wl": F.lit(None).cast("array<double>"), "wl_count": F.lit(None).cast("array<bigint>")})
    else:
        marked = effects.join(F.broadcast(subset.select("member_idx", F.lit(True).alias("inside"))), "member_idx", "left").withColumn("h", F.col("h") & F.coalesce("inside", F.lit(False)))
        own = period_stat(marked)
        out = out.join(listed(own, "d", "wl"), "cell").join(listed(own, "informative", "wl_count"), "cell")
    said, direction = verdict(F.col("d"), F.col("wl"), F.col("untestable"), F.col("min_effect"), F.col("predicted_sign"))
    return out.withColumns({"verdict": said, "direction": direction})


def rejects(p_holm: Column) -> Column:
    return p_holm <= HOLM_ALPHA

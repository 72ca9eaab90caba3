"""Whether published findings apply to a configuration: classification by value, as joins against small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ANCHOR, MED_MIN, PRESETS, SIG_N, SMA_N
from ..functions.text import general

# fixed values: the tested universe, periods, rules and findings
UNIVERSE = (
    "AAPL", "MSFT", "NVDA", "AMZN", "GOOGL", "META", "AVGO", "TSLA", "AMD", "NFLX",
    "CRM", "ORCL", "ADBE", "QCOM", "TXN", "INTU", "AMAT", "MU", "NOW", "PANW",
    "GOOG", "TSM", "ASML", "IBM", "ISRG",
)
EVIDENCE_PERIODS = ("2016-09-20/2021-09-17", "2021-09-20/2025-12-31")
TESTED = {"v": "tested_drawdown_only", "f": "tested_drawdown_only", "vf": "components_tested_separately"}
UNTESTED = "untested_parameters"
#: (ord, cell, component, rule, metric, control, result, late, early, Holm p); drawdown effects in percentage points.
FINDINGS = (
    (0, "V1", "V", "v", "sharpe", "exposure_matched", "not established", 0.044, 0.063, 0.002),
    (1, "V2", "V", "v", "mdd", "exposure_matched", "passed", 2.09, 5.92, 0.002),
    (2, "F1", "F", "f", "calmar", "segment_shuffle", "not established", 0.028, -0.007, 0.742),
    (3, "F2", "F", "f", "mdd", "segment_shuffle", "passed", 5.72, 3.27, 0.002),
    (4, "VF1", "VF", "vf", "sharpe", "exposure_matched", "not established", 0.059, -0.007, 0.491),
    (5, None, "VF", "vf", "mdd", None, "never tested", None, None, None),
)
FROZEN = (("anchor", ANCHOR), ("sig_n", SIG_N), ("med_min", MED_MIN), ("sma_n", SMA_N))


def findings_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FINDINGS, "ord int, cell string, component string, rule string, metric string, control string, result string, late double, early double, holm_p double")


def rules_table(spark: SparkSession) -> DataFrame:
    rows = [(name, *PRESETS[name], status) for name, status in TESTED.items()]
    return spark.createDataFrame(rows, "rule string, rule_vol boolean, rule_floor double, rule_below double, status string")


def text(value: Column, number: bool = True) -> Column:
    """A value as text: `none` for null; numbers with six significant digits."""
    return F.coalesce(general(value) if number else value.cast("string"), F.lit("none"))


def match(configs: DataFrame) -> DataFrame:
    """configs with rule and status of the tested rule whose vol, vol_floor and below_sma are equal by value (no floor is
    not a floor of 0); null where there is none."""
    rules = F.broadcast(rules_table(configs.sparkSession))
    same = (configs["vol"] == rules["rule_vol"]) & configs["vol_floor"].eqNullSafe(rules["rule_floor"]) & (configs["below_sma"] == rules["rule_below"])
    return configs.join(rules, same, "left").drop("rule_vol", "rule_floor", "rule_below")


def classify(configs: DataFrame) -> DataFrame:
    """match() with config_status, deviations and applied_rule.

    Deviations: changed frozen parameters first; then, without a matching rule, what differs from the preset, or for the
    default preset's own values that they were only described.
    """
    frozen = [F.when(F.col(k).cast("string") != str(v), F.concat(F.lit(f"{k}="), text(F.col(k), not isinstance(v, str)))) for k, v in FROZEN]
    vol, floor, below = PRESETS["vf75"]
    described = (F.col("vol") == vol) & F.col("vol_floor").eqNullSafe(F.lit(floor)) & (F.col("below_sma") == below)
    note = " (descriptive comparison only)"
    noted = F.array(F.concat(F.lit("vol_floor="), text(F.col("vol_floor")), F.lit(note)), F.concat(F.lit("below_sma="), text(F.col("below_sma")), F.lit(note)))

    def preset(i: int) -> Column:
        out = F.lit(None)
        for name, values in PRESETS.items():
            out = F.when(F.col("preset") == name, F.lit(values[i])).otherwise(out)
        return out

    changed = [F.when(~F.col(k).eqNullSafe(preset(i)), F.concat(F.lit(f"{k}="), text(F.col(k), k != "vol"))) for i, k in enumerate(("vol", "vol_floor", "below_sma"))]
    own = F.when(F.col("rule").isNotNull(), F.array().cast("array<string>")).when(described, noted).otherwise(F.array_compact(F.array(*changed)))
    out = match(configs).withColumn("frozen", F.array_compact(F.array(*frozen)))
    out = out.withColumns({"deviations": F.concat("frozen", own), "applied_rule": F.when(F.size("frozen") == 0, F.col("rule"))})
    return out.withColumn("config_status", F.when(F.col("applied_rule").isNull(), UNTESTED).otherwise(F.col("status"))).drop("frozen")


def universe_membership(requests: DataFrame, universe: DataFrame, by: list[str]) -> DataFrame:
    """by, universe_membership: whether all, none or some of a request's symbols (any case) are in the universe."""
    own = requests.withColumn("symbol", F.upper("symbol")).join(universe.select(F.upper("symbol").alias("symbol"), F.lit(True).alias("inside")).distinct(), "symbol", "left")
    inside = F.coalesce("inside", F.lit(False))
    said = F.when(F.bool_and(inside), "in_backtest_universe").when(F.bool_or(inside), "mixed").otherwise("not_backtested")
    return own.groupBy(*by).agg(said.alias("universe_membership"))


def findings(configs: DataFrame, by: list[str]) -> DataFrame:
    """by, and every finding with whether it applies: to configurations that are a tested rule, its own findings.

    Each configuration meets the same six findings, which are put beside it as an array.
    """
    table = findings_table(configs.sparkSession)
    rows = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(row, table.dtypes)]) for row in FINDINGS])
    return classify(configs).select(*by, "applied_rule", F.explode(rows).alias("f")).select(*by, "f.*", F.coalesce(F.col("f.rule") == F.col("applied_rule"), F.lit(False)).alias("applies"))

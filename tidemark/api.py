"""What a user calls: snapshots, evidence blocks, append and verify, with results as rows or text."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Rule
from .operators import evidence, signals

#: The columns of a snapshot.
COLUMNS = ("symbol", "date", "close", "w", "w_vol", "wv", "above_sma200", "sma200", "sigma", "sigma_tgt", "vol_ratio", "bars", "first_bar", "error")


def snapshot(bars: DataFrame, symbols: list[str], rule: Rule) -> DataFrame:
    """One row per requested symbol in order (upper-cased, not de-duplicated); a symbol without bars keeps its row, with an error."""
    spark = bars.sparkSession
    asked = spark.createDataFrame([(i, s.upper()) for i, s in enumerate(symbols)], "ord int, symbol string")
    own = bars.join(F.broadcast(asked.select("symbol").distinct()), "symbol", "left_semi").where(F.col("dt") >= rule.anchor)
    last = signals.latest(signals.signals(own, rule))
    out = asked.join(last, "symbol", "left").withColumn("error", F.when(F.col("date").isNull(), F.lit(f"no settled bars on or after {rule.anchor}")))
    return out.orderBy("ord").select(*COLUMNS)


def evidence_block(spark: SparkSession, rule: Rule, symbols: list[str] | None = None, data_asof: str | None = None, forward_since: str | None = None) -> dict:
    """Which published findings apply to the rule; figures as stated there, drawdown effects in percentage points."""
    config = spark.createDataFrame([(0, rule.preset, rule.vol, rule.vol_floor, float(rule.below_sma), rule.anchor, rule.sig_n, rule.med_min, rule.sma_n)], "id int, preset string, vol boolean, vol_floor double, below_sma double, anchor string, sig_n int, med_min int, sma_n int")
    said = evidence.classify(config).select("config_status", "deviations").head()
    found = [r.asDict() for r in evidence.findings(config, ["id"]).orderBy("ord").drop("id", "ord").collect()]
    membership = None
    if symbols:
        universe = spark.createDataFrame([(s,) for s in evidence.UNIVERSE], "symbol string")
        asked = spark.createDataFrame([(0, s) for s in symbols], "id int, symbol string")
        membership = evidence.universe_membership(asked, universe, ["id"]).head()["universe_membership"]
    return {
        "config": rule.as_row(), "config_status": said["config_status"], "deviations": list(said["deviations"]), "universe_membership": membership, "component_findings": found,
        "evidence_window": list(evidence.EVIDENCE_PERIODS), "forward_track_since": forward_since, "data_asof": data_asof,
        "disclaimer": "History of a few large stocks over two periods; lower drawdowns came with lower returns. No forecast and no advice.",
    }


def number(x, digits: int = 4) -> str:
    return "-" if x is None else f"{x:.{digits}g}" if isinstance(x, float) else str(x)


def table(rows: list[dict], columns: tuple[str, ...] = ("symbol", "date", "close", "w", "w_vol", "above_sma200", "sma200", "sigma", "sigma_tgt", "error")) -> str:
    cells = [list(columns)] + [[number(r.get(c)) for c in columns] for r in rows]
    widths = [max(map(len, column)) for column in zip(*cells)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(row, widths)).rstrip() for row in cells)


def markdown(rows: list[dict], columns: tuple[str, ...]) -> str:
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(number(r.get(c)) for c in columns) + " |" for r in rows)])


def evaluation_dict(found: dict[str, DataFrame], tables: tuple[str, ...] = ("cells", "strategy", "summary", "c_dagger")) -> dict:
    """An evaluation's tables as lists of plain rows, for JSON: cells in their order, the others by path."""
    order = {"cells": ["ord"]}
    plain = lambda x: [plain(y) for y in x] if isinstance(x, list) else None if isinstance(x, float) and not math.isfinite(x) else x
    return {k: [{c: plain(v) for c, v in r.asDict(True).items()} for r in found[k].orderBy(*order.get(k, ["period", "symbol"])).collect()] for k in tables if k in found}


def grading_markdown(cells: DataFrame) -> str:
    """The graded cells of an evaluation as a Markdown table."""
    rows = [r.asDict() for r in cells.orderBy("ord").collect()]
    for r in rows:
        r["d"] = " / ".join(number(x) for x in r["d"])
        r["untestable"] = ",".join(map(str, r.get("untestable") or [])) or "-"
    return markdown(rows, ("name", "metric", "control", "d", "t", "t_lo", "t_hi", "p", "p_holm", "untestable", "verdict", "direction", "subset_check"))


def render(rows: list[dict], block: dict, form: str) -> str:
    if form == "json":
        return json.dumps({"results": rows, "evidence": block}, default=str, indent=2)
    text = markdown(rows, COLUMNS) if form == "markdown" else table(rows)
    lines = [text, "", f"config: {block['config_status']}" + "".join(f"; {d}" for d in block["deviations"])]
    return "\n".join(lines + [f"- {f['cell'] or f['component']}: {f['metric']} {f['result']}" + (" (applies)" if f["applies"] else "") for f in block["component_findings"]] + [block["disclaimer"]])

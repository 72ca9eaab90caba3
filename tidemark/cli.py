"""Command line: `python -m tidemark.cli snapshot SYMBOL... --bars PATH`, `evidence`, `append LOG`, `observe LOG`, `verify LOG`.

Results go to the standard output, refusals and warnings to the error output; the exit code is 1 where something failed.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys
import zoneinfo

from . import __version__, api, journal, refresh
from .config import ANCHOR, MED_MIN, PRESETS, SIG_N, SMA_N, UNSET, parse_budget, parse_floor, rule
from .operators import evidence, maintain, track
from .session import session
from .sources import remote


#: Seconds for all requests of a command.
SNAPSHOT_S, APPEND_S = 120.0, 600.0


def add_source(own: argparse.ArgumentParser, seconds: float) -> None:
    own.add_argument("--bars", default=None, help="a folder of CSV files by symbol, or a Parquet table")
    own.add_argument("--source", default=None, help="address of CSV bars with {symbol}, {start}, {stop}; without it only stored bars are read")
    own.add_argument("--offline", action="store_true", help="read stored bars only")
    own.add_argument("--budget", type=parse_budget, default=seconds, help="seconds for all requests")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    top.add_argument("--version", action="version", version=__version__)
    kinds = top.add_subparsers(dest="command", required=True)
    for name in ("snapshot", "evidence"):
        own = kinds.add_parser(name)
        own.add_argument("symbols", nargs="+" if name == "snapshot" else "*")
        own.add_argument("--preset", choices=sorted(PRESETS), default="vf75")
        own.add_argument("--vol-floor", type=parse_floor, default=UNSET)
        own.add_argument("--below-sma", type=float, default=UNSET)
        own.add_argument("--anchor", default=ANCHOR)
        for option, value in (("--sig-n", SIG_N), ("--med-min", MED_MIN), ("--sma-n", SMA_N)):
            own.add_argument(option, type=int, default=value)
        own.add_argument("--format", choices=("table", "json", "markdown"), default="table")
        if name == "snapshot":
            add_source(own, SNAPSHOT_S)
            own.add_argument("--today", type=dt.date.fromisoformat, default=None, help="New York date")
    own = kinds.add_parser("append")
    own.add_argument("log", help="the forward log, a Parquet table")
    add_source(own, APPEND_S)
    own.add_argument("--today", type=dt.date.fromisoformat, default=None, help="New York date")
    own.add_argument("--asof", type=dt.date.fromisoformat, default=None, help="an earlier day, with --dry-run only")
    own.add_argument("--dry-run", action="store_true", help="print the rows, write nothing")
    own.add_argument("--export", default=None, help="a file of JSON lines that gets the new rows too")
    own.add_argument("--symbols", nargs="+", default=list(evidence.UNIVERSE))
    own.add_argument("--anchor", default=ANCHOR)
    own = kinds.add_parser("verify")
    own.add_argument("log")
    own.add_argument("--prefix-of", default=None, help="an older copy that must be the log's beginning")
    own.add_argument("--observations", default=None, help="the observations, a Parquet table")
    own.add_argument("--lines", default=None, help="the log's exported file, verified too")
    own.add_argument("--public-ref", default=None, help="say which rows this git ref published in time; needs --observations, --repo and --lines")
    own.add_argument("--repo", default=".", help="the git repository of the exported file")
    own = kinds.add_parser("observe")
    own.add_argument("log", help="the observations, a Parquet table")
    own.add_argument("--repository", required=True, help="owner/name")
    own.add_argument("--ref", default="refs/heads/main")
    own.add_argument("--activity-file", default=None, help="a JSON array of activity entries, in place of the API")
    own.add_argument("--api", default="https://api.github.com")
    return top


def today_et() -> tuple[dt.date, dt.time]:
    now = dt.datetime.now(zoneinfo.ZoneInfo("America/New_York"))
    return now.date(), now.time()


def current_bars(spark, a: argparse.Namespace, symbols: list[str], anchor: str):
    """Settled bars, brought up to date before unless offline, and what happened by symbol."""
    place = a.bars or remote.default_folder()
    day, time = today_et()
    if a.today is not None:
        day, time = a.today, dt.time(23, 59)
    said = {}
    if a.source and not a.offline:
        said = refresh.refresh(spark, place, symbols, day, remote.http_csv(a.source), remote.Budget(a.budget), time, anchor)
    return maintain.settled(refresh.stored(spark, place)[0], day, time, anchor), said, day


def run_append(a: argparse.Namespace) -> int:
    spark, symbols = session(), [s.upper() for s in a.symbols]
    try:
        own, said, day = current_bars(spark, a, symbols, a.anchor)
        if spent := [s for s, x in said.items() if x["error"]]:
            raise journal.Refused(f"{said[spent[0]]['error']}; nothing written")
        done = journal.append(own, a.log, day, symbols, rule(anchor=a.anchor), asof=a.asof, dry_run=a.dry_run)
    except journal.Refused as e:
        print(f"refused: {e}", file=sys.stderr)
        return 1
    for s, through in done["stale"].items():
        print(f"not written: {s}, bars through {through}" + (f" ({said[s]['note']})" if s in said else ""), file=sys.stderr)
    if a.export and not a.dry_run:
        journal.export_lines(spark, a.log, a.export)
    print(json.dumps({"asof": str(done["asof"]), "deadline": done["deadline"], "appended": 0 if a.dry_run else len(done["rows"]), "stale": done["stale"]} | ({"dry_run": done["rows"]} if a.dry_run else {}), default=str))
    return 0


def run_verify(a: argparse.Namespace, top: argparse.ArgumentParser) -> int:
    spark = session()
    report = journal.verify(spark, a.log, a.prefix_of, a.observations)
    if a.lines:
        report["lines"] = journal.verify_lines(spark, a.lines)
    bad = report["error"] is not None or report.get("observations_error") is not None or report.get("is_prefix") is False or report.get("lines", {}).get("error") is not None
    if a.public_ref:
        if not (a.observations and a.lines):
            top.error("--public-ref needs --observations and --lines")
        if not bad:
            file = os.path.relpath(os.path.realpath(a.lines), os.path.realpath(a.repo))
            states = journal.public_states(spark, a.log, a.observations, a.repo, file, a.public_ref)
            report["states"] = track.state_counts(states).head().asDict()
            report["rows_status"] = [r.asDict() for r in states.orderBy("asof", "symbol").collect()]
    print(json.dumps(report, default=str))
    return int(bad)


def run_observe(a: argparse.Namespace) -> int:
    try:
        if a.activity_file:
            with open(a.activity_file, encoding="utf-8") as f:
                entries = json.load(f)
            if not isinstance(entries, list):
                raise ValueError(f"{a.activity_file}: no JSON array")
        else:
            entries = remote.fetch_activity(a.repository, a.ref, a.api, os.environ.get("GITHUB_TOKEN"))
        new = journal.observe(session(), a.log, entries, a.repository, a.ref)
    except (journal.Refused, OSError, ValueError) as e:
        print(f"refused: {e}", file=sys.stderr)
        return 1
    print(json.dumps({"recorded": len(new)}))
    return 0


def main(argv: list[str] | None = None) -> int:
    top = parser()
    a = top.parse_args(argv)
    if a.command == "verify":
        return run_verify(a, top)
    if a.command == "observe":
        return run_observe(a)
    if a.command == "append":
        if a.asof and not a.dry_run:
            top.error("--asof is for dry runs only")
        return run_append(a)
    try:
        own = rule(a.preset, vol_floor=a.vol_floor, below_sma=a.below_sma, anchor=a.anchor, sig_n=a.sig_n, med_min=a.med_min, sma_n=a.sma_n)
    except ValueError as e:
        top.error(str(e))
    spark = session()
    if a.command == "evidence":
        print(json.dumps(api.evidence_block(spark, own, a.symbols), indent=2))
        return 0
    symbols = [s.upper() for s in a.symbols]
    bars, said, _ = current_bars(spark, a, symbols, own.anchor)
    rows = [r.asDict() for r in api.snapshot(bars, symbols, own).collect()]
    for r in rows:
        about = said.get(r["symbol"], {})
        r |= {"note": about.get("note"), "stale": bool(about.get("degraded"))}
        if about.get("error"):
            r |= {k: None for k in r if k not in ("symbol", "note", "stale")} | {"error": about["error"]}
    asof = max((str(r["date"]) for r in rows if r["date"]), default=None)
    print(api.render(rows, api.evidence_block(spark, own, symbols, asof), a.format))
    if failed := [r["symbol"] for r in rows if r["error"]]:
        print(f"no result for {', '.join(failed)}", file=sys.stderr)
    return int(len(failed) == len(rows))


if __name__ == "__main__":
    sys.exit(main())

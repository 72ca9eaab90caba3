"""Remote sources with injectable transports: bars by symbol under a time budget, paginated activity, versions of a file."""

from __future__ import annotations

import datetime as dt
import io
import json
import os
import re
import subprocess
import time
import urllib.parse
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .bars import BARS, PRICES

#: Seconds: a request's longest time, and what must be left to start one.
REQUEST_S, LEAST_S = 20.0, 1.0
WAITS_S = (3.0, 6.0)
PAGE, MAX_PAGES = 100, 10


class BudgetExceeded(Exception):
    """No time is left for a request or for the wait before its repetition."""


class Budget:
    """A deadline that requests and waits draw on."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.clock, self.sleep = clock, sleep
        self.end = clock() + seconds

    def left(self) -> float:
        return self.end - self.clock()

    def timeout(self) -> float:
        if self.left() < LEAST_S:
            raise BudgetExceeded(f"{self.left():.1f} s left")
        return min(REQUEST_S, self.left())

    def wait(self, seconds: float) -> None:
        if self.left() - seconds < LEAST_S:
            raise BudgetExceeded(f"no time for a wait of {seconds} s")
        self.sleep(seconds)


def fetch_bars(symbol: str, start: dt.date, stop: dt.date, transport: Callable, budget: Budget, waits=WAITS_S) -> pd.DataFrame | None:
    """Bars of [start, stop) from transport(symbol, start, stop, timeout), tried again after each of `waits`; None if all
    tries fail or give nothing. Days lose their zone, rows with an empty price go."""
    for wait in (*waits, None):
        try:
            own = transport(symbol, start, stop, budget.timeout())
            if own is not None and len(own):
                own = own.copy()
                own["dt"] = pd.to_datetime(own["dt"]).dt.tz_localize(None).dt.date
                return own.assign(symbol=symbol)[["symbol", "dt", *PRICES]].dropna()
        except BudgetExceeded:
            raise
        except Exception:  # noqa: S110  a failed try; the last one gives None
            pass
        if wait is not None:
            budget.wait(wait)
    return None


def http_csv(template: str, opener: Callable | None = None) -> Callable:
    """A transport that reads CSV (date, open, high, low, close, volume, with a header) from template's address, in which
    {symbol}, {start} and {stop} are filled in."""

    def transport(symbol: str, start: dt.date, stop: dt.date, timeout: float) -> pd.DataFrame:
        with (opener or urllib.request.urlopen)(template.format(symbol=urllib.parse.quote(symbol), start=start, stop=stop), timeout=timeout) as answer:
            own = pd.read_csv(io.BytesIO(answer.read())).iloc[:, : 1 + len(PRICES)]
        return own.set_axis(["dt", *PRICES], axis=1)

    return transport


def bars_frame(spark: SparkSession, symbols: list[str], start: dt.date | dict[str, dt.date], stop: dt.date, transport: Callable, budget: Budget) -> tuple[DataFrame, dict[str, str]]:
    """Bars of all symbols, from one day or from each one's own, and a note for each that failed; a used-up budget ends the
    run with the rest noted."""
    frames, notes = [], {}
    for i, symbol in enumerate(symbols):
        try:
            own = fetch_bars(symbol, start[symbol] if isinstance(start, dict) else start, stop, transport, budget)
        except BudgetExceeded as e:
            notes |= {s: f"fetch budget exhausted ({e})" for s in symbols[i:]}
            break
        if own is None:
            notes[symbol] = "fetch failed"
        else:
            frames.append(own)
    data = pd.concat(frames) if frames else pd.DataFrame(columns=BARS.names)
    return spark.createDataFrame(data[BARS.names].astype({c: float for c in PRICES}), BARS) if len(data) else spark.createDataFrame([], BARS), notes


def fetch_activity(repository: str, ref: str, api: str, token: str | None = None, opener: Callable | None = None, max_pages: int = MAX_PAGES, timeout: float = 30) -> list[dict]:
    """All entries of a paginated activity list (JSON arrays, `Link: ...; rel="next"`), from one host only."""
    if not re.fullmatch(r"[\w.-]+/[\w.-]+", repository, re.A):
        raise ValueError(f"not owner/name: {repository!r}")
    opener = opener or urllib.request.urlopen
    url, out = f"{api}/repos/{repository}/activity?" + urllib.parse.urlencode({"per_page": PAGE, "ref": ref}, safe="/"), []
    for _ in range(max_pages):
        request = urllib.request.Request(url, headers={"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {}))
        with opener(request, timeout=timeout) as answer:
            page, links = json.loads(answer.read()), (answer.headers or {}).get("Link") or ""
        if not isinstance(page, list):
            raise ValueError(f"{url}: no JSON array")
        out += page
        following = re.search(r'<([^>]+)>\s*;\s*rel="next"', links)
        if not following:
            break
        url = following[1]
        if not url.startswith(f"{api}/"):
            raise ValueError(f"a link leads to another host: {url}")
    return out


def activity_frame(spark: SparkSession, entries: list[dict]) -> DataFrame:
    rows = [(i, *(None if e.get(k) is None else str(e[k]) for k in ("id", "activity_type", "ref", "after", "timestamp"))) for i, e in enumerate(entries) if isinstance(e, dict)]
    return spark.createDataFrame(rows, "seq int, id string, activity_type string, ref string, after string, timestamp string")


def file_versions(spark: SparkSession, repository: str, path: str) -> DataFrame:
    """commit_ord, sha, committed_at, seq, line: every version of a file in a git history, oldest first."""
    git = lambda *a: subprocess.run(["git", "-C", repository, *a], capture_output=True, text=True)
    rows = []
    for i, entry in enumerate(git("log", "--reverse", "--format=%H %cI", "--", path).stdout.splitlines()):
        sha, when = entry.split(" ", 1)
        shown = git("show", f"{sha}:{path}")
        if shown.returncode == 0:  # else the commit deleted it
            rows += [(i, sha, when, n, line) for n, line in enumerate(shown.stdout.splitlines(), 1)]
    return spark.createDataFrame(rows, "commit_ord int, sha string, committed_at string, seq int, line string")


def git_commits(spark: SparkSession, repository: str, *refs: str) -> DataFrame:
    """child, parent of the commits that refs reach."""
    out = subprocess.run(["git", "-C", repository, "rev-list", "--parents", *(refs or ("--all",))], capture_output=True, text=True, check=True).stdout
    return spark.createDataFrame([(c, p) for c, *parents in map(str.split, out.splitlines()) for p in parents], "child string, parent string")


def git_reach(spark: SparkSession, repository: str, heads: list[str]) -> DataFrame:
    """head, sha: the commits that each head reaches; heads that the repository does not have reach nothing."""
    rows = []
    for head in heads:
        done = subprocess.run(["git", "-C", repository, "rev-list", head, "--"], capture_output=True, text=True)
        rows += [(head, sha) for sha in done.stdout.split()] if done.returncode == 0 else []
    return spark.createDataFrame(rows, "head string, sha string")


def default_folder() -> str:
    """Where bars are kept: TIDEMARK_HOME, or a folder in the user's home."""
    return os.environ.get("TIDEMARK_HOME") or os.path.join(os.path.expanduser("~"), ".tidemark", "bars")


def append_lines(path: str, rows: list[dict]) -> None:
    """Adds rows to a JSON-lines file: written beside it whole, then put in its place. ASCII, compact, no NaN."""
    before = ""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            before = f.read()
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(tmp := f"{path}.tmp", "w", encoding="utf-8", newline="\n") as f:
        f.write(before + "".join(json.dumps(r, separators=(",", ":"), ensure_ascii=True, allow_nan=False) + "\n" for r in rows))
    os.replace(tmp, path)

"""The commands end to end: fetch and store, append and its refusals, exported lines, observations, publication."""

import datetime as dt
import json
import subprocess

import pandas as pd
import pytest
from helpers import BARS, bars_rows, random_walk
from pyspark.sql import functions as F

from tidemark import cli, journal, refresh
from tidemark.config import rule
from tidemark.sources import bars, remote

START = dt.date(2024, 1, 1)  # a Monday
NAMES = ["AA", "BB", "CC"]


def rows_of(symbol, days, factor=1.0):
    return [(s, d, *(x * factor for x in p)) for s, d, *p in bars_rows(symbol, random_walk(days, 1)[1], start=START)]


def server(series, calls=None, fail=()):
    def transport(symbol, start, stop, timeout):
        if calls is not None:
            calls.append((symbol, start))
        if symbol in fail:
            raise OSError("down")
        own = [r for r in series.get(symbol, []) if start <= r[1] < stop]
        return pd.DataFrame([r[1:] for r in own], columns=["dt", *bars.PRICES])

    return transport


def budget():
    return remote.Budget(600, lambda: 0.0, lambda s: None)


@pytest.mark.parametrize("tabular", [True, False])
def test_refresh_decides_by_symbol(spark, tmp_path, tabular):
    place, day = str(tmp_path / "bars"), START + dt.timedelta(days=49)
    series = {s: rows_of(s, 50) for s in ("AA", "BB", "CC", "DD")}
    have = series["AA"][:40] + [(s, d, *(x * 2 for x in p)) for s, d, *p in series["BB"][:40]] + series["CC"][:40]
    (bars.write_table if tabular else bars.write_csv)(spark.createDataFrame(have, BARS), place)
    calls = []
    said = refresh.refresh(spark, place, ["AA", "BB", "CC", "DD", "EE"], day, server(series, calls, fail=("CC",)), budget(), dt.time(12), "2024-01-01")
    assert {s: (x["action"], x["degraded"]) for s, x in said.items()} == {"AA": ("append", False), "BB": ("replace", False), "CC": ("cache", True), "DD": ("initial", False), "EE": ("failed", True)}
    assert ("AA", START + dt.timedelta(days=9)) in calls and ("BB", START) in calls and ("AA", START) not in calls
    got = refresh.stored(spark, place)[0]
    # the day is not over: its bar is not stored
    assert {r.symbol: (r.n, r.last) for r in got.groupBy("symbol").agg(F.count("*").alias("n"), F.max("dt").alias("last")).collect()} == {s: (n, START + dt.timedelta(days=n - 1)) for s, n in (("AA", 49), ("BB", 49), ("CC", 40), ("DD", 49))}
    assert got.where("symbol = 'BB'").orderBy("dt").first().c == series["BB"][0][5]
    again = refresh.refresh(spark, place, ["AA"], day, server(series), budget(), dt.time(12), "2024-01-01")
    assert again["AA"]["note"] == "no new data"


def test_refresh_without_time_changes_nothing(spark, tmp_path):
    place, series = str(tmp_path / "bars"), {s: rows_of(s, 30) for s in NAMES}
    bars.write_table(spark.createDataFrame(series["AA"][:10], BARS), place)
    clock = iter([0.0, 0.0, 0.0, 9.9, 9.9, 9.9, 9.9, 9.9])
    said = refresh.refresh(spark, place, NAMES, START + dt.timedelta(days=29), server(series), remote.Budget(10, lambda: next(clock, 9.9)), dt.time(23), "2024-01-01")
    assert "budget" in said["CC"]["error"] and "budget" in said["BB"]["error"]
    assert refresh.stored(spark, place)[0].select("symbol").distinct().count() == 1


def test_commands(spark, tmp_path, capsys, monkeypatch):
    folder, log, seen, repo = (str(tmp_path / x) for x in ("bars", "log", "seen", "repo"))
    file, day = f"{repo}/daily.jsonl", START + dt.timedelta(days=39)  # a Friday
    series = {s: rows_of(s, 60) for s in NAMES}
    monkeypatch.setattr(remote, "http_csv", lambda template: server(series))
    common = ["--bars", folder, "--symbols", *NAMES, "--anchor", "2024-01-01"]
    subprocess.run(["git", "init", "-q", repo], check=True)
    git = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True, text=True).stdout.strip()

    assert cli.main(["append", log, "--today", str(day), "--offline", *common]) == 1 and "no symbol has settled bars" in capsys.readouterr().err
    assert cli.main(["append", log, "--today", str(day), "--source", "x", "--dry-run", *common]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["appended"] == 0 and len(said["dry_run"]) == 3 and journal.read(spark, log).count() == 0
    assert cli.main(["append", log, "--today", str(day - dt.timedelta(days=1)), *common]) == 1 and "after today" in capsys.readouterr().err
    assert cli.main(["append", log, "--today", str(day + dt.timedelta(days=1)), "--source", "x", *common]) == 1 and "no weekday" in capsys.readouterr().err
    assert cli.main(["append", log, "--today", str(day + dt.timedelta(days=1)), "--dry-run", "--asof", str(day), *common]) == 0
    assert json.loads(capsys.readouterr().out)["asof"] == str(day)
    with pytest.raises(SystemExit):
        cli.main(["append", log, "--asof", str(day), *common])
    monkeypatch.setattr(remote, "Budget", lambda s: type("B", (), {"timeout": lambda self: (_ for _ in ()).throw(remote.BudgetExceeded("none"))})())
    assert cli.main(["append", log, "--today", str(day + dt.timedelta(days=3)), "--source", "x", *common]) == 1 and "nothing written" in capsys.readouterr().err
    monkeypatch.undo()

    # Friday's rows: committed, pushed before Monday's opening; Monday's rows: committed, pushed days later
    whole = spark.createDataFrame([r for s in NAMES for r in series[s]], BARS)
    for k, back in ((39, 0), (42, 0)):
        until = START + dt.timedelta(days=k)
        journal.append(whole.where(F.col("dt") <= F.lit(until)), log, until, NAMES, rule(anchor="2024-01-01"), dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc))
        assert journal.export_lines(spark, log, file) == 3
        git("add", "-A")
        git("commit", "-q", "-m", f"day {k}")
    assert journal.export_lines(spark, log, file) == 0
    shas = git("log", "--reverse", "--format=%H").split()
    entries = [
        {"id": 2, "activity_type": "push", "ref": "refs/heads/main", "after": shas[1], "timestamp": "2024-02-20T10:00:00Z"},
        {"id": 1, "activity_type": "push", "ref": "refs/heads/main", "after": shas[0].upper(), "timestamp": "2024-02-10T10:00:00Z"},
        {"id": 1, "activity_type": "push", "ref": "refs/heads/main", "after": "f" * 40, "timestamp": "2024-02-11T10:00:00Z"},
        {"id": 3, "activity_type": "push", "ref": "refs/heads/dev", "after": shas[1], "timestamp": "2024-02-12T10:00:00Z"},
    ]
    (tmp_path / "activity.json").write_text(json.dumps(entries))
    observe = ["observe", seen, "--repository", "a/b", "--activity-file", str(tmp_path / "activity.json")]
    assert cli.main(observe) == 0 and json.loads(capsys.readouterr().out) == {"recorded": 2}
    assert cli.main(observe) == 0 and json.loads(capsys.readouterr().out) == {"recorded": 0}
    stored = journal.read_observations(spark, seen).orderBy("seq").collect()
    assert [(r.event_id, r.head_sha, r.repo, r.commits) for r in stored] == [("1", shas[0], "a/b", []), ("2", shas[1], "a/b", [])]
    (tmp_path / "activity.json").write_text("{}")
    assert cli.main(observe) == 1 and "no JSON array" in capsys.readouterr().err

    verify = ["verify", log, "--observations", seen, "--lines", file, "--repo", repo, "--public-ref", "HEAD"]
    assert cli.main(verify) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["states"] == {"unpublished": 0, "published_unverified": 0, "late": 3, "forward": 3} and report["observations"] == 2 and report["lines"] == {"rows": 6, "error": None}
    assert {r["state"] for r in report["rows_status"] if r["asof"] == str(day)} == {"forward"}

    good = open(file).read().splitlines(keepends=True)
    for lines, error in (
        (good[:2] + [good[2].replace('"symbol":"CC"', '"symbol":"CX"')] + good[3:], "line 3: row_hash does not match"),
        (good[:1] + good[2:], "line 2: prev_hash does not match"),
        ([*good, "{broken\n"], "line 7: not valid JSON"),
        ([*good[:5], json.dumps(dict(reversed(json.loads(good[5]).items()))) + "\n"], "line 6: other keys or order"),
        ([*good[:5], good[5].rstrip("\n")], "line 6: no line end"),
        ([], None),
    ):
        with open(f"{repo}/other", "w") as f:
            f.writelines(lines)
        assert journal.verify_lines(spark, f"{repo}/other") == {"rows": len(lines), "error": error}

import datetime as dt
import io
import json
import subprocess

import numpy as np
import pandas as pd
import pytest
from helpers import BARS, PATHS, bars_rows, path_rows, random_walk, slow_ledger
from pyspark.sql import functions as F

from tidemark import api, cli
from tidemark.config import rule
from tidemark.operators import track
from tidemark.sources import bars, remote
from tidemark.streaming import flows

SF = "/root/testdata/sf0.001"


def test_csv_and_table_round_trip(spark, tmp_path):
    own = spark.createDataFrame(bars_rows("AB.C", [0.1 + 0.2, 1 / 3]) + bars_rows("D", [5.0]), BARS)
    bars.write_csv(own, str(tmp_path / "csv"))
    got = bars.read_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, own.collect()))
    (tmp_path / "csv" / "D.csv").write_text("Date,O,H,L,C,V\n2020-01-01,1,1,,1,1\n2020-01-02,1,1,1,1,1\n")
    assert bars.read_csv(spark, str(tmp_path / "csv")).where("symbol = 'D'").count() == 1
    bars.write_table(own, str(tmp_path / "t"))
    bars.write_table(own.where("symbol = 'D'").withColumn("c", F.lit(9.0)), str(tmp_path / "t"))
    assert {r.symbol: r.c for r in bars.read_table(spark, str(tmp_path / "t")).where("dt = '2020-01-01'").collect()} == {"AB.C": 0.1 + 0.2, "D": 9.0}


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def test_fetch_retries_and_budget(spark):
    good = pd.DataFrame({"dt": pd.to_datetime(["2024-01-02"]).tz_localize("UTC"), **{c: [1.0] for c in "ohlcv"}})
    clock, tries = Clock(), []

    def flaky(symbol, start, stop, timeout):
        tries.append(timeout)
        if len(tries) < 3:
            raise OSError
        return good

    out = remote.fetch_bars("A", dt.date(2024, 1, 1), dt.date(2024, 1, 3), flaky, remote.Budget(60, clock, clock.sleep))
    assert out["dt"].tolist() == [dt.date(2024, 1, 2)] and clock.slept == [3.0, 6.0] and tries == [20.0, 20.0, 20.0]
    assert remote.fetch_bars("A", None, None, lambda *a: None, remote.Budget(60, clock, clock.sleep)) is None
    late = Clock()
    frame, notes = remote.bars_frame(spark, ["A", "B"], None, None, lambda *a: None, remote.Budget(3.5, late, late.sleep))
    assert frame.count() == 0 and set(notes) == {"A", "B"} and "budget" in notes["B"]


class Answer(io.BytesIO):
    def __init__(self, body, link=None):
        super().__init__(json.dumps(body).encode())
        self.headers = {"Link": link} if link else {}


def test_pages():
    host, seen = "https://api.test", []

    def opener(request, timeout):
        seen.append(request.full_url)
        return Answer([{"id": len(seen)}], f'<{host}/next{len(seen)}>; rel="next"' if len(seen) < 3 else None)

    assert [e["id"] for e in remote.fetch_activity("a/b", "refs/heads/main", host, opener=opener)] == [1, 2, 3]
    assert seen[0] == f"{host}/repos/a/b/activity?per_page=100&ref=refs/heads/main"
    with pytest.raises(ValueError, match="another host"):
        remote.fetch_activity("a/b", "r", host, opener=lambda *a, **k: Answer([], '<https://evil.test/x>; rel="next"'))
    with pytest.raises(ValueError, match="array"):
        remote.fetch_activity("a/b", "r", host, opener=lambda *a, **k: Answer({}))
    with pytest.raises(ValueError, match="owner/name"):
        remote.fetch_activity("a/b/../c", "r", host)


def test_file_versions(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    for text in ("a\n", "a\nb\n"):
        (tmp_path / "log").write_text(text)
        git("add", "log")
        git("commit", "-qm", text)
    rows = remote.file_versions(spark, str(tmp_path), "log")
    assert sorted((r.commit_ord, r.line) for r in rows.collect()) == [(0, "a"), (1, "a"), (1, "b")]
    first = track.introducing_version(rows.select(F.col("line").alias("row_hash"), "commit_ord", "sha", "committed_at"))
    assert {r.row_hash: r.sha for r in first.collect()} == {r.line: r.sha for r in rows.where("commit_ord = if(line = 'a', 0, 1)").collect()}
    assert remote.git_commits(spark, str(tmp_path)).count() == 1


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "x" / "log.jsonl")
    remote.append_lines(path, [{"b": 1, "a": "é"}])
    remote.append_lines(path, [{"b": 2, "a": None}])
    assert open(path).read() == '{"b":1,"a":"\\u00e9"}\n{"b":2,"a":null}\n'
    with pytest.raises(ValueError):
        remote.append_lines(path, [{"b": float("nan")}])
    lines = track.read_lines(spark, path)
    assert [(r.seq, r.row.b, r.error) for r in track.parse_log(lines, "struct<b: int, a: string>").orderBy("seq").collect()] == [(1, 1, None), (2, 2, None)]


def test_bars_from_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    query = flows.bars_stream(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got, want = spark.read.parquet(str(tmp_path / "out")), bars.from_events(events)
    last = events.agg(F.to_date(F.max("ts"))).head()[0]
    settled = want.where(F.col("dt") < F.date_sub(F.lit(last), 1))
    assert settled.count() > 0 and settled.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0


def test_ledger_over_a_stream(spark, tmp_path):
    o, c = random_walk(60, 4)
    target = np.concatenate([[1.0], np.repeat([1.0, 0.5, 0.8, 0.3, 1.0, 0.6], 10)[:59]])
    days = spark.createDataFrame(path_rows("p", "S", o, c, target), PATHS).select("symbol", "dt", "o", "c", "target")
    for k, part in enumerate((days.where("dt < '2020-01-25'"), days.where("dt >= '2020-01-25'"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(days.schema).parquet(str(tmp_path / "in"))
        query = flows.ledger_stream(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    v, w, paid, trades = slow_ledger(o, c, target, "threshold")
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("t").collect()
    assert len(got) == 60 and np.allclose([r.v for r in got], v, rtol=1e-12) and got[-1].trades == trades and got[-1].paid == pytest.approx(paid)


def test_observation_batches(spark, tmp_path):
    from tidemark.shared import ensure_checkpoints

    ensure_checkpoints(spark)
    entry = lambda i, day: {"id": i, "activity_type": "push", "ref": "r", "after": f"{i:040x}", "timestamp": f"2024-01-{day:02}T00:00:00Z"}
    run = flows.observe_batch(str(tmp_path / "log"), "r")
    run(remote.activity_frame(spark, [entry(2, 3), entry(1, 2), entry(2, 4)]), 0)
    again = remote.activity_frame(spark, [entry(2, 3), entry(3, 1)])
    run(again, 1)
    run(again, 1)  # a repeated batch
    log = spark.read.parquet(str(tmp_path / "log"))
    assert [r.event_id for r in log.orderBy("seq").collect()] == ["1", "2", "3"]
    assert track.verify(log, ["log"], ["event_id"]).count() == 0


def test_snapshot_and_evidence(spark):
    own = spark.createDataFrame(bars_rows("A", random_walk(300, 1)[1], start=dt.date(2020, 1, 1)), BARS)
    rows = [r.asDict() for r in api.snapshot(own, ["a", "nope", "a"], rule()).collect()]
    assert [r["symbol"] for r in rows] == ["A", "NOPE", "A"] and rows[1]["error"] and not rows[0]["error"] and rows[0]["bars"] == 300
    block = api.evidence_block(spark, rule(), ["AAPL", "ZZZ"])
    assert block["universe_membership"] == "mixed" and block["config_status"] == "untested_parameters" and len(block["component_findings"]) == 6
    assert [f["cell"] for f in api.evidence_block(spark, rule("f"))["component_findings"] if f["applies"]] == ["F1", "F2"]
    for form in ("json", "table", "markdown"):
        assert "NOPE" in api.render(rows, block, form)
    assert json.loads(api.render(rows, block, "json"))["results"][0]["symbol"] == "A"


def test_command_line(spark, tmp_path, capsys):
    own = spark.createDataFrame(bars_rows("A", random_walk(300, 1)[1], start=dt.date(2020, 1, 1)), BARS)
    bars.write_csv(own, str(tmp_path / "csv"))
    assert cli.main(["snapshot", "A", "--bars", str(tmp_path / "csv"), "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["results"][0]["bars"] == 300
    bars.write_table(own, str(tmp_path / "t"))
    assert cli.main(["snapshot", "A", "B", "--bars", str(tmp_path / "t")]) == 0 and cli.main(["snapshot", "B", "--bars", str(tmp_path / "t")]) == 1
    assert cli.main(["evidence", "--preset", "v"]) == 0 and "tested_drawdown_only" in capsys.readouterr().out
    for bad in (["snapshot", "A", "--below-sma", "0"], ["nonsense"], ["snapshot", "A", "--vol-floor", "2"]):
        with pytest.raises(SystemExit) as e:
            cli.main(bad)
        assert e.value.code == 2

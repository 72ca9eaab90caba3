import datetime as dt
import hashlib
import json

import pytest
from helpers import BARS, bars_rows
from pyspark.sql import functions as F

from tidemark.operators import evidence, maintain, track
from tidemark.sources import remote


def frame(spark, rows):
    return spark.createDataFrame(rows, BARS)


def moved(rows, **change):
    names = BARS.replace(" string", "").replace(" double", "").replace(" date", "").split(", ")
    return [tuple(change.get(n, lambda x: x)(v) for n, v in zip(names, r)) for r in rows]


@pytest.fixture
def stored():
    return bars_rows("A", range(100, 140))  # 2020-01-01 .. 2020-02-09


def action(spark, old, new, full):
    every = [(s,) for s in {r[0] for r in old + new + full} or {"A"}]
    out = maintain.decide(spark.createDataFrame(every, "symbol string"), frame(spark, old), frame(spark, new), frame(spark, full), "2020-01-01").head()
    return out.action, out.degraded, out.gap, out.appended


def test_update_decisions(spark, stored):
    recent = stored[9:]  # from 30 days before the last
    longer = bars_rows("A", range(100, 145))
    assert action(spark, stored, [], []) == ("cache", True, 0, 0)
    assert action(spark, stored, recent, []) == ("none", False, 0, 0)
    assert action(spark, stored, longer[9:], []) == ("append", False, 0, 5)
    assert action(spark, stored, longer[9:20] + longer[22:], []) == ("append", True, 2, 5)
    adjusted = moved(longer, c=lambda x: x / 2)
    assert action(spark, stored, adjusted[9:], adjusted) == ("replace", False, 0, 0)
    assert action(spark, stored, adjusted[9:], adjusted[:5] + adjusted[6:]) == ("cache", True, 1, 0)  # never overwritten by less
    assert action(spark, stored, adjusted[9:], []) == ("cache", True, 0, 0)
    assert action(spark, [], [], longer) == ("initial", False, 0, 0)
    assert action(spark, [], longer[:0], []) == ("failed", True, 0, 0)


def test_overlap_tolerance(spark, stored):
    ok = lambda f: maintain.overlap_ok(frame(spark, stored), frame(spark, moved(stored[5:], c=f))).head().ok
    assert ok(lambda x: x * (1 + 5e-10)) and not ok(lambda x: x * (1 + 2e-9))
    assert not maintain.overlap_ok(frame(spark, stored), frame(spark, bars_rows("A", [1.0], start=dt.date(2021, 1, 1)))).head().ok


def test_merge_and_settled(spark, stored):
    new = moved(bars_rows("A", range(100, 145))[35:], v=lambda x: 7.0)
    merged = maintain.merge_by_date(frame(spark, stored), frame(spark, new)).orderBy("dt").collect()
    assert len(merged) == 45 and [r.v for r in merged] == [1.0] * 35 + [7.0] * 10
    last = dt.date(2020, 2, 9)
    n = lambda *a: maintain.settled(frame(spark, stored), *a).count()
    assert n(last, dt.time(16, 4), None) == 39 and n(last, dt.time(16, 5), None) == 40 and n(last + dt.timedelta(1), dt.time(9), None) == 40
    assert n(last, dt.time(16, 5), "2020-02-01") == 9


def test_evidence_matches_by_value(spark):
    base = dict(anchor="2019-06-01", sig_n=20, med_min=250, sma_n=200)
    rows = [
        (0, "vf75", True, None, 1.0, *base.values()),
        (1, "vf75", True, 0.0, 1.0, *base.values()),
        (2, "vf75", True, 0.75, 0.75, *base.values()),
        (3, "vf", True, None, 0.5, *base.values()),
        (4, "f", False, None, 0.5, "2019-06-01", 20, 250, 150),
    ]
    configs = spark.createDataFrame(rows, "id int, preset string, vol boolean, vol_floor double, below_sma double, anchor string, sig_n int, med_min int, sma_n int")
    got = {r.id: r for r in evidence.classify(configs).collect()}
    assert got[0].config_status == "tested_drawdown_only" and got[0].applied_rule == "v" and got[0].deviations == []
    assert got[1].config_status == evidence.UNTESTED and got[1].deviations == ["vol_floor=0", "below_sma=1"]
    assert got[2].config_status == evidence.UNTESTED and all("descriptive" in d for d in got[2].deviations)
    assert got[3].config_status == "components_tested_separately"
    assert got[4].config_status == evidence.UNTESTED and got[4].deviations == ["sma_n=150"] and got[4].applied_rule is None
    applies = evidence.findings(configs, ["id"]).where("applies").groupBy("id").count().orderBy("id").collect()
    assert [tuple(r) for r in applies] == [(0, 2), (3, 2)]


def test_universe(spark):
    assert len(evidence.UNIVERSE) == 25
    universe = spark.createDataFrame([(s,) for s in evidence.UNIVERSE], "symbol string")
    asked = spark.createDataFrame([(0, "aapl"), (0, "MSFT"), (1, "XYZ"), (2, "IBM"), (2, "XYZ")], "id int, symbol string")
    got = {r.id: r[1] for r in evidence.universe_membership(asked, universe, ["id"]).collect()}
    assert got == {0: "in_backtest_universe", 1: "not_backtested", 2: "mixed"}


# ---------------------------------------------------------------- logs
@pytest.fixture
def sealed(spark):
    rows = spark.createDataFrame([(0, i, f"2024-01-{i:02}", "A") for i in range(1, 9)], "log int, seq int, asof string, symbol string")
    return track.seal(rows.withColumn("canon", track.canonical({"asof": F.col("asof"), "symbol": F.col("symbol")})), ["log"]).cache()


def check(rows):
    bad = track.verify(rows, ["log"], ["asof", "symbol"]).collect()
    return (bad[0].line, bad[0].error) if bad else None


def test_seal_and_verify(sealed):
    rows = sealed.orderBy("seq").collect()
    last = track.ZERO
    for r in rows:
        assert r.prev_hash == last and r.row_hash == hashlib.sha256(f"{r.canon}\x1e{last}".encode()).hexdigest()
        last = r.row_hash
    assert check(sealed) is None
    assert check(sealed.withColumn("canon", F.when(F.col("seq") == 3, "x").otherwise(F.col("canon")))) == (3, "row_hash does not match")
    assert check(sealed.where("seq <> 4")) == (4, "prev_hash does not match")
    assert check(sealed.where("seq < 7")) is None  # a lost end shows in the prefix check only
    assert check(sealed.withColumn("asof", F.when(F.col("seq") == 6, "2024-01-02").otherwise(F.col("asof")))) == (6, "duplicate key")


def test_sealing_goes_on_from_the_last_hash(spark, sealed):
    new = spark.createDataFrame([(0, 9, "2024-01-09", "A")], "log int, seq int, asof string, symbol string").withColumn("canon", track.canonical({"asof": F.col("asof"), "symbol": F.col("symbol")}))
    head = sealed.orderBy(F.desc("seq")).head().row_hash
    more = track.seal(new, ["log"], F.lit(head))
    assert check(sealed.unionByName(more)) is None


def test_prefix(spark):
    lines = lambda *x: spark.createDataFrame([(i, s) for i, s in enumerate(x)], "seq int, line string")
    assert track.prefix_check(lines("a", "b", "c"), lines("a", "b")).head().is_prefix
    assert not track.prefix_check(lines("a"), lines("a", "b")).head().is_prefix
    assert not track.prefix_check(lines("a", "x"), lines("a", "b")).head().is_prefix


def test_canonical_json(spark):
    text = '{"b": 1e-05, "a": {"z": "\\u00e9", "y": [1, 2.50]}}'
    got = spark.createDataFrame([(text,), (None,)], "s string").select(track.canonical_json(F.col("s"))).collect()
    assert got[0][0] == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":")) and got[1][0] is None


@pytest.mark.parametrize("asof, utc", [("2024-03-07", "2024-03-08 14:30:00"), ("2024-03-08", "2024-03-11 13:30:00"), ("2024-11-01", "2024-11-04 14:30:00"), ("2024-07-06", "2024-07-08 13:30:00")])
def test_deadline(spark, asof, utc):
    got = spark.createDataFrame([(asof,)], "d string").select(F.date_format(track.deadline(F.to_date("d")), "yyyy-MM-dd HH:mm:ss")).head()[0]
    assert got == utc


def test_publication_states(spark):
    day = dt.date(2024, 3, 7)  # due 2024-03-08 14:30 UTC
    rows = spark.createDataFrame([(h, day) for h in "abcdef"], "row_hash string, asof date")
    intro = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s3"), ("d", "s4"), ("e", "s5")], "row_hash string, sha string")
    public = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s5",)], "sha string")
    at = lambda h, m: dt.datetime(2024, 3, 8, h, m, tzinfo=dt.timezone.utc)
    obs = spark.createDataFrame([("s1", at(14, 30), []), ("h", at(14, 31), ["s2"]), ("h", at(20, 0), [])], "head_sha string, push_time timestamp, commits array<string>")
    reach = spark.createDataFrame([("h", "s2"), ("h", "s5")], "head string, sha string")
    out = track.publication_state(rows, intro, public, reach, obs)
    assert {r.row_hash: r.state for r in out.collect()} == {"a": "forward", "b": "late", "c": "published_unverified", "d": "unpublished", "e": "late", "f": "unpublished"}
    assert tuple(track.state_counts(out).head()) == (2, 1, 2, 1)


def test_ancestors_follow_every_parent(spark):
    commits = spark.createDataFrame([("d", "b"), ("d", "c"), ("c", "a"), ("b", "a"), ("x", "d")], "child string, parent string")
    from tidemark.shared import ensure_checkpoints

    ensure_checkpoints(spark)
    got = track.ancestors(spark.createDataFrame([("d",), ("a",), ("gone",)], "head string"), commits)
    assert {(r.head, r.sha) for r in got.collect()} == {("d", "d"), ("d", "b"), ("d", "c"), ("d", "a"), ("a", "a"), ("gone", "gone")}


def test_activity(spark):
    sha = "A" * 40
    entries = [
        {"id": 1, "activity_type": "push", "ref": "r", "after": sha, "timestamp": "2024-01-01T00:00:00Z"},
        {"id": "2", "activity_type": "force_push", "ref": "r", "after": sha, "timestamp": "2024-01-01T02:00:00+02:00"},
        {"id": 3, "activity_type": "merge", "ref": "r", "after": sha, "timestamp": "2024-01-01T00:00:00Z"},
        {"id": 4, "activity_type": "push", "ref": "other", "after": sha, "timestamp": "2024-01-01T00:00:00Z"},
        {"id": 5, "activity_type": "push", "ref": "r", "after": "xyz", "timestamp": "2024-01-01T00:00:00Z"},
        {"id": 6, "activity_type": "push", "ref": "r", "after": sha, "timestamp": "2024-01-01T00:00:00"},
        {"id": "", "activity_type": "push", "ref": "r", "after": sha, "timestamp": "2024-01-01T00:00:00Z"},
        {"id": 7, "activity_type": "push", "ref": "r", "after": None, "timestamp": None},
        {"id": 1, "activity_type": "push", "ref": "r", "after": sha, "timestamp": "2024-01-05T00:00:00Z"},
        "junk",
    ]
    parsed = track.parse_activity(remote.activity_frame(spark, entries), "r")
    assert sorted((r.event_id, str(r.push_time)) for r in parsed.collect()) == [("1", "2024-01-01 00:00:00"), ("1", "2024-01-05 00:00:00"), ("2", "2024-01-01 00:00:00")]
    known = spark.createDataFrame([("2",)], "event_id string")
    assert [(r.event_id, str(r.push_time)) for r in track.observe(parsed, known, "push_time").collect()] == [("1", "2024-01-01 00:00:00")]


def test_append_plan_refuses(spark):
    snap = spark.createDataFrame([("A", dt.date(2024, 3, 8)), ("B", dt.date(2024, 3, 7)), ("C", dt.date(2024, 3, 8))], "symbol string, date date")
    known = spark.createDataFrame([(dt.date(2024, 3, 8), "C")], "asof date, symbol string")
    assert [r.symbol for r in track.append_plan(snap, known, dt.date(2024, 3, 8)).collect()] == ["A"]
    with pytest.raises(Exception, match="after today"):
        track.append_plan(snap, known, dt.date(2024, 3, 7)).collect()
    weekend = snap.withColumn("date", F.lit("2024-03-09").cast("date"))
    with pytest.raises(Exception, match="no weekday"):
        track.append_plan(weekend, known, dt.date(2024, 3, 10)).collect()

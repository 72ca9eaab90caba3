import datetime as dt

import pytest
from helpers import BARS, bars_rows, random_walk
from pyspark.sql import functions as F

from tidemark import cli, journal
from tidemark.config import rule

START = dt.date(2024, 1, 1)  # a Monday
NAMES = ("AA", "BB", "CC")


def bars(spark, days, names=NAMES):
    return spark.createDataFrame([r for k, s in enumerate(names) for r in bars_rows(s, random_walk(days, k)[1], start=START)], BARS)


def put(spark, df, path, today, **options):
    return journal.append(df, path, today, NAMES, rule("vf75"), dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc), **options)


def test_append_fill_up_and_verify(spark, tmp_path):
    path, day = str(tmp_path / "log"), START + dt.timedelta(days=39)  # a Friday
    whole = bars(spark, 40)
    behind = whole.where(~((F.col("symbol") == "BB") & (F.col("dt") == F.lit(day))))
    first = put(spark, behind, path, day)
    assert first["asof"] == day and [r["symbol"] for r in first["rows"]] == ["AA", "CC"] and first["stale"] == {"BB": day - dt.timedelta(days=1)}
    assert first["deadline"] == "2024-02-12T14:30:00Z"
    assert [r["symbol"] for r in put(spark, whole, path, day)["rows"]] == ["BB"]  # the same day is filled up
    assert put(spark, whole, path, day)["rows"] == []
    later = put(spark, bars(spark, 43), path, day + dt.timedelta(days=3))
    assert [r["seq"] for r in later["rows"]] == [4, 5, 6] and later["rows"][0]["params"]["vol_floor"] == 0.75
    report = journal.verify(spark, path)
    assert report == {"rows": 6, "error": None, "coverage": {"2024-02-09": 3, "2024-02-12": 3}}
    assert journal.earliest_asof(spark, path) == day and journal.earliest_asof(spark, str(tmp_path / "none")) is None


def test_refusals(spark, tmp_path):
    path, day = str(tmp_path / "log"), START + dt.timedelta(days=39)
    whole = bars(spark, 40)
    with pytest.raises(journal.Refused, match="no symbol"):
        put(spark, whole.where("symbol = 'ZZ'"), path, day)
    with pytest.raises(Exception, match="after today"):
        put(spark, whole, path, day - dt.timedelta(days=1))
    with pytest.raises(Exception, match="no weekday"):
        put(spark, bars(spark, 41), path, day + dt.timedelta(days=2))
    put(spark, whole, path, day)
    log = journal.read(spark, path)
    for k, (change, said) in enumerate(((log.withColumn("w", F.when(F.col("seq") == 2, 0.1).otherwise(F.col("w"))), "line 2: content does not match"), (log.where("seq <> 2"), "line 2: prev_hash does not match"))):
        change.write.parquet(f"{tmp_path}/bad{k}")
        assert journal.verify(spark, f"{tmp_path}/bad{k}")["error"] == said
        with pytest.raises(journal.Refused, match=said):
            put(spark, whole, f"{tmp_path}/bad{k}", day)
    log.where("seq < 3").write.parquet(f"{tmp_path}/cut")
    assert journal.verify(spark, f"{tmp_path}/cut")["error"] is None
    assert journal.verify(spark, f"{tmp_path}/cut", path)["is_prefix"] is False and journal.verify(spark, path, f"{tmp_path}/cut")["is_prefix"] is True


def test_log_commands(spark, tmp_path, capsys):
    bars(spark, 40).write.partitionBy("symbol").parquet(str(tmp_path / "bars"))
    log, today = str(tmp_path / "log"), str(START + dt.timedelta(days=39))
    assert cli.main(["append", log, "--bars", str(tmp_path / "bars"), "--today", today, "--symbols", *NAMES, "--anchor", "2020-01-01"]) == 0
    assert '"appended": 3' in capsys.readouterr().out
    assert cli.main(["verify", log]) == 0 and '"error": null' in capsys.readouterr().out

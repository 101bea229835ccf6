"""The command line and its exit codes."""

import json

import pytest
from pyspark.sql import functions as F

from lofted import cli

MISSION = {"name": "one", "launch_lat": 23.26, "launch_lon": 77.41, "launch_alt_m": 500.0, "launch_epoch_utc": "2026-09-14T04:30:00Z", "sim": {"step_s": 0.5}}
BALLOON = {"name": "b", "gas": "HELIUM", "payload_mass_kg": 1.2, "envelope_mass_kg": 1.2, "launch_diameter_m": 1.8, "burst_diameter_m": 4.0, "free_lift_kg": 1.1, "ascent_cd": 0.45, "chute_area_m2": 1.0, "chute_cd": 1.4}


@pytest.fixture
def files(tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(MISSION, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(BALLOON))
    (tmp_path / "s.txt").write_text("Station identifier: X\nPRES HGHT\n" + "".join(f" {1000 - 90 * k}.0 {1000 * k} {15 - 6 * k}.0 0 0 0 270 {10 + k}\n" for k in range(10)))
    (tmp_path / "log.csv").write_text("time,packet,lat,lon,alt\n" + "".join(f"2026-09-14T04:{30 + k // 60:02d}:{k % 60:02d}Z,{k},23.26,77.41,{500 + 5 * k}\n" for k in range(20)) + "bad\n")
    return tmp_path


def test_usage(spark, files, capsys):
    assert cli.main(["version"]) == 0 and "schema" in capsys.readouterr().out
    assert cli.main([]) == 1 and cli.main(["fly"]) == 1 and cli.main(["predict"]) == 1 and cli.main(["--help"]) == 0
    assert cli.main(["ingest"], spark) == 1


def test_ingest_and_its_errors(spark, files, capsys):
    own = {k: str(files / v) for k, v in (("mission", "m.json"), ("balloon", "b.json"), ("sounding", "s.txt"), ("log", "log.csv"), ("out", "out"))}
    assert cli.main(["ingest", *[x for k, v in own.items() for x in (f"--{k}", v)]], spark) == 0
    out = files / "out"
    assert spark.read.parquet(str(out / "telemetry" / "rows")).count() == 20 and spark.read.parquet(str(out / "telemetry" / "rejects")).count() == 1
    assert spark.read.parquet(str(out / "sounding" / "rows")).count() == 10 and spark.read.parquet(str(out / "mission")).first().ground_elev_m == 500.0
    assert "telemetry: 20 rows" in capsys.readouterr().out
    (files / "bad.json").write_text("{")
    (files / "low.json").write_text(json.dumps(BALLOON | {"burst_diameter_m": 1.0}))
    (files / "far.json").write_text(json.dumps(MISSION | {"launch_lat": 91}))
    (files / "none.csv").write_text("x,y\n1,2\n")
    assert cli.main(["ingest", "--mission", str(files / "bad.json")], spark) == 3
    assert cli.main(["ingest", "--balloon", str(files / "low.json")], spark) == 2 and "burst_diameter_m" in capsys.readouterr().err
    assert cli.main(["ingest", "--mission", str(files / "far.json")], spark) == 2
    assert cli.main(["ingest", "--log", str(files / "none.csv")], spark) == 3
    assert cli.main(["ingest", "--log", str(files / "absent.csv")], spark) == 70
    assert cli.main(["replay", "--mission", own["mission"], "--balloon", own["balloon"], "--log", own["log"], "--particles", "3", "--filters", "2"], spark) == 2


def test_predict(spark, files, capsys):
    own = ["--mission", str(files / "m.json"), "--balloon", str(files / "b.json"), "--step", "0.5", "--out", str(files / "p")]
    assert cli.main(["predict", *own, "--members", "12", "--sounding", str(files / "s.txt")], spark) == 0
    members = spark.read.parquet(str(files / "p" / "members"))
    assert members.count() == 12 and members.where("status = 'OK'").agg(F.max("lat")).first()[0] is not None
    (record,) = spark.read.parquet(str(files / "p" / "run")).collect()
    assert record.rows == 12 and record.seed == 42 and record.status == "OK"
    assert spark.read.parquet(str(files / "p" / "ellipses")).count() == 2 and spark.read.parquet(str(files / "p" / "outlines")).count() == 2 * 73
    assert spark.read.text(str(files / "p" / "footprint")).count() == 2 + 2 + 12 and "95% of 12 members" in capsys.readouterr().out
    assert cli.main(["predict", *own, "--members", "0"], spark) == 2 and cli.main(["predict", *own, "--step", "0"], spark) == 2

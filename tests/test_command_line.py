import json

import pytest
import yaml
from test_specs import CLEAN, FAN_OUT, ONE_PER_DAY, SAFE

from tallyframe.__main__ import arguments, execute
from tallyframe.plans.spec import WriteRefused
from tallyframe.sources import writers


@pytest.fixture(scope="module")
def project(bookings, hotels, city_events, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, df in {"otb": bookings, "hotels": hotels, "city_events": city_events}.items():
        writers.write_parquet(df, f"{root}/{name}.parquet")
    sources = {n: f"{n}.parquet" for n in ("otb", "hotels", "city_events")}
    (root / "specs").mkdir()
    for name, last in (("safe", [ONE_PER_DAY, SAFE]), ("unsafe", [FAN_OUT])):
        spec = {"sources": sources, "steps": [*CLEAN, *last]}
        (root / "specs" / f"{name}.yaml").write_text(yaml.safe_dump(spec))
    return root


def run(spark, *argv):
    found = execute(spark, arguments(list(map(str, argv))))
    json.dumps(found)  # all of it is plain
    return found


def test_profile_and_check(spark, project):
    found = run(spark, "profile", project / "hotels.parquet")
    assert found["hotels"]["candidate_keys"] == ["hotel_id", "hotel_name", "rooms"]
    assert set(run(spark, "profile", project)) == {"otb", "hotels", "city_events"}
    checked = run(spark, "check", project / "otb.parquet", project / "hotels.parquet", "--on", "hotel_id")
    assert [r["booking_id"] for r in checked["evidence"]["unmatched_left_rows"]] == ["B0011"]


def test_run_and_build(spark, project, tmp_path):
    steps = run(spark, "run", project / "specs" / "safe.yaml", "--root", project, "--write", tmp_path)
    assert steps[-1]["blocking"] == [] and (tmp_path / "safe.parquet").exists()
    with pytest.raises(WriteRefused):
        run(spark, "run", project / "specs" / "unsafe.yaml", "--root", project, "--write", tmp_path)
    built = run(spark, "build", project / "specs", "--root", project, "--out", tmp_path, "--gate")
    assert {m["model"]: m["path"] is not None for m in built} == {"safe": True, "unsafe": False}

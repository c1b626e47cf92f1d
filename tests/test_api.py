import json

from noticelake.plans import api
from noticelake.schemas import FLAT_EXTRACTION
from noticelake.session import get_session


def test_outages_and_status(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "date": "d", "message": "m"}, {"id": 2, "date": "d", "message": "n"}]), encoding="utf-8")
    parsed = spark.createDataFrame([(1, ["a"], "10:00", None)], f"id long, {FLAT_EXTRACTION}")
    for newest in (True, False):
        got = api.current_outages(spark, str(tmp_path), parsed, newest)
        assert {r.id: r.locations for r in got.collect()} == {1: ["a"], 2: None}
    assert api.outage_by_id(got, 2).first().message == "n" and api.outage_by_id(got, 9).collect() == []
    status = api.run_status(spark, str(tmp_path)).first()
    assert (status.total_runs, status.last_id) == (1, 2) and status.last_run is not None
    assert all(hasattr(api, name) for name in api.__all__)


def test_session_settings(spark):
    session = get_session(**{"spark.sql.session.timeZone": "UTC"})
    assert session is spark or session.conf.get("spark.sql.adaptive.enabled") == "true"

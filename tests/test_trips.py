"""Trips whenever they start, against brute force."""

import datetime
import os

import pytest

from siftline.plans import core

DATA = "/root/testdata/sf0.001"
UNKNOWN = "Could not verify travel conflict — exact conference dates unknown."


def test_flags_of_trips_whenever_they_start(spark, tmp_path):
    state = [
        (1, "2027-03-10", "open", None), (2, "2026-06-10", "approved", "x"), (3, "2025-01-03", "sent", None), (4, "March 2027", "open", "n"), (5, None, "dismissed", None), (6, "2026-09-01", "open", None), (7, "9-11 March 2027", "open", None),
        (8, None, None, None),
    ]
    events = [(10, "2027-03-14", "2027-03-20"), (11, "2026-06-01", "2026-06-10"), (12, "2025-01-07", "2025-01-07"), (13, "2026-09-06", "2026-09-08"), (14, "2026-09-05", "2026-08-01"), (15, None, "2026-09-03"), (16, "2027-03-10", "2027-03-12"), (17, "2027-03-10", "2027-03-12")]
    spark.createDataFrame(state, "ord bigint, conf_date string, status string, bot_notes string").write.parquet(str(tmp_path / "cfp_state.parquet"))
    spark.createDataFrame(events, "check_id bigint, conf_start string, conf_end string").write.parquet(str(tmp_path / "event_results.parquet"))
    got = {r["ord"]: tuple(r)[1:] for r in core.QUERIES["trip_flags"](spark, str(tmp_path)).collect()}
    march = "Travel conflict: overlaps with 16 (2027-03-10 – 2027-03-12)."
    got = {k: (v[0] and int(v[0]), *v[1:]) for k, v in got.items()}
    assert got == {
        1: (16, "conflict", march), 2: (11, "conflict", "x | Travel conflict: overlaps with 11 (2026-06-01 – 2026-06-10)."), 3: (12, "sent", None), 4: (None, "open", "n | " + UNKNOWN), 5: (None, "dismissed", None), 6: (None, "open", None),
        7: (16, "conflict", march), 8: (None, None, None),
    }


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_no_candidate_meets_a_trip(spark):
    day = datetime.date.fromisoformat
    trips = core._trips(spark, DATA)
    spans = [(r["start"], r["end"]) for r in trips.collect()]
    clash = lambda r: r["conf_date"] is not None and any(day(r["conf_date"]) <= b and day(r["conf_date"]) + datetime.timedelta(4) >= a for a, b in spans)
    free = core._candidates(spark, DATA, trips.limit(0)).collect()
    got = core.QUERIES["cfp_pipeline"](spark, DATA).collect()
    assert any(map(clash, free)) and not any(map(clash, got))
    assert {r["ord"] for r in free if not clash(r)} <= {r["ord"] for r in got}

"""Answers computed beforehand for two sizes of the tables; NULL for a sum of 0."""

import pytest
from tallyweave import harness
from tallyweave.plans.planner import Planner
from tallyweave.queries import catalog
from tallyweave.streaming.protocol import Engine

# query, answer at sf0.01, answer at sf0.001
GOLDEN = [
    ("5 3|0.1=1.0&1.0>750|0.0 1.1", "56790600 91509", "NULL NULL"),
    ("6 5|0.0=1.0&0.3=1|0.1 1.1 0.0", "8546155 6454711 64780669", "85755 64786 678954"),
    ("6 5 3|0.0=1.0&1.1=2.0&2.1<5|0.2 1.0 2.1", "590732 90266851 24809", "4753 788352 2231"),
    ("6 4 2|0.1=1.0&0.2=2.0&1.1>25|0.0 1.1 2.1", "228218913 1153523 351097", "1905747 97345 39018"),
    ("6 2 1 0|0.2=1.0&1.1=2.0&2.1=3.0&3.0<2|0.0 2.0 3.0", "171351034 231461 14801", "1316850 32885 610"),
    ("6 5 3 2|0.0=1.0&1.1=2.0&0.2=3.0&2.1=3.1&3.1>3|0.0 1.0 2.1 3.1", "15584497 15584497 26915 26915", "162482 162482 3890 3890"),
    ("3 2|0.1=1.1&1.0<10|0.0 1.0", "464311 2872", "4547 246"),
    ("5 5|0.1=1.1&0.0<500|0.0 1.0", "1403675 38132603", "1387052 3902117"),
    ("5 3|0.1=1.0&1.0=0.1&0.0>7000|0.1 1.0 0.1", "6035156 6035156 6035156", "NULL NULL NULL"),
    ("6 5|0.0=1.0&1.0>999999999|0.0 1.1", "NULL NULL", "NULL NULL"),
    ("1 0|0.1=1.0&1.0=0|1.0 0.0", "NULL 50", "NULL 50"),
    ("6 5|0.0=1.0&0.0>2000&0.0<4000&0.3=2|0.1 0.1", "1157125 1157125", "NULL NULL"),
    ("7 3|0.1=1.0&1.1=7|0.0 1.0", "1074120 22539", "NULL NULL"),
    ("6||0.0 0.3", None, None),
    ("6|0.0>1000&0.3<3|0.0 0.3", "128662983 24079", "762525 901"),
    ("6 5|0.0=1.0&0.1=1.1|0.0 1.1", "211459 24757", "22680 2348"),
    ("6 5|0.0=1.0&0.0=0.1|0.0 1.1 0.1", "1751 786 1751", "409 383 409"),
]


@pytest.mark.parametrize("place,folder", [(1, "sf0.01"), (2, "sf0.001")])
def test_workload(spark, place, folder):
    cases = [g for g in GOLDEN if g[place] is not None]
    engine = Engine(Planner(catalog(spark, f"/root/testdata/{folder}")), threads=4)
    half = len(cases) // 2
    work = [g[0] for g in cases[:half]] + ["F"] + [g[0] for g in cases[half:]] + ["F"]
    report = harness.run_workload(engine, work, [g[place] for g in cases])
    assert report.valid, report.failures
    assert len(report.batch_ms) == 2 and report.ms > 0


def test_wrong_answers_are_reported(spark):
    engine = Engine(Planner(catalog(spark, "/root/testdata/sf0.001")), threads=1)
    report = harness.run_workload(engine, ["0||0.0", "F"], ["11"])
    assert not report.valid and report.failures == [("0||0.0", "11", "10")]

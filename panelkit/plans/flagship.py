"""Line list to labelled panel."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.targets import relative_binary
from .registry import query
from .standins import Tables


def flagship(t: Tables) -> DataFrame:
    """Monthly counts, densified, with exposure, rate and a target relative to the seasonal mean."""
    labelled, _ = relative_binary(t.panel, None, ("entity", "month"), "count")
    return labelled.select("entity", "start_date", "count", "pop", "cases_per_100k", "cat_target")


@query(
    "flagship_labelled_panel",
    "AGG-1 AGG-4 AGG-9 WIN-12 WIN-13 JON-2 PRJ-9 AGG-11 TGT-3",
    uses="panel expected",
    sql="""SELECT p.entity, p.start_date, p.count, p.pop, p.cases_per_100k,
             CASE WHEN p.count > x.expected THEN '1' ELSE '0' END AS cat_target
           FROM panel p JOIN expected x USING (entity, month)""",
)
def _(t: Tables) -> DataFrame:
    return flagship(t)

"""P3 for the aggregate tables: late arrivals refresh only the days they touch.

Landed rows carry their ingestion day (``_ingest_date``) beside their own
event day.  What arrived after the last refresh names a set of event days; a
daily table is built again from the rows of those days and their partitions
are replaced, so what a refresh reads and writes follows the days that
changed, not the table.  The driver holds days, never rows.

A table whose day needs neighbouring days (returns of the day before, say)
states them as ``reach = (back, ahead)``: day ``d`` is built from the rows of
``d - back`` to ``d + ahead``, so a change of day ``i`` touches ``i - ahead``
to ``i + back``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import drop_partitions, write_partitioned

INGEST = "_ingest_date"


@dataclass
class Refresh:
    """What a refresh did: the days replaced, those left without rows, and
    the ingestion day up to which arrivals are in the table now."""

    days: list[dt.date]
    emptied: list[dt.date]
    upto: dt.date | None


def touched_days(landed: DataFrame, day: Column, since: dt.date | None) -> tuple[list[dt.date], dt.date | None]:
    """Event days of the rows that arrived after ``since`` (all rows for
    None), and the last ingestion day.  Rows without a day touch none."""
    new = landed if since is None else landed.filter(F.col(INGEST) > F.lit(since))
    r = new.agg(F.array_sort(F.collect_set(day)).alias("days"), F.max(INGEST).alias("upto")).first()
    return list(r["days"]), r["upto"] or since


def _spread(days: list[dt.date], before: int, after: int) -> list[dt.date]:
    return sorted({d + dt.timedelta(days=k) for d in days for k in range(-before, after + 1)})


def refresh(landed: DataFrame, since: dt.date | None, day: Column, build: Callable[[DataFrame], DataFrame],
            out: str, out_day: str, reach: tuple[int, int] = (0, 0)) -> Refresh:
    """Bring the table at ``out`` (partitioned by ``out_day``) up to date with
    ``landed``.  Rows arrive once and stay, so a repeated refresh finds
    nothing new; one that was interrupted is simply done again."""
    days, upto = touched_days(landed, day, since)
    if not days:
        return Refresh([], [], upto)
    back, ahead = reach
    outputs = _spread(days, ahead, back)
    made = build(landed.filter(day.isin(_spread(outputs, back, ahead)))).filter(F.col(out_day).isin(outputs)).checkpoint()
    with_rows = {r[0] for r in made.select(out_day).distinct().collect()}
    write_partitioned(made.repartition(F.col(out_day)), out, [out_day])
    emptied = [d for d in outputs if d not in with_rows]
    drop_partitions(landed.sparkSession, out, [f"{out_day}={d.isoformat()}" for d in emptied])
    return Refresh(outputs, emptied, upto)

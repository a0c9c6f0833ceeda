"""Largest-task share per query, from Spark's event log.

usage: python tools/skew_report.py SF_DIR EVENT_LOG_DIR [key-prefix ...]

Runs registered queries into the ``noop`` sink with the event log on and
adaptive partition coalescing off (so every shuffle stage keeps
``spark.sql.shuffle.partitions`` tasks), then reads the task-end events:
per stage, shuffle records read by its largest task over the stage total.
For each query the worst such share among its big shuffle stages (at
least 10 % of its largest, at least two tasks) is printed.  Run it on a folder from ``tools/make_skewed.py`` and on the
original: a share that jumps towards 1/3 or more marks a hot key that
lands in one task; an even stage stays near 1 / #tasks.
"""

from __future__ import annotations

import glob
import json
import os
import sys
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def records(task: dict) -> int:
    """Shuffle records read (scan tasks follow the file layout, not the plan)."""
    sr = (task.get("Task Metrics") or {}).get("Shuffle Read Metrics") or {}
    return sr.get("Total Records Read", sr.get("Remote Records Read", 0) + sr.get("Local Records Read", 0))


def parse(log_dir: str) -> dict[str, tuple[float, int, int]]:
    stage_query: dict[int, str] = {}
    per_stage: dict[int, list[int]] = defaultdict(list)
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    if group:
                        for sid in ev.get("Stage IDs", []):
                            stage_query[sid] = group
                elif kind == "SparkListenerTaskEnd" and ev.get("Task End Reason", {}).get("Reason") == "Success":
                    per_stage[ev["Stage ID"]].append(records(ev))
    by_query: dict[str, list[list[int]]] = defaultdict(list)
    for sid, tasks in per_stage.items():
        if sid in stage_query:
            by_query[stage_query[sid]].append(tasks)
    out = {}
    for q, stages in by_query.items():
        biggest = max(sum(t) for t in stages) or 1
        worst = (0.0, 0, 0)
        for t in stages:
            total = sum(t)
            if len(t) < 2 or total < 0.1 * biggest or total == 0:
                continue
            share = max(t) / total
            if share > worst[0]:
                worst = (share, len(t), total)
        out[q] = worst
    return out


def main() -> None:
    sf, log_dir = sys.argv[1], sys.argv[2]
    only = sys.argv[3:]
    os.makedirs(log_dir, exist_ok=True)
    from tillpoint.session import build_session
    spark = build_session(extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                 "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false",
                                 "spark.driver.memory": "16g"})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for kv in os.environ.get("SKEW_CONF", "").split(","):  # e.g. scaled-down skew-join thresholds
        if "=" in kv:
            spark.conf.set(*kv.split("=", 1))
    from tillpoint import registry
    qs = registry.queries()
    keys = [k for k in qs if not only or any(k.startswith(o) for o in only)]
    for k in keys:
        spark.sparkContext.setJobGroup(k, k)
        qs[k](spark, sf).write.format("noop").mode("overwrite").save()
    spark.stop()
    res = parse(log_dir)
    print(json.dumps({k: {"largest_task_share": round(res.get(k, (0, 0, 0))[0], 3),
                          "tasks": res.get(k, (0, 0, 0))[1], "stage_records": res.get(k, (0, 0, 0))[2]}
                      for k in keys}))


if __name__ == "__main__":
    main()

"""Write a skewed copy of a driver scale folder for the hot-key benchmark.

usage: python tools/make_skewed.py SRC_SF_DIR DEST_DIR

A third of the orders move to one customer, a third of the line items to
one part and (a different third) to one supplier, and a third of the events
to one user.  Every other column and table is unchanged (tables that are
not rewritten are linked).  Run ``bench.py`` with ``BENCH_SF_DIR=DEST_DIR``
and compare with the unskewed folder: a job whose time grows much more than
its input did has a hot-key problem.
"""

from __future__ import annotations

import os
import sys

import duckdb

# The hot keys and which third of the rows they take.
HOT = {
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS o_custkey)",
    "lineitem": ("SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 1 THEN 1 ELSE l_partkey END AS l_partkey, "
                 "CASE WHEN l_orderkey % 3 = 2 THEN 1 ELSE l_suppkey END AS l_suppkey)"),
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id)",
}


def main() -> None:
    src, dest = sys.argv[1], sys.argv[2]
    os.makedirs(dest, exist_ok=True)
    con = duckdb.connect()
    for f in sorted(os.listdir(src)):
        if not f.endswith(".parquet"):
            continue
        name = f[:-len(".parquet")]
        out = os.path.join(dest, f)
        if name in HOT:
            con.execute(f"COPY ({HOT[name]} FROM read_parquet('{src}/{f}')) TO '{out}' (FORMAT PARQUET)")
        elif not os.path.exists(out):
            os.symlink(os.path.join(os.path.abspath(src), f), out)
    print(dest)


if __name__ == "__main__":
    main()

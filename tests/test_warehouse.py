"""Views over the written warehouse equal the views over derived inputs, and
date filters prune partitions."""

import re
import tempfile

from conftest import SF_SMALL, rows
from tillpoint.plans import views as v
from tillpoint.plans import warehouse as wh
from tillpoint.sources import testdata as td


def test_views_over_written_tables(spark):
    root = tempfile.mkdtemp(prefix="tillpoint-wh-")
    wh.write_tables(spark, SF_SMALL, root)
    fs, st = wh.fact_sales_at(spark, root), wh.table(spark, root, "dim_store")
    assert rows(v.daily_sales_by_country(fs)) == rows(v.daily_sales_by_country(td.fact_sales(spark, SF_SMALL)))
    got = v.sales_rollup_by_region(fs, st, td.SALES_AS_OF)
    exp = v.sales_rollup_by_region(td.fact_sales(spark, SF_SMALL), td.dim_store(spark, SF_SMALL), td.SALES_AS_OF)
    assert rows(got) == rows(exp)
    import io
    from contextlib import redirect_stdout
    buf = io.StringIO()
    with redirect_stdout(buf):
        got.explain("formatted")
    assert re.search(r"PartitionFilters: \[isnotnull\(sale_date#\d+\), \(sale_date#\d+ >= 2001-07-25\)", buf.getvalue())
    sh = wh.table(spark, root, "fact_shipments")
    assert rows(v.otd_by_carrier(sh, td.SHIP_AS_OF)) == rows(v.otd_by_carrier(td.fact_shipments(spark, SF_SMALL),
                                                                                td.SHIP_AS_OF))

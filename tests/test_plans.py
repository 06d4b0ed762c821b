"""Plan properties that matter at scale: physical scans of the fact tables in AQE's final plans.

A small derived panel that several steps read is written once (checkpoint) and a long table is merged
by one pivot, so the executed plans must not re-scan the fact tables per reference.
"""

import collections
import contextlib
import io
import re

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL


def _scans(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    df.collect()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    found = re.findall(r"Location: InMemoryFileIndex \[file:[^\]]*/([a-z_]+)\.parquet\]", buf.getvalue())
    return collections.Counter(found)


@pytest.mark.parametrize("name,table,most", [
    ("att_gt", "orders", 0),             # cohort means read from the checkpoint
    ("att_dynamic", "orders", 0),
    ("eval_metrics", "orders", 0),       # feature panel read from the checkpoint
    ("impute_scale", "orders", 0),
    ("base_period_impute", "orders", 1),  # only the one-column scan of the grid bounds
    ("coverage_flags", "orders", 0),
    ("series_outer", "events", 1),       # one pivot, not three filtered scans
])
def test_fact_table_scanned_at_most(spark, name, table, most):
    assert _scans(spark, name)[table] <= most

"""panelcraft: panel-data analytics as Spark DataFrame jobs.

Subpackages
-----------
sources    scans and sinks (CSV/Parquet/JSON, zip members, series files, HTML tables, text lines, manifests)
functions  column expressions (cleaning, dates, regex, formatting) and ordered-scan helpers
operators  DataFrame -> DataFrame operators (panel grid, joins, intervals, segmentation, dedupe,
           features, case flags, regression, DiD, prediction, text embedding, reports)
plans      the end-to-end pipelines and the test-data queries with their SQL oracles
streaming  incremental (append) variants of the file sinks
"""

from panelcraft.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]

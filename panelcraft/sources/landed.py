"""Landed raw files: zip members, series files, HTML tables, JSON records, manifests.

Each source reads many files with ONE scan; per-file loops of the reference become a key column.
Python runs only where a format has no Spark reader (zip members, HTML tables), per file in a task.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelcraft.functions.partitioning import spread

# ------------------------------------------------------------------------------------------------
# CSV members of zip archives
# ------------------------------------------------------------------------------------------------


def zip_csv_members(spark: SparkSession, path: str, member_suffix: str, columns: Sequence[str],
                    path_glob: str = "*.zip") -> DataFrame:
    """The member whose name ends with ``member_suffix`` (case-insensitive) of every archive.

    Output: ``archive`` (file name) + the requested ``columns`` as strings (callers ``try_cast``).
    Decoding: UTF-8, else Latin-1.  One archive is one task; the archive bytes never reach the driver.
    """
    cols = list(columns)
    schema = StructType([StructField("archive", StringType())] + [StructField(c, StringType()) for c in cols])
    files = (spark.read.format("binaryFile").option("pathGlobFilter", path_glob).load(path)
             .select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content"))
    suffix = member_suffix.lower()

    def read(it):
        for pdf in it:
            outs = []
            for name, content in zip(pdf["archive"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as zf:
                    member = next((m for m in zf.namelist() if m.lower().endswith(suffix)), None)
                    if member is None:
                        raise FileNotFoundError(f"{name} has no member that ends with {member_suffix}")
                    raw = zf.read(member)
                try:
                    text = raw.decode("utf-8")
                except UnicodeDecodeError:
                    text = raw.decode("latin-1")
                df = pd.read_csv(io.StringIO(text), dtype=str, usecols=lambda c: c in cols)
                for c in cols:
                    if c not in df.columns:
                        df[c] = None
                df.insert(0, "archive", name)
                outs.append(df[["archive", *cols]])
            if outs:
                yield pd.concat(outs, ignore_index=True)

    return spread(files).mapInPandas(read, schema=schema)


# ------------------------------------------------------------------------------------------------
# One two-column series file per (unit, metric); the file name names the series
# ------------------------------------------------------------------------------------------------


def series_files(spark: SparkSession, path_glob: str, name_pattern: str,
                 name_groups: dict[str, int]) -> DataFrame:
    """Read every ``date,value`` file with one scan; the file name gives the key columns.

    ``name_pattern`` is a regex on the file name (e.g. ``^([A-Z]{2})(UR|PCPI|POP)\\.csv$``) and
    ``name_groups`` maps output columns to its groups.  Header rows are dropped by the failed date
    parse; values go through a lossy cast.
    """
    raw = (spark.read.schema("c0 string, c1 string").option("header", False).csv(path_glob)
           .withColumn("__file", F.col("_metadata.file_name")))
    out = raw.select(
        *[F.regexp_extract("__file", name_pattern, g).alias(c) for c, g in name_groups.items()],
        F.try_to_date(F.col("c0"), "yyyy-MM-dd").alias("date"),
        F.col("c1").try_cast("double").alias("value"))
    return out.where(F.col("date").isNotNull())


# ------------------------------------------------------------------------------------------------
# The first HTML table of a page
# ------------------------------------------------------------------------------------------------


MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534  # fixed values of the HTML standard: larger spans count as these


def _span(value: str | None, most: int) -> int:
    digits = re.match(r"\s*\+?(\d+)", value or "")
    return min(int(digits.group(1)), most) if digits else 1


class _FirstTable(HTMLParser):
    """Cells of the first table.  End tags are optional: a cell ends at the next cell, row, row group or table end.
    A table inside a cell belongs to the cell's text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth = 0
        self.done = False
        self.hidden = 0
        self.group = "tbody"
        self.rows: list[tuple[str, int, list[tuple[str, bool, int, int]]]] = []  # group, its number, cells
        self.groups = 0
        self.in_row = False
        self.cell: list[str] | None = None
        self.about: tuple[bool, int, int] = (False, 1, 1)

    def _end_cell(self):
        if self.cell is not None:
            self.rows[-1][2].append((" ".join("".join(self.cell).split()), *self.about))
            self.cell = None

    def _begin_group(self, name):
        self._end_cell()
        self.in_row, self.group = False, name
        self.groups += 1

    def _begin_row(self):
        self._end_cell()
        self.rows.append((self.group, self.groups, []))
        self.in_row = True

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        elif tag in ("script", "style"):
            self.hidden += 1
        elif self.depth != 1:
            return
        elif tag in ("thead", "tbody", "tfoot"):
            self._begin_group(tag)
        elif tag == "tr":
            self._begin_row()
        elif tag in ("td", "th"):
            if not self.in_row:
                self._begin_row()
            self._end_cell()
            at = dict(attrs)
            self.cell = []
            self.about = (tag == "th", max(1, _span(at.get("colspan"), MAX_COLSPAN)), _span(at.get("rowspan"), MAX_ROWSPAN))
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if self.done:
            return
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.depth:
            self.depth -= 1
            if self.depth == 0:
                self._end_cell()
                self.done = True
        elif self.depth != 1:
            return
        elif tag in ("td", "th"):
            self._end_cell()
        elif tag == "tr":
            self._end_cell()
            self.in_row = False
        elif tag in ("thead", "tbody", "tfoot"):
            self._begin_group("tbody")

    def handle_data(self, data):
        if self.cell is not None and not self.hidden:
            self.cell.append(data)

    def grid(self) -> list[tuple[int, int, str, bool]]:
        """(row, column, text, is_header) of every slot that a cell occupies.  Header rows are those of ``thead``, or
        without one the first rows that hold ``th`` only.  A cell reaches down to the end of its row group at most."""
        self._end_cell()
        rows = sorted((r for r in self.rows if r[2]), key=lambda r: ("thead", "tbody", "tfoot").index(r[0]))
        n_head = sum(g == "thead" for g, _, _ in rows)
        if not n_head:
            while n_head < len(rows) and all(th for _, th, _, _ in rows[n_head][2]):
                n_head += 1
        out, below = [], {}  # column -> (rows still covered, text)
        for r, (_, group, cells) in enumerate(rows):
            if r and (group != rows[r - 1][1] or r == n_head):
                below = {}
            c, taken, todo = 0, {}, list(cells)
            while todo or c in below or any(x > c for x in below):
                if c in below:
                    left, text = below[c]
                    taken[c] = (left - 1, text)
                    out.append((r, c, text, r < n_head))
                    c += 1
                elif todo:
                    text, _, across, down = todo.pop(0)
                    for k in range(c, c + across):
                        taken[k] = ((down or MAX_ROWSPAN) - 1, text)
                        out.append((r, k, text, r < n_head))
                    c += across
                else:
                    c += 1
            below = {k: v for k, v in taken.items() if v[0] > 0}
        return out


def html_first_table_cells(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, row, col, text, is_header) of every slot of the first ``<table>`` of every page; a cell that spans rows
    or columns fills each slot that it covers.  A page without a table has no rows."""
    schema = "page long, row int, col int, text string, is_header boolean"

    def parse(it):
        for pdf in it:
            recs = []
            for pid, doc in zip(pdf[page], pdf[html]):
                p = _FirstTable()
                p.feed(doc or "")
                p.close()
                recs += [(pid, *slot) for slot in p.grid()]
            yield pd.DataFrame(recs, columns=["page", "row", "col", "text", "is_header"])

    return spread(pages.select(F.col(page).cast("long").alias(page), F.col(html))).mapInPandas(parse, schema=schema)


def flatten_header(cells: DataFrame, header_rows: int | None = None) -> DataFrame:
    """One name per (page, col): the texts of the header rows joined with ``_``, empty parts and those that hold
    ``Unnamed`` dropped; without any part, or without header rows, the name is ``col``.  ``header_rows`` sets the
    number of header rows by hand, else the cells tell."""
    head = F.col("is_header") if header_rows is None else F.col("row") < header_rows
    part = head & (F.col("text") != "") & ~F.contains("text", F.lit("Unnamed"))
    parts = F.array_sort(F.collect_list(F.when(part, F.struct("row", "text"))))
    name = F.array_join(F.transform(parts, lambda x: x["text"]), "_")
    return (cells.groupBy("page", "col").agg(name.alias("name"))
            .withColumn("name", F.when(F.col("name") == "", "col").otherwise(F.col("name"))))


def pick_columns(names: DataFrame, key_like: str = "STATE", value_like: str = "TOTAL") -> DataFrame:
    """Per page the key column (first whose name contains ``key_like``, else the first column) and
    the value column (last containing ``value_like``, else the last column)."""
    up = F.upper("name")
    return names.groupBy("page").agg(
        F.coalesce(F.min(F.when(up.contains(key_like), F.col("col"))), F.min("col")).alias("key_col"),
        F.coalesce(F.max(F.when(up.contains(value_like), F.col("col"))), F.max("col")).alias("value_col"))


def table_key_values(cells: DataFrame, header_rows: int | None = None, key_like: str = "STATE",
                     value_like: str = "TOTAL") -> DataFrame:
    """S11-S13 together: (page, row, key_text, value_text) of the body rows of each page's first table."""
    picks = pick_columns(flatten_header(cells, header_rows), key_like, value_like)
    body = cells.where(~F.col("is_header") if header_rows is None else F.col("row") >= header_rows).join(picks, on="page")
    return body.groupBy("page", "row").agg(
        F.max(F.when(F.col("col") == F.col("key_col"), F.col("text"))).alias("key_text"),
        F.max(F.when(F.col("col") == F.col("value_col"), F.col("text"))).alias("value_text"))


# ------------------------------------------------------------------------------------------------
# JSON records
# ------------------------------------------------------------------------------------------------


def json_records(spark: SparkSession, path: str, schema: StructType | str, where: Column | None = None,
                 columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """JSON records with projection and predicate (pushed to the scan) and an optional row limit."""
    df = spark.read.schema(schema).json(path)
    if where is not None:
        df = df.where(where)
    if columns:
        df = df.select(*columns)
    return df.limit(limit) if limit else df


def pick_from_json_array(json_col: Column, element_schema: str, predicate, value_field: str) -> Column:
    """Parse a JSON array, keep the elements matching ``predicate`` (a Column lambda), take the
    first one's ``value_field`` as double (NULL when none, or not numeric)."""
    arr = F.from_json(json_col, f"array<{element_schema}>")
    first = F.try_element_at(F.filter(arr, predicate), F.lit(1))
    return first[value_field].try_cast("double")


# ------------------------------------------------------------------------------------------------
# manifests
# ------------------------------------------------------------------------------------------------


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root``: relative path, size, SHA-256 of the content (hashed in tasks).

    Spark's file scan leaves out files without a byte; their paths come from the listing of the file system."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    full = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("bytes"),
                        F.sha2(F.col("content"), 256).alias("sha256"))
    found = full.unionByName(_empty_files(spark, root))
    top = "^" + re.escape(re.sub("^file:/*", "/", root).rstrip("/") + "/")
    return found.withColumn("path", F.regexp_replace("path", top, ""))


def _empty_files(spark: SparkSession, root: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    rows = []
    while listed.hasNext():
        status = listed.next()
        name = status.getPath().getName()
        if status.getLen() == 0 and not name.startswith(("_", ".")):  # the scan ignores these too
            rows.append((re.sub("^file:/*", "/", status.getPath().toString()), 0, hashlib.sha256(b"").hexdigest()))
    return spark.createDataFrame(rows, "path string, bytes bigint, sha256 string")


def content_manifest(df: DataFrame, key: str, content: str) -> DataFrame:
    """S17/F9 on a content column: (key, bytes, sha256)."""
    return df.select(F.col(key), F.octet_length(content).cast("bigint").alias("bytes"),
                     F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def append_manifest_rows(rows: DataFrame, path: str) -> None:
    """Append rows to a manifest table."""
    rows.write.mode("append").parquet(path)

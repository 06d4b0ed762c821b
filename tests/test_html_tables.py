"""HTML tables: spans, optional end tags, header rows of several kinds."""

from panelcraft.sources.landed import _FirstTable, flatten_header, html_first_table_cells, table_key_values

TWO_ROWS = ("<table><tr><th rowspan=2>STATE<th colspan=3>Rural<th rowspan=2>TOTAL"
            "<tr><th>Interstate<th>Other<th>TOTAL"
            "<tr><td>Alabama<td>1<td>2<td>3<td>10"
            "<tr><td>Alaska<td colspan=2>-<td>4<td>20</table>")


def slots(html):
    p = _FirstTable()
    p.feed(html)
    p.close()
    return p.grid()


def rows(html):
    out = {}
    for r, c, text, _ in slots(html):
        out.setdefault(r, {})[c] = text
    return [[v[c] for c in sorted(v)] for _, v in sorted(out.items())]


def test_two_row_header_picks_the_total_not_a_part(spark):
    pages = spark.createDataFrame([(1, TWO_ROWS)], "page_id long, html string")
    cells = html_first_table_cells(pages, "page_id", "html")
    names = {r["col"]: r["name"] for r in flatten_header(cells).collect()}
    assert names == {0: "STATE_STATE", 1: "Rural_Interstate", 2: "Rural_Other", 3: "Rural_TOTAL", 4: "TOTAL_TOTAL"}
    assert sorted(tuple(r)[2:] for r in table_key_values(cells).collect()) == [("Alabama", "10"), ("Alaska", "20")]


def test_spans_fill_every_slot_they_cover():
    html = ("<table><tr><td rowspan=3>a<td>b<td rowspan=2>c<tr><td>d<tr><td>e<td>f<tr><td colspan=3>g"
            "<tr><td rowspan=0>h<td>i<td>j<tr><td>k<td>l</table>")
    assert rows(html) == [["a", "b", "c"], ["a", "d", "c"], ["a", "e", "f"], ["g", "g", "g"], ["h", "i", "j"], ["h", "k", "l"]]


def test_a_span_ends_with_its_row_group():
    html = "<table><thead><tr><th rowspan=9>H<th>I<tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d<tfoot><tr><td>t</table>"
    assert rows(html) == [["H", "I"], ["a", "b"], ["c", "d"], ["t"]]
    # a foot that comes first in the page comes last in the table
    assert rows("<table><tfoot><tr><td>t<tbody><tr><td>b</table>") == [["b"], ["t"]]


def test_header_rows(spark):
    def head(html):
        return sorted({r for r, _, _, h in slots(html) if h})
    assert head("<table><thead><tr><td>a<tr><td>b</thead><tr><th>c</table>") == [0, 1]
    assert head("<table><tr><th>a<tr><th>b<tr><th>c<td>d</table>") == [0, 1]
    assert head("<table><tr><td>a<tr><td>b</table>") == []
    pages = spark.createDataFrame([(1, "<table><tr><td>x<td>1<td>2<tr><td>y<td>3<td>4</table>"), (2, "no table"), (3, None), (4, ""),
                                   (5, "<table><tr><th>Unnamed: 0<th><tr><td>z<td>5</table>")], "page_id long, html string")
    cells = html_first_table_cells(pages, "page_id", "html")
    got = sorted((r["page"], r["key_text"], r["value_text"]) for r in table_key_values(cells).collect())
    assert got == [(1, "x", "2"), (1, "y", "4"), (5, "z", "5")]  # first and last column without a fitting name
    assert {r["name"] for r in flatten_header(cells).collect()} == {"col"}


def test_cells_left_open_nested_tables_and_bad_spans():
    html = ("<table><caption>C</caption><tr><td colspan=x>a &amp; b<br>c<td rowspan=-2>d<table><tr><td>in<td>side</table>e"
            "<tr><td>f<script>if (a<b) {}</script>g<td>h")
    assert rows(html) == [["a & b c", "dinsidee"], ["fg", "h"]]
    assert rows("<table><td>no row<td>tag</table>") == [["no row", "tag"]]
    assert rows("<table></table><table><tr><td>second</table>") == []
    assert rows("</td></table><table><tr><td>late</table>") == [["late"]]

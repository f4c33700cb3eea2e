"""Queries over positioned text: tables, lines, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators import layout, quality
from proofline.plans.registry import query
from proofline.sources import tables as T
from proofline.sources.tables import ITEMS, table

Spark = SparkSession
COLUMNS = [("c1", 0.0), ("c2", 110.0), ("c3", 250.0), ("c4", 400.0)]
COLUMN_SQL = "CASE WHEN 400 <= x0 + 12 THEN 'c4' WHEN 250 <= x0 + 12 THEN 'c3' WHEN 110 <= x0 + 12 THEN 'c2' WHEN 0 <= x0 + 12 THEN 'c1' END"


@query(f"WITH {ITEMS} SELECT page, id, {COLUMN_SQL} AS \"column\" FROM items")
def asof_column(spark: Spark, d: str) -> DataFrame:
    return layout.to_columns(T.items(spark, d), COLUMNS).select("page", "id", "column")


ANCHORS = "anchors AS (SELECT page, text AS row_id, min(y0) AS y FROM items WHERE text LIKE '%1' GROUP BY 1, 2)"


def anchors(items: DataFrame) -> DataFrame:
    return items.filter("text like '%1'").groupBy("page", F.col("text").alias("row_id")).agg(F.min("y0").alias("y"))


@query(f"""WITH {ITEMS}, {ANCHORS}, b AS (SELECT page, row_id, y - 6 AS top, coalesce(lead(y) OVER (PARTITION BY page ORDER BY y, row_id) - 2, 240.0::DOUBLE) AS stop FROM anchors)
    SELECT i.page, id, arg_min(row_id, (top, row_id)) AS row_id FROM items i JOIN b ON b.page = i.page AND (y0 + y1) / 2 >= top AND (y0 + y1) / 2 < stop GROUP BY i.page, id""")
def band_interval(spark: Spark, d: str) -> DataFrame:
    items = T.items(spark, d).withColumn("y", layout.centre_y())
    return layout.to_bands(items, layout.bands(anchors(items), "page", 240.0), "page", ["id"])


@query(f"""WITH {ITEMS}, f AS (SELECT page, coalesce(CASE WHEN isnan(regr_slope(y0, x0)) THEN NULL ELSE regr_slope(y0, x0) END, 0) AS slope, avg(x0) AS mx FROM items WHERE text LIKE '%2' GROUP BY page)
    SELECT i.page, id, round((y0 + y1) / 2 - coalesce(slope * ((x0 + x1) / 2 - mx), 0) + 0.00012345::DOUBLE, 3) AS y FROM items i LEFT JOIN f ON f.page = i.page""")
def slope_straighten(spark: Spark, d: str) -> DataFrame:
    items = T.items(spark, d)
    points = items.filter("text like '%2'").select("page", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return layout.straightened(items, points, "page").select("page", "id", F.round(F.col("y") + 0.00012345, 3).alias("y"))


@query(f"""WITH {ITEMS}, w AS (SELECT page, id, text AS field, x0 AS x, (y0 + y1) / 2 AS y, text LIKE 'N%' AS ex FROM items),
    l AS (SELECT a.page, a.id AS a, b.id AS b, a.x AS ax, a.y AS ay, (b.y - a.y) / (b.x - a.x) AS slope FROM w a JOIN w b ON a.page = b.page AND abs(b.x - a.x) >= 100 AND abs((b.y - a.y) / (b.x - a.x)) <= 0.1::DOUBLE),
    o AS (SELECT l.page, a, b, count(DISTINCT field) AS fields, count(*) FILTER (ex) AS exact, arg_min(y, (id, y)) AS top FROM l JOIN w ON w.page = l.page AND abs(y - (ay + slope * (x - ax))) <= 15 GROUP BY l.page, a, b)
    SELECT page, fields, exact, top FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY fields DESC, exact DESC, top, a, b) AS nth FROM o) WHERE nth = 1""")
def header_row(spark: Spark, d: str) -> DataFrame:
    words = T.items(spark, d).select("page", "id", F.col("text").alias("field"), F.col("x0").alias("x"), layout.centre_y().alias("y"), F.col("text").startswith("N").alias("is_exact"))
    return layout.header_lines(words, "page")


@query(f"""WITH {ITEMS} SELECT page, {COLUMN_SQL} AS "column", string_agg(text, ' ' ORDER BY round_even(y0 / 8, 0), x0, y0, text) AS text, count(*) AS n_items, min(score) AS score, max(x1) AS x1 FROM items GROUP BY ALL""")
def cell_text(spark: Spark, d: str) -> DataFrame:
    cells = layout.cell_text(layout.to_columns(T.items(spark, d), COLUMNS), ["page", "column"])
    return cells.select("page", "column", "text", "n_items", "score", "x1")


@query(f"""WITH {ITEMS}, c AS (SELECT *, {COLUMN_SQL} AS "column" FROM items) SELECT page, "column", median(x0) AS edge FROM c GROUP BY ALL""")
def column_edges(spark: Spark, d: str) -> DataFrame:
    return layout.column_edges(layout.to_columns(T.items(spark, d), COLUMNS), "page")


# pieces of lines: a page's columns start at 0 and 100 plus a shift of its own; from the page's third line on, some pieces stray
GRID = """g AS (SELECT l_orderkey AS page, l_linenumber AS ln, l_linenumber * 30 + l_suppkey % 6 AS y, CASE WHEN l_linenumber > 2 AND l_partkey % 3 = 0 THEN 57 + l_partkey % 20 ELSE 100 * (l_partkey % 2) END + 20 * (l_orderkey % 4) AS x0 FROM lineitem)"""
PAGE_COLUMN = "CASE WHEN 100 + 20 * (page % 4) <= x0 + 12 THEN 'b' WHEN 20 * (page % 4) <= x0 + 12 THEN 'a' END"


def grid(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    li, p = table(spark, d, "lineitem"), F.col("l_partkey")
    shift = 20 * (F.col("l_orderkey") % 4)
    x0 = F.when((F.col("l_linenumber") > 2) & (p % 3 == 0), 57 + p % 20).otherwise(100 * (p % 2)) + shift
    items = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ln"), (F.col("l_linenumber") * 30 + F.col("l_suppkey") % 6).alias("y"), x0.alias("x0"))
    pages = items.select("page").distinct()
    shift = 20 * (F.col("page") % 4)
    columns = pages.select("page", F.inline(F.array(F.struct(F.lit("a").alias("column"), shift.alias("x")), F.struct(F.lit("b").alias("column"), (shift + 100).alias("x")))))
    return items, columns


@query(f"""WITH {GRID} SELECT page, ln, y, x0, {PAGE_COLUMN} AS "column" FROM g""")
def asof_page_column(spark: Spark, d: str) -> DataFrame:
    """Each page's items by that page's own columns."""
    return layout.to_page_columns(*grid(spark, d), "page").select("page", "ln", "y", "x0", "column")


@query(f"""WITH {GRID}, c AS (SELECT page, unnest(['a', 'b']) AS "column", unnest([20 * (page % 4), 100 + 20 * (page % 4)]) AS x FROM (SELECT DISTINCT page FROM g)),
    e AS (SELECT c.page, coalesce(m.edge, c.x) AS edge FROM c LEFT JOIN (SELECT page, {PAGE_COLUMN} AS "column", median(x0) AS edge FROM g GROUP BY 1, 2) m ON m.page = c.page AND m."column" = c."column"),
    s AS (SELECT page, y - lag(y) OVER (PARTITION BY page ORDER BY y) AS step FROM g),
    q AS (SELECT page, coalesce(greatest(6.0, CASE WHEN count(CASE WHEN step > 3 AND step < 80 THEN 1 END) > 0 THEN 0.2::DOUBLE * median(CASE WHEN step > 3 AND step < 80 THEN step END) END), 8.0) AS reach, count(CASE WHEN step > 3 AND step < 80 THEN 1 END) AS k FROM s GROUP BY page),
    n AS (SELECT g.page, ln, y, (SELECT min(abs(x0 - edge)) FROM e WHERE e.page = g.page) <= CASE WHEN k = 0 THEN 8.0 ELSE reach END AS near FROM g JOIN q ON q.page = g.page),
    l AS (SELECT page, ln, min(y) AS y, count(*) AS n, count(*) FILTER (near) AS k FROM n GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ln) AS nth, lag(y) OVER (PARTITION BY page ORDER BY ln) AS above FROM l)
    SELECT page, arg_min((y + above) / 2, ln) FILTER (nth > 1 AND k < 0.6 * n) AS cut FROM o GROUP BY page""")
def end_of_table(spark: Spark, d: str) -> DataFrame:
    items, columns = grid(spark, d)
    return layout.table_end(items, items, columns, "page")


@query(f"""WITH {ITEMS}, a AS (SELECT * FROM items WHERE text IN ('NO0', 'NO1')), v AS (SELECT * FROM items WHERE text NOT IN ('NO0', 'NO1')),
    h AS (SELECT a.page, a.id AS a, a.text AS label, a.y0 AS ay, a.x0 AS ax, arg_min(v.text, (v.x0, v.id, v.text)) AS value FROM a JOIN v ON v.page = a.page AND v.x0 >= a.x1 AND least(a.y1, v.y1) - greatest(a.y0, v.y0) > 0.4 * (a.y1 - a.y0) GROUP BY ALL)
    SELECT page, label, arg_min(value, (ay, ax, a, value)) AS value FROM h GROUP BY page, label""")
def label_pairs(spark: Spark, d: str) -> DataFrame:
    labels = spark.createDataFrame([("NO0", "NO0"), ("NO1", "NO1")], "text string, label string")
    return layout.pairs(T.items(spark, d), labels, "page")


WORN = """w AS (SELECT page, id, CASE ln_supp % 4 WHEN 0 THEN 'Report No.' WHEN 1 THEN 'Rep0rt No' WHEN 2 THEN 'Unit:' ELSE text END AS text, CASE ln_supp % 4 WHEN 0 THEN 'report_no' WHEN 1 THEN 'report_no' WHEN 2 THEN 'unit' END AS label, ln_supp % 4 = 1 AS worn, x0, y0, x1, y1
    FROM (SELECT *, CAST(split_part(id, '-', 3) AS BIGINT) AS ln_supp FROM items))"""


@query(f"""WITH {ITEMS}, {WORN}, c AS (SELECT page, label, arg_min(struct_pack(id := id, y0 := y0, y1 := y1, x1 := x1), (worn, y0, x0, id)) AS a FROM w WHERE label IS NOT NULL GROUP BY 1, 2),
    h AS (SELECT c.page, c.label, v.* EXCLUDE (page, label), min((v.x0, v.y0, v.id, v.x1)) OVER (PARTITION BY c.page, c.label) AS nearest FROM c LEFT JOIN w v ON v.page = c.page AND v.id <> c.a.id AND v.x0 >= c.a.x1 AND least(c.a.y1, v.y1) - greatest(c.a.y0, v.y0) > 0.4 * (c.a.y1 - c.a.y0))
    SELECT page, label, string_agg(text, ' ' ORDER BY x0, y0, id, x1, text) FILTER (id IS NOT NULL AND x0 < nearest[4] + 6) AS value FROM h GROUP BY 1, 2""")
def label_claims(spark: Spark, d: str) -> DataFrame:
    """Labels of a form, some with a wrong letter: those printed well are taken first."""
    items, m = T.items(spark, d), F.split("id", "-")[2].cast("long") % 4
    text = F.when(m == 0, "Report No.").when(m == 1, "Rep0rt No").when(m == 2, "Unit:").otherwise(F.col("text"))
    labels = spark.createDataFrame([("Report No", "report_no"), ("Unit", "unit"), ("Plant Manager", "manager")], "text string, label string")
    return layout.label_values(items.withColumn("text", text), labels, "page")


@query("""WITH l AS (SELECT *, max(CASE WHEN l_linenumber = 1 OR l_partkey % 5 = 0 THEN printf('%06d-%06d', l_partkey, l_suppkey) END) OVER (PARTITION BY l_orderkey, l_linenumber) AS head FROM lineitem),
    u AS (SELECT DISTINCT l_orderkey, l_linenumber, head FROM l)
    SELECT l_orderkey, l_linenumber, last_value(head IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS section FROM u""")
def section_regions(spark: Spark, d: str) -> DataFrame:
    head = F.when((F.col("l_linenumber") == 1) | (F.col("l_partkey") % 5 == 0), F.format_string("%06d-%06d", "l_partkey", "l_suppkey"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(head).alias("head"))
    return layout.sections_of(lines, "l_orderkey", ["l_linenumber"], F.col("head")).select("l_orderkey", "l_linenumber", "section")


@query(f"""WITH RECURSIVE {ITEMS}, s AS (SELECT page, text, x0, (y0 + y1) / 2 AS c, y1 - y0 AS h, row_number() OVER (PARTITION BY page ORDER BY (y0 + y1) / 2, x0, text, y1 - y0) AS k FROM items),
    f AS (SELECT page, k, text, x0, c, 0 AS "row" FROM s WHERE k = 1
        UNION ALL SELECT s.page, s.k, s.text, s.x0, CASE WHEN abs(s.c - f.c) <= greatest(8.0, 0.4 * s.h) THEN f.c ELSE s.c END,
        CASE WHEN abs(s.c - f.c) <= greatest(8.0, 0.4 * s.h) THEN f."row" ELSE f."row" + 1 END FROM f JOIN s ON s.page = f.page AND s.k = f.k + 1)
    SELECT page, "row", string_agg(text, ' ' ORDER BY x0, text) AS text, count(*) AS n FROM f GROUP BY page, "row" """)
def doc_lines(spark: Spark, d: str) -> DataFrame:
    return layout.rows_of_text(T.items(spark, d), "page")


@query(f"WITH {ITEMS} SELECT page, id FROM items WHERE (y0 + y1) / 2 BETWEEN 60 AND 120")
def region_filter(spark: Spark, d: str) -> DataFrame:
    return layout.in_region(T.items(spark, d), 60.0, 120.0).select("page", "id")


@query(f"WITH {ITEMS} SELECT page, id, x0 * 2 AS x0, (842 - y1) * 2 AS y0, x1 * 2 AS x1, (842 - y0) * 2 AS y1 FROM items")
def text_layer_items(spark: Spark, d: str) -> DataFrame:
    items = T.items(spark, d).withColumns({"height": F.lit(842.0), "scale": F.lit(2.0)})
    return layout.to_pixels(items, "height", "scale").select("page", "id", "x0", "y0", "x1", "y1")


@query(f"WITH {ITEMS} SELECT page AS file, count(*) FILTER (text NOT LIKE 'R%') AS n, min(score) FILTER (text NOT LIKE 'R%') AS least_score FROM items GROUP BY page HAVING count(*) FILTER (text NOT LIKE 'R%') > 0")
def ocr_items(spark: Spark, d: str) -> DataFrame:
    item = F.struct(F.when(F.col("text").startswith("R"), " ").otherwise(F.col("text")).alias("text"), "score", F.array("x0", "y0", "x1", "y1").alias("bbox"))
    records = T.items(spark, d).groupBy(F.col("page").alias("file")).agg(F.collect_list(item).alias("texts"))
    return layout.exploded_reads(records).groupBy("file").agg(F.count("*").alias("n"), F.min("score").alias("least_score"))


@query(f"""WITH {ITEMS} SELECT page, text AS row_id, arg_min("column", ("column", id)) AS "column", count(DISTINCT "column") > 1 AS conflict FROM (SELECT *, {COLUMN_SQL} AS "column" FROM items) GROUP BY 1, 2""")
def multipage_rows(spark: Spark, d: str) -> DataFrame:
    rows = layout.to_columns(T.items(spark, d), COLUMNS).withColumnRenamed("text", "row_id").withColumn("place", F.col("column"))
    return quality.keep_first(rows, ["page", "row_id"], ["place", "id"], "column").select("page", "row_id", "column", "conflict")


@query("""SELECT doc_id, nth, path FROM (SELECT o_custkey AS doc_id, o_orderkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS nth FROM orders) WHERE path IN (SELECT l_orderkey FROM lineitem)""")
def ordered_pages(spark: Spark, d: str) -> DataFrame:
    given = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("t"), F.col("o_orderkey").alias("path"))))
    paths = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.transform(given, lambda x: x["path"]).alias("paths"))
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path")).distinct()
    return T.ordered_pages(paths, pages).select("doc_id", F.col("nth").cast("long").alias("nth"), "path")

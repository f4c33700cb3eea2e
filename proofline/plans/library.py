"""Queries over positioned pages: the library from items to chunks, and a form's sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators import layout, library
from proofline.plans.registry import query
from proofline.plans.storage import place
from proofline.sources.tables import table

Spark = SparkSession

# Documents as pages of twelve lines: a running head, numbered headings in bold, regular or unknown type, footnotes on every other page.
PAGES = """l AS (SELECT doc_id, (i - 1) // 12 AS p, (i - 1) % 12 AS r, line FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
    t AS (SELECT doc_id, p, r, CASE WHEN r = 0 THEN 'Document ' || doc_id || ', page ' || (p + 1) WHEN r = 5 THEN (p % 30 + 1) || CASE p % 3 WHEN 0 THEN '.' WHEN 1 THEN '.2' ELSE '' END || ' Part about ' || substr(regexp_replace(line, '[^A-Za-z ]', '', 'g'), 1, 30)
        WHEN r = 9 AND p % 2 = 0 THEN '7' ELSE line END AS text, CASE WHEN r = 9 AND p % 2 = 0 THEN 4.0 WHEN r >= 10 AND p % 2 = 0 THEN 8.0 WHEN r = 5 THEN 14.0 ELSE 10.0 + length(line) % 2 END::DOUBLE AS h, CASE WHEN r = 5 AND p % 4 < 2 THEN p % 4 = 0 END AS bold FROM l)"""


def page_items(spark: Spark, d: str) -> DataFrame:
    """Each line as two pieces: its first word, and the rest a little lower."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    rows = lines.withColumns({"p": F.floor(F.col("i") / 12).cast("int"), "r": F.col("i") % 12})
    p, r, line = F.col("p"), F.col("r"), F.col("line")
    heading = F.concat(p % 30 + 1, F.when(p % 3 == 0, ".").when(p % 3 == 1, ".2").otherwise(""), F.lit(" Part about "), F.substring(F.regexp_replace(line, "[^A-Za-z ]", ""), 1, 30))
    mark = (r == 9) & (p % 2 == 0)
    text = F.when(r == 0, F.concat(F.lit("Document "), "doc_id", F.lit(", page "), p + 1)).when(r == 5, heading).when(mark, "7").otherwise(line)
    height = F.when(mark, 4.0).when((r >= 10) & (p % 2 == 0), 8.0).when(r == 5, 14.0).otherwise(10.0 + F.length(line) % 2)
    bold = F.when((r == 5) & (p % 4 < 2), p % 4 == 0)
    rows = rows.select("doc_id", p.alias("page"), "r", text.alias("text"), height.alias("h"), bold.alias("bold"))
    first = F.substring_index("text", " ", 1)
    n, top = F.length(first), 30.0 + 66 * F.col("r")
    piece = lambda t, x0, x1, y0: F.struct(t.alias("text"), x0.cast("double").alias("x0"), y0.alias("y0"), x1.cast("double").alias("x1"), (y0 + F.col("h")).alias("y1"))
    rest = F.substr("text", n + 2)
    both = F.array(piece(first, F.lit(50), 50 + 6 * n, top), piece(rest, 54 + 6 * n, 54 + 6 * n + 6 * F.length(rest), top + 1))
    pieces = F.when(F.length("text") > n, both).otherwise(F.slice(both, 1, 1))
    return rows.select("doc_id", "page", F.lit(800.0).alias("page_height"), "bold", F.inline(pieces))


#: The printed lines, as the rule joins them.
PRINTED = (
    PAGES
    + r""", u AS (SELECT *, length(split_part(text, ' ', 1)) AS n, length(text) > length(split_part(text, ' ', 1)) AS two FROM t),
    v AS (SELECT doc_id, p AS page, r AS "row", trim(regexp_replace(text, '\s+', ' ', 'g')) AS line, 50.0 AS x0, 30.0 + 66 * r AS y0, CASE WHEN two THEN 54 + 6 * n + 6 * (length(text) - n - 1) ELSE 50 + 6 * n END::DOUBLE AS x1, 30.0 + 66 * r + h + CASE WHEN two THEN 1 ELSE 0 END AS y1, h, (30 + 66 * r + h / 2) / 800 AS yf, bold FROM u),
    w AS (SELECT *, lower(regexp_replace(replace(line, CAST(doc_id AS VARCHAR), chr(1)), '[0-9\s]', '', 'g')) AS shape, regexp_replace(line, '[0-9\s]', '', 'g') AS plain FROM v WHERE line <> '')"""
)
COMMON = "c AS (SELECT shape, count(DISTINCT doc_id) AS n_docs FROM w WHERE shape <> '' GROUP BY shape HAVING count(DISTINCT doc_id) >= greatest(3, 0.5 * (SELECT count(DISTINCT doc_id) FROM documents)))"


@query(f"""WITH {PRINTED} SELECT doc_id, page, "row", sha256(line) AS line, x0, y0, x1, y1, h AS height, bold FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY doc_id, page ORDER BY "row") AS "row") FROM w)""")
def printed_lines(spark: Spark, d: str) -> DataFrame:
    """Pieces of text joined into lines, with their boxes, heights and type; numbered within their page."""
    lines = library.page_lines(page_items(spark, d))
    nth = F.row_number().over(library.Window.partitionBy("doc_id", "page").orderBy("row"))
    return lines.select("doc_id", "page", nth.cast("long").alias("row"), F.sha2("line", 256).alias("line"), "x0", "y0", "x1", "y1", "height", "bold")


@query(f"WITH {PRINTED}, {COMMON} SELECT shape, n_docs FROM c")
def library_furniture(spark: Spark, d: str) -> DataFrame:
    """Shapes on half of all documents, counted by slots first."""
    lines = library.page_lines(page_items(spark, d))
    shaped = lines.withColumn("shape", library.own_shape(F.col("line"), F.col("doc_id")))
    return library.library_shapes(shaped, table(spark, d, "documents").select("doc_id").distinct().count())


LIBRARY = (
    PRINTED
    + f", {COMMON}"
    + r""", o AS (SELECT doc_id, shape, count(DISTINCT page) AS k FROM w GROUP BY 1, 2), q AS (SELECT doc_id, count(DISTINCT page) AS k, median(CASE WHEN length(line) >= 40 THEN h END) AS body FROM w GROUP BY 1),
    k AS (SELECT w.*, q.body FROM w JOIN o USING (doc_id, shape) JOIN q USING (doc_id) WHERE NOT (w.shape <> '' AND (yf < 0.1 OR yf > 0.9) AND (q.k >= 3 AND o.k >= 0.5 * q.k OR w.shape IN (SELECT shape FROM c)))),
    m AS (SELECT *, plain = '' AND regexp_full_match(line, '[0-9\s]+') AS bare, regexp_full_match(line, '[0-9\s]+') AND h < 0.6 * body AND max(h) OVER (PARTITION BY doc_id, page ORDER BY "row" ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) < 0.96 * body AS mark FROM k),
    f AS (SELECT *, coalesce("row" >= min(CASE WHEN mark THEN "row" END) OVER (PARTITION BY doc_id, page), false) AS note FROM m),
    g AS (SELECT * REPLACE (CASE WHEN note AND lag(bare AND note) OVER (PARTITION BY doc_id, page ORDER BY "row") THEN trim(lag(line) OVER (PARTITION BY doc_id, page ORDER BY "row")) || ' ' || line ELSE line END AS line), line AS own FROM f),
    s AS (SELECT *, NOT note AND regexp_full_match(own, '\d{1,2}(?:\.\d+){0,4}\.?\s+[A-Z][^.]{2,110}') AND length(own) <= 120 AND NOT regexp_matches(own, '\.{6,}') AND coalesce(bold, h >= 1.08 * body, false) AS heads FROM g WHERE CASE WHEN note THEN NOT bare ELSE plain <> '' END),
    i AS (SELECT *, sum(CASE WHEN heads THEN 1 ELSE 0 END) OVER d AS nth, last_value(CASE WHEN heads THEN own END IGNORE NULLS) OVER d AS head FROM s WINDOW d AS (PARTITION BY doc_id ORDER BY page, "row" ROWS UNBOUNDED PRECEDING)),
    j AS (SELECT doc_id, CASE WHEN note THEN 'notes' ELSE 'text' END AS part_of, CAST(CASE WHEN note THEN page ELSE nth END AS INTEGER) AS place, CASE WHEN note THEN 'footnotes' WHEN head IS NULL THEN '0' ELSE regexp_extract(head, '^(\d{1,2}(?:\.\d+){0,4})\.?\s', 1) END AS section,
        CASE WHEN note THEN 'Footnotes, page ' || page WHEN head IS NULL THEN '' ELSE trim(regexp_extract(head, '^\d{1,2}(?:\.\d+){0,4}\.?\s+(.*)$', 1)) END AS heading, page, line, x0, y0, x1, y1, row_number() OVER (PARTITION BY doc_id, note, CASE WHEN note THEN page ELSE nth END ORDER BY page, "row") AS n FROM i WHERE NOT heads),
    r AS (SELECT j.*, 0 AS part, length(line) + 1 AS size FROM j WHERE n = 1
        UNION ALL SELECT j.*, CASE WHEN r.size + length(j.line) > 1400 THEN r.part + 1 ELSE r.part END, CASE WHEN r.size + length(j.line) > 1400 THEN 0 ELSE r.size END + length(j.line) + 1 FROM r JOIN j ON j.doc_id = r.doc_id AND j.part_of = r.part_of AND j.place = r.place AND j.n = r.n + 1),
    a AS (SELECT doc_id, arg_min(own, (page, "row")) FILTER (length(own) >= 12 AND shape NOT IN ('', chr(1))) AS title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, "row") AS n FROM g WHERE NOT note AND plain <> '') WHERE n <= 4 GROUP BY doc_id),
    b AS (SELECT doc_id, part_of, place, section, heading, part, min(page) AS page_first, max(page) AS page_last, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(line, chr(10) ORDER BY n) AS text FROM r GROUP BY ALL)"""
)


def library_of(spark: Spark, d: str) -> DataFrame:
    """All documents as a library; its lines are stored once and read by each step."""
    path = place(spark)
    library.page_lines(page_items(spark, d)).write.parquet(f"{path}/lines")
    return library.build(spark.read.parquet(f"{path}/lines"), table(spark, d, "documents").select("doc_id").distinct().count())


@query(f"""WITH RECURSIVE {LIBRARY} SELECT doc_id, part_of, place, section, heading, part, page_first, page_last, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1, y1, sha256(doc_id || ' ' || coalesce(title, CAST(doc_id AS VARCHAR)) || '. ' || heading || chr(10) || text) AS sha256 FROM b LEFT JOIN a USING (doc_id)""")
def library_chunks(spark: Spark, d: str) -> DataFrame:
    """From positioned items to chunks with section, heading, pages and box; the hash is of what search embeds: id, title, heading and text."""
    found = library_of(spark, d)
    return found.select("doc_id", "part_of", "place", "section", "heading", "part", "page_first", "page_last", "x0", "y0", "x1", "y1", F.sha2("embedded", 256).alias("sha256"))


# The headings of an inspection report, as bare letters with their number.
FORM = [("identification", "1equipmentidentification"), ("findings", "2inspectionfindings"), ("thickness", "3ultrasonicthicknesssurvey"), ("recommendations", "4recommendations"), ("summary", "5inspectorssummary")]
FORM_SQL = ", ".join(f"('{n}', '{t}')" for n, t in FORM)

# Every page but some holds a heading at a height of its own, with up to three letters worn to a z; every sixth has lost its number.
HEADINGS = f"""form AS (SELECT row_number() OVER () AS s, name, target FROM (VALUES {FORM_SQL}) v(name, target)),
    l AS (SELECT doc_id, (i - 1) // 12 AS page, (i - 1) % 12 AS r, line FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
    h AS (SELECT DISTINCT doc_id, page, CAST((doc_id + page) % 6 AS INTEGER) AS s, CAST((doc_id // 6 + page) % 4 AS INTEGER) AS worn, (doc_id * 7 + page * 13) % 11 AS r FROM l WHERE (doc_id + page) % 5 <> 4),
    d AS (SELECT h.*, name, target, substr(target, 2) AS words, 2 + (doc_id + page) % 5 AS a FROM h JOIN form ON form.s = CASE WHEN h.s = 0 THEN 3 ELSE h.s END),
    e AS (SELECT *, CASE WHEN s = 0 THEN '' ELSE CAST(s AS VARCHAR) END || substr(words, 1, a - 1) || CASE WHEN worn > 0 THEN 'z' ELSE substr(words, a, 1) END || substr(words, a + 1, 2) || CASE WHEN worn > 1 THEN 'z' ELSE substr(words, a + 3, 1) END || substr(words, a + 4, 2) || CASE WHEN worn > 2 THEN 'z' ELSE substr(words, a + 6, 1) END || substr(words, a + 7) AS bare FROM d),
    k AS (SELECT doc_id, page, 20.0 + 60 * r AS top, 34.0 + 60 * r AS bottom, name AS section FROM e WHERE s > 0 AND (bare = target OR levenshtein(bare, target) <= 1
        OR (SELECT count(*) FROM range(1, length(target) + 1) x(i) WHERE bare[i] = target[i]) * 2.0::DOUBLE / (2 * length(target)) >= 0.88)),
    pg AS (SELECT DISTINCT doc_id, page FROM l), nx AS (SELECT *, lead(top) OVER (PARTITION BY doc_id, page ORDER BY top) AS following FROM k),
    op AS (SELECT pg.doc_id, pg.page, k.top, last_value(section IGNORE NULLS) OVER (PARTITION BY pg.doc_id ORDER BY pg.page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM pg LEFT JOIN k ON k.doc_id = pg.doc_id AND k.page = pg.page),
    sp AS (SELECT doc_id, page, section, bottom AS top, coalesce(following, 800.0) AS stop FROM nx UNION ALL SELECT doc_id, page, open, 0.0, coalesce(top, 800.0) FROM op WHERE open IS NOT NULL AND coalesce(top, 1.0) > 0)"""


def form_items(spark: Spark, d: str) -> DataFrame:
    """Lines and headings of each page as items: doc_id, page, text, y0, y1."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    rows = lines.select("doc_id", F.floor(F.col("i") / 12).alias("page"), "text", (F.lit(45.0) + 60 * (F.col("i") % 12)).alias("y0"))
    body = rows.withColumn("y1", F.col("y0") + 10)
    key, page = F.col("doc_id"), F.col("page")
    heads = rows.select("doc_id", "page").distinct().filter((key + page) % 5 != 4)
    s, worn, a = (key + page) % 6, (F.floor(key / 6) + page) % 4, 2 + (key + page) % 5
    words = F.element_at(F.array(*[F.lit(t[1:]) for _, t in FORM]), F.when(s == 0, 3).otherwise(s).cast("int"))
    z = lambda n, at: F.when(worn > n, "z").otherwise(F.substr("words", at.cast("int"), F.lit(1)))
    heads = heads.withColumns({"words": words, "number": F.when(s == 0, "").otherwise(F.concat(s, F.lit(". "))), "a": a})
    w = lambda at, n: F.substr("words", at.cast("int"), F.lit(n))
    at = F.col("a")
    worn_words = F.concat(F.substr("words", F.lit(1), (at - 1).cast("int")), z(0, at), w(at + 1, 2), z(1, at + 3), w(at + 4, 2), z(2, at + 6), F.substr("words", (at + 7).cast("int")))
    top = 20.0 + 60 * ((key * 7 + page * 13) % 11)
    heads = heads.select("doc_id", "page", F.upper(F.concat("number", worn_words)).alias("text"), top.alias("y0"), (top + 14).alias("y1"))
    return body.unionByName(heads)


@query(f"""WITH {HEADINGS}, it AS (SELECT doc_id, page, 50.0 + 60 * r AS c FROM l UNION ALL SELECT doc_id, page, 27.0 + 60 * r FROM e)
    SELECT sp.doc_id, sp.page, section, top::DOUBLE AS top, stop::DOUBLE AS "end", count(c) AS n_items FROM sp LEFT JOIN it ON it.doc_id = sp.doc_id AND it.page = sp.page AND c BETWEEN top AND stop GROUP BY ALL""")
def form_sections(spark: Spark, d: str) -> DataFrame:
    """Where a form's sections lie on each page, from headings as they are printed, worn or without their number; and how many items each span holds."""
    items = form_items(spark, d)
    pages = items.select("doc_id", "page", F.lit(800.0).alias("height")).distinct()
    spans = layout.section_spans(pages, layout.heading_marks(items, FORM))
    held = layout.in_spans(items, spans).groupBy("doc_id", "page", "section", "top").agg(F.count("*").alias("n"))
    return spans.join(held, ["doc_id", "page", "section", "top"], "left").select("doc_id", "page", "section", "top", "end", F.coalesce("n", F.lit(0)).cast("long").alias("n_items"))

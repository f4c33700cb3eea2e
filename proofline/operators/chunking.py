"""Documents to clean lines, sections and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.sizes import short

# Lengths and shares.
CHUNK, BODY_CHARS, REPEAT_SHARE, REPEAT_COUNT, MARGIN = 1400, 40, 0.5, 3, 0.10
FOOTNOTE_MARK, FOOTNOTE_TEXT, TITLE_LINES, TITLE_CHARS = 0.6, 0.96, 4, 12
TEXT_LAYER_CHARS, TRIAGE_PAGES, SCANNED_CHARS, SCANNED_SHARE = 60, 25, 50, 0.6
HEADING = r"^(\d{1,2}(?:\.\d+){0,4})\.?\s+([A-Z][^.]{2,110})$"
HEADING_CHARS, HEADING_SCALE, DOT_LEADER = 120, 1.08, r"\.{6,}"
#: A number or mark that stands alone.
BARE = r"^[\d\s]+$"
#: Shapes that may repeat across documents.
SHAPES = 100_000


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line: a text's lines, numbered from 0; a null text has none."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def shape(line: Column, own_id: Column) -> Column:
    """What a repeated line has in common: no digits, spaces or own id, lower case."""
    return F.lower(F.regexp_replace(F.replace(line, own_id, F.lit("")), r"[\d\s]", ""))


def furniture(lines: DataFrame) -> DataFrame:
    """shape, n_docs of what repeats across documents: on half of them at least, and on three.

    lines: doc_id, shape, of a whole page, not of its margins alone. A shape counts once for a document; an empty shape never counts.
    """
    n = lines.agg(F.count_distinct("doc_id").alias("all"))
    seen = lines.filter("shape <> ''").groupBy("shape").agg(F.count_distinct("doc_id").alias("n_docs"))
    return seen.join(F.broadcast(n)).filter((F.col("n_docs") >= REPEAT_COUNT) & (F.col("n_docs") >= REPEAT_SHARE * F.col("all"))).select("shape", "n_docs")


def strip_furniture(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """Lines without those at a margin whose shape repeats across documents (``repeated``) or on most pages of their document.

    lines: doc_id, page, shape, at_margin. On most pages: on half of them at least, of three or more. Only lines at a
    margin with a shape meet other tables; all others stay where they are.
    """
    at = F.col("at_margin") & (F.col("shape") != "")
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages")).filter(F.col("pages") >= REPEAT_COUNT)
    on = lines.filter("shape <> ''").groupBy("doc_id", "shape").agg(F.count_distinct("page").alias("on"))
    own = on.join(pages, "doc_id").filter(F.col("on") >= REPEAT_SHARE * F.col("pages")).select("doc_id", "shape")
    margin = lines.filter(at).join(short(repeated.select("shape"), SHAPES), "shape", "left_anti").join(own, ["doc_id", "shape"], "left_anti")
    return lines.filter(~at | at.isNull()).unionByName(margin.select(*lines.columns))


def body_height(lines: DataFrame) -> DataFrame:
    """doc_id, body: the median height of a document's long lines; null without any."""
    return lines.groupBy("doc_id").agg(F.median(F.when(F.length("line") >= BODY_CHARS, F.col("height"))).alias("body"))


def split_footnotes(lines: DataFrame, body: DataFrame | None) -> DataFrame:
    """Adds footnote: from a small bare number on, after which come lines of which none on the page reaches running-text height.

    lines: doc_id, page, pos, line, height, and body where no table of it is given.
    """
    page = Window.partitionBy("doc_id", "page")
    rest = F.max("height").over(page.orderBy("pos").rowsBetween(1, Window.unboundedFollowing))
    rows = lines if body is None else lines.join(body, "doc_id")
    mark = F.regexp_like("line", F.lit(BARE)) & (F.col("height") < FOOTNOTE_MARK * F.col("body")) & (rest < FOOTNOTE_TEXT * F.col("body"))
    rows = rows.withColumn("mark", F.when(mark, F.col("pos")))
    first = F.min("mark").over(page)
    rows = rows.withColumn("footnote", F.coalesce(F.col("pos") >= first, F.lit(False))).drop("mark")
    return rows if body is None else rows.drop("body")


def footnotes(lines: DataFrame) -> DataFrame:
    """doc_id, page, pos, line: footnote lines, each mark glued to the line after it; a mark that no line follows is nothing. lines: as above, footnotes only."""
    w = Window.partitionBy("doc_id", "page").orderBy("pos")
    bare = lambda c: F.coalesce(F.regexp_like(c, F.lit(BARE)), F.lit(False))
    rows = lines.withColumn("before", F.lag("line").over(w)).filter(~bare(F.col("line")))
    return rows.select("doc_id", "page", "pos", F.when(bare(F.col("before")), F.concat_ws(" ", F.trim("before"), "line")).otherwise(F.col("line")).alias("line"))


def is_heading(line: Column) -> Column:
    """Whether a line is a numbered heading and not one of a list of contents."""
    return line.rlike(HEADING) & (F.length(line) <= HEADING_CHARS) & ~line.rlike(DOT_LEADER)


def heading_type(bold: Column, height: Column, body: Column) -> Column:
    """Whether a line is set as a heading: in bold or, where that isn't known, taller than running text."""
    return F.coalesce(bold, height >= HEADING_SCALE * body, F.lit(False))


def with_sections(lines: DataFrame, heading: Column) -> DataFrame:
    """Adds section: how many headings stand at or before a line; 0 is the preamble."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.sum(F.when(heading, 1).otherwise(0)).over(w).cast("int"))


def chunk_lines(line_array: Column, limit: int = CHUNK) -> Column:
    """An array of chunks from an array of lines: greedy, never within a line, joined by line breaks.

    Before a line, a chunk that is not empty closes if its size and the line's exceed the limit;
    a line adds its length and one. A fold inside the engine; a longer line is its own chunk.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))

    def step(acc: Column, line: Column) -> Column:
        full = (F.size(acc["open"]) > 0) & (acc["size"] + F.length(line) > limit)
        return F.struct(
            F.when(full, F.array_append(acc["done"], F.array_join(acc["open"], "\n"))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(line)).otherwise(F.array_append(acc["open"], line)).alias("open"),
            (F.when(full, 0).otherwise(acc["size"]) + F.length(line) + 1).alias("size"),
        )

    last = lambda a: F.when(F.size(a["open"]) > 0, F.array_append(a["done"], F.array_join(a["open"], "\n"))).otherwise(a["done"])
    return F.aggregate(line_array, start, step, last)


def chunks(docs: DataFrame, limit: int = CHUNK) -> DataFrame:
    """doc_id, chunk, text: a text's chunks, numbered from 0; empty ones are left out."""
    rows = docs.select("doc_id", F.posexplode(chunk_lines(F.split("text", "\n"), limit)).alias("chunk", "text"))
    return rows.filter("text <> ''")


def titles(lines: DataFrame) -> DataFrame:
    """doc_id, title: of a document's first four lines that hold more than digits the first that is long enough and more than its id; else the id.

    lines: doc_id, pos, line. Documents without such lines have their id, too.
    """
    own = F.col("doc_id").cast("string")
    some = F.when(shape(F.col("line"), F.lit("")) != "", F.struct("pos", "line"))
    top = lines.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(some)), 1, TITLE_LINES).alias("top"))
    fine = F.filter("top", lambda t: (shape(t["line"], own) != "") & (F.length(t["line"]) >= TITLE_CHARS))
    return top.select("doc_id", F.coalesce(F.get(fine, F.lit(0))["line"], own).alias("title"))


def chunk_boxes(lines: DataFrame) -> DataFrame:
    """doc_id, chunk, text, first_page, last_page, x0, y0, x1, y1 from lines with chunk, page, pos and box."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "pos", "line"))), lambda s: s["line"]), "\n")
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return lines.groupBy("doc_id", "chunk").agg(text.alias("text"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), *box)


def route(n_chars: Column, force: Column | None = None) -> Column:
    """Whether a page's own text is enough or it must be recognised; ``force`` ("text" or "ocr", null: neither) overrides."""
    own = F.when(n_chars >= TEXT_LAYER_CHARS, "text").otherwise("ocr")
    return own if force is None else F.when(force.isin("text", "ocr"), force).otherwise(own)


def triage(pages: DataFrame, by: str, order: list[str]) -> DataFrame:
    """by, sampled, avg_chars, scanned: at most 25 evenly spaced pages of each document decide whether it is scanned."""
    w = Window.partitionBy(by)
    rows = pages.withColumn("nth", F.row_number().over(w.orderBy(*order)) - 1).withColumn("all", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("all") / TRIAGE_PAGES))
    taken = rows.filter((F.col("nth") % step == 0) & (F.floor(F.col("nth") / step) < TRIAGE_PAGES))
    few = F.count_if(F.col("n_chars") < SCANNED_CHARS)
    return taken.groupBy(by).agg(F.count("*").alias("sampled"), F.avg("n_chars").alias("avg_chars"), (few > SCANNED_SHARE * F.count("*")).alias("scanned"))

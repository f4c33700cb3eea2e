"""A library from positioned text: printed lines, furniture, footnotes, numbered sections, chunks with page and box.

Everything of a document is done within one shuffle by its id: lines of pages by folds, all the rest by
windows and groupings that this partitioning already serves. Furniture of the whole library is counted beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.exact import squeezed
from proofline.functions.sizes import short
from proofline.operators import chunking as C
from proofline.operators.layout import ROW_PX, ROW_SHARE, centre_y

#: Slots by which shapes are counted roughly, and shapes that may repeat on most documents.
SLOTS = 1 << 14


def page_lines(items: DataFrame) -> DataFrame:
    """doc_id, page, row, line, x0, y0, x1, y1, height, y_frac, bold: the printed lines of each page, from the top.

    items: doc_id, page, page_height, text, x0, y0, x1, y1, bold (null where fonts aren't known). An item joins the open line
    if its centre is within 8 pixels, or 40 % of its own height, of the line's first item. A line's pieces go from left to
    right; its centre is its first item's, its type that of its leftmost piece. Lines without text are left out.
    """
    item = F.struct(centre_y().alias("c"), F.col("x0").alias("x0"), F.col("text").alias("text"), "y0", "x1", "y1", "bold")
    start = F.struct(F.array().cast("array<int>").alias("rows"), F.lit(-1).alias("row"), F.lit(None).cast("double").alias("c"))

    def step(acc: Column, i: Column) -> Column:
        same = F.coalesce(F.abs(i["c"] - acc["c"]) <= F.greatest(F.lit(ROW_PX), ROW_SHARE * (i["y1"] - i["y0"])), F.lit(False))
        row = F.when(same, acc["row"]).otherwise(acc["row"] + 1)
        return F.struct(F.array_append(acc["rows"], row).alias("rows"), row.alias("row"), F.when(same, acc["c"]).otherwise(i["c"]).cast("double").alias("c"))

    pages = items.repartition("doc_id").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(item)).alias("items"), F.max("page_height").alias("page_height"))
    rows = pages.select("doc_id", "page", "page_height", F.explode(F.arrays_zip("items", F.aggregate("items", start, step, lambda a: a["rows"]).alias("rows"))).alias("z"))
    piece = F.struct("z.items.x0", "z.items.c", "z.items.text", "z.items.bold")
    text = squeezed(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), " "))
    box = [F.min("z.items.x0").alias("x0"), F.min("z.items.y0").alias("y0"), F.max("z.items.x1").alias("x1"), F.max("z.items.y1").alias("y1")]
    lines = rows.groupBy("doc_id", "page", F.col("z.rows").alias("row")).agg(
        text.alias("line"), *box, F.max(F.col("z.items.y1") - F.col("z.items.y0")).alias("height"), (F.min("z.items.c") / F.first("page_height")).alias("y_frac"), F.min(piece)["bold"].alias("bold")
    )
    return lines.filter("line <> ''")


def own_shape(line: Column, doc_id: Column) -> Column:
    """A line's shape with the document's own id, however written, as a mark."""
    quoted = F.regexp_replace(doc_id.cast("string"), r"([^A-Za-z0-9])", r"\\$1")
    return F.lower(F.regexp_replace(F.regexp_replace(line, F.concat(F.lit("(?i)"), quoted), F.lit("\u0001")), r"[\d\s]", ""))


def library_shapes(lines: DataFrame, n_docs: int) -> DataFrame:
    """shape, n_docs: the shapes that stand on half of all documents, and on three at least, wherever on the page.

    lines: doc_id, shape, a document's lines in one task. First each document's different shapes are counted by slots of their hash, of which a task
    sends ``SLOTS`` at most; a shape in a slot of too few documents is out, exactly. Only the others are counted by name; the slots
    left are at most twice a document's mean number of shapes.
    """
    least = max(C.REPEAT_COUNT, C.REPEAT_SHARE * n_docs)
    shapes = lines.filter("shape <> ''").groupBy("doc_id").agg(F.collect_set("shape").alias("shapes"))
    slot = lambda s: F.pmod(F.xxhash64(s), F.lit(SLOTS)).cast("int")
    slots = shapes.select(F.explode(F.array_distinct(F.transform("shapes", slot))).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    hopeful = shapes.select(F.explode("shapes").alias("shape")).withColumn("slot", slot(F.col("shape"))).join(F.broadcast(slots.select("slot")), "slot")  # ``SLOTS`` rows at most
    return hopeful.groupBy("shape").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= least)


def furnished(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """Adds furniture: a line in a margin whose shape is on half of its document's pages (of three or more) or among ``repeated`` (shape)."""
    pages = F.size(F.collect_set("page").over(Window.partitionBy("doc_id")))
    on = F.size(F.collect_set("page").over(Window.partitionBy("doc_id", "shape")))
    margin = (F.col("y_frac") < C.MARGIN) | (F.col("y_frac") > 1 - C.MARGIN)
    often = (pages >= C.REPEAT_COUNT) & (on >= C.REPEAT_SHARE * pages)
    rows = lines.join(short(repeated.select("shape", F.lit(True).alias("common")), C.SHAPES), "shape", "left")
    return rows.withColumn("furniture", (F.col("shape") != "") & margin & (often | F.coalesce("common", F.lit(False)))).drop("common")


def placed(lines: DataFrame) -> DataFrame:
    """Adds part_of (text, notes), section, heading, place to lines without furniture: where each belongs.

    lines: doc_id, page, row, line, height, bold, shape, body. Sections are numbered within a document by ``place``; those of notes come after all
    others. Page numbers and marks on their own hold no text. A footnote's mark goes before the line after it.
    """
    page, doc = Window.partitionBy("doc_id", "page").orderBy("row"), Window.partitionBy("doc_id").orderBy("page", "row")
    rows = C.split_footnotes(lines.withColumnRenamed("row", "pos"), None).withColumnRenamed("pos", "row")
    note = F.col("footnote")
    bare = F.regexp_like("line", F.lit(C.BARE))
    glued = F.when(note & F.lag(bare & note, 1, False).over(page), F.concat_ws(" ", F.trim(F.lag("line").over(page)), "line")).otherwise(F.col("line"))
    rows = rows.withColumns({"bare": bare, "glued": glued}).filter(F.when(note, ~F.col("bare")).otherwise(C.shape(F.col("line"), F.lit("")) != ""))
    heading = ~note & C.is_heading(F.col("line")) & C.heading_type(F.col("bold"), F.col("height"), F.col("body"))
    rows = rows.withColumn("heads", heading).withColumn("place", F.sum(F.when(F.col("heads"), 1).otherwise(0)).over(doc).cast("int"))
    of = lambda n: F.last(F.when(F.col("heads"), F.trim(F.regexp_extract("line", C.HEADING, n))), ignorenulls=True).over(doc)
    rows = rows.withColumns({"number": F.coalesce(of(1), F.lit("0")), "name": F.coalesce(of(2), F.lit(""))}).filter(~F.col("heads"))
    return rows.select(
        "*",
        F.when(note, "footnotes").otherwise(F.col("number")).alias("section"),
        F.when(note, F.concat(F.lit("Footnotes, page "), "page")).otherwise(F.col("name")).alias("heading"),
        F.when(note, "notes").otherwise("text").alias("part_of"),
    ).withColumns({"line": F.col("glued"), "place": F.when(F.col("part_of") == "notes", F.col("page").cast("int")).otherwise(F.col("place"))}).drop("glued", "bare", "heads", "number", "name", "footnote")


def starts(sizes: Column, limit: int) -> Column:
    """Where the chunks of lines of these lengths begin: before a line that would not fit, if the chunk isn't empty."""
    first = F.struct(F.array(F.lit(0)).alias("at"), F.lit(0).alias("size"), F.lit(0).alias("n"))

    def step(acc: Column, size: Column) -> Column:
        full = (acc["n"] > F.element_at(acc["at"], -1)) & (acc["size"] + size > limit)
        return F.struct(F.when(full, F.array_append(acc["at"], acc["n"])).otherwise(acc["at"]).alias("at"), (F.when(full, 0).otherwise(acc["size"]) + size + 1).alias("size"), (acc["n"] + 1).alias("n"))

    return F.aggregate(sizes, first, step, lambda a: a["at"])


def chunked(lines: DataFrame, limit: int = C.CHUNK) -> DataFrame:
    """doc_id, part_of, place, section, heading, part, page_first, page_last, x0, y0, x1, y1, text: each section in pieces, cut between lines."""
    line = F.struct("page", "row", "line", "x0", "y0", "x1", "y1")
    sections = lines.groupBy("doc_id", "part_of", "place", "section", "heading").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    sections = sections.withColumn("at", starts(F.transform("lines", lambda s: F.length(s["line"])), limit))
    rows = sections.select("*", F.posexplode("at").alias("part", "begin"))
    piece = F.slice("lines", F.col("begin") + 1, F.coalesce(F.get("at", F.col("part") + 1), F.size("lines")) - F.col("begin"))
    rows = rows.select("doc_id", "part_of", "place", "section", "heading", "part", piece.alias("p"))
    edge = lambda f, name: f(F.transform("p", lambda s: s[name])).alias(name)
    text = F.array_join(F.transform("p", lambda s: s["line"]), "\n")
    box = [edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1")]
    return rows.select("doc_id", "part_of", "place", "section", "heading", "part", F.get("p", F.lit(0))["page"].alias("page_first"), F.element_at("p", -1)["page"].alias("page_last"), *box, text.alias("text"))


def titled(lines: DataFrame) -> DataFrame:
    """doc_id, title: of a document's first four lines of text the first that is long enough and more than its id; else the id. lines: as in ``placed``, headings too."""
    doc = Window.partitionBy("doc_id").orderBy("page", "row")
    top = lines.filter(C.shape(F.col("line"), F.lit("")) != "").withColumn("nth", F.row_number().over(doc)).filter(F.col("nth") <= C.TITLE_LINES)
    fine = ~F.col("shape").isin("", "\u0001") & (F.length("line") >= C.TITLE_CHARS)
    found = F.min(F.when(fine, F.struct("nth", "line")))["line"]
    return top.groupBy("doc_id").agg(F.coalesce(found, F.col("doc_id").cast("string")).alias("title"))


def build(lines: DataFrame, n_docs: int, limit: int = C.CHUNK) -> DataFrame:
    """The chunks of a library, with their documents' titles and the text for search (``embedded``). lines: as ``page_lines`` gives them, best stored before.

    A document without lines of text has no chunks. Sections that share a number, or repeat, stay apart by ``place``.
    """
    rows = lines.withColumn("shape", own_shape(F.col("line"), F.col("doc_id")))
    median = F.expr(f"percentile(CASE WHEN length(line) >= {C.BODY_CHARS} THEN height END, 0.5)").over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("body", median)
    kept = furnished(rows, library_shapes(rows, n_docs)).filter(~F.col("furniture"))
    chunks = chunked(placed(kept), limit)
    notes = C.split_footnotes(kept.withColumnRenamed("row", "pos"), None).withColumnRenamed("pos", "row")
    titles = titled(notes.filter(~F.col("footnote")))
    found = chunks.join(titles, "doc_id", "left").withColumn("title", F.coalesce("title", F.col("doc_id").cast("string")))
    return found.withColumn("embedded", F.concat(F.col("doc_id").cast("string"), F.lit(" "), "title", F.lit(". "), "heading", F.lit("\n"), "text"))

"""Positioned text to tables, lines and sections. Boxes are x0, y0, x1, y1 in pixels from the top left."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from proofline.functions.exact import bare
from proofline.functions.sizes import if_few, short
from proofline.operators.quality import LEAD, ONE_EDIT_FROM, RATIO, alike

# Tolerances in pixels and shares.
COLUMN_SLACK, BAND_BEFORE, BAND_GAP, SPREAD, MAX_TILT, MIN_RUN = 12, 6, 2, 15.0, 0.10, 100.0
ROW_PX, ROW_SHARE, READ_STEP, OVERLAP, ALIGNED = 8.0, 0.4, 8, 0.4, 0.6
VALUE_PX = 6.0
PITCH_FROM, PITCH_TO, PITCH_SHARE, NEAR_PX, NO_PITCH_PX, LINE_PX = 3, 80, 0.2, 6.0, 8.0, 6.0
HEADING_FROM, HEADING_MORE = 8, 6
#: Words of a page whose lines meet each of them.
FEW = 24
#: Different texts with claims to labels that go to every task; more are met by a shuffle.
FEW_TEXTS = 10_000


def centre_y(y0: str = "y0", y1: str = "y1") -> Column:
    return (F.col(y0) + F.col(y1)) / 2


def to_pixels(items: DataFrame, height_pt: str, scale: str) -> DataFrame:
    """Boxes in points from the bottom left as pixels from the top left."""
    s, h = F.col(scale), F.col(height_pt)
    return items.withColumns({"x0": F.col("x0") * s, "x1": F.col("x1") * s, "y0": (h - F.col("y1")) * s, "y1": (h - F.col("y0")) * s})


def exploded_reads(records: DataFrame) -> DataFrame:
    """Items of recognised pages, without empty texts: file, nth, text, score, x0, y0, x1, y1. records: file, texts(text, score, bbox)."""
    rows = records.select("file", F.posexplode("texts").alias("nth", "t")).filter("trim(t.text) <> ''")
    box = [F.get("t.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.select("file", "nth", "t.text", "t.score", *box)


def in_region(items: DataFrame, top: float, bottom: float) -> DataFrame:
    """Items whose centre lies between two heights, both included."""
    return items.filter(centre_y().between(top, bottom))


def straightened(items: DataFrame, anchors: DataFrame, page: str) -> DataFrame:
    """Adds y: the centre's height without the page's tilt, the least-squares slope through the anchors.

    anchors: page, x, y. One point, or points one above the other, give no slope; a page without
    anchors keeps its heights.
    """
    fit = anchors.groupBy(page).agg(F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"), F.avg("x").alias("mx"))
    cx = (F.col("x0") + F.col("x1")) / 2
    return items.join(fit, page, "left").withColumn("y", centre_y() - F.coalesce(F.col("slope") * (cx - F.col("mx")), F.lit(0.0))).drop("slope", "mx")


def header_lines(words: DataFrame, page: str) -> DataFrame:
    """page, fields, exact, top: the printed line that carries most of a table's column words.

    words: page, id, field, is_exact, x, y. Each pair of words on a page far enough apart and not
    too steep proposes a line; words within reach of it belong to it. Most fields win, then most
    exact words, then the topmost (by the line's first word), then the first pair. On pages of up to ``FEW`` words, each line meets each word. On others, seen from one word, each
    other is on the lines of an interval of slopes: a sweep over the sorted slopes counts them, so a page takes the square of its words times a
    logarithm, and may have any number. Both give the same line.
    """
    words = words.withColumn("many", F.count("*").over(Window.partitionBy(page)) > FEW)
    return lines_by_pairs(words.filter("not many").drop("many"), page).unionByName(lines_by_sweep(words.filter("many").drop("many"), page))


def lines_by_pairs(words: DataFrame, page: str) -> DataFrame:
    """``header_lines`` for pages of few words."""
    a, b = words.select(page, F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("id").alias("a")), words.select(page, F.col("x").alias("bx"), F.col("y").alias("by"), F.col("id").alias("b"))
    slope = (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax"))
    far = F.abs(F.col("bx") - F.col("ax")) >= MIN_RUN
    lines = a.join(b, page).filter(far & (F.abs(slope) <= MAX_TILT)).withColumn("slope", slope)
    on = lines.join(words, page).filter(F.abs(F.col("y") - (F.col("ay") + F.col("slope") * (F.col("x") - F.col("ax")))) <= SPREAD)
    of = on.groupBy(page, "a", "b").agg(F.count_distinct("field").alias("fields"), F.count_if("is_exact").alias("exact"), F.min(F.struct("id", "y")).alias("f"))
    best = F.row_number().over(Window.partitionBy(page).orderBy(F.desc("fields"), F.desc("exact"), F.col("f.y"), "a", "b"))
    return of.withColumn("nth", best).filter("nth = 1").select(page, "fields", "exact", F.col("f.y").cast("double").alias("top"))


def lines_by_sweep(words: DataFrame, page: str) -> DataFrame:
    """``header_lines`` for pages of any number of words."""
    kind = {f.name: f.dataType for f in words.schema.fields}
    rows = words.select(page, "id", "field", "is_exact", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    schema = StructType([StructField(page, kind[page]), StructField("fields", LongType()), StructField("exact", LongType()), StructField("top", DoubleType())])
    return rows.groupBy(page).applyInPandas(lambda g: best_line(g, page), schema)


def best_line(g: pd.DataFrame, page: str) -> pd.DataFrame:
    """The best line of one page's words, by a sweep for each word."""
    g = g.sort_values("id", kind="stable").reset_index(drop=True)
    x, y, exact = g["x"].to_numpy(), g["y"].to_numpy(), g["is_exact"].fillna(False).to_numpy(bool)
    codes = pd.factorize(g["field"])[0]
    best = None
    for a in range(len(g)):
        with np.errstate(all="ignore"):
            slopes = (y - y[a]) / (x - x[a])
        far = (np.abs(x - x[a]) >= MIN_RUN) & (np.abs(slopes) <= MAX_TILT)
        if not far.any():
            continue
        partner = np.flatnonzero(far)
        partner = partner[np.argsort(slopes[partner], kind="stable")]
        s = slopes[partner]
        on = lambda w, i: np.abs(y[w] - (y[a] + s[i] * (x[w] - x[a]))) <= SPREAD
        with np.errstate(all="ignore"):
            ends = np.sort(np.stack([(y - y[a] - SPREAD) / (x - x[a]), (y - y[a] + SPREAD) / (x - x[a])]), axis=0)
        level = x == x[a]
        first = np.where(level, 0, np.searchsorted(s, ends[0]))
        stop = np.where(level, np.where(np.abs(y - y[a]) <= SPREAD, len(s), 0), np.searchsorted(s, ends[1], side="right"))
        every = np.arange(len(g))
        for _ in range(2):  # the interval's ends are rounded: the rule itself decides beside them
            wider = ~level & (first > 0)
            first -= wider & on(every, np.maximum(first - 1, 0))
            wider = ~level & (stop < len(s))
            stop += wider & on(every, np.minimum(stop, len(s) - 1))
            narrow = ~level & (first < stop)
            first += narrow & ~on(every, np.minimum(first, len(s) - 1))
            narrow = ~level & (first < stop)
            stop -= narrow & ~on(every, np.maximum(stop - 1, 0))
        held = first < stop
        count = lambda of: np.cumsum(np.bincount(first[of], minlength=len(s) + 1) - np.bincount(stop[of], minlength=len(s) + 1))[:-1]
        fields = sum((count(held & (codes == c)) > 0).astype(np.int64) for c in range(codes.max() + 1))
        n_exact = count(held & exact)
        top = max(zip(fields.tolist(), n_exact.tolist(), strict=True))
        if best is not None and top < best[0]:
            continue
        for i in np.flatnonzero((fields == top[0]) & (n_exact == top[1])).tolist():
            begins = int(np.flatnonzero(held & (first <= i) & (i < stop))[0])
            one = (top, (-y[begins]), [-a, -int(partner[i])])
            if best is None or one > best:
                best = one
    if best is None:
        return pd.DataFrame({page: [], "fields": [], "exact": [], "top": []})
    return pd.DataFrame({page: [g[page].iloc[0]], "fields": [best[0][0]], "exact": [best[0][1]], "top": [-best[1]]})


def to_columns(items: DataFrame, columns: list[tuple[str, float]]) -> DataFrame:
    """Adds column: the last one that starts at or before the item's left edge, with slack; null left of all."""
    out = F.lit(None).cast("string")
    for name, x in sorted(columns, key=lambda c: c[1]):
        out = F.when(F.lit(float(x)) <= F.col("x0") + COLUMN_SLACK, F.lit(name)).otherwise(out)
    return items.withColumn("column", out)


def to_page_columns(items: DataFrame, columns: DataFrame, page: str) -> DataFrame:
    """Adds column: as ``to_columns``, with each page's own columns (page, column, x), which are few; null on pages without any."""
    own = columns.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("x", "column"))).alias("columns"))
    begun = F.filter("columns", lambda c: c["x"] <= F.col("x0") + COLUMN_SLACK)
    return items.join(own, page, "left").withColumn("column", F.try_element_at(begun, F.lit(-1))["column"]).drop("columns")


def bands(anchors: DataFrame, page: str, bottom: float) -> DataFrame:
    """page, row_id, top, end: from a little above each anchor to a little above the next; the last reaches the bottom."""
    following = F.lead("y").over(Window.partitionBy(page).orderBy("y", "row_id"))
    return anchors.select(page, "row_id", (F.col("y") - BAND_BEFORE).alias("top"), F.coalesce(following - BAND_GAP, F.lit(float(bottom))).alias("end"))


def to_bands(items: DataFrame, rows: DataFrame, page: str, item_id: list[str]) -> DataFrame:
    """Each item with the first band of its page that holds its height; items outside all bands are left out."""
    hit = items.join(rows, page).filter((F.col("y") >= F.col("top")) & (F.col("y") < F.col("end")))
    return hit.groupBy(page, *item_id).agg(F.min(F.struct("top", "row_id"))["row_id"].alias("row_id"))


def cell_text(items: DataFrame, cell: list[str]) -> DataFrame:
    """A row for each cell: text in reading order (heights in steps, then left to right), lowest score, joint box."""
    row = F.struct(F.bround(F.col("y0") / READ_STEP, 0).alias("r"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("text").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]), " ")
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return items.groupBy(*cell).agg(text.alias("text"), F.min("score").alias("score"), F.count("*").alias("n_items"), *box)


def table_end(body: DataFrame, last: DataFrame, columns: DataFrame, page: str) -> DataFrame:
    """page, cut: the height at which a table's last row ends; null if all of its lines are in line with the columns.

    body, last: page, x0, y of the table's items and of those in its last band; columns: page, column, x. A column's edge is
    the median left edge of its items, or x where it has none. Items within ``LINE_PX`` of the first of a line are one line;
    one is loose if fewer than ``ALIGNED`` of its items start at an edge, give or take a share of the usual pitch. The first line
    belongs to the table; the cut is midway between the first loose line and the one before.
    """
    edges = to_page_columns(body, columns, page).groupBy(page, "column").agg(F.median("x0").alias("edge"))
    edges = columns.join(edges, [page, "column"], "left").groupBy(page).agg(F.collect_list(F.coalesce("edge", F.col("x").cast("double"))).alias("edges"))
    step = F.col("y") - F.lag("y").over(Window.partitionBy(page).orderBy("y"))
    pitch = body.select(page, step.alias("step")).groupBy(page).agg(F.median(F.when((F.col("step") > PITCH_FROM) & (F.col("step") < PITCH_TO), F.col("step"))).alias("pitch"))
    reach = F.when(F.col("pitch").isNull(), NO_PITCH_PX).otherwise(F.greatest(F.lit(NEAR_PX), PITCH_SHARE * F.col("pitch")))
    near = F.exists("edges", lambda e: F.abs(F.col("x0") - e) <= reach)
    held = last.join(edges, page).join(pitch, page, "left").groupBy(page).agg(F.array_sort(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), near.alias("near")))).alias("items"))
    line = lambda y, n, k: F.struct(y.alias("y"), n.alias("n"), k.alias("k"))
    one = lambda x: F.when(x["near"], 1).otherwise(0)

    def add(lines: Column, x: Column) -> Column:
        top = F.element_at(lines, -1)
        more = F.array_append(F.slice(lines, F.lit(1), F.size(lines) - 1), line(top["y"], top["n"] + 1, top["k"] + one(x)))
        return F.when((F.size(lines) > 0) & (x["y"] - F.try_element_at(lines, F.lit(-1))["y"] <= LINE_PX), more).otherwise(F.array_append(lines, line(x["y"], F.lit(1), one(x))))

    lines = F.aggregate("items", F.array().cast("array<struct<y: double, n: int, k: int>>"), add)
    loose = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size("lines") - 1, F.lit(1))), lambda i: F.when(F.get("lines", i)["k"] < ALIGNED * F.get("lines", i)["n"], i)), lambda i: i.isNotNull())
    first = F.get(loose, F.lit(0))
    return held.select(page, lines.alias("lines")).select(page, ((F.get("lines", first - 1)["y"] + F.get("lines", first)["y"]) / 2).alias("cut"))


def column_edges(items: DataFrame, page: str) -> DataFrame:
    """page, column, edge: the median left edge of each column's items."""
    return items.groupBy(page, "column").agg(F.median("x0").alias("edge"))


def pairs(items: DataFrame, labels: DataFrame, page: str) -> DataFrame:
    """page, label, value: for each label the nearest item to its right on the same printed line.

    items: page, id, text, x0, y0, x1, y1; labels: text, label. The same line: more than 40 % of
    the label's height is shared. Labels never serve as values; of several items with one label
    the topmost leftmost counts. A page bounds the join.
    """
    tagged = items.join(short(labels, 10_000), "text", "left")
    a = tagged.filter("label is not null").select(page, F.col("id").alias("a"), "label", F.col("x1").alias("right"), F.col("y0").alias("t"), F.col("y1").alias("b"), F.struct("y0", "x0", "id").alias("place"))
    v = tagged.filter("label is null").select(page, F.col("id").alias("v"), F.col("text").alias("value"), "x0", "y0", "y1")
    shared = F.least("b", "y1") - F.greatest("t", "y0")
    hit = a.join(v, page).filter((F.col("x0") >= F.col("right")) & (shared > OVERLAP * (F.col("b") - F.col("t"))))
    one = hit.groupBy(page, "a", "label", "place").agg(F.min(F.struct("x0", "v", "value"))["value"].alias("value"))
    return one.groupBy(page, "label").agg(F.min(F.struct("place", "value"))["value"].alias("value"))


def label_values(items: DataFrame, labels: DataFrame, page: str) -> DataFrame:
    """page, label, value: for each label the text to its right on the same printed line; null if there is none.

    items: page, id, text, x0, y0, x1, y1; labels: text, label, a short closed set. Letters and digits alone count
    in a label. Items that are a label go first; then, from top to bottom, those that are like just one of the labels
    that are left. Of several items for one label the topmost leftmost counts. The same line: more than 40 % of the
    label's height is shared. The value is the nearest item to the right, with those that begin before it ends. A page bounds the join.
    """
    labels = short(labels.select(bare(F.col("text")).alias("word"), "label").distinct(), 10_000)
    kind = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    box = ("y0", "x0", "id", "x1", "y1")
    # what each different text may claim is found first; then a page's items meet once, and the rest is expressions over them
    texts = items.select("text").distinct().withColumn("word", bare(F.col("text")))
    exact = labels.groupBy("word").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    marked = texts.join(near(texts.select("word").distinct(), labels), "word", "left").join(F.broadcast(exact), "word", "left").filter("labels is not null or likes is not null").select("text", "likes", "labels")
    tagged = items.join(if_few(marked, FEW_TEXTS), "text", "left").filter(F.col(page).isNotNull())
    pages = tagged.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "id", "likes", "labels", "x1", "y1", "text"))).alias("items"))
    won_type = f"array<struct<label: string, place: struct<{', '.join(f'{c}: {kind[c]}' for c in box)}>>>"
    start = F.struct(F.array().cast("array<string>").alias("held"), F.array().cast(won_type).alias("won"))
    claim = lambda label, item: F.struct(label.alias("label"), F.struct(*[item[c].alias(c) for c in box]).alias("place"))

    def is_label(acc: Column, item: Column) -> Column:
        fresh = F.array_except(item["labels"], acc["held"])
        return F.struct(F.concat(acc["held"], F.array_compact(fresh)).alias("held"), F.concat(acc["won"], F.transform(fresh, lambda label: claim(label, item))).alias("won"))

    def is_like(acc: Column, item: Column) -> Column:
        left = F.filter(item["likes"], lambda c: ~F.array_contains(acc["held"], c["label"]))
        top, next_ = F.get(left, F.lit(0)), F.coalesce(F.get(left, F.lit(1))["ratio"], F.lit(0.0))
        fine = F.coalesce(top["fine"] & (top["ratio"] - next_ >= LEAD), F.lit(False))
        return F.struct(F.when(fine, F.array_append(acc["held"], top["label"])).otherwise(acc["held"]).alias("held"), F.when(fine, F.array_append(acc["won"], claim(top["label"], item))).otherwise(acc["won"]).alias("won"))

    first = F.aggregate(F.filter("items", lambda o: o["labels"].isNotNull()), start, is_label)
    won = F.aggregate(F.filter("items", lambda o: o["likes"].isNotNull()), first, is_like, lambda acc: acc["won"])
    whole = lambda w: w["place"]["id"].isNotNull() & w["place"]["y0"].isNotNull() & w["place"]["x0"].isNotNull()

    def on_line(a: Column, o: Column) -> Column:
        shared = F.least(a["y1"], o["y1"]) - F.greatest(a["y0"], o["y0"])
        return (o["id"] != a["id"]) & (o["x0"] >= a["x1"]) & (shared > OVERLAP * (a["y1"] - a["y0"]))

    right = lambda a: F.array_sort(F.transform(F.filter("items", lambda o: on_line(a, o)), lambda o: F.struct(*[o[c].alias(c) for c in ("x0", "y0", "id", "x1", "text")])))
    lines = F.transform(F.filter(won, whole), lambda w: F.struct(w["label"].alias("label"), right(w["place"]).alias("line")))
    joined = F.filter("line", lambda o: o["x0"] < F.get("line", F.lit(0))["x1"] + VALUE_PX)
    return pages.select(page, F.inline(lines)).select(page, "label", F.when(F.size("line") > 0, F.array_join(F.transform(joined, lambda o: o["text"]), " ")).alias("value"))


def near(words: DataFrame, labels: DataFrame) -> DataFrame:
    """word, likes: for each word that is no label but may be like one, all labels by likeness (of equals the later by letters first).

    Words whose length alone rules out every label are left out before anything is compared.
    """
    words = words.join(labels, "word", "left_anti").alias("w")
    hopeful = words.join(labels.alias("l"), F.expr(f"2 * least(length(w.word), length(l.word)) >= {RATIO} * (length(w.word) + length(l.word)) or abs(length(w.word) - length(l.word)) <= 1"), "left_semi")
    both = hopeful.join(F.broadcast(labels.withColumnRenamed("word", "choice"))).withColumn("ratio", alike("word", "choice"))
    fine = (F.col("ratio") >= RATIO) | ((F.length("word") >= ONE_EDIT_FROM) & (F.levenshtein("word", "choice") <= 1))
    scored = F.struct((-F.col("ratio")).alias("less"), "choice", "label", "ratio", fine.alias("fine"))
    later = lambda a, b: F.when(a["less"] < b["less"], -1).when(a["less"] > b["less"], 1).when(a["choice"] > b["choice"], -1).when(a["choice"] < b["choice"], 1).otherwise(0)
    return both.groupBy("word").agg(F.array_sort(F.collect_list(scored), later).alias("likes"))


def sections_of(lines: DataFrame, doc: str, order: list[str], heading: Column) -> DataFrame:
    """Adds section: the last heading at or before each line, across pages; null before the first."""
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(w))


def rows_of_text(items: DataFrame, page: str) -> DataFrame:
    """page, row, text, n: items joined into printed rows by a fold over the page's sorted items.

    An item joins the open row if its centre is near that of the row's first item: within 8
    pixels, or 40 % of its own height. Ties in height go by left edge, then text.
    """
    item = F.struct(centre_y().alias("c"), F.col("x0").alias("x"), F.col("text").alias("t"), (F.col("y1") - F.col("y0")).alias("h"))
    start = F.struct(F.array().cast("array<struct<row:int,x:double,t:string>>").alias("out"), F.lit(-1).alias("row"), F.lit(None).cast("double").alias("c"))

    def step(acc: Column, i: Column) -> Column:
        same = F.coalesce(F.abs(i["c"] - acc["c"]) <= F.greatest(F.lit(ROW_PX), ROW_SHARE * i["h"]), F.lit(False))
        row = F.when(same, acc["row"]).otherwise(acc["row"] + 1)
        one = F.struct(row.alias("row"), i["x"].cast("double").alias("x"), i["t"].alias("t"))
        return F.struct(F.array_append(acc["out"], one).alias("out"), row.alias("row"), F.when(same, acc["c"]).otherwise(i["c"]).alias("c"))

    folded = items.groupBy(page).agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step, lambda a: a["out"]).alias("out"))
    rows = folded.select(page, F.explode("out").alias("o")).select(page, "o.*")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "t"))), lambda s: s["t"]), " ")
    return rows.groupBy(page, "row").agg(text.alias("text"), F.count("*").alias("n"))


def heading_marks(items: DataFrame, sections: list[tuple[str, str]]) -> DataFrame:
    """doc_id, page, top, bottom, section: the items that are a form's numbered headings, worn print allowed for.

    items: doc_id, page, text, y0, y1; sections: (name, heading as bare letters and digits with its number first), in the form's order. A text that begins
    with a heading is it. One of eight letters or more, with the same first sign and not much longer (by six), is it if alike enough or one letter away,
    and clearly ahead of others: the number must be exact, the words may be damaged. Only different texts with such a sign and length are compared.
    """
    word = bare(F.col("text"))
    exact = F.coalesce(*[F.when(F.startswith(F.col("word"), F.lit(t)), F.lit(name)) for name, t in sections])
    words = items.select(word.alias("word")).distinct().withColumn("exact", exact)
    each = F.array(*[F.struct(F.lit(t).alias("choice"), F.lit(name).alias("name")) for name, t in sections])
    fits = lambda c: (F.substring("word", 1, 1) == F.substring(c["choice"], 1, 1)) & (F.length("word") <= F.length(c["choice"]) + HEADING_MORE)
    hopeful = words.filter(F.col("exact").isNull() & (F.length("word") >= HEADING_FROM)).select("word", F.filter(each, fits).alias("likes")).filter(F.size("likes") > 0)
    scored = hopeful.select("word", F.explode("likes").alias("l")).select("word", "l.*").withColumn("ratio", alike("word", "choice"))
    top = scored.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("ratio", "choice", "name")), asc=False).alias("s"))
    best, after = F.get("s", F.lit(0)), F.coalesce(F.get("s", F.lit(1))["ratio"], F.lit(0.0))
    fine = ((best["ratio"] >= RATIO) | (F.levenshtein("word", best["choice"]) <= 1)) & (best["ratio"] - after >= LEAD)
    found = words.filter("exact is not null").select("word", F.col("exact").alias("section")).unionByName(top.filter(fine).select("word", best["name"].alias("section")))
    return items.withColumn("word", word).join(found, "word").select("doc_id", "page", F.col("y0").alias("top"), F.col("y1").alias("bottom"), "section")


def section_spans(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, section, page, top, end: where each section lies, page by page.

    pages: doc_id, page, height, every page of a document; marks: as ``heading_marks`` gives them. A section begins below its heading and ends above the next one; it goes
    on from the top of the next page if the page doesn't begin with a heading at its very edge. What stands before the first heading is in none.
    """
    own = marks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("top", "bottom", "section"))).alias("marks"))
    rows = pages.join(own, ["doc_id", "page"], "left")
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("open", F.last(F.element_at("marks", -1)["section"], ignorenulls=True).over(before)).withColumn("marks", F.coalesce("marks", F.array()))
    first = F.get("marks", F.lit(0))["top"]
    span = lambda section, top, end: F.struct(section.alias("section"), top.cast("double").alias("top"), end.cast("double").alias("end"))
    goes_on = F.when(F.col("open").isNotNull() & (F.coalesce(first, F.lit(1.0)) > 0), F.array(span(F.col("open"), F.lit(0.0), F.coalesce(first, F.col("height")))))
    here = F.transform("marks", lambda m, i: span(m["section"], m["bottom"], F.coalesce(F.get("marks", i + 1)["top"], F.col("height"))))
    return rows.select("doc_id", "page", F.inline(F.concat(F.coalesce(goes_on, F.array()), here))).select("doc_id", "section", "page", "top", "end")


def in_spans(items: DataFrame, spans: DataFrame) -> DataFrame:
    """Items with the section in whose span their centre lies, both ends included; one on an end of two spans is in both."""
    return items.join(spans, ["doc_id", "page"]).filter(centre_y().between(F.col("top"), F.col("end")))

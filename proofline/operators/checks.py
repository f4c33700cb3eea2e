"""Checks of free text against facts: leaks, addresses, pages, claims, grounding and plans."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.exact import HYPHENS, NUMBERS, names_token, squeezed
from proofline.functions.sizes import short
from proofline.operators.selection import first_pattern, named

# What leaves a house only by mistake, what is never said, and number words.
STANDARDS = r"(?i)(OISD|API|ASME|ASTM|ISO|IS|BS|EN|IEC|NFPA)[- ]?$"
TAG = r"\b[A-Z]{1,4}-\d{2,5}[A-Z]?\b"
REPORT = r"\b[A-Z]{2,6}/[A-Z]{2,6}/\d{4}/\d+\b"
MAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PRIVATE = r"\b(?:10|127)(?:\.\d{1,3}){3}\b|\b192\.168(?:\.\d{1,3}){2}\b|\b172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2}\b"
VERDICT = (
    r"(?i)\b(?:is|are|be|been|was|were|hereby)\s+(?:approved|cleared)\b|\bapproved for\b|\bI approve\b"
    r"|\bfit for (?:service|purpose)\b|\bsafe to (?:operate|continue)\b|\bsigned[- ]off\b"
)
BREACH = (
    r"(?i)\b(below|undershot|under-?thickness|short of|falls? short|falling short|less than|fails? to meet"
    r"|insufficient|deficien\w*|violat\w*|breach\w*)\b[^.]{0,40}?\b(min\w*|required|allowable)\b"
)
WRONG_UNIT = r"(?i)\d+(?:\.\d+)?\s*(?:inch(?:es)?|in\.|cm|\")"
WORDS = "zero one two three four five six seven eight nine ten eleven twelve".split()
MINIMUM = r"(?i)\b(?:min(?:imum|\.)?(?!\s+(?:\w+\s+)?(?:measured|recorded|observed|reading))|required|allowable)\b[^.\d]{0,25}?(\d+\.\d+)"
MEASURED = r"(?i)\b(?:current\w*|measured|measuring|measures|reading of)\b[^.\d]{0,25}?(\d+\.\d+)"
DONE = r"(?i)\bI(?:'ve| have)\s+(?:already\s+)?(?:read|drafted|written|checked|reviewed|run|sent|emailed|approved|inspected|searched)\b"
PROPER, END_LETTERS, QUOTE = r"\b[A-Z][A-Za-z]+\b", 4, r'["“]([^"”]{4,})["”]'
REPLY_WORDS, ANSWER_WORDS = 90, 150
COUNTED = r"(?i)\b(\d+)\s+(critical|major|minor|observation)s?\b"


def leaks(text: Column, names: tuple[str, ...] = ()) -> Column:
    """One finding for each kind of thing that should not leave: tags (not public standards), report numbers, own names, mail, private addresses."""
    first = lambda p: F.when(text.rlike(p), F.regexp_extract(text, p, 0))
    kinds = [("report number", first(REPORT)), ("e-mail", first(MAIL)), ("private address", first(PRIVATE))]
    # a tag right after a standard's name is part of that name
    around = F.regexp_extract_all(text, F.lit(rf"((?:\b[A-Za-z]+[- ])?{TAG})"), F.lit(1))
    own = F.filter(around, lambda x: ~F.regexp_extract(x, rf"^(.*?){TAG}$", 1).rlike(STANDARDS))
    tag = F.regexp_extract(F.get(own, F.lit(0)), f"{TAG}$", 0)
    kinds = [("tag", F.when(F.size(own) > 0, tag)), *kinds]
    if names:
        kinds.append(("own name", first(r"(?i)\b(?:" + "|".join(names) + r")\b")))
    return F.array_compact(F.array(*[F.when(hit.isNotNull(), F.concat(F.lit(f"{kind}: "), hit)) for kind, hit in kinds]))


def url_problem(url: Column) -> Column:
    """Why an address can't be fetched, or null: scheme, host, then a name or password in it."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    return F.when(url.isNull() | ~scheme.isin("http", "https"), "scheme").when(host == "", "host").when(F.regexp_extract(authority, r"^(.+)@", 1).rlike("[^:]"), "user")


def private_address(host: Column) -> Column:
    """Whether a literal address is loopback, link-local or private."""
    return host.rlike(rf"^(?:{PRIVATE})$") | host.rlike(r"^169\.254(?:\.\d{1,3}){2}$")


# Special ranges of addresses, as the registries list them.
LOCAL_V4 = ("0.0.0.0/8", "10.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
SHARED_V4 = ("192.0.0.9", "192.0.0.10")
LOCAL_V6 = r"^(?:f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|100::|0?64:ff9b:1:|2001:0?db8:|2001:0{0,3}:|2001::|2002:|3fff:0?[0-9a-f]{0,3}:)"
V4, V6 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$", r"^(?=.*:)(?!.*::.*::)[0-9a-f:]*(?:::|:)[0-9a-f:]*$"


def v4_number(address: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    octets = F.split(address, r"\.")
    at = lambda i: F.get(octets, F.lit(i)).try_cast("long")
    return F.when(address.rlike(V4), at(0) * (1 << 24) + at(1) * (1 << 16) + at(2) * (1 << 8) + at(3))


def v4_range(network: str) -> tuple[int, int]:
    """The first and last address of a network, as numbers."""
    first, bits = network.split("/")
    low = sum(int(o) << (24 - 8 * i) for i, o in enumerate(first.split(".")))
    return low, low + (1 << (32 - int(bits))) - 1


def scope(address: Column) -> Column:
    """loopback, local (private, link-local or reserved) or external; null for what is no address, and for 0.0.0.0 and ::.

    A zone (%eth0) doesn't count; an IPv4 address mapped into IPv6 counts as itself.
    """
    bare = F.lower(F.substring_index(address, "%", 1))
    mapped = F.regexp_extract(bare, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    number = v4_number(F.when(mapped != "", mapped).otherwise(bare))
    low, high = v4_range("127.0.0.0/8")
    local = functools.reduce(lambda a, b: a | b, [number.between(*v4_range(n)) for n in LOCAL_V4]) & ~number.isin(*[v4_range(f"{a}/32")[0] for a in SHARED_V4])
    v4 = F.when(number == 0, None).when(number.between(low, high), "loopback").when(local, "local").otherwise("external")
    digits = F.size(F.filter(F.split(bare, ":"), lambda x: x != ""))
    whole = bare.rlike(V6) & ~bare.rlike(r"[0-9a-f]{5}") & F.when(F.contains(bare, F.lit("::")), digits <= 7).otherwise((digits == 8) & bare.rlike(r"^[0-9a-f].*[0-9a-f]$"))
    v6 = F.when(bare.rlike("^[0:]+$"), None).when(bare.rlike("^[0:]*:0*1$"), "loopback").when(bare.rlike(LOCAL_V6), "local").otherwise("external")
    return F.when(number.isNotNull(), v4).when(whole, v6)


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_text(html: Column) -> Column:
    """Readable text of a page: what never is text goes with its element, then all tags; blanks collapse."""
    gone = r"(?is)<(script|style|noscript|nav|footer|header|form|svg|iframe|template)\b[^>]*>.*?</\1\s*>"
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), gone, ""), r"(?s)<[^>]*>", "")
    blank = F.regexp_replace(plain, r"[ \t\r\f\x0B]+", " ")
    return F.trim(F.regexp_replace(blank, r"\s*\n\s*(\n\s*)+", "\n\n"))


def reply_json(reply: Column) -> Column:
    """The JSON in a model's reply: code fences stripped; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(reply), r"(?s)^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    return F.try_parse_json(bare)


def unwrapped(reply: Column, field: str) -> Column:
    """A field of a reply as text, out of a ``{"value": x}`` around it if there is one."""
    v = reply_json(reply)
    return F.coalesce(F.try_variant_get(v, f"$.{field}.value", "string"), F.try_variant_get(v, f"$.{field}", "string"))


def plain(text: Column) -> Column:
    return F.regexp_replace(text, HYPHENS, "-")


def digits_for_words(text: Column) -> Column:
    """Number words up to twelve as digits."""
    for i, word in enumerate(WORDS):
        text = F.regexp_replace(text, rf"(?i)\b{word}\b", str(i))
    return text


def unknown_numbers(texts: DataFrame, allowed: DataFrame) -> DataFrame:
    """doc_id, number: numbers in a text that its document's evidence (doc_id, form) does not hold."""
    found = texts.select("doc_id", F.explode(F.regexp_extract_all(plain(F.col("text")), F.lit(f"({NUMBERS})"), F.lit(1))).alias("number")).distinct()
    return found.join(allowed.select("doc_id", F.col("form").alias("number")).distinct(), ["doc_id", "number"], "left_anti")


def wrong_counts(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, severity, said, there: counts of findings that a text states wrongly. counts: doc_id, severity (lower case), n."""
    worded = digits_for_words(plain(F.col("text")))
    claims = texts.select("doc_id", F.explode(F.regexp_extract_all(worded, F.lit(COUNTED), F.lit(0))).alias("c"))
    claims = claims.select("doc_id", F.lower(F.regexp_extract("c", COUNTED, 2)).alias("severity"), F.regexp_extract("c", COUNTED, 1).cast("long").alias("said"))
    both = claims.join(counts, ["doc_id", "severity"], "left").withColumn("there", F.coalesce("n", F.lit(0).cast("long")))
    return both.filter("said <> there").select("doc_id", "severity", "said", "there")


def said_wrongly(text: Column, max_words: int) -> Column:
    """What a summary says that it must not: a verdict, another unit; or that it is empty or too long."""
    p = plain(text)
    words = F.when(F.trim(p) == "", 0).otherwise(F.size(F.split(F.trim(p), r"\s+")))
    return F.array_compact(F.array(F.when(p.rlike(VERDICT), "verdict"), F.when(p.rlike(WRONG_UNIT), "unit"), F.when(words > max_words, "too long"), F.when(words == 0, "empty")))


def sentences(texts: DataFrame) -> DataFrame:
    """doc_id, nth, sentence."""
    return texts.select("doc_id", F.posexplode(F.split(F.trim(plain(F.col("text"))), r"(?<=[.!?])\s+")).alias("nth", "sentence"))


def breach_claims(parts: DataFrame) -> DataFrame:
    """Sentences that claim a value below its minimum."""
    return parts.filter(F.col("sentence").rlike(BREACH))


def swapped_roles(texts: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id, number, said: numbers that a text gives as a minimum though only measured, or as measured though only a minimum.

    values: doc_id, form, minimum (whether that value is a minimum; a number may be listed as both).
    """
    known = values.groupBy("doc_id", F.col("form").alias("number")).agg(F.bool_or("minimum").alias("is_min"), F.bool_or(~F.col("minimum")).alias("is_measured"))
    text = plain(F.col("text"))
    told = lambda p, name: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: F.struct(x.alias("number"), F.lit(name).alias("said")))
    said = texts.select("doc_id", F.explode(F.concat(told(MINIMUM, "minimum"), told(MEASURED, "measured"))).alias("s")).select("doc_id", "s.*").distinct()
    wrong = F.when(F.col("said") == "minimum", F.col("is_measured") & ~F.col("is_min")).otherwise(F.col("is_min") & ~F.col("is_measured"))
    return said.join(known, ["doc_id", "number"]).filter(wrong).select("doc_id", "number", "said")


def breach_problems(texts: DataFrame, readings: DataFrame) -> DataFrame:
    """doc_id, problem: what a text says of breaches against the readings' own.

    readings: doc_id, cml_id, location, breached. A breach that isn't mentioned; a sentence that claims one for a
    reading that has none; one that names no reading where the document has no breach at all.
    """
    per = readings.groupBy("doc_id").agg(F.collect_set(F.struct("cml_id", "location", F.coalesce("breached", F.lit(False)).alias("breached"))).alias("all"))
    rows = texts.select("doc_id", plain(F.col("text")).alias("text")).join(per, "doc_id", "left").withColumn("all", F.coalesce("all", F.array().cast(per.schema["all"].dataType)))
    missed = F.filter("all", lambda r: r["breached"] & ~F.contains(F.col("text"), r["cml_id"]))
    silent = F.transform(missed, lambda r: F.concat(F.lit("does not mention "), r["cml_id"]))
    claims = F.filter(F.split(F.trim("text"), r"(?<=[.!?])\s+"), lambda s: s.rlike(BREACH))
    about = lambda s, r: F.contains(s, r["cml_id"]) | F.contains(F.lower(s), F.lower(r["location"]))
    named = F.transform(claims, lambda s: F.filter("all", lambda r: about(s, r)))

    def problem(held: Column) -> Column:
        wrong = F.array_join(F.array_sort(F.transform(F.filter(held, lambda r: ~r["breached"]), lambda r: r["cml_id"])), ", ")
        none = (F.size(held) == 0) & ~F.exists("all", lambda r: r["breached"])
        return F.when(wrong != "", F.concat(F.lit("says below minimum: "), wrong)).when(none, "claims a breach that was not found")

    found = rows.select("doc_id", silent.alias("silent"), "all", named.alias("named"))
    found = found.select("doc_id", F.explode(F.array_compact(F.concat("silent", F.transform("named", problem)))).alias("problem"))
    return found.distinct()  # rows of a document are where its texts are


def reply_problems(text: Column, names: Column, most: int = REPLY_WORDS) -> Column:
    """What a chat reply must not do: be empty, give a verdict, name own documents (``names``: those found in it), claim work, be too long."""
    p = plain(F.coalesce(text, F.lit("")))
    blank = F.trim(p) == ""
    words = F.regexp_count(p, F.lit(r"\S+"))
    found = F.array(
        F.when(p.rlike(VERDICT), "verdict"),
        F.when(F.size(names) > 0, F.concat(F.lit("names "), F.array_join(F.array_sort(names), ", "))),
        F.when(p.rlike(DONE), "claims work"),
        F.when(words > most, "too long"),
    )
    return F.when(blank, F.array(F.lit("empty"))).otherwise(F.array_compact(found))


NUMBER_SHAPE, LABEL = r"(\d+(?:[.,/:]\d+)*)", r"\bP\d+\b"


def unsupported(text: Column, source: Column, known: Column, ids: Column, bare: Callable[[Column], Column], protocol: Column, free: bool = False) -> tuple[Column, Column]:
    """Names and numbers in a text that a source does not hold: identifiers (``ids``, compared as ``bare``), then capitalised words; numbers without thousands commas.

    A passage's label is no claim, nor are words of ``protocol`` (lower case). A capitalised word that begins a sentence may be an ordinary one: one of ``known`` (an array of
    lower-case words), or any where ``free``. A sentence ends at a stop after a word of four letters or more, so not after "Dr." or an initial.
    """
    rest = F.aggregate(ids, F.regexp_replace(text, LABEL, " "), lambda t, x: F.replace(t, x, F.lit(" ")))
    missing = F.filter(ids, lambda x: ~F.contains(bare(source), bare(x)))
    # (word, what stands before it) of each capitalised word: the text is cut where such words begin
    pieces = F.split(rest, rf"(?={PROPER})")
    word = lambda x: F.regexp_extract(x, rf"^({PROPER})", 1)
    before = lambda i: F.rtrim(F.when(i > 0, F.get(pieces, i - 1)).otherwise(F.lit("")))
    starts = lambda i: (F.rtrim(F.array_join(F.slice(pieces, F.lit(1), i), "")) == "") | F.regexp_like(before(i), F.lit(rf"[A-Za-z]{{{END_LETTERS},}}[.!?:;]$"))
    ordinary = lambda w: F.lit(True) if free else F.array_contains(known, F.lower(w))
    fine = lambda w, i: F.contains(F.lower(source), F.lower(w)) | F.contains(protocol, F.lower(w)) | (starts(i) & ordinary(w))
    odd = F.filter(F.transform(pieces, lambda x, i: F.when((word(x) != "") & ~fine(word(x), i), word(x))), lambda x: x.isNotNull())
    number = lambda c: F.transform(F.regexp_extract_all(c, F.lit(NUMBER_SHAPE), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")))
    return F.array_distinct(F.concat(missing, odd)), F.array_except(number(rest), number(source))


def answer_problems(sentences: DataFrame, passages: DataFrame, known: Column, identifiers: Callable[[Column], Column], bare: Callable[[Column], Column], protocol: str = "") -> DataFrame:
    """answer_id, nth, problem for each sentence of an answer against the passages that it cites.

    sentences: answer_id, nth, text, sources (labels); passages: answer_id, label, text (with the passage's own name).
    A sentence must cite passages, and such as the search gave; its identifiers, names, numbers (``unsupported``) and quotes must stand in them.
    """
    rows = sentences.select("answer_id", "nth", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
    cited = rows.select("answer_id", "nth", F.explode("sources").alias("label")).distinct().join(passages.select("answer_id", "label", F.col("text").alias("passage")), ["answer_id", "label"])
    per = cited.groupBy("answer_id", "nth").agg(F.array_sort(F.collect_set("label")).alias("found"), F.array_join(F.array_sort(F.collect_list("passage")), " ").alias("source"))
    rows = rows.join(per, ["answer_id", "nth"], "left").withColumn("ids", identifiers(F.regexp_replace("text", LABEL, " ")))
    source = F.trim(F.regexp_replace(F.col("source"), r"\s+", " "))
    unknown = F.array_except("sources", F.coalesce("found", F.array().cast("array<string>")))
    said = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(f"{kind}: "), x))
    names, numbers = unsupported(F.col("text"), source, known, F.col("ids"), bare, F.lit(protocol.lower()))
    quotes = F.filter(F.regexp_extract_all("text", F.lit(QUOTE), F.lit(1)), lambda q: ~F.contains(F.lower(source), F.lower(F.trim(q))))
    checked = F.concat(said("names", names), said("number", numbers), said("quotes", F.array_distinct(quotes)))
    problems = F.when(F.size("sources") == 0, F.array(F.lit("cites no passage"))).otherwise(F.concat(said("cites", unknown), F.when(F.col("source").isNotNull(), checked).otherwise(F.array().cast("array<string>"))))
    return rows.select("answer_id", "nth", F.explode(problems).alias("problem")).distinct()


def reply_grounding(replies: DataFrame, sentences: DataFrame, passages: DataFrame, known: Column, identifiers: Callable[[Column], Column], bare: Callable[[Column], Column], protocol: str = "", most: int = ANSWER_WORDS) -> DataFrame:
    """answer_id, nth, problem of whole replies; nth is null for what isn't about one sentence.

    replies: answer_id, question, answerable, missing (the note on what the passages lack); the rest as in ``answer_problems``. The note may name only what the question or a
    passage names, whatever begins its sentences. A reply that can't answer gives no sentences, and they aren't looked at; one that can gives some, of ``most`` words in all.
    """
    every = passages.groupBy("answer_id").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("all"))
    counted = F.size(F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != ""))
    given = sentences.groupBy("answer_id").agg(F.count("*").alias("n"), F.sum(counted).alias("words"))
    note = F.trim(F.regexp_replace(F.coalesce("missing", F.lit("")), r"\s+", " "))
    source = F.concat_ws(" ", F.trim(F.regexp_replace(F.coalesce("all", F.lit("")), r"\s+", " ")), "question")
    rows = replies.join(every, "answer_id", "left").join(given, "answer_id", "left").withColumns({"note": note, "n": F.coalesce("n", F.lit(0))})
    rows = rows.withColumn("ids", identifiers(F.regexp_replace("note", LABEL, " ")))
    names, numbers = unsupported(F.col("note"), source, known, F.col("ids"), bare, F.lit(protocol.lower()), free=True)
    said = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(f"{kind}: "), x))
    can = F.coalesce(F.col("answerable"), F.lit(False))
    flag = F.array_compact(F.array(F.when(~can & (F.col("n") > 0), "cannot answer, but gives sentences"), F.when(can & (F.col("n") == 0), "gives no sentences"), F.when(can & (F.col("words") > most), "too long")))
    whole = rows.select("answer_id", F.lit(None).cast("int").alias("nth"), F.explode(F.concat(said("note names", names), said("note number", numbers), flag)).alias("problem")).distinct()
    able = replies.filter("answerable").select("answer_id")
    single = answer_problems(sentences.join(able, "answer_id", "left_semi"), passages, known, identifiers, bare, protocol)
    return whole.unionByName(single.withColumn("nth", F.col("nth").cast("int")))


def ungrounded(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """claim_id, number: numbers of a claim that none of the passages it cites holds.

    claims: claim_id, text, cited (array of passage ids); passages: passage_id, text. Thousands commas do not count.
    """
    number = lambda c: F.transform(F.regexp_extract_all(F.col(c), F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")))
    said = claims.select("claim_id", F.explode(F.array_distinct(number("text"))).alias("number"))
    there = claims.select("claim_id", F.explode("cited").alias("passage_id")).join(passages, "passage_id").select("claim_id", F.explode(F.array_distinct(number("text"))).alias("number")).distinct()
    return said.join(there, ["claim_id", "number"], "left_anti")


def plan_problems(
    steps: DataFrame,
    kinds: DataFrame,
    limit: int,
    parts: DataFrame | None = None,
    documents: DataFrame | None = None,
    requests: DataFrame | None = None,
    tasks: DataFrame | None = None,
    plans: DataFrame | None = None,
    library: DataFrame | None = None,
    regulated: list[str] | None = None,
) -> DataFrame:
    """plan_id, problem: what is wrong with the steps of a plan.

    steps: plan_id, nth, kind, arg; kinds: kind, needs_arg, and where wanted takes_doc, takes_task, no_documents, regulated. Unknown kinds, missing arguments, repeated
    steps (arguments that a kind doesn't need don't count), too many steps. With parts (plan_id, kind, text: of the request; the kind ``none`` for what no step can do): kinds of steps that no part has, plans without
    parts. With documents (doc, name) and requests (plan_id, text): documents that aren't listed, or whose name the request
    doesn't hold as a whole token; and, with the library's ids (doc), questions of kinds that may not name any of them. With tasks (task): tasks that aren't listed. With plans (plan_id, not_possible): parts that no
    step does though nothing is said to be impossible, the reverse, and plans that have no steps and don't say why. With ``regulated`` (patterns): requests for such work whose plan has steps, but none of a regulated kind.
    """
    has = lambda name: name in kinds.columns
    joined = steps.join(short(kinds, 10_000), "kind", "left")
    argument = F.when(F.coalesce("needs_arg", F.lit(True)), F.trim(F.coalesce("arg", F.lit("")))).otherwise("")
    found = [
        joined.filter("needs_arg is null").select("plan_id", F.concat(F.lit("unknown kind: "), "kind").alias("problem")),
        joined.filter("needs_arg and trim(coalesce(arg, '')) = ''").select("plan_id", F.concat(F.lit("no argument: "), "kind").alias("problem")),
        joined.filter("needs_arg is not null").groupBy("plan_id", "kind", argument.alias("said")).count().filter("count > 1").select("plan_id", F.concat(F.lit("repeated: "), "kind").alias("problem")),
        steps.groupBy("plan_id").count().filter(F.col("count") > limit).select("plan_id", F.lit("too many steps").alias("problem")),
    ]
    good = joined.filter("needs_arg is not null").select("plan_id", "kind").distinct()
    if parts is not None:
        listed = parts.select("plan_id", "kind").distinct()
        found.append(good.join(listed, ["plan_id", "kind"], "left_anti").select("plan_id", F.concat(F.lit("no part: "), "kind").alias("problem")))
        every = steps.select("plan_id") if plans is None else plans.select("plan_id")
        found.append(every.distinct().join(listed, "plan_id", "left_anti").select("plan_id", F.lit("no parts").alias("problem")))
    if documents is not None and requests is not None:
        wanted = joined.filter("takes_doc and trim(coalesce(arg, '')) <> ''").select("plan_id", F.trim("arg").alias("doc")).distinct().join(documents, "doc", "left").join(requests, "plan_id", "left")
        held = names_token(F.coalesce("text", F.lit("")), F.col("name"))
        problem = F.when(F.col("name").isNull(), F.concat(F.lit("not listed: "), "doc")).when(~held, F.concat(F.lit("not named: "), "doc"))
        found.append(wanted.select("plan_id", problem.alias("problem")).filter("problem is not null"))
    if documents is not None and has("no_documents"):
        names = documents.select(F.explode(F.array("doc", "name")).alias("name"))
        names = names if library is None else names.unionByName(library.select(F.col("doc").alias("name")))
        asking = joined.filter("no_documents and not coalesce(takes_doc, false)" if has("takes_doc") else "no_documents").select("plan_id", "kind", F.col("arg").alias("text"))
        of = named(asking, names).groupBy("plan_id", "kind").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
        found.append(of.select("plan_id", F.concat("kind", F.lit(" asks about: "), "names").alias("problem")))
    if tasks is not None and has("takes_task"):
        asked = joined.filter("takes_task and trim(coalesce(arg, '')) <> ''").select("plan_id", F.trim("arg").alias("task"))
        found.append(asked.join(tasks.select("task").distinct(), "task", "left_anti").select("plan_id", F.concat(F.lit("no such task: "), "task").alias("problem")))
    if plans is not None:
        said = F.trim(F.coalesce("not_possible", F.lit(""))) != ""
        why = plans.select("plan_id", said.alias("said"))
        n = good.groupBy("plan_id").agg(F.count("*").alias("n"))
        idle = why.join(n, "plan_id", "left_anti").filter("not said")
        found.append(idle.select("plan_id", F.lit("no steps, and no reason").alias("problem")))
        if parts is not None:
            undone = parts.join(good, ["plan_id", "kind"], "left_anti").select("plan_id", squeezed(F.coalesce("text", F.lit(""))).alias("text"))
            found.append(undone.join(why.filter("not said"), "plan_id").select("plan_id", F.concat(F.lit("undone: "), "text").alias("problem")))
            done = why.filter("said").join(parts.select("plan_id").distinct(), "plan_id", "left_semi").join(undone.select("plan_id").distinct(), "plan_id", "left_anti")
            found.append(done.select("plan_id", F.lit("said to be impossible, but every part has a step").alias("problem")))
    if regulated and requests is not None and has("regulated"):
        asks = requests.filter(first_pattern(F.coalesce("text", F.lit("")), regulated).isNotNull()).select("plan_id").distinct().join(good.select("plan_id").distinct(), "plan_id", "left_semi")
        held = joined.filter("regulated").select("plan_id").distinct()
        found.append(asks.join(held, "plan_id", "left_anti").select("plan_id", F.lit("needs a regulated step").alias("problem")))
    return functools.reduce(DataFrame.unionByName, found).distinct()


def netstat(text: Column) -> Column:
    """The TCP connections in a listing but those that only listen, as (local, remote, state, pid): one for each line; remote is the address alone, without brackets or zone.

    A line has five parts at least: TCP, two addresses with ports, a state, a number.
    """
    parts = F.transform(F.split(text, r"\r?\n"), lambda line: F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "))
    fine = F.filter(parts, lambda p: (F.size(p) >= 5) & (F.get(p, F.lit(0)) == "TCP") & F.get(p, F.lit(4)).rlike(r"^\d+$") & (F.get(p, F.lit(3)) != "LISTENING"))
    host = lambda a: F.substring_index(F.regexp_replace(F.regexp_extract(a, "^(.*):[^:]*$", 1), r"^\[|\]$", ""), "%", 1)
    return F.transform(fine, lambda p: F.struct(F.get(p, F.lit(1)).alias("local"), host(F.get(p, F.lit(2))).alias("remote"), F.get(p, F.lit(3)).alias("state"), F.get(p, F.lit(4)).cast("long").alias("pid")))

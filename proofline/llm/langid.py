"""Operator 12: language identification by interpolated Kneser-Ney character models.

A text is read as words: runs of letters with their marks, lower case, each a sequence of its own between
two boundary signs. For each language a model of ``ORDER`` characters gives the chance of a character
after those before it: absolute discounts estimated from counts of counts, lower orders from the number of different
characters to the left, and a uniform chance at the end. All languages' models lie in one sorted array of 64-bit
hashes of character sequences for each order, with the logarithm of the interpolated chance and of the weight
that the shorter sequence has, for each language. The language with the lowest cross-entropy for each character wins.

Words' costs are kept in a table of bounded size, so that common words are looked up once; texts are counted word by
word, whole, in blocks. Models are learnt from whole texts sampled by their hash, ``CHARS`` characters or so of each
language, ``TOTAL`` of all, and from no more than ``LANGS`` languages (those with most text). A fifth of the sample is kept
from the models: on it the score is calibrated (a softmax of cross-entropies at the temperature that makes the right
languages likeliest), and with it the rejection: a text whose cross-entropy lies beyond that of nearly all
calibration texts of its language is marked ``rejected``. Those are the figures that reach the driver.

Results for odd input: a null text, or one without letters, is ``und`` with a score of 0, and isn't rejected; where no language
can be learnt all are ``und``; ties go to the first language by name; rows without an id or a language are predicted, not learnt
from; repeated texts of a language are learnt from once; runs of letters are cut after 64; texts of any length are read whole; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.llm import store
from proofline.llm.shingles import mix

ORDER = 5
#: Bounds of the sample: characters of a language, of all, languages.
CHARS, TOTAL, LANGS = 400_000, 8_000_000, 500
#: One of so many sampled texts calibrates.
FIFTH = 5
#: The share of calibration texts within their language's limit, and the room beyond it.
WITHIN, ROOM = 0.995, 1.25
UNKNOWN = "und"
#: Characters of a text taken apart at once; words whose costs are kept; words worked on at once.
BLOCK, MEMO, SLICE = 1 << 20, 200_000, 20_000
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]{0,63}")
EDGE = 0x110000
_place = mix(np.arange(1, ORDER + 1, dtype=np.uint64)) | np.uint64(1)


def words(text: str | None) -> Counter[str]:
    """How often each word occurs in a whole text. Blocks of a long text end at a space, or after ``2 * BLOCK`` characters without one."""
    if not text:
        return Counter()
    if len(text) <= BLOCK:
        return Counter(WORD.findall(text.lower()))
    found: Counter[str] = Counter()
    at = 0
    while at < len(text):
        end = text.find(" ", at + BLOCK, at + 2 * BLOCK)
        end = end if end >= 0 else at + 2 * BLOCK
        found.update(WORD.findall(text[at:end].lower()))
        at = end
    return found


def signs(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of words between edges, one after another, and where each word begins."""
    sizes = np.fromiter(map(len, some), np.int64, len(some)) + 2
    starts = np.cumsum(sizes) - sizes
    found = np.full(int(sizes.sum()), EDGE, np.uint64)
    inside = np.ones(len(found), bool)
    inside[starts] = inside[starts + sizes - 1] = False
    found[inside] = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4")
    return found, starts


def sequences(found: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length 1 to ``ORDER``, the hash of the sequence that ends at each sign, and whether it lies within its word."""
    at = np.arange(len(found)) - np.repeat(starts, np.diff(starts, append=len(found)))
    total = np.zeros(len(found), np.uint64)
    out = []
    for n in range(ORDER):
        moved = np.zeros(len(found), np.uint64)
        moved[n:] = found[: len(found) - n] + np.uint64(1)
        total = total + moved * _place[n]
        out.append((mix(total + np.uint64(n)), at >= n))
    return out


@dataclass
class Model:
    """Sorted hashes of sequences for each length; for each, by language, the log chance of its last sign and the log weight it leaves to the shorter one."""

    langs: list[str]
    keys: list[np.ndarray]
    chances: list[np.ndarray]
    weights: list[np.ndarray]
    floor: np.ndarray
    heat: float = 1.0
    limits: np.ndarray | None = None

    def costs(self, some: list[str]) -> np.ndarray:
        """Words by languages: what all signs of a word but its first edge cost."""
        found, starts = signs(some)
        cost = np.repeat(-self.floor[None, :], len(found), axis=0)
        before = np.zeros((len(found), len(self.langs)), np.float32)  # weights of the sequences that end one sign earlier
        for n, (hashes, inside) in enumerate(sequences(found, starts)):
            keys = self.keys[n]
            if not len(keys):
                break
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            known = inside & (keys[at] == hashes)
            seen = known[:, None] & (self.chances[n][at] < 0)
            # a longer sequence that is known has its own chance; where only its start is, the shorter one's counts by the start's weight
            cost = np.where(seen, -self.chances[n][at], cost - np.where(inside[:, None], before, 0) if n else cost)
            before = np.zeros_like(before)
            before[1:] = np.where(known[:-1, None], self.weights[n][at[:-1]], 0)
        cost[starts] = 0
        return np.add.reduceat(cost, starts, axis=0)


def learn(counts: dict[str, Counter[str]]) -> Model:
    """Interpolated Kneser-Ney models of the words of each language."""
    langs = sorted(counts)
    tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    alphabet: set[str] = set()
    for own in counts.values():
        alphabet.update(*own)
    least = 1 / (len(alphabet) + 2)  # every known sign, the edge, and one for all others
    for lang in langs:
        some = sorted(counts[lang])
        found, starts = signs(some)
        times = np.repeat(np.fromiter((counts[lang][w] for w in some), np.int64, len(some)), np.diff(starts, append=len(found)))
        every = sequences(found, starts)
        first = np.zeros(len(found), bool)
        first[starts] = True
        lower = None
        # from the shortest to the longest: counts of different signs to the left, at the longest of occurrences
        for n in range(ORDER):
            hashes, inside = every[n]
            use = inside & ~first
            keys, where, back = np.unique(hashes[use], return_index=True, return_inverse=True)
            ends = np.flatnonzero(use)[where]  # one place where each sequence ends
            real = np.bincount(back, weights=times[use], minlength=len(keys))
            if n + 1 < ORDER:
                longer, inside_longer = every[n + 1]
                far = inside_longer & ~first
                _, one = np.unique(longer[far], return_index=True)
                left = np.searchsorted(keys, hashes[np.flatnonzero(far)[one]])
                different = np.bincount(left, minlength=len(keys)).astype(float)
                # what begins a word has nothing to its left but the edge: its occurrences count
                starting = np.zeros(len(keys), bool)
                starting[back[~inside_longer[use]]] = True
                number = np.where(starting, real, different)
            else:
                number = real
            once, twice = (number == 1).sum(), (number == 2).sum()
            cut = once / (once + 2 * twice) if once else 0.5
            context = every[n - 1][0][ends - 1] if n else np.zeros(len(ends), np.uint64)
            names, group = np.unique(context, return_inverse=True)
            whole, kinds = np.bincount(group, weights=number), np.bincount(group)
            weight = cut * kinds / whole
            chance = (number - cut) / whole[group] + weight[group] * (lower(ends) if n else least)
            tables[n].append((keys, np.log(chance), names, np.log(weight)))

            def lower(places: np.ndarray, keys=keys, chance=chance, hashes=hashes) -> np.ndarray:
                return chance[np.searchsorted(keys, hashes[places])]

    keys, chances, weights = [], [], []
    floor = np.array([t[3][0] for t in tables[0]], np.float32) + math.log(least) if langs else np.zeros(0, np.float32)
    for n in range(ORDER):
        # sequences of this length, and those that are contexts of longer ones
        after = tables[n + 1] if n + 1 < ORDER else [(None, None, np.zeros(0, np.uint64), np.zeros(0))] * len(langs)
        own = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t[0] for t in tables[n]), *(t[2] for t in after)]))
        chance, weight = np.zeros((len(own), len(langs)), np.float32), np.zeros((len(own), len(langs)), np.float32)
        for i, (t, a) in enumerate(zip(tables[n], after, strict=True)):
            chance[np.searchsorted(own, t[0]), i] = t[1]
            weight[np.searchsorted(own, a[2]), i] = a[3]
        keys.append(own)
        chances.append(chance)
        weights.append(weight)
    return Model(langs, keys, chances, weights, floor)


def entropies(texts: Iterator[str | None], model: Model, memo: dict[str, int], table: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts by languages: nats for each sign; and how many signs each text has (0: no letters). ``memo`` and ``table`` keep words' costs."""
    found = [words(t) for t in texts]
    size = np.array([sum(c * (len(w) + 1) for w, c in one.items()) for one in found], np.int64)
    total = np.zeros((len(found), len(model.langs)))
    at = 0
    while at < len(found):
        stop, new = at, set()
        while stop < len(found) and (stop == at or len(new) < SLICE):
            new.update(w for w in found[stop] if w not in memo)
            stop += 1
        if len(memo) > MEMO:
            memo.clear()
            table.clear()
            new = {w for one in found[at:stop] for w in one}
        if new:
            some = sorted(new)
            table[:] = [np.concatenate([*table, *(model.costs(some[i : i + SLICE]) for i in range(0, len(some), SLICE))])]
            memo.update(zip(some, range(len(memo), len(memo) + len(some)), strict=True))
        for i in range(at, stop):
            if found[i]:
                ids = np.fromiter((memo[w] for w in found[i]), np.int64, len(found[i]))
                total[i] = np.fromiter(found[i].values(), np.float64, len(ids)) @ table[0][ids]
        at = stop
    return total / np.maximum(size, 1)[:, None], size


def held_out():
    """Column: whether a row is kept out of learning (crc32 of its id as text, modulo 3, is 1)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def sampled(docs: DataFrame, chars: int, total: int, langs: int) -> DataFrame:
    """lang, text, calibrates: texts to learn from, each once, about ``chars`` characters of each language, never more than twice that but for a language's first text."""
    usable = docs.filter(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    sizes = usable.groupBy("lang").agg(F.sum(F.length("text").cast("long")).alias("chars")).orderBy(F.desc("chars"), "lang").limit(langs).collect()
    each = min(chars, total // max(1, len(sizes)))
    schema = "lang string, bar long"
    bars = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, each / max(1, r["chars"])) * (1 << 62))) for r in sizes], schema)
    hashed = usable.withColumn("hash", F.shiftrightunsigned(F.xxhash64("text"), 2))
    few = hashed.join(F.broadcast(bars), "lang").filter(F.col("hash") <= F.col("bar"))  # ``LANGS`` rows at most
    # a language whose texts all lie above its bar gives the first of them
    none = bars.join(few.select("lang").distinct(), "lang", "left_anti").select("lang")
    first = hashed.join(F.broadcast(none), "lang").groupBy("lang").agg(F.min("hash").alias("hash"))
    more = hashed.join(F.broadcast(first), ["lang", "hash"])
    chosen = few.select("lang", "text", "hash").unionByName(more.select("lang", "text", "hash")).groupBy("lang", "hash").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("hash", "text")
    kept = chosen.withColumns({"sum": F.sum(F.length("text").cast("long")).over(order), "nth": F.row_number().over(order)}).filter((F.col("sum") <= 2 * each) | (F.col("nth") == 1))
    return kept.select("lang", "text", (F.col("nth") % FIFTH == 0).alias("calibrates"))


def train(docs: DataFrame, chars: int = CHARS, total: int = TOTAL, langs: int = LANGS) -> Model:
    """Models of a bounded sample, calibrated on a fifth of it."""
    spark = docs.sparkSession
    with store.Scope(spark):
        sample = store.table(sampled(docs, chars, total, langs), "sample")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in store.slices(batches):
                for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = words(text)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["lang", "word", "n"])

        every = sample.filter(~F.col("calibrates")).select("lang", "text").mapInArrow(count, "lang string, word string, n long")
        rows = every.groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()  # the sample's words
        counts: dict[str, Counter[str]] = {}
        for lang, word, n in zip(*(rows.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            counts.setdefault(lang, Counter())[word] = n
        model = learn(counts)
        if model.langs:
            calibrate(spark, model, sample.filter("calibrates").select("lang", "text"))
    return model


def calibrate(spark: SparkSession, model: Model, texts: DataFrame) -> None:
    """Temperature and limits from texts that the models haven't seen; numbers of a bounded sample reach the driver."""
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, table = {}, []
        for batch in store.slices(batches):
            found, size = entropies(batch.column(1).to_pylist(), sent.value, memo, table)
            use = size > 0
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(use)), pa.array(list(found[use]), pa.list_(pa.float64()))], ["lang", "nats"])

    rows = texts.mapInArrow(run, "lang string, nats array<double>").toArrow()
    sent.destroy()
    nats = np.array(rows.column("nats").to_pylist()).reshape(-1, len(model.langs))
    right = [model.langs.index(x) if x in model.langs else -1 for x in rows.column("lang").to_pylist()]
    known = np.array(right, int) >= 0
    nats, right = nats[known], np.array(right, int)[known]
    wins = nats.argmin(axis=1) if len(nats) else right
    model.limits = np.full(len(model.langs), np.inf)
    if len(nats):
        heats = 2.0 ** np.arange(-2, 9, 0.5)
        loss = [-np.log(np.maximum(1e-12, softmax(nats, h)[np.arange(len(right)), right])).mean() for h in heats]
        model.heat = float(heats[int(np.argmin(loss))])
        for i in range(len(model.langs)):
            own = nats[(right == i) & (wins == i), i]
            if len(own):
                model.limits[i] = ROOM * np.quantile(own, WITHIN)


def softmax(nats: np.ndarray, heat: float) -> np.ndarray:
    """The chance of each language from cross-entropies."""
    odds = np.exp(-heat * (nats - nats.min(axis=1, keepdims=True)))
    return odds / odds.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, chars: int = CHARS, total: int = TOTAL, langs: int = LANGS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, nats, rejected of every document."""
    model = train(docs, chars, total, langs)
    sent: Broadcast[Model] = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo, table = sent.value, {}, []
        for batch in store.slices(batches):
            if not model.langs:
                n = batch.num_rows
                columns = [pa.array([UNKNOWN] * n), pa.array([0.0] * n), pa.array([None] * n, pa.float64()), pa.array([False] * n)]
            else:
                nats, size = entropies(batch.column(1).to_pylist(), model, memo, table)
                best, some = nats.argmin(axis=1), size > 0
                at = np.arange(len(best))
                least, score = nats[at, best], softmax(nats, model.heat)[at, best]
                rejected = some & (least > model.limits[best])
                names = [model.langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                columns = [pa.array(names), pa.array(np.where(some, score, 0.0)), pa.array(least, mask=~some), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "lang_pred", "score", "nats", "rejected"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, nats double, rejected boolean")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "nats", "rejected")

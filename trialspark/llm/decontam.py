"""Benchmark decontamination: rare n-gram seeds join training passages to test items, Smith-Waterman scores the alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from trialspark.llm.common import HOT_SHARE, bounded_broadcast, join_counted, release, written

TOKEN = re.compile(r"[^\W_]+")
#: Bits of the filter that a scan carries: a fixed size, whatever the benchmark holds.
FILTER_BITS = 1 << 24
#: Items of fewer words are sought by pairs of words too.
SHORT = 24
#: Tasks over which the places of one busy n-gram are dealt.
SALTS = 64
#: Words that are hashed at once.
RUN = 200_000


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


class Numbers(dict):
    """Numbers of words, kept for the next texts while there are under a million."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[word] = number = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return number


def word_numbers(words: list[str], known: Numbers | None = None) -> np.ndarray:
    known = Numbers() if known is None else known
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def gram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words; of all words where there are fewer."""
    if not len(w):
        return w
    n = min(n, len(w))
    out = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def pair_hashes(w: np.ndarray, gap: int) -> np.ndarray:
    """Hashes of each word with the one `gap` places on."""
    left, right = w[:-gap], w[gap:]
    out = (left ^ (left >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F) + right + np.uint64(gap)
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def smith_waterman(a: np.ndarray, b: np.ndarray, match: float = 1.0, mismatch: float = -0.5, gap: float = -0.5) -> tuple[float, int, int]:
    """Best local alignment of two sequences of numbers: (score, first and last place in b, end exclusive).

    Row by row over a; along a row, a run of gaps in b is a running maximum of score - gap * place.
    """
    steps = -gap * np.arange(1, len(b) + 1)
    prev, began = np.zeros(len(b) + 1), np.arange(len(b) + 1)
    best = (0.0, 0, 0)
    for x in a:
        diag = prev[:-1] + np.where(b == x, match, mismatch)
        up = prev[1:] + gap
        row = np.maximum(np.maximum(diag, up), 0)
        start = np.where(row == 0, np.arange(1, len(b) + 1), np.where(diag >= up, began[:-1], began[1:]))
        lifted = row + steps
        peak = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == peak, np.arange(len(b)), 0))
        row = peak - steps
        start = start[source]
        prev, began = np.concatenate([[0.0], row]), np.concatenate([[0], start])
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (float(row[k]), int(start[k]), k + 1)
    return best


def seeds_of(items: DataFrame, n: int, min_words: int) -> DataFrame:
    """(gram, item, item_at, width, spare, need): the n-grams that may be seeds of each item, and how many of them must.

    Items of under SHORT words have pairs of words too, next to each other or with one between, since a change at every third
    word leaves no longer run. An alignment that passes keeps some of an item's grams: all but four pairs for each of a third of
    the words changed, or in longer items all but n for each of a sixth. So `spare` of them may go, the commonest, and
    `need` others are still met. width is how far edits may shift a copy's words against the item's.
    """

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, text in zip(pdf["item"], pdf["item_text"], strict=True):
                w = word_numbers(tokens(text))
                m = len(w)
                if m < min_words:
                    continue
                kinds = [gram_hashes(w, n)]
                left = m - n + 1 - n * (m // 6)
                if m < SHORT:
                    kinds += [pair_hashes(w, gap) for gap in (1, 2) if m > gap]
                    left = 2 * m - 3 - 4 * (m // 3)
                at = np.concatenate([np.arange(len(k)) for k in kinds])
                rows = {"gram": np.concatenate(kinds).view(np.int64), "item": i, "item_at": at, "width": 8 + m // 2, "spare": max(0, left - 2), "need": max(1, min(2, left))}
                yield pd.DataFrame(rows)

    return items.mapInPandas(grams, "gram long, item long, item_at long, width long, spare long, need long")


def rare_seeds(seeds: DataFrame, counts: DataFrame) -> DataFrame:
    """Each item's seeds without its `spare` commonest, by the number of places in all documents that hold them (n)."""
    told = seeds.join(counts, "gram", "left").na.fill(0, ["n"])
    order = Window.partitionBy("item").orderBy(F.desc("n"), "gram", "item_at")
    return told.withColumn("common", F.row_number().over(order)).filter("common > spare").drop("common", "spare", "n")


def joined_to_seeds(hits: DataFrame, seeds: DataFrame, counts: DataFrame, rows: int = 500_000) -> DataFrame:
    """hits JOIN seeds USING (gram): by broadcast up to so many seeds, else with the places of busy grams dealt over SALTS tasks.

    Busy grams hold over 1/HOT_SHARE of all places each, so there are under HOT_SHARE of them whatever the input.
    """
    if seeds.limit(rows + 1).count() <= rows:
        return hits.join(F.broadcast(seeds), "gram")
    total = counts.agg(F.sum("n")).first()[0] or 0
    busy = F.broadcast(counts.filter(F.col("n") * HOT_SHARE > total).select("gram", F.lit(True).alias("busy")))
    dealt = hits.join(busy, "gram", "left").withColumn("salt", F.when(F.col("busy"), F.pmod(F.xxhash64("id", "at"), F.lit(SALTS)).cast("int")).otherwise(0))
    salts = F.when(F.col("busy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = seeds.join(busy, "gram", "left").withColumn("salt", F.explode(salts))
    return dealt.drop("busy").join(copied.drop("busy"), ["gram", "salt"]).drop("salt")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 3, min_score: float = 0.5, min_words: int = 5, broadcast_seeds: int = 500_000) -> DataFrame:
    """(id, item, score, begin, end, n_seeds): a row for each document and test item whose words it repeats, edited or not.

    Words are runs of letters and digits in lower case. Seeds are an item's rarer n-grams (seeds_of, rare_seeds), counted over
    all documents: as many of the commonest are left out as a copy can do without, so that a phrase that many items or
    documents share is a seed only of items that hold little else. Equal item texts are looked for once and returned under
    each id. A scan of the documents writes the places whose n-gram is in a filter of fixed size; they are counted, and those
    of seeds joined to the items. Two different seeds at about the same shift between document and item (one where an item is so
    short that edits may leave one) make a candidate. Around them the passage is aligned with the whole item (match 1, mismatch
    and gap -0.5); score is the best local alignment over the item's words. Pairs of at least min_score are returned with
    the most hits of seeds at one shift there; begin and end are word places in the document.

    A copy is sure to be met with a third of its words replaced in items of under SHORT words, with a sixth in longer ones;
    with more edits most are (tests/llm plant copies with up to a third edited: at least 0.95 in each length).

    Null and empty texts and items match nothing, nor do items of under min_words words. Repeated documents, or ids, are
    scored row by row and returned once. Rows without an id are ignored.
    """
    named = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("named"), F.col(f"`{item_text_col}`").alias("item_text")).filter("named IS NOT NULL AND item_text IS NOT NULL").distinct()
    named = written(named, "items")
    items = written(named.select("item_text").distinct().withColumn("item", F.monotonically_increasing_id()), "item-texts")
    ids = written(named.join(items, "item_text").select("item", "named"), "item-ids")
    seeds = written(seeds_of(items, n, min_words), "grams")
    bits = seeds.select(F.pmod("gram", F.lit(FILTER_BITS)).cast("int").alias("bit")).distinct().toPandas()["bit"].to_numpy(np.int64)
    mask = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    np.bitwise_or.at(mask, bits >> 3, (1 << (bits & 7)).astype(np.uint8))
    shared = docs.sparkSession.sparkContext.broadcast(mask)

    def places(ids: list, numbers: list) -> pd.DataFrame:
        """The hits of some texts, hashed as one run of words; what reaches over a text's end is none."""
        w, ends = np.concatenate(numbers), np.cumsum([len(x) for x in numbers])
        starts = ends - [len(x) for x in numbers]
        out = []
        for span, g in ((n, gram_hashes(w, n)), (2, pair_hashes(w, 1)), (3, pair_hashes(w, 2))):
            g = g.view(np.int64)
            bit = g & (FILTER_BITS - 1)
            at = np.flatnonzero(shared.value[bit >> 3] >> (bit & 7) & 1)
            text = np.searchsorted(ends, at, side="right")
            inside = at + span <= ends[text]
            at, text = at[inside], text[inside]
            out.append((np.array(ids, dtype=np.int64)[text], g[at], at - starts[text]))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("id", "gram", "at"), zip(*out, strict=True), strict=True)})

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Numbers()
        for pdf in batches:
            ids, numbers, size = [], [], 0
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                ids.append(i)
                numbers.append(word_numbers(tokens(text), known))
                size += len(numbers[-1])
                if size >= RUN:
                    yield places(ids, numbers)
                    ids, numbers, size = [], [], 0
            if ids:
                yield places(ids, numbers)

    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    met = written(base.mapInPandas(hits, "id long, gram long, at long"), "places")
    counts = written(met.groupBy("gram").agg(F.count("*").alias("n")), "gram-counts")
    rare = written(rare_seeds(seeds, counts), "seeds")
    found = joined_to_seeds(met, rare, counts, broadcast_seeds).withColumn("begin", F.col("at") - F.col("item_at"))
    band = F.floor(F.col("begin") / F.col("width"))
    found = found.withColumn("band", F.explode(F.array(band, band - 1)))
    seen = found.groupBy("id", "item", "band").agg(F.count("*").alias("n_seeds"), F.min("begin").alias("low"), F.max("begin").alias("high"), (F.min("gram") != F.max("gram")).alias("two"), F.max("need").alias("need"))
    seen = seen.filter("two OR need = 1").groupBy("id", "item").agg(F.collect_set(F.struct("low", "high", "n_seeds")).alias("spans"))
    seen = written(seen, "candidates")
    release(met)
    often = seen.groupBy("item").agg(F.count("*").alias("n")).join(items, "item")
    passages = join_counted(seen, often, ["item"], "n").join(base, "id")
    passages = passages.select("id", "item", "text", "item_text", "spans.low", "spans.high", "spans.n_seeds")
    scored = passages.withColumn("m", _aligner(min_score)("text", "item_text", "low", "high", "n_seeds")).select("id", "item", "m.*").filter(F.col("score") >= min_score)
    scored = scored.join(bounded_broadcast(ids), "item").withColumn("item", F.col("named")).drop("named")
    return scored.groupBy("id", "item").agg(F.max_by(F.struct("score", "begin", "end", "n_seeds"), F.struct("score", "begin")).alias("m")).select("id", "item", "m.*")


def _aligner(min_score: float):
    @pandas_udf("score double, begin long, end long, n_seeds long")
    def align(texts: pd.Series, items: pd.Series, lows: pd.Series, highs: pd.Series, hits: pd.Series) -> pd.DataFrame:
        rows, known, last, whole = [], Numbers(), None, np.zeros(0, dtype=np.uint64)
        for text, item, *spans in zip(texts, items, lows, highs, hits, strict=True):
            wanted = word_numbers(tokens(item), known)
            if text != last:
                last, whole = text, word_numbers(tokens(text), known)
            spare = 8 + len(wanted) // 2
            best, merged = (0.0, 0, 0, 0), []
            for a, b, n_seeds in sorted(zip(*spans, strict=True)):
                if merged and a <= merged[-1][1] + spare:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]), max(n_seeds, merged[-1][2]))
                else:
                    merged.append((a, b, n_seeds))
            for a, b, n_seeds in merged:
                first, last_word = max(0, a - spare), min(len(whole), b + len(wanted) + spare)
                given = whole[first:last_word]
                if np.isin(wanted, given).sum() < min_score * len(wanted):  # no alignment has more matches than this
                    continue
                score, begin, end = smith_waterman(wanted, given)
                if score / len(wanted) > best[0]:
                    best = (score / len(wanted), first + begin, first + end, n_seeds)
            rows.append(best)
        return pd.DataFrame(rows, columns=["score", "begin", "end", "n_seeds"])

    return align

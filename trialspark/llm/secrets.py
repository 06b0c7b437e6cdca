"""Secret scans: patterns, and password guess-cost dynamic programming over values in credential contexts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from trialspark.llm.common import written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: A credential's name, something that gives it a value, and the value.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private)[\x20_-]?key|credentials?|login|bearer|auth(?:orization)?)(?![A-Za-z])"""
    r"""(?:["']?\x20*(?:[:=]+>?|->)\x20*["'`]?|\x20+(?:is|was)\x20*:?\x20*["'`]?|\x20+["'`])(?:bearer\x20+|basic\x20+)?([^\s"'`<>,;]{6,})""",
    re.ASCII | re.IGNORECASE,
)
NAMES = ("pass", "pwd", "secret", "token", "key", "credential", "login", "bearer", "auth")
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "guess")
HEX_OF = bytes.maketrans(bytes(range(256)), bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256)))
#: Rows of a keyboard, each shifted by half a key against the one above, and what stands for letters in passwords.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4301$5@7!", "aeoissati")
PLACE = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
#: Years; dates by year, by day and by month, with a year of four digits or of two; numbers of one digit where signs part them.
#: Each is tried at each place, and each length that a date may have there.
DAY, MONTH, YEAR, PART = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d", r"[-./]"
SHORT_DAY, SHORT_MONTH = r"(?:[12]\d|3[01]|0?[1-9])", r"(?:1[0-2]|0?[1-9])"
DATES = [
    re.compile(x)
    for x in (
        YEAR,
        rf"{YEAR}{PART}?{MONTH}{PART}?{DAY}",
        *(rf"{a}{PART}?{b}{PART}?{y}" for a, b in ((DAY, MONTH), (MONTH, DAY)) for y in (YEAR, r"\d\d")),
        *(rf"{a}{PART}{b}{PART}{y}" for a, b in ((SHORT_DAY, SHORT_MONTH), (SHORT_MONTH, SHORT_DAY)) for y in (YEAR, r"\d\d")),
        *(rf"{YEAR}{PART}{SHORT_MONTH}{PART}{d}" for d in (SHORT_DAY, r"[1-9]")),
    )
]
#: Characters of a repeated block, and of a keyboard walk, at most.
BLOCK, WALK = 8, 64


def _neighbours(a: str, b: str) -> bool:
    if a == b or a not in PLACE or b not in PLACE:
        return False
    (r, k), (q, m) = PLACE[a], PLACE[b]
    return r == q and abs(k - m) == 1 or q - r == 1 and m - k in (-1, 0) or r - q == 1 and k - m in (-1, 0)


def _brute(c: str) -> float:
    """log10 of a character's class."""
    return 1.0 if c in "0123456789" else math.log10(26) if c.isascii() and c.isalpha() else math.log10(33) if c.isascii() else 2.0


def guess_cost(value: str, ranks: dict[str, int], longest: int = 24) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses that the cheapest segmentation of value takes, and its segments (kind, start, end).

    Segments: a word costs its rank, times two for other cases than lower and for letters written as digits; a year 120
    guesses, a date 36500; a repeat of a block (of BLOCK characters at most) what the block's characters cost by brute force,
    or as a word, times the number of blocks; a keyboard walk of three or more keys (WALK at most) a start times four
    directions for each stretch; a brute-force character the size of its class. Each segment but a brute-force character also
    costs a factor of 2, for being one of several kinds. All words, dates, walks and repeats at all places are offered, so
    the cost is the least. A repeat goes on from its last block, so that time is linear in the length of usual values.
    """
    n, low = len(value), value.lower()
    plain = low.translate(LEET) if len(low) == n else low
    low, plain = (low, plain) if len(low) == n else (value, value)
    best, back = [0.0] + [math.inf] * n, [("", 0)] * (n + 1)
    kind_cost = math.log10(2)
    brute = [0.0]
    for c in value:
        brute.append(brute[-1] + _brute(c))

    def offer(i: int, j: int, kind: str, cost: float) -> None:
        if best[i] + cost < best[j]:
            best[j], back[j] = best[i] + cost, (kind, i)

    def word(i: int, j: int) -> float:
        rank = ranks.get(low[i:j])
        spelled = rank is None and (rank := ranks.get(plain[i:j])) is not None
        return math.inf if rank is None else math.log10(rank) + kind_cost * (1 + spelled + (value[i:j] != low[i:j]))

    # For each block length and the start of the last of equal blocks: places where they may begin, and the cost up to the first
    # block's end. A later start is kept if it is the best now; an earlier one may be again as blocks go on.
    began: list[dict[int, list[tuple[int, float]]]] = [{} for _ in range(BLOCK + 1)]
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            if (cost := word(i, j)) < math.inf:
                offer(i, j, "word", cost)
        offer(i, i + 1, "brute", brute[i + 1] - brute[i])
        if value[i].isascii() and value[i].isdigit():
            for k, date in enumerate(DATES):
                if m := date.match(value, i):
                    offer(i, m.end(), "date", kind_cost + math.log10(36500 if k else 120))
        for size in range(1, min(BLOCK, (n - i) // 2) + 1):
            if low[i : i + size] == low[i + size : i + 2 * size]:
                block = min(brute[i + size] - brute[i], word(i, i + size) - kind_cost if size >= 3 else math.inf)
                end, starts = i + 2 * size, began[size].pop(i, [])
                if best[i] + block + math.log10(2) < min((c + math.log10((end - k) // size) for k, c in starts), default=math.inf):
                    starts.append((i, best[i] + block))
                began[size][i + size] = starts
                for k, c in starts:
                    if end - k >= 3 and (cost := c + kind_cost + math.log10((end - k) // size)) < best[end]:
                        best[end], back[end] = cost, ("repeat", k)
        j, turns, step = i + 1, 0, None
        while j < min(n, i + WALK) and _neighbours(low[j - 1], low[j]):
            (r, k), (q, s) = PLACE[low[j - 1]], PLACE[low[j]]
            turns += step is not None and step != (q - r, s - k)
            step, j = (q - r, s - k), j + 1
            if j - i >= 3:
                offer(i, j, "walk", kind_cost + math.log10(len(PLACE)) + math.log10(j - i) + math.log10(4) * (turns + 1))
    segments, j = [], n
    while j:
        kind, i = back[j]
        segments.append((kind, i, j))
        j = i
    return best[n], segments[::-1]


def base_spans(text: str, lower: str) -> list[tuple[str, int, int]]:
    """The three patterns' spans; each pattern is looked for only where a text can hold it."""
    out = []
    if any(x in lower for x in ASSIGN_NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"\x01" * 24 in text.encode("utf-8", "surrogatepass").translate(HEX_OF):
        out += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def guessed_spans(text: str, lower: str, base: list[tuple[str, int, int]], ranks: dict[str, int], least: float) -> list[tuple[str, int, int, float]]:
    """Values in credential contexts that no base span covers and that take 10**least guesses or more, whatever their letters."""
    out = []
    if not any(x in lower for x in NAMES):
        return out
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        while end > start and text[end - 1] in ".,;:!?)]}*#":
            end -= 1
        if end - start < 6 or any(s < end and start < e for _, s, e in base):
            continue
        cost, _ = guess_cost(text[start:end], ranks)
        if cost >= least:
            out.append(("guess", start, end, cost))
    return out


_WORD = re.compile(r"[a-z]{3,24}")


def word_ranks(docs: DataFrame, text_col: str = "text", most: int = 20_000) -> dict[str, int]:
    """The `most` commonest words (3 to 24 letters a-z, in lower case) of all texts, with their ranks from 1.

    Words are counted over all documents, in each batch first; only the bounded list comes to the driver. How many words are
    as common is counted by steps of a twelfth of a doubling first, so that tasks send only words that may be in the list.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: Counter = Counter()
            for text in pdf["text"]:
                n.update(_WORD.findall((text or "").lower()))
            yield pd.DataFrame({"word": pd.Series(list(n), dtype=object), "n": pd.Series(list(n.values()), dtype="int64")})

    counts = docs.select(F.col(f"`{text_col}`").alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("step", F.floor(F.log2("n") * 12).cast("int")), "word-counts")
    least, above = 0, 0
    for step, words in sorted(((r.step, r["count"]) for r in counts.groupBy("step").count().collect()), reverse=True):
        least, above = step, above + words
        if above >= most:
            break
    chosen = counts.filter(F.col("step") >= least).orderBy(F.desc("n"), "word").limit(most)
    return {r.word: k for k, r in enumerate(chosen.select("word").collect(), 1)}


def scanned(docs: DataFrame, text_col: str = "text", least: float = 10.0, most_words: int = 20_000, out_col: str = "secrets") -> DataFrame:
    """docs with out_col: array of (kind, start, end, log10_guesses, segments), by start, then by kind as in KINDS.

    start and end are code points of the whole text, end exclusive. log10_guesses is the guess cost of a span of kind
    assign (its value) or guess, segments the kinds and lengths of its cheapest segmentation; both are null for others. Null and empty texts have none. Rows come back as they are, repeated or not; a
    column named out_col is replaced. No rows in, no rows out.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(docs, text_col, most_words))

    @pandas_udf("array<struct<kind: string, start: long, end: long, log10_guesses: double, segments: string>>")
    def spans(texts: pd.Series) -> pd.Series:
        def told(value: str) -> tuple[float, str]:
            cost, segments = guess_cost(value, ranks.value)
            return cost, ",".join(f"{kind}:{end - start}" for kind, start, end in segments)

        rows = []
        for text in texts:
            text = text or ""
            lower = text.lower()
            base = base_spans(text, lower)
            found = [(k, s, e, *(told(ASSIGN.match(text, s)[2]) if k == "assign" else (None, None))) for k, s, e in base]
            found += [(k, s, e, *told(text[s:e])) for k, s, e, _ in guessed_spans(text, lower, base, ranks.value, least)]
            rows.append([dict(zip(("kind", "start", "end", "log10_guesses", "segments"), x, strict=True)) for x in sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))])
        return pd.Series(rows)

    return docs.withColumn(out_col, spans(F.col(f"`{text_col}`")))


def span_list(spans, kinds: tuple[str, ...] = KINDS):
    """kind:start:end, comma-joined, of the spans of these kinds."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

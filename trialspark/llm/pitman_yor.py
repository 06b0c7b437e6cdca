"""LM scoring by a hierarchical Pitman-Yor model of word pairs.

Every context (the word before) is a Chinese restaurant; the word after it is a customer's dish. Tables of all context
restaurants are the customers of one parent restaurant, whose own base is uniform over the known words and one unknown.

Seating. Only the number of tables of each dish matters. With x drawn from Gamma(strength / discount + tables, 1), the
number of tables t of a dish with c customers has a probability in proportion to S(c, t) (discount x base)**t, where S are
generalised Stirling numbers, whatever the restaurant's other dishes do. So a Gibbs sweep draws x for each restaurant, then
all dishes at once: by inverse cumulative sums up to EXACT customers; beyond, by seating customers one after another and
taking the new seating with its Metropolis-Hastings chance. What lies in other tasks (the parent's probabilities) stands as
it was when a sample began, as in other distributed Gibbs samplers.

How it runs. Words are 64-bit hashes. One scan of the texts reduces each batch to its distinct pairs with their counts,
dealt by context to buckets; pairs of common contexts are dealt by pair, so that no context fills a bucket. Buckets tell
shards of words how many customers (tables) each word has; shards seat them and answer the parent's counts. A bucket scores
its pairs and answers the batches that asked, so that a pair is sent once from a batch, however often the batch holds it.
Messages are packed number arrays, one for each two parts that have something to tell: never more of them than pairs.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import least_hashed, scratch, written

#: Hashes of what no word can be: the end of a text, and what stands before its first word.
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" ", b"  "))
#: Tokens of a batch at most, unless one text has more.
BATCH_TOKENS = 2_000_000
#: Texts from which common words are taken. They only make messages short and say which contexts are dealt by pair.
SAMPLE_TEXTS, COMMON = 16_000, 400_000
#: Customers up to which a dish's tables are drawn exactly; up to which customers of other dishes are seated one by one,
#: and beyond which in groups of a 64th of those seated.
EXACT, ONE_BY_ONE = 100, 1024
#: A pair's score is told in so many steps of a unit of log10: rounding moves it by 5e-7 at most, as 32-bit floats would.
STEPS = 1 << 20
MESSAGE = "bucket long, shard long, kind int, body binary"


@dataclass(frozen=True)
class Settings:
    """Strengths of both levels, sweeps of the seating for each sample, and samples to average."""

    strength: float = 0.5
    parent_strength: float = 10.0
    sweeps: int = 2
    samples: int = 2
    bucket_tokens: int = 1_500_000


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words (A-Z in lower case, cut at ASCII white space), and of its end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, dtype=np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    out[-1] = END
    return out


def place_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Which of so many equal ranges of hashes each lies in; grows with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def mixed(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    h = (context ^ (context >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + token * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)


def pack(*arrays: np.ndarray, kinds: str) -> bytes:
    """Arrays as numbers of these kinds, compressed byte by byte of a number; +kind: as differences, for sorted numbers."""
    raw = b""
    for a, k in zip(arrays, kinds.split(), strict=True):
        a = np.asarray(a).astype(f"<{k.lstrip('+')}")
        a = np.diff(a, prepend=a.dtype.type(0)) if k[0] == "+" else a
        raw += len(a).to_bytes(8, "little") + a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(body: bytes, kinds: str) -> list[np.ndarray]:
    raw, at, out = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True), 0, []
    for k in kinds.split():
        n, of = int.from_bytes(raw[at : at + 8], "little"), np.dtype(f"<{k.lstrip('+')}")
        a = np.frombuffer(raw, dtype=np.uint8, count=n * of.itemsize, offset=at + 8).reshape(of.itemsize, n).T
        a = np.ascontiguousarray(a).reshape(-1).view(of)
        out.append(np.cumsum(a, dtype=of) if k[0] == "+" else a)
        at += 8 + a.nbytes
    return out


@dataclass(frozen=True)
class Common:
    """Hashes of common words, sorted; those of them, sorted, whose contexts are dealt by pair."""

    words: np.ndarray
    hot: np.ndarray

    def codes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each hash as its place among the common words, or their number and the hash itself in a second array."""
        if not len(self.words):
            return np.zeros(len(h), dtype=np.int64), h
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[at] == h
        return np.where(known, at, len(self.words)), h[~known]

    def hashes(self, codes: np.ndarray, rest: np.ndarray) -> np.ndarray:
        out = np.append(self.words, np.uint64(0))[codes]
        out[codes == len(self.words)] = rest
        return out

    def is_hot(self, context: np.ndarray) -> np.ndarray:
        return self.hot_at(context) >= 0

    def hot_at(self, context: np.ndarray) -> np.ndarray:
        """Place of each context in hot, or -1."""
        if not len(self.hot):
            return np.full(len(context), -1)
        at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
        return np.where(self.hot[at] == context, at, -1)


def common_words(base: DataFrame, buckets: int) -> Common:
    """Common words of a bounded sample of texts, the least by hash; hot are those with over a quarter of a bucket's tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h, n = np.unique(np.concatenate([np.append(START, token_hashes(t)) for t in pdf["text"]] or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pd.DataFrame({"h": h.view(np.int64), "n": n})

    sample = least_hashed(base.select("id", "text"), SAMPLE_TEXTS, base.count(), "id")
    counts = written(sample.select("text").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "sample-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.desc("n"), "h").limit(COMMON).toPandas()
    words = top["h"].to_numpy(np.int64).view(np.uint64)
    hot = words[(top["n"] * 4 * buckets > total) & (top["n"] > 50)] if buckets > 1 else words[:0]
    return Common(np.sort(words), np.sort(hot))


#: Kinds of arrays of a batch's pairs in a bucket: contexts' codes and hashes, pairs of each, words' codes and hashes, counts in training.
PAIRS = "u4 +u8 u4 u4 u8 u4"


def _entries(buckets: int, shared):
    """(id, train, text) -> (bucket, batch, kind, body): a batch's distinct pairs by bucket (kind 0), and its documents (kind 1).

    Pairs of a batch are numbered by bucket, context and word. Documents are lists of the numbers of their pairs.
    """

    def flush(batch: int, docs: list) -> Iterator[dict]:
        common = shared.value
        n = np.array([len(d[2]) for d in docs])
        token = np.concatenate([d[2] for d in docs])
        words, code = np.unique(token, return_inverse=True)
        before = np.concatenate([[len(words)], code[:-1]])
        before[np.cumsum(n)[:-1]] = len(words)
        train = np.repeat([d[1] for d in docs], n)
        _, first, pair = np.unique(before * (len(words) + 1) + code, return_index=True, return_inverse=True)
        context, token = np.append(words, START)[before[first]], token[first]
        del code, before
        count = np.bincount(pair[train], minlength=len(first))
        bucket = place_of(np.where(common.is_hot(context), mixed(context, token), context), buckets)
        order = np.argsort(bucket.astype(np.uint32), kind="stable")
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        ends, pair = np.cumsum(n), number[pair]
        lists = np.concatenate([np.diff(np.sort(pair[e - k : e]), prepend=0) for e, k in zip(ends, n, strict=True)])
        ids = np.array([-1 if d[0] is None else d[0] for d in docs])
        info = np.array([2 * (d[0] is None) + d[1] for d in docs])
        yield {"bucket": -1 - batch, "batch": batch, "kind": 1, "body": pack(ids, info, n, lists, kinds="i8 u1 u4 u4")}
        context, token, count, bucket = context[order], token[order], count[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            own = context[lo:hi]
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            body = pack(*common.codes(own[starts]), np.diff(starts, append=hi - lo), *common.codes(token[lo:hi]), count[lo:hi], kinds=PAIRS)
            yield {"bucket": bucket[lo], "batch": batch, "kind": 0, "body": body}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, no, docs, held = TaskContext.get().partitionId(), 0, [], 0
        for pdf in batches:
            for i, train, text in zip(pdf["id"], pdf["train"], pdf["text"], strict=True):
                docs.append((None if pd.isna(i) else int(i), bool(train), token_hashes(text)))
                held += len(docs[-1][2])
                if held >= BATCH_TOKENS:
                    yield pd.DataFrame(flush((part << 24) + no, docs))
                    no, docs, held = no + 1, [], 0
        if docs:
            yield pd.DataFrame(flush((part << 24) + no, docs))

    return run


class Bucket:
    """All distinct pairs of context and word that were dealt to a bucket, with their counts in training."""

    def __init__(self, bodies: pd.DataFrame, common: Common):
        parts = []
        for batch, body in bodies.sort_values("batch")[["batch", "body"]].itertuples(index=False):
            c1, c2, runs, w1, w2, count = unpack(body, PAIRS)
            parts.append((batch, np.repeat(common.hashes(c1, c2), runs), common.hashes(w1, w2), count))
        self.batches = [p[0] for p in parts]
        self.sizes = [len(p[1]) for p in parts]
        context, token, count = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
        del parts
        _, first, self.pair = np.unique(mixed(context, token), return_index=True, return_inverse=True)
        self.pair = self.pair.astype(np.int32)
        self.count = np.bincount(self.pair, weights=count, minlength=len(first)).astype(np.int64)
        self.words, self.word = np.unique(token[first], return_inverse=True)
        contexts, self.room = np.unique(context[first], return_inverse=True)
        self.rooms, self.hot_at = len(contexts), common.hot_at(contexts)
        self.seen = self.count > 0
        self.many = np.flatnonzero(self.count > 1)
        self.hot = len(common.hot)

    def per_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, weights=values, minlength=len(self.words)).astype(np.int64)

    def per_room(self, values: np.ndarray, hot: np.ndarray | None = None) -> np.ndarray:
        """Sums of pairs' values by restaurant; those of restaurants that are in several buckets are told by hot."""
        out = np.bincount(self.room, weights=values, minlength=self.rooms)
        return out if hot is None or not self.hot else np.where(self.hot_at >= 0, hot[self.hot_at], out)

    def hot_sums(self, values: np.ndarray) -> np.ndarray:
        """This bucket's part of the sums of hot restaurants."""
        at = self.hot_at >= 0
        return np.bincount(self.hot_at[at], weights=self.per_room(values)[at], minlength=self.hot)

    def tables(self, many: np.ndarray) -> np.ndarray:
        """Tables of each pair: one where it is seen, `many` where it is seen more than once."""
        t = self.seen.astype(np.int64)
        t[self.many] = many
        return t


def log_stirling(most: int, discount: float) -> np.ndarray:
    """log S(c, t) of generalised Stirling numbers for 0 <= t, c <= most; S(c + 1, t) = S(c, t - 1) + (c - discount t) S(c, t)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(1, most + 1)
    for c in range(most):
        stay = np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)) + out[c, 1:], -np.inf)
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay)
    return out


def draw_tables(count: np.ndarray, a: np.ndarray, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """t of each dish with probability in proportion to S(count, t) a**t, for counts that the Stirling numbers cover."""
    out = np.ones(len(count), dtype=np.int64)
    order = np.argsort(count, kind="stable")
    cuts = np.flatnonzero(np.diff(count[order], prepend=-1, append=-2))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        c = count[order[lo]]
        for at in np.array_split(order[lo:hi], -(-(hi - lo) * c // 1_000_000)) if c > 1 else []:
            weight = stirling[c, 1 : c + 1] + np.log(a[at])[:, None] * np.arange(1, c + 1)
            total = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[at] = 1 + (total < (rng.random(len(at)) * total[:, -1])[:, None]).sum(axis=1)
    return out


@dataclass
class Path:
    """How dishes, the most customers first, came to their tables: in each step the customers before it, those it seats, and the tables."""

    steps: list[tuple[float, np.ndarray, np.ndarray]]
    tables: np.ndarray

    def log_weight(self, a: np.ndarray, discount: float) -> np.ndarray:
        out = np.zeros(len(self.tables))
        for n, own, t in self.steps:
            out[: len(t)] += own * np.log(a[: len(t)] + n - discount * t)
        return out

    def replaced(self, other: Path, take: np.ndarray) -> Path:
        steps = [(n, own, np.where(take[: len(t)], u, t)) for (n, own, t), (_, _, u) in zip(self.steps, other.steps, strict=True)]
        return Path(steps, np.where(take, other.tables, self.tables))


def seated(count: np.ndarray, a: np.ndarray, discount: float, rng: np.random.Generator) -> Path:
    """Seats the customers of dishes, in falling order of count, one after another: a new table has chance a to n - discount t."""
    t, n, steps = np.ones(len(count)), 1.0, []
    while live := int(np.searchsorted(-count, -n)):
        step = 1.0 if n < ONE_BY_ONE else math.ceil(n / 64)
        own, now = np.minimum(step, count[:live] - n), t[:live].copy()
        chance = a[:live] / (a[:live] + n - discount * now)
        t[:live] += rng.random(live) < chance if step == 1 else rng.binomial(own.astype(np.int64), chance)
        steps.append((n, own, now))
        n += step
    return Path(steps, t)


def gibbs(count: np.ndarray, base: np.ndarray, discount: float, x_of: Callable[[np.ndarray], np.ndarray], sweeps: int, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after so many sweeps. x_of: tables -> x of each dish's restaurant. base: chances in the parent."""
    t = np.ones(len(count), dtype=np.int64)
    few, large = np.flatnonzero(count <= EXACT), np.flatnonzero(count > EXACT)
    large = large[np.argsort(-count[large], kind="stable")]
    stirling, path = log_stirling(EXACT, discount), None
    for _ in range(sweeps):
        a = np.maximum(discount * x_of(t) * base, 1e-300)
        t[few] = draw_tables(count[few], a[few], stirling, rng)
        if len(large):
            new = seated(count[large], a[large], discount, rng)
            if path is not None:
                new = path.replaced(new, np.log(rng.random(len(large))) < new.log_weight(a[large], discount) - path.log_weight(a[large], discount))
            path = new
            t[large] = path.tables
    return t


def predictive(count, tables, room_count, room_tables, above, strength: float, discount: float) -> np.ndarray:
    """A dish's chance in a restaurant with its customers and tables, where above is its chance in the parent."""
    spare = (strength + discount * room_tables) / (strength + room_count)
    return np.where(room_count == 0, above, (count - discount * tables) / (strength + room_count) + spare * above)


@dataclass
class Parent:
    """The parent restaurant: known words, training tokens, customers, tables, discounts of both levels; totals of hot contexts."""

    words: int
    tokens: int
    customers: float
    tables: float
    discount: float
    parent_discount: float
    hot_count: np.ndarray = field(default_factory=lambda: np.zeros(0))
    hot_tables: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def probability(self, customers: np.ndarray, tables: np.ndarray, strength: float) -> np.ndarray:
        own = np.maximum(customers - self.parent_discount * tables, 0)
        return (own + (strength + self.parent_discount * self.tables) / (self.words + 1)) / (strength + self.customers)


def _cells(words: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    cuts = np.searchsorted(place_of(words, shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        yield int(s), slice(cuts[s], cuts[s + 1])


def _message(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "shard", "kind", "body"])


#: Kinds of messages: a bucket's request to a shard; a shard's answers for a sample; a bucket's tables for a sample.
REQUEST, ANSWER, STATE = 0, 100, 200


def _sums(messages: DataFrame) -> np.ndarray:
    """Bodies of numbers, added up: in at most 32 tasks, whose sums are added here."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"body": [pack(np.sum([unpack(b, "f8")[0] for b in pdf["body"]], axis=0), kinds="f8")]})

    parts = messages.groupBy(F.pmod(F.col("bucket") + F.col("shard"), F.lit(32))).applyInPandas(add, "body binary").collect()
    return np.sum([unpack(p.body, "f8")[0] for p in parts], axis=0) if parts else np.zeros(0)


def _requests(shards: int, shared):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b, at = Bucket(pdf, shared.value), int(pdf["bucket"].iloc[0])
        c, types = b.per_word(b.count), b.per_word(b.seen)
        rows = [(at, s, REQUEST, pack(*shared.value.codes(b.words[x]), c[x], types[x], kinds="+u4 +u8 u4 u4")) for s, x in _cells(b.words, shards)]
        totals = np.concatenate([[(b.count == 1).sum(), (b.count == 2).sum()], b.hot_sums(b.count), b.hot_sums(b.seen)])
        return _message([*rows, (at, -1, REQUEST, pack(totals, kinds="f8"))])

    return run


def _shard_words(pdf: pd.DataFrame, common: Common) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]:
    """Of a shard's requests: (bucket, places of its words) in turn, and each word's count and contexts."""
    told = []
    for b, body in pdf.sort_values("bucket")[["bucket", "body"]].itertuples(index=False):
        codes, rest, count, types = unpack(body, "+u4 +u8 u4 u4")
        told.append((int(b), common.hashes(codes, rest), count, types))
    words, at = np.unique(np.concatenate([x[1] for x in told]), return_inverse=True)
    count = np.bincount(at, weights=np.concatenate([x[2] for x in told]), minlength=len(words))
    types = np.bincount(at, weights=np.concatenate([x[3] for x in told]), minlength=len(words))
    cuts = np.cumsum([0, *(len(x[1]) for x in told)])
    return [(x[0], at[cuts[k] : cuts[k + 1]]) for k, x in enumerate(told)], count, types


def _shard_totals(shared):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, count, types = _shard_words(pdf, shared.value)
        return pd.DataFrame({"words": [int((count > 0).sum())], "tokens": [int(count.sum())], "customers": [int(types.sum())], "ones": [int((types == 1).sum())], "twos": [int((types == 2).sum())]})

    return run


def _answers(parent: Parent, s: Settings, sample: int, shared):
    """Seats the parent's customers, `types` and the further tables that buckets told, and answers each bucket."""
    drawn = np.random.default_rng([sample, 1]).gamma(s.parent_strength / parent.parent_discount + parent.tables)

    def run(key: tuple, requests: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        if not len(requests) or key[0] < 0:
            return _message([])
        cells, count, types = _shard_words(requests, shared.value)
        extra = {int(b): body for b, body in more[["bucket", "body"]].itertuples(index=False)}
        customers = types.copy()
        for b, at in cells:
            if b in extra:
                which, n = unpack(extra[b], "u4 u4")
                customers[at[which]] += n
        t = (customers > 0).astype(np.int64)
        many = np.flatnonzero(customers > 1)
        rng = np.random.default_rng([sample, 2, int(key[0])])
        base = np.full(len(many), 1 / (parent.words + 1))
        t[many] = gibbs(customers[many].astype(np.int64), base, parent.parent_discount, lambda t: np.full(len(t), drawn), s.sweeps, rng)
        told = (customers, t) if sample else (customers, t, count)
        rows = [(b, int(key[0]), ANSWER + sample, pack(*[x[at] for x in told], kinds="u4 u4 u4"[: 3 * len(told) - 1])) for b, at in cells]
        return _message([*rows, (-1, int(key[0]), ANSWER + sample, pack(np.array([customers.sum(), t.sum()]), kinds="f8"))])

    return run


def _told(messages: pd.DataFrame, sample: int) -> list[np.ndarray]:
    """(customers, tables) in the parent of each of a bucket's words, by a sample's answers; of sample 0 their counts, too."""
    own = messages[messages["kind"] == ANSWER + sample].sort_values("shard")
    got = [unpack(body, "u4 u4" if sample else "u4 u4 u4") for body in own["body"]]
    return [np.concatenate(x).astype(float) for x in zip(*got, strict=True)]


def _seatings(parent: Parent, s: Settings, sample: int, shards: int, shared):
    """Samples the tables of a bucket's restaurants, and tells shards which words have how many more than one a pair."""
    d = parent.discount
    hot_x = np.random.default_rng([sample, 3]).gamma(s.strength / d + parent.hot_tables)

    def run(key: tuple, bodies: pd.DataFrame, messages: pd.DataFrame) -> pd.DataFrame:
        if not len(bodies):
            return _message([])
        b, at = Bucket(bodies, shared.value), int(key[0])
        customers, tables, *_ = _told(messages, sample - 1)
        base = parent.probability(customers, tables, s.parent_strength)[b.word[b.many]]
        rng = np.random.default_rng([sample, 4, at])

        def x_of(t: np.ndarray) -> np.ndarray:
            x = rng.gamma(s.strength / d + b.per_room(b.tables(t)))
            return (np.where(b.hot_at >= 0, hot_x[b.hot_at], x) if b.hot else x)[b.room[b.many]]

        t = gibbs(b.count[b.many], base, d, x_of, s.sweeps, rng)
        every = b.tables(t)
        rows = [(at, -1, STATE + sample, pack(t, kinds="u4")), (at, -2, STATE + sample, pack(b.hot_sums(every), kinds="f8"))]
        more = b.per_word(every - b.seen)
        for shard, x in _cells(b.words, shards):
            which = np.flatnonzero(more[x])
            if len(which):
                rows.append((at, shard, STATE + sample, pack(which, more[x][which], kinds="u4 u4")))
        return _message(rows)

    return run


def _scores(parents: list[Parent], s: Settings, shared):
    """For each batch that asked: log10 of the averaged probability of each of its pairs, and the word's count in training."""

    def run(key: tuple, bodies: pd.DataFrame, messages: pd.DataFrame) -> pd.DataFrame:
        if not len(bodies):
            return pd.DataFrame({"bucket": [], "part": [], "body": []})
        b, mean = Bucket(bodies, shared.value), 0.0
        count = _told(messages, 0)[2]
        for k, parent in enumerate(parents, 1):
            customers, tables = _told(messages, k)
            state = messages[(messages["kind"] == STATE + k) & (messages["shard"] == -1)]["body"].iloc[0]
            t = b.tables(unpack(state, "u4")[0])
            above = parent.probability(customers, tables, s.parent_strength)[b.word]
            rooms = b.per_room(b.count, parent.hot_count)[b.room], b.per_room(t, parent.hot_tables)[b.room]
            mean = mean + predictive(b.count, t, *rooms, above, s.strength, parent.discount)
        score, plain = np.rint(-np.log10(mean / len(parents)) * STEPS).astype(np.uint32), count[b.word].astype(np.uint32)
        cuts = np.cumsum([0, *b.sizes])
        rows = [(-1 - batch, int(key[0]), pack(score[p := b.pair[lo:hi]], plain[p], kinds="u4 u4")) for batch, lo, hi in zip(b.batches, cuts, cuts[1:], strict=False)]
        return pd.DataFrame(rows, columns=["bucket", "part", "body"])

    return run


RESULT = "id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _by_document(words: int, tokens: int):
    def run(key: tuple, docs: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({c.split()[0]: [] for c in RESULT.split(", ")})
        ids, info, n, lists = unpack(docs["body"].iloc[0], "i8 u1 u4 u4")
        told = [unpack(body, "u4 u4") for body in parts.sort_values("part")["body"]]
        score, count = (np.concatenate([x[k] for x in told]) for k in (0, 1))
        plain = np.log10(count + 0.5)
        ends = np.cumsum(n, dtype=np.int64)
        starts = ends - n
        steps = np.cumsum(lists, dtype=np.int64)
        pair = steps - np.repeat(steps[starts] - lists[starts], n)
        sums = [np.add.reduceat(x[pair].astype(float), starts) for x in (score, plain, count > 0)]
        base = sums[1] - n * math.log10(tokens + 0.5 * (words + 1))
        out = pd.DataFrame({"id": pd.array(ids, dtype="Int64"), "train": info % 2 > 0, "n_tokens": n.astype(np.int64), "n_known": sums[2].astype(np.int64), "base_score": base, "score": -sums[0] / STEPS})
        out.loc[info > 1, "id"] = pd.NA
        return out

    return run


def _bucketed(df: DataFrame, by: str, parts: int, label: str) -> tuple[DataFrame, str]:
    """df as a table bucketed by a column, in the shared folder, a file for each bucket: tasks find its rows without a shuffle."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    dealt = df.repartition(parts, by)
    dealt.write.bucketBy(parts, by).option("path", scratch(spark, label)).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name), name


def _discount(ones: float, twos: float) -> float:
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5


def scored_documents(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Scores every whole text by the model learnt from the rows where the condition `train` holds.

    Returns (id, train, n_tokens, n_known, base_score, score, train_tokens, vocabulary): n_known tokens stand in training;
    base_score is the add-0.5 unigram log10 probability over the known words and one unknown, score the model's. Perplexity
    of a set of rows is 10 ** (-sum(score) / sum(n_tokens)). n_known and base_score are exact (words are told apart by hashes of
    64 bits); score is within 5e-7 a token of the model's.

    Null and empty texts are an end alone. Rows are scored one by one: repeated rows come back repeated, a row without an id
    keeps its null. A null condition is not training. Nothing to learn from leaves uniform probabilities. The seating is
    seeded by bucket and shard, whose numbers follow from the length of all texts: a result does not depend on the cluster.
    """
    spark: SparkSession = docs.sparkSession
    s = settings
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(f"`{text_col}`").alias("text"))
    size = base.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / 6 / s.bucket_tokens))
    shards = max(1, math.ceil(buckets / 4))
    shared = spark.sparkContext.broadcast(common_words(base, buckets))
    hot = len(shared.value.hot)
    tokens, token_name = _bucketed(base.mapInPandas(_entries(buckets, shared), "bucket long, batch long, kind int, body binary"), "bucket", buckets, "tokens")
    own = tokens.filter("kind = 0")
    requests, request_name = _bucketed(own.groupBy("bucket").applyInPandas(_requests(shards, shared), MESSAGE), "shard", shards, "requests")
    asked = requests.filter("shard >= 0")
    totals = asked.groupBy("shard").applyInPandas(_shard_totals(shared), "words long, tokens long, customers long, ones long, twos long").agg(*[F.sum(c) for c in ("words", "tokens", "customers", "ones", "twos")]).first()
    words, train_tokens, customers, ones, twos = (x or 0 for x in totals)
    told = _sums(requests.filter("shard < 0"))
    told = told if len(told) else np.zeros(2 + 2 * hot)
    parent = Parent(words, train_tokens, customers, words, _discount(*told[:2]), _discount(ones, twos), told[2 : 2 + hot], told[2 + hot :])
    parents, messages, more = [], None, None
    for sample in range(s.samples + 1):
        hot_tables = parent.hot_tables
        if sample:
            state = own.groupBy("bucket").cogroup(messages.filter(F.col("kind") == ANSWER + sample - 1).groupBy("bucket")).applyInPandas(_seatings(parent, s, sample, shards, shared), MESSAGE)
            state = written(state, "seatings")
            messages, more = messages.unionByName(state.filter("shard = -1")), state.filter("shard >= 0")
            hot_tables = _sums(state.filter("shard = -2")) if hot else hot_tables
        else:
            more = asked.limit(0)
        answers = written(asked.groupBy("shard").cogroup(more.groupBy("shard")).applyInPandas(_answers(parent, s, sample, shared), MESSAGE), "answers")
        sums = _sums(answers.filter("bucket < 0"))
        sums = sums if len(sums) else np.zeros(2)
        parent = Parent(words, train_tokens, float(sums[0]), float(sums[1]), parent.discount, parent.parent_discount, parent.hot_count, hot_tables)
        answers = answers.filter("bucket >= 0")
        messages = answers if messages is None else messages.unionByName(answers)
        if sample:
            parents.append(parent)
    partial = own.groupBy("bucket").cogroup(messages.groupBy("bucket")).applyInPandas(_scores(parents, s, shared), "bucket long, part long, body binary")
    lists = tokens.filter("kind = 1")
    out = lists.groupBy("bucket").cogroup(partial.groupBy("bucket")).applyInPandas(_by_document(words, train_tokens), RESULT)
    out = written(out, "scores").withColumns({"train_tokens": F.lit(train_tokens).cast("long"), "vocabulary": F.lit(words).cast("long")})
    for name in (token_name, request_name):
        spark.sql(f"DROP TABLE {name}")
    return out

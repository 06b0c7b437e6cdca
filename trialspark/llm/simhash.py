"""SimHash near-dedup over vantage-point trees.

Fingerprints are partitioned by Hamming distance to vantage points. A node with vantage v and radius m sends a point p
inside if d(p, v) <= m + r and outside if d(p, v) > m: by the triangle bound two points within r of each other are
together in one of the two. So each leaf shard, with the points that overlap its boundary, answers its pairs alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from trialspark.llm.common import join_counted, least_hashed, release, written
from trialspark.llm.graph import components

#: Of a point set, this share is in either half of a node at radius 2; a shard holds about so many points; levels of the
#: shared tree at most (below them, a shard's own tree goes on); points of the tree's sample for each shard.
HALF, SHARD, MOST_LEVELS, SAMPLE = 0.6, 4096, 16, 8
#: Points that go down the shared tree at once: many more than it has leaves.
PLACED = 100_000
#: Points of a leaf of the shared tree that is cut by a tree of its own, and levels of that.
LARGE_LEAF, MORE_LEVELS = 1 << 20, 12
#: Shingles of a slice of a block whose members are all compared, each member counted as 64 more.
SLICE = 1_000_000
#: Bytes of a shingle's hash in the sets that are compared: two different shingles of a pair of texts of 1000 words agree in
#: 48 bits about once in 300 million pairs, and then move its similarity by a thousandth.
SET_BYTES = 6


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words, A-Z in lower case, repeats included; of all words if fewer; none if none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) <= words:
        runs = [b" ".join(w)] if w else []
    else:
        runs = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in runs), dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_column(text, words: int = 3):
    @pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([majority(shingle_hashes(t, words)) for t in texts], dtype=np.uint64).view(np.int64))

    return fingerprint(text)


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantageTree:
    """Nodes (vantage, radius, inside, outside); a negative child -k - 1 is leaf k."""

    def __init__(self, sample: np.ndarray, radius: int, levels: int):
        self.reach, self.nodes, self.leaves = radius, [], 0
        self.root = self._grow(np.unique(sample), levels)

    def _grow(self, points: np.ndarray, levels: int) -> int:
        if levels and len(points) >= 16:
            vantage = points[len(points) // 2]
            d = distance(points, vantage)
            split = int(np.median(d))
            inside, outside = points[d <= split + self.reach], points[d > split]
            if max(len(inside), len(outside)) < 0.9 * len(points):
                at = len(self.nodes)
                self.nodes.append(None)
                self.nodes[at] = (vantage, split, self._grow(inside, levels - 1), self._grow(outside, levels - 1))
                return at
        self.leaves += 1
        return -self.leaves

    def shards(self, points: np.ndarray, at: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        at = self.root if at is None else at
        if at < 0:
            yield -at - 1, points
        elif len(points):
            vantage, split, inside, outside = self.nodes[at]
            d = distance(points, vantage)
            yield from self.shards(points[d <= split + self.reach], inside)
            yield from self.shards(points[d > split], outside)


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of i and j in label, where each class is named by its least index."""
    while len(i):
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while (nxt := label[label]).tobytes() != label.tobytes():
            label[:] = nxt
        left = label[i] != label[j]
        i, j = i[left], j[left]


def local_classes(points: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct points, the least index that chains of steps of at most radius reach."""
    label = np.arange(len(points))

    def visit(own: np.ndarray) -> None:
        if len(own) > 256:
            d = distance(points[own], points[own[len(own) // 2]])
            split = int(np.median(d))
            inside, outside = own[d <= split + radius], own[d > split]
            if max(len(inside), len(outside)) < 0.9 * len(own):
                visit(inside)
                visit(outside)
                return
        step = max(1, 2_000_000 // max(1, len(own)))
        for at in range(0, len(own), step):
            rest = own[at:]
            i, j = np.nonzero(distance(points[own[at : at + step], None], points[rest][None, :]) <= radius)
            _merge(label, own[at : at + step][i[i < j]], rest[j[i < j]])

    visit(label.copy())
    return label


def linked(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct longs (fp) -> (node, root) for those that chains of steps of at most `radius` bits join to others.

    The shared tree's vantage points come from a bounded sample, SAMPLE fingerprints for a leaf and 2**19 at most, the
    least by hash; every fingerprint is indexed. Leaves of over LARGE_LEAF points are cut by trees of their own (_deeper), so
    that shards stay small however many fingerprints there are. A shard emits a spanning star for each of its classes, never
    all its pairs.
    """
    spark = prints.sparkSession
    n = prints.count()
    levels = max(0, min(MOST_LEVELS, math.ceil(math.log(max(n, 1) / SHARD) / math.log(1 / HALF))))
    sample = least_hashed(prints, SAMPLE << levels, n, "fp").toPandas()["fp"] if levels else []
    tree = spark.sparkContext.broadcast(VantageTree(np.array(sample, dtype=np.int64).view(np.uint64), radius, levels))

    def placed(points: np.ndarray) -> pd.DataFrame:
        found = [(leaf, own) for leaf, own in tree.value.shards(points) if len(own)]
        leaves = np.repeat([leaf for leaf, _ in found], [len(own) for _, own in found])
        return pd.DataFrame({"leaf": leaves, "fp": np.concatenate([own for _, own in found]).view(np.int64)})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for pdf in batches:
            held.append(pdf["fp"].to_numpy(np.int64).view(np.uint64))
            if sum(map(len, held)) >= PLACED:
                yield placed(np.concatenate(held))
                held = []
        if sum(map(len, held)):
            yield placed(np.concatenate(held))

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.sort(pdf["fp"].to_numpy(np.int64)).view(np.uint64)
        label = local_classes(points, radius)
        mine = np.flatnonzero(label != np.arange(len(points)))
        return pd.DataFrame({"a": points[mine].view(np.int64), "b": points[label[mine]].view(np.int64)})

    leaves = prints.mapInPandas(place, "leaf long, fp long")
    if n <= LARGE_LEAF:
        return components(leaves.groupBy("leaf").applyInPandas(pairs, "a long, b long"))
    leaves = _deeper(written(leaves, "vantage-leaves"), radius)
    found = components(leaves.groupBy("leaf").applyInPandas(pairs, "a long, b long"))
    release(leaves)
    return found


def _deeper(leaves: DataFrame, radius: int) -> DataFrame:
    """(leaf, fp) with each leaf of over LARGE_LEAF points cut by a vantage-point tree of about 4096 of its own points.

    Points of such a leaf are dealt to slices, each of which gets the leaf's sample and so builds the same tree. Rounds go on
    until no leaf is large, but for those that triangle bounds don't split: they are left as they are, under a negative number.
    """
    while True:
        sizes = leaves.groupBy("leaf").agg(F.count("*").alias("n")).filter((F.col("n") > LARGE_LEAF) & (F.col("leaf") >= 0))
        sizes = written(sizes.withColumn("slices", F.ceil(F.col("n") / LARGE_LEAF).cast("long")), "large-leaves")
        if not sizes.limit(1).count():
            release(sizes)
            return leaves
        own = written(join_counted(leaves, sizes, ["leaf"], "n"), "large-leaf-points")
        sample = own.filter(F.pmod(F.xxhash64("fp", "leaf"), F.col("n")) < 4096)
        sample = sample.select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "fp")
        dealt = own.select("leaf", F.pmod(F.xxhash64("fp"), F.col("slices")).alias("slice"), "fp")

        def cut(key: tuple, points: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
            tree = VantageTree(some["fp"].to_numpy(np.int64).view(np.uint64), radius, MORE_LEVELS)
            fps = points["fp"].to_numpy(np.int64).view(np.uint64)
            found = [(k, x) for k, x in tree.shards(fps) if len(x)]
            name = lambda k: key[0] * (1 << MORE_LEVELS) + k if tree.leaves > 1 else -1 - key[0]
            return pd.DataFrame({"leaf": np.repeat([name(k) for k, _ in found], [len(x) for _, x in found]), "fp": np.concatenate([x for _, x in found] or [fps]).view(np.int64)})

        parts = dealt.groupBy("leaf", "slice").cogroup(sample.groupBy("leaf", "slice")).applyInPandas(cut, "leaf long, fp long")
        # Leaves that stay small are told apart from parts of large ones by their place below the next level's numbers.
        small = leaves.join(F.broadcast(sizes.select("leaf")), "leaf", "left_anti")
        small = small.withColumn("leaf", F.when(F.col("leaf") >= 0, -1 - F.col("leaf")).otherwise(F.col("leaf")))
        cut_leaves = written(small.unionByName(parts), "vantage-leaves")
        release(leaves, own, sizes)
        leaves = cut_leaves


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component): each text's SimHash and the smallest id that links of at most `radius` differing bits reach.

    Null and empty texts have fingerprint zero, and link like any other. Repeated rows come back repeated. A row without an
    id takes part and gets its component, which is null only if no row of it has an id. No rows in, no rows out.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), fingerprint_column(F.col(f"`{text_col}`"), words).alias("fp"))
    base = written(base, "simhash")
    classes = written(base.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    roots = linked(classes.select("fp"), radius).withColumnRenamed("node", "fp")
    known = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = written(known, "simhash-roots")
    least = known.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("members"))
    named = join_counted(known, least, ["root"], "members").select("fp", "component", "n")
    return join_counted(base, written(named, "simhash-named"), ["fp"], "n").select("id", "fp", "component")


def _picks(words: int, tables: int, picks: int):
    odd = np.random.default_rng(7).integers(0, 2**63, tables, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, prints, sizes = [], [], []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                h = np.unique(shingle_hashes(text, words))
                if not len(h):
                    found = {0}
                elif len(h) <= picks:
                    found = {majority(h)}
                else:
                    found = set()
                    for some in [odd] if len(h) <= 100_000 else np.split(odd, len(odd)):
                        mixed = h * some[:, None]
                        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                        first = h[np.argpartition(mixed, picks - 1, axis=1)[:, :picks]]
                        if picks == 3:
                            a, b, c = first.T
                            found.update((a & b | a & c | b & c).tolist())
                        else:
                            found.update(majority(row) for row in first)
                ids += [i] * len(found)
                prints += found
                sizes += [len(h)] * len(found)
            yield pd.DataFrame({"id": np.array(ids, dtype=np.int64), "size": np.array(sizes, dtype=np.int64), "fp": np.array(prints, dtype=np.uint64).view(np.int64)})

    return run


def _word_key(text):
    @pandas_udf("h1 long, h2 long")
    def key(texts: pd.Series) -> pd.DataFrame:
        raw = b"".join(xxhash.xxh3_128_digest(b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split())) for t in texts)
        h = np.frombuffer(raw, dtype="<i8").reshape(-1, 2)
        return pd.DataFrame({"h1": h[:, 0], "h2": h[:, 1]})

    return key(text)


def _shingle_sets(words: int):
    @pandas_udf("binary")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([packed_set(shingle_hashes(t, words)) for t in texts])

    return sets


def packed_set(hashes: np.ndarray) -> bytes:
    """The distinct hashes in order, of each the upper SET_BYTES bytes."""
    upper = np.unique(hashes >> np.uint64(64 - 8 * SET_BYTES))
    return upper.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes()


def unpacked_set(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // SET_BYTES, 8), dtype=np.uint8)
    out[:, :SET_BYTES] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, SET_BYTES)
    return out.reshape(-1).view("<i8")


def _jaccard(a: str, b: str):
    @pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(map(unpacked_set, a), map(unpacked_set, b), strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(1, len(x) + len(y) - both))
        return pd.Series(out, dtype="float64")

    return similarity(a, b)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, tables: int = 8, picks: int = 3, radius: int = 2) -> DataFrame:
    """(id, component): documents of one component are equal word for word or joined by links of Jaccard similarity >= `similarity`.

    A whole text's 64-bit SimHash at 0.8 similarity lies about 8 bits off, too far for triangle bounds to prune. So each
    distinct text gives `tables` SimHashes, each of the `picks` of its word shingles that come first in one of as many
    random orders: they agree with chance similarity**picks each. Fingerprints that a vantage-point tree links form a
    block; every text of it is compared with the block's first text and with the one before it, by the similarity of whole
    shingle sets (SET_BYTES of each hash), unless the sets' sizes alone rule it out. Where that leaves a block in several
    components, all its texts of different components are compared as well (`_finished`), so that no link inside a block
    is lost. What this may lose: two alike texts that agree in no table (0.3 % at 0.8 with the defaults).

    Ids must be unique and not null here. Null and empty texts are equal to each other.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("id IS NOT NULL")
    keyed = written(base.select("id", _word_key(F.col("text")).alias("k")).select("id", "k.*"), "word-keys")
    same = written(keyed.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")), "word-classes")
    firsts = same.select(F.col("first").alias("id"))
    prints = base.mapInPandas(_picks(words, tables, picks), "id long, size long, fp long").join(firsts, "id", "left_semi")
    prints = written(prints, "picked")
    counts = written(prints.groupBy("fp").agg(F.count("*").alias("n")), "picked-classes")
    roots = linked(counts.select("fp"), radius).withColumnRenamed("node", "fp")
    named = counts.join(roots, "fp", "left").withColumn("block", F.coalesce("root", "fp")).drop("root")
    named = written(named, "picked-blocks")
    shared = named.groupBy("block").agg(F.sum("n").alias("all")).filter("all > 1").select("block")
    member = join_counted(prints, named.join(shared, "block", "left_semi"), ["fp"], "n").select("block", "id", "size").distinct()
    every = written(member, "block-members")
    member = written(_with_rivals(every.withColumn("comp", F.col("id")), similarity).drop("comp"), "members-with-rivals")
    release(prints, counts, named, every)
    pairs = written(_spanning_pairs(member, similarity), "near-pairs")
    wanted = member.select("id").distinct()
    sets = written(base.join(wanted, "id", "left_semi").select("id", _shingle_sets(words)("text").alias("s")), "shingle-sets")
    weight = pairs.groupBy("a").agg(F.count("*").alias("n"))
    left = weight.join(sets.withColumnsRenamed({"id": "a", "s": "sa"}), "a")
    alike = join_counted(pairs, left, ["a"], "n").join(sets.withColumnsRenamed({"id": "b", "s": "sb"}), "b")
    alike = written(alike.filter(_jaccard("sa", "sb") >= similarity).select("a", "b"), "alike")
    release(pairs)
    more = _finished(member, sets, components(alike), similarity)
    found = components(alike.unionByName(more)).withColumnsRenamed({"node": "first", "root": "component"})
    release(alike, sets, member)
    classes = same.join(found, "first", "left").withColumn("component", F.coalesce("component", "first"))
    return join_counted(keyed, written(classes, "near-classes"), ["h1", "h2"], "n").select("id", "component")


def _spanning_pairs(member: DataFrame, similarity: float) -> DataFrame:
    """(block, id, size) -> distinct (a, b): each member with its block's least id, and with the id before it.

    The id before it is found among the members of the same slice of a block (a slice: ids that share all but the last
    bits of their hash), so that a large block is many small windows and not one. Pairs of sets of which the smaller has
    under `similarity` of the larger's size can't be alike and are left out.
    """
    least = member.groupBy("block").agg(F.min(F.struct("id", "size")).alias("least"), F.count("*").alias("n"))
    star = join_counted(member, least, ["block"], "n")
    slices = F.when(F.col("n") > 4096, F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / 1024))).otherwise(F.lit(0))
    own = F.struct("id", "size")
    sliced = star.select("block", "id", own.alias("b"), F.col("least").alias("a"), slices.alias("slice"))
    chain = sliced.withColumn("before", F.lag("b").over(Window.partitionBy("block", "slice").orderBy("id")))
    pairs = chain.select("a", "b").union(chain.select("before", "b")).filter("a.id <> b.id")
    fits = F.least("a.size", "b.size") >= similarity * F.greatest("a.size", "b.size") - 1e-9
    return pairs.filter(fits).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def _with_rivals(known: DataFrame, similarity: float) -> DataFrame:
    """Rows of (block, id, size, comp) whose block has a member of another comp of a size that may be alike.

    Sizes are cut into bands, each 1 / similarity times as far as the one before, so that alike sets lie in one band or in
    two that touch. A band's least and greatest comp, with those of the bands beside it, tell whether it has rivals.
    """
    step = max(-math.log(similarity), 1e-3) * 1.000001
    known = known.withColumn("band", F.floor(F.log(F.greatest(F.col("size"), F.lit(1))) / step))
    bands = known.groupBy("block", "band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"))
    bands = written(bands, "size-bands")
    beside = bands.select("block", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"), "low", "high")
    rivals = beside.groupBy("block", "band").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high")
    open_bands = bands.select("block", "band", "n").join(rivals.select("block", "band"), ["block", "band"])
    return join_counted(known, written(open_bands, "open-bands"), ["block", "band"], "n").drop("band", "n")


def _finished(member: DataFrame, sets: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links of blocks' members in different components of found, enough of them to join all that are alike.

    A block goes to one task with the sets of its members that may have likes (_with_rivals); of blocks with the same
    such members one is taken. A block of over SLICE shingles is cut into slices, none of which mixes a component of over
    SLICE with others, and each two slices go to a task, but for two of one component. So every two members in different
    components that may be alike meet, whatever the block's size.
    """
    known = member.join(found.withColumnsRenamed({"node": "id", "root": "comp"}), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    known = written(_with_rivals(written(known, "block-components"), similarity).withColumn("w", F.col("size") + 64), "rivals")
    alike = F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark")
    blocks = known.groupBy("block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"), alike, F.min("id").alias("least"), F.max("id").alias("most"))
    blocks = written(blocks.filter("low < high").groupBy("n", "mark", "least", "most").agg(F.min("block").alias("block")).select("block", "n"), "open-blocks")
    own = written(join_counted(known, blocks, ["block"], "n").drop("n"), "open-members")
    parts = own.groupBy("block", "comp").agg(F.sum("w").alias("cw"), F.count("*").alias("cn"))
    parts = parts.withColumn("large", F.when(F.col("cw") > SLICE, F.col("comp")))
    small = parts.filter("large IS NULL").groupBy("block").agg(F.ceil(F.sum("cw") / SLICE).alias("smalls"))
    parts = written(parts.join(small, "block", "left"), "block-parts")
    slices = F.when(F.col("large").isNull(), F.pmod(F.xxhash64("comp"), "smalls")).otherwise(F.pmod(F.xxhash64("id"), F.ceil(F.col("cw") / SLICE)))
    sliced = join_counted(own, parts, ["block", "comp"], "cn").select("block", "id", "comp", "large", slices.alias("k"))
    sliced = written(sliced, "block-slices")
    every = sliced.groupBy("block", "large", "k").agg(F.count("*").alias("members"))
    every = every.select("block", F.struct("large", "k").alias("p"), F.count("*").over(Window.partitionBy("block")).alias("slices"))
    every = written(every, "slices")
    one, two = every.select("block", F.col("p").alias("p"), "slices"), every.select("block", F.col("p").alias("q"))
    met = one.join(two, "block").filter("slices = 1 OR (p < q AND NOT (p.large IS NOT NULL AND p.large <=> q.large))")
    met = met.select("block", F.xxhash64("block", "p", "q").alias("task"), F.array_distinct(F.array("p", "q")).alias("of"))
    sent = met.select("block", "task", F.explode("of").alias("p")).select("block", "task", "p.large", "p.k")
    at = (sliced["block"] == sent["block"]) & sliced["large"].eqNullSafe(sent["large"]) & (sliced["k"] == sent["k"])
    dealt = sliced.join(sent, at).select(sliced["block"], "task", "id", "comp").join(sets, "id")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(cross_links(pdf["id"].to_numpy(np.int64), pdf["comp"].to_numpy(np.int64), [unpacked_set(x) for x in pdf["s"]], similarity), columns=["a", "b"], dtype="int64")

    return dealt.groupBy("block", "task").applyInPandas(links, "a long, b long")


def cross_links(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of sets of at least this similarity that join all classes which such links join; members of one comp are one class.

    A member is compared with all others by the postings of its elements. Those with the commonest elements go first, as
    they have the most likes; then all outside the then largest class, for each two classes have one that is outside.
    """
    order = np.argsort(ids)
    ids, comps, sets = ids[order], comps[order], [np.asarray(sets[k], dtype=np.int64) for k in order]
    label = np.unique(comps, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(len(sets)), sizes)
    ends = np.cumsum(sizes)
    by_element = np.argsort(element, kind="stable")
    holders, often = holder[by_element], np.bincount(element)
    begin = np.cumsum(often) - often
    out: list[tuple[int, int]] = []

    def compare(k: int) -> None:
        mine = element[ends[k] - sizes[k] : ends[k]]
        n, starts = often[mine], begin[mine]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
        both = np.bincount(holders[place], minlength=len(sets))
        like = np.flatnonzero((both >= similarity * (sizes + sizes[k] - both)) & (label != label[k]))
        for j in like:
            if label[j] != label[k]:
                out.append((int(ids[k]), int(ids[j])))
                label[label == label[j]] = label[k]

    central = np.bincount(holder, often[element], minlength=len(sets)) / np.maximum(sizes, 1)
    first = np.argsort(-central, kind="stable")[:8]
    for k in first:
        compare(k)
    rest = np.flatnonzero(label != np.bincount(label).argmax())
    for k in np.setdiff1d(rest, first):
        if (label == label[0]).all():
            break
        compare(k)
    return out

"""Homomorphic multiset hash: wide vectors hashed from paragraphs, summed modulo powers of two. DataFrame functions only.

A text is the multiset of its paragraphs (its lines). A paragraph's vector has three parts, all of longs:

* identity: IDENTITY 64-bit hashes of the whole paragraph, summed modulo 2**64. Equal multisets have equal sums, in any
  order of paragraphs; unequal ones differ but for chance, unless someone builds a collision on purpose.
* a count of the paragraph's phrases, summed modulo 2**64. A phrase ends where white space follows a word that ends in one
  of a few letters or signs, two or three words on average, so that an edit changes the phrases beside it alone.
* likeness: LANES counts modulo 2**32, two to a long: lane k counts the phrases whose hash has bit k set. Twice a count less
  the number of phrases is a sum of signs, and sums of signs keep angles: the cosine of two texts' sums estimates that of
  their phrase counts.

A sum of vectors is a vector: inserting or deleting paragraphs adds or subtracts their own (added, removed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.common import written

#: Longs of a vector: identity sums, one count of phrases, and LANES // 2 pairs of lanes.
IDENTITY, LANES = 4, 128
WIDTH = IDENTITY + 1 + LANES // 2
LOW = 0xFFFFFFFF
#: Two lanes of a long, 32 bits apart.
PAIR = 1 << 32 | 1
PHRASE_END = "(?<=[eimsyEIMSY.,;:!?])[\\x20\\x09-\\x0D]+"


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW))


def _high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def _whole(high: Column, low: Column) -> Column:
    """high * 2**32 + low modulo 2**64, for non-negative sums of 32-bit halves, without an overflow check."""
    return F.shiftleft(_low(high + _high(low)), 32).bitwiseOR(_low(low))


def _plus(a: Column, b: Column, k: Column) -> Column:
    """Place k of two vectors added: with a carry between the halves of a long, but for pairs of lanes."""
    high, low = _high(a) + _high(b), _low(a) + _low(b)
    return F.when(k <= IDENTITY, _whole(high, low)).otherwise(F.shiftleft(_low(high), 32).bitwiseOR(_low(low)))


def _by_place(a: Column, b: Column, f) -> Column:
    return F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p, k: f(p["x"], p["y"], k))


def added(a: Column, b: Column) -> Column:
    """The vector after b's paragraphs are inserted into a."""
    return _by_place(a, b, _plus)


def removed(a: Column, b: Column) -> Column:
    """The vector after b's paragraphs are deleted from a."""

    def minus(x: Column, y: Column, k: Column) -> Column:
        high, low = _high(F.bitwise_not(y)), _low(F.bitwise_not(y)) + 1
        negative = F.when(k <= IDENTITY, _whole(high, low)).otherwise(F.shiftleft(_low(high + 1), 32).bitwiseOR(_low(low)))
        return _plus(x, negative, k)

    return _by_place(a, b, minus)


def summed(parts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and v0, v1, ...: the vectors of all texts of a key added up, each place a column (the identity's two halves apart).

    Texts are exploded to paragraphs and phrases, which are counted where they are: if parts is partitioned by a key,
    nothing is shuffled. A null text is an empty one, a single empty paragraph.
    """
    lines = parts.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("_line"))
    hashes = [F.xxhash64(F.lit(k), "_line").alias(f"_i{k}") for k in range(IDENTITY)]
    phrases = lines.select(*keys, *hashes, F.posexplode(F.split("_line", PHRASE_END, -1)).alias("_at", "_phrase"))
    phrases = phrases.select(*keys, "_at", *[f"_i{k}" for k in range(IDENTITY)], *[F.xxhash64(F.lit(k), "_phrase").alias(f"_p{k}") for k in range(LANES // 64)])
    once = lambda x: F.sum(F.when(F.col("_at") == 0, x).otherwise(F.lit(0).cast("long")))
    sums = [once(_high(F.col(f"_i{k}"))).alias(f"h{k}") for k in range(IDENTITY)] + [once(_low(F.col(f"_i{k}"))).alias(f"v{k}") for k in range(IDENTITY)]
    sums.append(F.count("*").alias(f"v{IDENTITY}"))
    for k in range(LANES // 2):
        bits = F.shiftrightunsigned(F.col(f"_p{k // 32}"), k % 32).bitwiseAND(F.lit(PAIR))
        sums.append(F.sum(bits).alias(f"v{IDENTITY + 1 + k}"))
    return phrases.groupBy(*keys).agg(*sums)


PLACES = [f"h{k}" for k in range(IDENTITY)] + [f"v{k}" for k in range(WIDTH)]


def as_vector(place) -> Column:
    """array<long>: a vector from the columns that summed() gives, each looked up by its name."""
    return F.array(*[_whole(place(f"h{k}"), place(f"v{k}")) if k < IDENTITY else place(f"v{k}") for k in range(WIDTH)])


def fingerprint_string(vector: Column) -> Column:
    """Hexadecimal, 16 digits for each long."""
    return F.lower(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def signs(vector: Column) -> Column:
    """array<double>: the sums of signs of the lanes, the upper lane of each long before the lower one."""
    pairs = F.slice(vector, IDENTITY + 2, LANES // 2)
    counts = F.flatten(F.transform(pairs, lambda p: F.array(F.shiftright(p, 32), F.shiftright(F.shiftleft(p, 32), 32))))
    return F.transform(counts, lambda c: 2.0 * c - F.element_at(vector, IDENTITY + 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(ab: Column, aa: Column, bb: Column) -> Column:
    """The cosine by these dot products, not under 0, and 0 where one vector is."""
    return F.when((aa == 0) | (bb == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ab / F.sqrt(aa * bb))))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the sums of signs of two vectors, not under 0; 1 where the vectors are the same."""
    x, y = signs(a), signs(b)
    return F.when(a == b, F.lit(1.0)).otherwise(cosine(dot(x, y), dot(x, x), dot(y, y)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, vector, fingerprint) of each id's text; rows that share an id are added up, rows without one left out.

    Null and empty texts are one empty paragraph. Very long texts are exploded by paragraph and phrase, never held as vectors.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).filter("id IS NOT NULL")
    return summed(base, ["id"], "t").select("id", as_vector(F.col).alias("vector")).withColumn("fingerprint", fingerprint_string(F.col("vector")))


#: Ids in one slice of the order of documents.
SLICE = 500_000


def chained(sizes: DataFrame) -> DataFrame:
    """(id, n) with unique ids -> (id, n, next_id, giver_to, give): each id's next one in descending order, in a ring.

    giver_to is the id whose next one this is, give a third of that one's n. The order is cut into ranges of about SLICE
    ids, each a window of its own; a row for each range links them, so no task sees all ids.
    """
    parts = max(1, -(-sizes.count() // SLICE))
    ranged = written(sizes.repartitionByRange(parts, "id").withColumn("p", F.spark_partition_id()), "ranges")
    ends = ranged.groupBy("p").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min_by("n", "id").alias("first_n"))
    order = Window.orderBy("first")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "p",
        F.coalesce(F.lag("last").over(order), F.max("last").over(every)).alias("before"),
        F.coalesce(F.lead("first").over(order), F.min("first").over(every)).alias("after"),
        F.coalesce(F.lead("first_n").over(order), F.first("first_n").over(every)).alias("after_n"),
    )
    own = Window.partitionBy("p").orderBy("id")
    inner = ranged.withColumns({"low": F.lag("id").over(own), "high": F.lead("id").over(own), "high_n": F.lead("n").over(own)})
    third = F.floor(F.coalesce("high_n", "after_n") / 3)
    return inner.join(F.broadcast(ends), "p").select("id", "n", F.coalesce("low", "before").alias("next_id"), F.coalesce("high", "after").alias("giver_to"), third.cast("int").alias("give"))


def edit_study(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each id: its fingerprint, that of its edited text, and their likeness to each other and to the next one.

    The edited text has the last third of the code points (rounded down) replaced by as many first code points of the next
    document in descending order of ids, or by all of it if it is shorter; the least id's next is the greatest. Null texts
    are empty. Where an id repeats, its greatest text stands for it; rows without an id are left out.

    Returns (id, n, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). Texts are shuffled once, by id,
    and a third of them once more, to the document that takes it. The paragraphs before the one that the edit cuts are
    hashed once: their vector is added to that of what follows them in the text, and in the edited text.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).filter("id IS NOT NULL")
    sizes = written(base.select("id", F.length("text").alias("n")), "sizes")
    if sizes.groupBy("id").count().filter("count > 1").limit(1).count():
        base = base.groupBy("id").agg(F.max("text").alias("text"))
        sizes = base.select("id", F.length("text").alias("n"))
    chain = written(chained(sizes), "chain")
    whole = base.join(chain.hint("merge"), "id")
    gifts = whole.select(F.col("giver_to").alias("id"), F.expr("left(text, give)").alias("gift"))
    kept = F.expr("left(text, n - cast(floor(n / 3) AS int))")
    edited = whole.join(gifts.hint("merge"), "id").select("id", "n", "next_id", "text", "gift", kept.alias("kept"))
    edited = edited.select("*", F.sha2(F.concat("kept", "gift").cast("binary"), 256).alias("edited_sha256"), F.substring_index("kept", "\n", -1).alias("cut"))
    before = F.length("kept") - F.length("cut")
    parts = [F.when(before > 0, F.expr("left(kept, length(kept) - length(cut) - 1)")), F.expr("substring(text, length(kept) - length(cut) + 1)"), F.concat("cut", "gift")]
    part = F.explode(F.array(*[F.struct(F.lit(k).alias("which"), p.alias("part")) for k, p in enumerate(parts)]))
    keys = ["id", "n", "next_id", "edited_sha256"]
    sums = summed(edited.select(*keys, part.alias("x")).select(*keys, "x.*").filter("part IS NOT NULL"), [*keys, "which"], "part")
    of = lambda name, but: F.sum(F.when(F.col("which") != but, F.col(name)).otherwise(F.lit(0).cast("long")))
    sums = sums.groupBy(*keys).agg(*[of(c, 2).alias(f"own_{c}") for c in PLACES], *[of(c, 1).alias(f"other_{c}") for c in PLACES])
    vectors = sums.select(*keys, *[as_vector(lambda c, x=x: F.col(f"{x}_{c}")).alias(x) for x in ("own", "other")])
    rows = written(vectors, "vectors")
    near = rows.join(rows.select(F.col("id").alias("next_id"), F.col("own").alias("next")), "next_id")
    near = near.withColumns({"x": signs(F.col("own")), "y": signs(F.col("other")), "z": signs(F.col("next"))})
    near = near.withColumns({a + b: dot(F.col(a), F.col(b)) for a, b in ("xx", "yy", "zz", "xy", "xz")})
    alike = lambda b, ab, bb: F.when(F.col("own") == F.col(b), F.lit(1.0)).otherwise(cosine(F.col(ab), F.col("xx"), F.col(bb)))
    return near.select(
        "id",
        F.col("n").cast("long").alias("n"),
        "edited_sha256",
        fingerprint_string(F.col("own")).alias("fingerprint"),
        fingerprint_string(F.col("other")).alias("edited_fingerprint"),
        alike("other", "xy", "yy").alias("near_edited"),
        alike("next", "xz", "zz").alias("near_next"),
    )

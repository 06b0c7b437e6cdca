"""Embedding near-duplicates by collision counting on sorted one-dimensional projections.

Each of a number of tables has a random direction, along which all vectors are sorted. Two vectors collide in a table if their
places along it lie within a window about either. A pair that collides in enough tables is verified by its cosine. A
window along one direction alone holds a fixed share of all vectors, whose pairs would grow with the square of their
number; so each table is first dealt by the signs of some further directions, more of them for more vectors, and sorted
within. The number of tables follows from the recall asked for at the least similarity: the chance that fewer than the count
of collisions are seen is binomial.

Equal vectors are one class, compared once. A table's sorted classes are cut into tiles; a tile is compared with itself and
with those tiles behind it that its last window reaches. A pair is dealt with in the first table in which it collides only:
all tables' places are worked out from the vectors again, in whole numbers, so that every task gets the same ones. Tasks
return sums of links and a star of each group they find, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from trialspark.llm.common import join_counted, written
from trialspark.llm.graph import components

#: Vectors have so many steps to a unit, directions to a standard deviation: products' sums stay exact in doubles.
VECTOR_STEPS, DIRECTION_STEPS = 1 << 13, 1 << 7
#: Half a window, in standard deviations of the difference of two vectors of the least similarity.
WINDOW = 2.0
#: Vectors that a table's signs leave together, about; collisions that a pair needs; classes of a tile; pairs at a time.
TOGETHER, NEEDED, TILE, PAIRS = 256, 2, 1024, 200_000
TILES = "run int, dim int, low long, high long, rows int, body binary"
FOUND = "kind int, cls long, n long"


class Plan:
    """Numbers of tables and signs for so many vectors, a least similarity and a recall at it."""

    def __init__(self, vectors: int, least: float, recall: float):
        self.least = least
        self.signs = max(0, round(math.log2(max(1, vectors) / TOGETHER)))
        #: Chance that a pair of the least similarity agrees in all signs, and lies within the window.
        self.chance = (1 - math.acos(least) / math.pi) ** self.signs * math.erf(WINDOW / math.sqrt(2))
        self.tables = NEEDED
        while self.recall() < recall:
            self.tables += 1

    def recall(self) -> float:
        return 1 - sum(math.comb(self.tables, k) * self.chance**k * (1 - self.chance) ** (self.tables - k) for k in range(NEEDED))

    @property
    def window(self) -> int:
        return math.ceil(WINDOW * math.sqrt(2 - 2 * self.least) * VECTOR_STEPS * DIRECTION_STEPS)


@lru_cache(maxsize=8)
def directions(dim: int, tables: int, signs: int) -> np.ndarray:
    """A column for each table's direction, then for its signs' directions; the same in every process."""
    rng = np.random.default_rng([dim, 12])
    each = [np.rint(rng.standard_normal((dim, 1 + signs)) * DIRECTION_STEPS) for _ in range(tables)]
    return np.concatenate([e[:, :1] for e in each] + [e[:, 1:] for e in each], axis=1)


def places(vectors: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit vectors -> (signs, place) of each in each table."""
    n, dim = vectors.shape
    p = np.rint(vectors * VECTOR_STEPS) @ directions(dim, plan.tables, plan.signs)
    bits = (p[:, plan.tables :] > 0).reshape(n, plan.tables, plan.signs)
    return bits @ (np.int64(1) << np.arange(plan.signs)) if plan.signs else np.zeros((n, plan.tables), dtype=np.int64), p[:, : plan.tables].astype(np.int64)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths, in doubles; scaled first, so that no square is too large or small."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def code(signs: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Signs and place as one number in their order; windows of different signs lie far apart."""
    return (signs << np.int64(32)) + place + np.int64(1 << 31)


def _dealt(plan: Plan, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["v"].map(len).to_numpy()
            for dim in np.unique(size):
                own = pdf[size == dim]
                for lo in range(0, len(own), 2000):
                    some = own.iloc[lo : lo + 2000]
                    raw = np.stack(some["v"].to_numpy()).astype(np.float64)
                    at = code(*places(unit(raw), plan))
                    bodies = [x.tobytes() for x in raw.astype(kind)]
                    for t in range(plan.tables):
                        yield pd.DataFrame({"run": t, "dim": dim, "at": at[:, t], "cls": some["cls"].to_numpy(), "n": some["n"].to_numpy(), "v": bodies})

    return run


def _tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows -> tiles of at most TILE rows, each of one table and one number of dimensions."""

    def tile(rows: pd.DataFrame) -> dict:
        body = b"".join([rows[c].to_numpy(np.int64).tobytes() for c in ("at", "cls", "n")] + rows["v"].tolist())
        return {"run": rows["run"].iloc[0], "dim": rows["dim"].iloc[0], "low": rows["at"].iloc[0], "high": rows["at"].iloc[-1], "rows": len(rows), "body": body}

    held: list[pd.DataFrame] = []
    for pdf in batches:
        for _, own in pdf.groupby(["run", "dim"], sort=False):
            if held and (held[0]["run"].iloc[0], held[0]["dim"].iloc[0]) != (own["run"].iloc[0], own["dim"].iloc[0]):
                yield pd.DataFrame([tile(pd.concat(held))])
                held = []
            held.append(own)
            while sum(map(len, held)) >= TILE:
                rows = pd.concat(held)
                yield pd.DataFrame([tile(rows.iloc[:TILE])])
                held = [rows.iloc[TILE:]] if len(rows) > TILE else []
    if held:
        yield pd.DataFrame([tile(pd.concat(held))])


def _opened(body: bytes, rows: int, dim: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at, cls, n = np.frombuffer(body, dtype=np.int64, count=3 * rows).reshape(3, rows)
    return at, cls, n, unit(np.frombuffer(body, dtype=kind, offset=24 * rows).reshape(rows, dim).astype(np.float64))


def colliding(table_no: int, a: tuple, b: tuple, same: bool, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of two tiles that are linked and first collide in this table, some at a time.

    Windows centred on a row reach to either side; each pair is seen from its first row.
    """
    (at_a, _, _, v_a), (at_b, _, _, v_b) = a, b
    signs_a, place_a = places(v_a, plan)
    signs_b, place_b = places(v_b, plan)
    low = np.arange(1, len(at_a) + 1) if same else np.searchsorted(at_b, at_a, "left")
    high = np.searchsorted(at_b, at_a + plan.window, "right")
    many = np.maximum(high - low, 0)
    ends = np.cumsum(many)
    lo = 0
    while lo < len(many):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
        i = np.repeat(np.arange(lo, hi), many[lo:hi])
        j = np.arange(len(i)) - np.repeat(ends[lo:hi] - many[lo:hi] - (ends[lo - 1] if lo else 0), many[lo:hi]) + low[i]
        hit = (signs_a[i] == signs_b[j]) & (np.abs(place_a[i] - place_b[j]) <= plan.window)
        able = (hit.argmax(axis=1) == table_no) & (hit.sum(axis=1) >= NEEDED)
        i, j = i[able], j[able]
        linked = np.einsum("ij,ij->i", v_a[i], v_b[j]) >= plan.least
        yield i[linked], j[linked]
        lo = hi


def stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Of nodes 0 to n - 1, the least one that each reaches through the edges."""
    least = np.arange(n)
    while True:
        now = least.copy()
        low = np.minimum(least[i], least[j])
        np.minimum.at(now, i, low)
        np.minimum.at(now, j, low)
        now = now[now]
        if (now == least).all():
            return least
        least = now


def _compared(plan: Plan, kind: str):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("side")
        tiles = [_opened(r.body, r.rows, r.dim, kind) for r in pdf.itertuples(index=False)]
        a, b = tiles[0], tiles[-1]
        pairs = list(colliding(int(pdf["run"].iloc[0]), a, b, len(tiles) == 1, plan))
        i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        links_a = np.bincount(i, weights=b[2][j], minlength=len(a[0])).astype(np.int64)
        links_b = np.bincount(j, weights=a[2][i], minlength=len(b[0])).astype(np.int64)
        cls = np.concatenate([a[1], b[1]])
        nodes, number = np.unique(cls, return_inverse=True)
        root = stars(number[i], number[len(a[0]) + j], len(nodes))
        told = np.bincount(number, weights=np.concatenate([links_a, links_b]), minlength=len(nodes)).astype(np.int64)
        some, tied = np.flatnonzero(told), np.flatnonzero(root != np.arange(len(nodes)))
        return pd.DataFrame({"kind": np.repeat([0, 1], [len(some), len(tied)]), "cls": np.concatenate([nodes[some], nodes[tied]]), "n": np.concatenate([told[some], nodes[root[tied]]])})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, recall: float = 0.999) -> DataFrame:
    """(id, n_links, component, kept) of each row; the method is told above.

    n_links are the other rows whose cosine with this one, in doubles, is `least` or more, among the pairs found; the chance
    that a pair just at `least` is found is `recall`, of closer ones higher. component is the smallest id that links reach, the
    row's own included; kept says whether that is its own. Equal vectors are always linked.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, nor do those of different
    lengths. Rows are vectors one by one: rows of the same id are others of one another. A row without an id keeps its null, is
    not kept, and gives a component no id (null if no row of it has one). No rows in, no rows out.
    """
    kind = "<f4" if vectors.select(F.col(f"`{vector_col}`").alias("v")).schema["v"].dataType == ArrayType(FloatType()) else "<f8"
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    able = F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = written(rows.withColumn("v", F.when(able, F.col("v"))), "vectors")
    some = rows.filter("v IS NOT NULL")
    classes = written(some.groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("least")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    count = classes.count()
    plan = Plan(count, least, recall)
    dealt = classes.select("cls", "n", "v").mapInPandas(_dealt(plan, kind), "run int, dim int, at long, cls long, n long, v binary")
    parts = max(1, math.ceil(count * plan.tables / 200_000))
    order = ["run", "dim", "at", "cls"]
    tiles = written(dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(_tiles, TILES).withColumn("place", F.monotonically_increasing_id()), "tiles")
    by = Window.partitionBy("run", "dim").orderBy("low", "place")
    named = tiles.select("run", "dim", "place", "low", "high", F.row_number().over(by).cast("long").alias("no"))
    begins = named.select("run", "dim", F.col("low").alias("at"), F.lit(0).alias("kind"), "no", "place", F.col("no").alias("begun"))
    reaches = named.select("run", "dim", (F.col("high") + plan.window).alias("at"), F.lit(1).alias("kind"), "no", "place", F.lit(0).cast("long").alias("begun"))
    last = F.max("begun").over(Window.partitionBy("run", "dim").orderBy("at", "kind", "no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = written(begins.unionByName(reaches).withColumn("last", last).filter("kind = 1").select("run", "dim", "no", "place", "last"), "spans")
    pairs = spans.select("run", "dim", "no", F.explode(F.sequence("no", "last")).alias("other"))
    sides = pairs.select("run", "dim", "no", "other", F.col("no").alias("own"), F.lit(0).alias("side")).unionByName(pairs.filter("other > no").select("run", "dim", "no", "other", F.col("other").alias("own"), F.lit(1).alias("side")))
    sides = sides.join(spans.select("run", "dim", F.col("no").alias("own"), "place"), ["run", "dim", "own"]).select("no", "other", "side", "place")
    bodies = sides.join(tiles.select("place", "run", "dim", "rows", "body"), "place")
    found = written(bodies.groupBy("run", "dim", "no", "other").applyInPandas(_compared(plan, kind), FOUND), "links")
    links = found.filter("kind = 0").groupBy("cls").agg(F.sum("n").alias("links"))
    roots = components(found.filter("kind = 1").select(F.col("cls").alias("a"), F.col("n").alias("b")))
    told = classes.join(links, "cls", "left").join(roots.withColumnsRenamed({"node": "cls"}), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    told = written(told.select("v", "n", "least", "root", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")), "told")
    smallest = told.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("size"))
    told = written(join_counted(told, written(smallest, "smallest"), ["root"], "size").select("v", "n", "component", "links"), "class-rows")
    ours = join_counted(some, told, ["v"], "n").select("id", F.col("links").alias("n_links"), "component")
    out = ours.unionByName(rows.filter("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))

"""Quotation linking: nested quote levels, hashed quoted passages joined to their original messages, reply order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.common import join_counted, written

MARK = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
ATTRIBUTION = re.compile(r"^[ \t]*(?:On\b.{0,200}\bwrote|Am\b.{0,200}\bschrieb.{0,80}|Le\b.{0,200}\ba écrit|El\b.{0,200}\bescribió)[ \t]*:[ \t]*$")
SPACE = re.compile(r"\s+")


def levels(text: str | None) -> list[tuple[int, str]]:
    """(quote level, line without its marks) of each line; the line that says who is quoted has level -1."""
    lines = (text or "").split("\n")
    out = []
    for k, line in enumerate(lines):
        m = MARK.match(line)
        level = m.group(1).count(">") if m else 0
        rest = line[m.end() :] if m else line
        follows = next((x for x in lines[k + 1 : k + 3] if x.strip()), "")
        if ATTRIBUTION.match(rest) and (len(n.group(1).replace(" ", "").replace("\t", "")) if (n := MARK.match(follows)) else 0) > level:
            level = -1
        out.append((level, rest))
    return out


def normal(passage: str) -> str:
    return SPACE.sub(" ", passage).strip().lower()


def runs(parsed: list[tuple[int, str]]) -> Iterator[tuple[int, list[str]]]:
    """Runs of lines of one level, cut at blank lines."""
    level, lines = 0, []
    for at, line in parsed:
        if lines and (at != level or not line.strip()):
            yield level, lines
            lines = []
        level = at
        if line.strip():
            lines.append(line)
    if lines:
        yield level, lines


def body(parsed: list[tuple[int, str]]) -> str:
    """A message's own lines; blank lines at the ends go, and of several blank lines where a quote stood, one stays."""
    return re.sub(r"\n{3,}", "\n\n", "\n".join(line for level, line in parsed if level == 0)).strip("\n")


def passages(text: str | None, min_chars: int) -> list[tuple[int, int, bytes]]:
    """(level, place, hash) of each run of level 0 or more and, where it has several, of each of its lines.

    The place numbers the runs. A passage of under min_chars normalised characters is not distinct enough to be linked.
    """
    out = []
    for k, (level, lines) in enumerate(r for r in runs(levels(text)) if r[0] >= 0):
        for p in dict.fromkeys([normal(" ".join(lines)), *map(normal, lines)]):
            if len(p) >= min_chars:
                out.append((level, k, xxhash.xxh3_128_digest(p.encode("utf-8", "surrogatepass"))))
    return out


SCHEMA = "conv long, turn long, level int, place int, h1 long, h2 long"


def _explode(min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, raw = [], []
            for conv, turn, text in zip(pdf["conv"], pdf["turn"], pdf["text"], strict=True):
                for level, place, h in passages(text, min_chars):
                    rows.append((conv, turn, level, place))
                    raw.append(h)
            h = np.frombuffer(b"".join(raw), dtype="<i8").reshape(-1, 2)
            out = pd.DataFrame(rows, columns=["conv", "turn", "level", "place"], dtype="int64")
            yield out.assign(h1=h[:, 0], h2=h[:, 1])

    return run


def _body_column(text):
    @F.pandas_udf("body string, n_quoted int")
    def parse(texts: pd.Series) -> pd.DataFrame:
        parsed = [levels(t) for t in texts]
        return pd.DataFrame({"body": [body(p) for p in parsed], "n_quoted": [sum(level > 0 for level, _ in runs(p)) for p in parsed]})

    return parse(text)


def links(messages: DataFrame, min_chars: int = 10) -> DataFrame:
    """(conv, turn, text) -> (conv, turn, level, place, from_conv, from_turn): each quoted run and where it was first written.

    A run is looked up whole and line by line, among messages' own runs and lines. First choice is the earliest turn of the
    same conversation, if before the quoting turn; else the least (conversation, turn) that holds it, other than the
    quoting message. A run's origin is the one that most of its passages name; ties go to the earliest. A run of which no
    passage is found has none and no row.
    """
    found = messages.filter("conv IS NOT NULL AND turn IS NOT NULL").mapInPandas(_explode(min_chars), SCHEMA)
    found = written(found, "passages")
    own, quoted = found.filter("level = 0"), found.filter("level > 0")
    key = ["h1", "h2"]
    many = quoted.groupBy(*key).agg(F.count("*").alias("n"))
    here = own.groupBy("conv", *key).agg(F.min("turn").alias("from_turn")).join(quoted.groupBy("conv", *key).agg(F.count("*").alias("n")), ["conv", *key])
    near = join_counted(quoted, written(here, "origins-here"), ["conv", *key], "n").filter("from_turn < turn")
    near = near.select("conv", "turn", "level", "place", *key, F.col("conv").alias("from_conv"), "from_turn")
    firsts = own.groupBy("conv", *key).agg(F.min("turn").alias("turn"))
    firsts = written(firsts.join(many.select(*key), key, "left_semi"), "first-holders")
    anywhere = written(firsts.groupBy(*key).agg(F.min(F.struct("conv", "turn")).alias("o"), F.count("*").alias("holders")), "origins-least")
    others = join_counted(firsts, anywhere, key, "holders").filter("conv <> o.conv").groupBy(*key).agg(F.min(F.struct("conv", "turn")).alias("other"))
    origins = anywhere.join(others, key, "left").join(many, key).select(*key, "o", "other", "n")
    far = join_counted(quoted, written(origins, "origins"), key, "n")
    far = far.withColumn("o", F.when(F.col("o.conv") == F.col("conv"), F.col("other")).otherwise(F.col("o"))).filter("o IS NOT NULL")
    far = far.select("conv", "turn", "level", "place", *key, F.col("o.conv").alias("from_conv"), F.col("o.turn").alias("from_turn"))
    votes = near.withColumn("kind", F.lit(0)).unionByName(far.withColumn("kind", F.lit(1)))
    run = ["conv", "turn", "level", "place"]
    counted = votes.groupBy(*run, "kind", "from_conv", "from_turn").agg(F.count("*").alias("votes"))
    best = counted.groupBy(*run).agg(F.min(F.struct("kind", (-F.col("votes")).alias("v"), "from_conv", "from_turn")).alias("b"))
    return best.select(*run, "b.from_conv", "b.from_turn")


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with name: a row's place, from 0, among the rows of its keys in this order; large groups are cut into ranges.

    Rows are range-partitioned by (keys, order), numbered within each range, and shifted by the rows that a group has in
    the ranges before, so that a group of any size is many small windows.
    """
    parts = max(1, -(-df.count() // 200_000))
    ranged = written(df.repartitionByRange(parts, *keys, *order).withColumn("range_no", F.spark_partition_id()), "ranges")
    inner = ranged.withColumn("within", F.row_number().over(Window.partitionBy("range_no", *keys).orderBy(*order)) - 1)
    sizes = ranged.groupBy("range_no", *keys).agg(F.count("*").alias("size"))
    before = Window.partitionBy(*keys).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size").withColumnsRenamed({k: f"shift_{k}" for k in keys})
    same = F.col("range_no") == F.col("shift_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"shift_{k}"))
    out = inner.join(shift.withColumnRenamed("range_no", "shift_range"), same)
    return out.withColumn(name, F.col("within") + F.col("before")).select(*df.columns, name)


def roots(parents: DataFrame) -> DataFrame:
    """(conv, turn, parent) -> (conv, turn, root): the turn that chains of parents end at, by doubling the steps.

    All replies of a long thread come to share one step's end, so ends are joined with the number of rows that have them.
    """
    step = written(parents.select("conv", "turn", F.col("parent").alias("root")), "roots")
    while True:
        above = step.select("conv", F.col("turn").alias("root"), F.col("root").alias("higher"))
        ends = step.groupBy("conv", "root").agg(F.count("*").alias("n")).join(above, ["conv", "root"], "left")
        ends = written(ends, "root-ends")
        if not ends.filter("higher IS NOT NULL").limit(1).count():
            return step
        moved = join_counted(step, ends, ["conv", "root"], "n")
        step = written(moved.select("conv", "turn", F.coalesce("higher", "root").alias("root")), "roots")


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Messages without quotes, in reply order: (conv, turn, role, position, parent, root, n_quoted, n_linked, from_conv, from_turn, body).

    A message's parent is the latest turn of its own conversation whose passage it quotes at the first level; without one
    it starts a thread. root is the first message of the thread. position orders a conversation by thread, then turn, from 0.
    from_conv and from_turn tell the first quoted passage whose origin is known, in whatever conversation. n_quoted counts
    quoted runs, n_linked those with a known origin.

    Null and empty texts give an empty body. A row without conversation or turn is kept, linked to nothing. Repeated rows
    stay, in the order of role and body. No rows in, no rows out.
    """
    base = messages.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    found = written(links(base, min_chars), "links")
    parents = found.filter("level = 1 AND from_conv = conv").groupBy("conv", "turn").agg(F.max("from_turn").alias("parent"))
    parents = written(parents, "parents")
    told = found.groupBy("conv", "turn").agg(F.count("*").alias("n_linked"), F.min(F.struct("place", "from_conv", "from_turn")).alias("o"))
    known = told.join(parents, ["conv", "turn"], "left").join(roots(parents), ["conv", "turn"], "left")
    known = known.select("conv", "turn", "n_linked", "parent", "root", "o.from_conv", "o.from_turn")
    parsed = base.withColumn("p", _body_column(F.col("text"))).select("conv", "turn", "role", "p.body", "p.n_quoted")
    out = parsed.join(known, ["conv", "turn"], "left").withColumns({"root": F.coalesce("root", "turn"), "n_linked": F.coalesce("n_linked", F.lit(0))})
    return ranked(out, ["conv"], ["root", "turn", "role", "body"], "position")

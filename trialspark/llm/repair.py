"""Conversation structure repair: the cheapest edits to turns in a legal order, by a square-root checkpointed programme.

A repaired conversation has roles `(s?(ua)+)?`. Going through it there are four states: nothing yet, and the last role's
initial. A row's *cost vector* says for each state before it what the cheapest edits from there to the end cost. Vectors go
backward, edits are read off forward: in each state the ASCII-least edit is taken that is tight, that is, whose cost and the
vector behind it make up the vector before it.

Memory. A conversation's rows lie in blocks that grow by a fixed number of rows, so n rows have in the order of sqrt(n)
blocks of at most sqrt(n) rows. Vectors are kept at the blocks' ends only, the checkpoints; a block's inner vectors are
worked out again when its edits are read off. A conversation may be of any length: each block is a row of its own, gives the
costs from each of its states before to each behind (a block's matrix), and only those matrices meet in a task to give the
checkpoints. A block's edits are read off for each state before it; the last pass, which sees rows in order, picks one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.common import join_counted, written

SPACES = " \t\n\x0b\x0c\r"
#: Rows of a conversation's first block, and how many more each next one has.
BLOCK_STEP = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after a system turn, after a user's, after an assistant's. The state that the next free role leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept row of an initial leads from each state; others are not legal.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Costs of the inserts behind the last row.
END = (0.0, 2.0 * INSERT, 1.0 * INSERT, 0.0)
BLANK, DUPLICATE = "b", "d"
WALKED = "key string, place long, kind int, symbols string, audits array<string>"


@lru_cache(maxsize=None)
def row_step(symbol: str, after: tuple[float, ...]) -> tuple[tuple[float, ...], float, tuple[tuple[str, int], ...]]:
    """A row's vector before it, less its least entry; that entry; and for each state the edits up to the row's own, and the state behind.

    symbol: the role's initial, in upper case if the text is truncated; BLANK or DUPLICATE. after: the vector behind the
    row, of which the least entry is 0: there are few such vectors, so rows are mostly looked up.
    """
    options: list[list[tuple[str, float, int]]] = []
    for state in range(4):
        own = [("D", DELETE + after[state], state)]
        if symbol not in (BLANK, DUPLICATE):
            more = TRUNCATED * symbol.isupper()
            if (state, symbol.lower()) in KEPT:
                to = KEPT[state, symbol.lower()]
                own.append(("K", KEEP + more + after[to], to))
            own.append(("R", REROLE + more + after[NEXT[state]], NEXT[state]))
        options.append(own)
    plain = [min(cost for _, cost, _ in own) for own in options]
    once = [min(plain[s], INSERT + plain[NEXT[s]]) for s in range(4)]
    before = [min(plain[s], INSERT + once[NEXT[s]]) for s in range(4)]
    moves = []
    for s in range(4):
        piece, state = "", s
        while True:
            deleted = options[state][0]
            if deleted[1] == before[state]:
                piece, state = piece + "D", state
                break
            if INSERT + before[NEXT[state]] == before[state]:
                piece, state = piece + "I", NEXT[state]
                continue
            edit, _, to = next(o for o in options[state][1:] if o[1] == before[state])
            piece, state = piece + edit, to
            break
        moves.append((piece, state))
    least = min(before)
    return tuple(x - least for x in before), least, tuple(moves)


def backward(symbols: str, after: tuple[float, ...]) -> tuple[tuple[float, ...], list]:
    """A block's vector before it, given the one behind; and each row's moves, in order."""
    total, moves = min(after), []
    after = tuple(x - total for x in after)
    for symbol in reversed(symbols):
        after, least, move = row_step(symbol, after)
        total += least
        moves.append(move)
    return tuple(x + total for x in after), moves[::-1]


def matrix(symbols: str) -> list[float]:
    """A block's costs by state behind, then state before."""
    return [x for end in range(4) for x in backward(symbols, tuple(0.0 if s == end else float("inf") for s in range(4)))[0]]


def walked(moves: list, state: int) -> str:
    """A block's edits from a state before it."""
    audit = []
    for move in moves:
        piece, state = move[state]
        audit.append(piece)
    return "".join(audit)


def _matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[["key", "part", "block"]].assign(costs=[matrix(s) for s in pdf["symbols"]])


def _checkpoints(pdf: pd.DataFrame) -> pd.DataFrame:
    """The vector behind each block of a conversation, from the last block to the first."""
    pdf = pdf.sort_values(["part", "block"], ascending=False)
    after, out = END, []
    for costs in pdf["costs"]:
        out.append(list(after))
        after = tuple(min(costs[4 * end + s] + after[end] for end in range(4)) for s in range(4))
    return pdf[["key", "part", "block"]].assign(after=out)


def _walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        audits = []
        for symbols, after in zip(pdf["symbols"], pdf["after"], strict=True):
            _, moves = backward(symbols, END if after is None else tuple(after))
            audits.append([walked(moves, s) for s in (range(4) if after is not None else [START])])
        yield pdf[["key", "place", "symbols"]].assign(kind=0, audits=audits)[["key", "place", "kind", "symbols", "audits"]]


class _Conversation:
    """What is known of a conversation while its blocks and rows come by in order."""

    def __init__(self, key: str):
        self.key, self.state, self.pieces, self.at, self.edits = key, START, None, 0, []
        self.counts = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.first = self.last = self.before = None
        self.distinct, self.lines, self.sha = 0, 0, hashlib.sha256()

    def block(self, symbols: str, audits: list[str]) -> None:
        self.symbols, self.pieces, self.row, self.at = symbols, audits[self.state if len(audits) > 1 else 0], 0, 0
        self.edits.append(self.pieces)

    def line(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def insert(self) -> tuple[str, str, str]:
        self.state = NEXT[self.state]
        self.counts["cost"] += INSERT
        self.line(NAMES[self.state], "")
        return "I", NAMES[self.state], ""

    def turn(self, turn, role: str, text: str) -> Iterator[tuple[str, str | None, str | None]]:
        """A row's edits: inserts before it, then its own."""
        symbol, self.row = self.symbols[self.row], self.row + 1
        if symbol in (BLANK, DUPLICATE):
            self.counts["blank" if symbol == BLANK else "duplicate"] += 1
        self.counts["truncated"] += symbol.isupper()
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.before = role[:1]
        if turn is not None:
            self.distinct += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        while self.pieces[self.at] == "I":
            self.at += 1
            yield self.insert()
        edit, self.at = self.pieces[self.at], self.at + 1
        if edit == "D":
            self.counts["cost"] += DELETE
            yield edit, None, None
            return
        self.state = NEXT[self.state] if edit == "R" else KEPT[self.state, role[:1]]
        role = NAMES[self.state] if edit == "R" else role
        self.counts["cost"] += (REROLE if edit == "R" else KEEP) + TRUNCATED * symbol.isupper()
        self.line(role, text)
        yield edit, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        while self.state in (SYSTEM, USER):
            self.edits.append("I")
            yield self.insert()

    def digest(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (self.key, *(self.counts | {"gaps": gaps}).values(), "".join(self.edits), self.sha.hexdigest())


DIGEST = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "key string, step long, edit string, role string, text string"


def _stream(digests: bool):
    """Blocks and rows in order of conversation and place -> a row for each conversation, or for each edit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out, step = None, [], 0
        columns = [c.split()[0] for c in (DIGEST if digests else EDITS).split(", ")]

        def told(edits) -> None:
            nonlocal step
            for e in edits:
                if not digests:
                    out.append((now.key, step, *e))
                    step += 1

        def close() -> None:
            told(now.end())
            if digests:
                out.append(now.digest())

        for pdf in batches:
            for key, kind, symbols, audits, has_turn, turn, role, text in pdf[["key", "kind", "symbols", "audits", "has_turn", "turn", "role", "text"]].itertuples(index=False):
                if now is None or key != now.key:
                    if now is not None:
                        close()
                    now, step = _Conversation(key), 0
                if kind == 0:
                    now.block(symbols, audits)
                elif kind == 1:
                    told(now.turn(int(turn) if has_turn else None, role, text))
            yield pd.DataFrame(out, columns=columns)
            out.clear()
        if now is not None:
            close()
            yield pd.DataFrame(out, columns=columns)

    return run


def damaged(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, dropped): rows with faults put in by crc32(`conv:turn`) % 20; nulls count as a space there.

    0 drops the row (it is marked, so that its conversation stays known), 1 empties its text, 2 takes `[.!?]` out, 3 repeats
    it, 4 makes it the user's. Null roles and texts become a space.
    """
    word = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(word(conv_col), F.lit(":"), word(turn_col)).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(word(text_col), "[.!?]", "")).otherwise(word(text_col))
    rows = convs.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(word(role_col)).alias("role"), text.alias("text"), (fault == 0).alias("dropped"), F.when(fault == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def _symbol(duplicate: Column) -> Column:
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    bare = F.rtrim("text", F.lit(SPACES))
    cut = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    return F.when(bare == "", BLANK).when(duplicate, DUPLICATE).when(cut, F.upper(initial)).otherwise(initial)


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in order of conversation and turn, dealt by ranges: (key, place, turn, role, text, dropped, h1, h2), written.

    place grows with the order; its upper bits are the range. Rows of one turn come by a hash of role and text, and equal
    rows by a number, so that one conversation, turn or row may fill many ranges.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    base = rows.select(key.alias("key"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.coalesce("dropped", F.lit(False)).alias("dropped"))
    base = base.withColumns({"h1": F.xxhash64("key", "role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role", "key"), "number": F.monotonically_increasing_id()})
    order = ["key", "turn", "h1", "h2", "number"]
    return written(base.repartitionByRange(*order).sortWithinPartitions(*order).drop("number").withColumn("place", F.monotonically_increasing_id()), "turns")


def _streamed(rows: DataFrame) -> DataFrame:
    """Blocks with their edits (kind 0) and rows (kind 1; 2 if dropped), in order in each partition, conversations whole."""
    turns = _ordered(rows)
    narrow = turns.filter(~F.col("dropped"))
    repeated = written(narrow.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1"), "repeated")
    again = join_counted(narrow.select("h1", "h2", "place"), repeated, ["h1", "h2"], "n").filter("place > first").select("place", F.lit(True).alias("again"))
    marked = narrow.select("key", "place", "role", "text", F.shiftright("place", 33).alias("part")).withColumn("symbol", _symbol(F.lit(False))).drop("role", "text")
    marked = marked.join(again, "place", "left").withColumn("symbol", F.when(F.col("again") & (F.col("symbol") != BLANK), DUPLICATE).otherwise(F.col("symbol")))
    at = F.row_number().over(Window.partitionBy("key", "part").orderBy("place")) - 1
    cut = marked.withColumn("block", F.floor((F.sqrt(8 * at / BLOCK_STEP + 1) - 1) / 2))
    blocks = cut.groupBy("key", "part", "block").agg(F.min("place").alias("place"), F.array_sort(F.collect_list(F.struct("place", "symbol"))).alias("rows"))
    blocks = blocks.select("key", "part", "block", "place", F.count("*").over(Window.partitionBy("key")).alias("n"), F.array_join(F.col("rows.symbol"), "").alias("symbols"))
    blocks = written(blocks, "blocks")
    several = blocks.filter("n > 1")
    ends = several.mapInPandas(_matrices, "key string, part long, block long, costs array<double>").groupBy("key").applyInPandas(_checkpoints, "key string, part long, block long, after array<double>")
    single = blocks.filter("n = 1").withColumn("after", F.lit(None).cast("array<double>"))
    edits = single.unionByName(several.join(ends, ["key", "part", "block"])).mapInPandas(_walks, WALKED)
    kind = F.when(F.col("dropped"), 2).otherwise(1)
    texts = turns.select("key", "place", kind.alias("kind"), "turn", F.col("turn").isNotNull().alias("has_turn"), "role", "text")
    both = edits.unionByName(texts.withColumn("turn", F.coalesce("turn", F.lit(0))), allowMissingColumns=True)
    return both.repartition("key").sortWithinPartitions("key", "place", "kind")


def _named(out: DataFrame, rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv"].dataType
    return out.select(F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(kind).alias("conv"), *[c for c in out.columns if c != "key"])


def repair_digests(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, dropped) -> a row for each conversation: (conv, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256).

    Rows are taken by turn, nulls first; of one turn, by a hash of role and text. A row's first fault counts: blank, duplicate
    (role and text stood before in the conversation), truncated (its last character that isn't white space is none of
    `.!?`). Edits are Keep (0), Rerole to user or assistant (3), Delete (4; blank and duplicate rows must go), Insert an empty
    turn (3); a truncated row that stays costs 3 more. audit has the initials of the cheapest edits, of several the
    ASCII-least; repaired_sha256 hashes `role:text` of the repaired turns, joined by newlines. gaps are turn numbers between
    the least and the greatest that no row has; illegal counts neighbours whose initials aren't su, ua or au.

    Dropped rows only make their conversation known: one without other rows has zeros, no edits, and the hash of nothing.
    Null roles and texts are a space; rows without a conversation make up one of their own, with a null id. Null `dropped`
    is false. Other columns are ignored; no rows in, no rows out. The hash is one serial sum over a conversation's text, so
    the last pass sees each conversation in one task, row by row: it holds a block and the audit, never the texts.
    """
    return _named(_streamed(rows).mapInPandas(_stream(True), DIGEST), rows)


def repair_edits(rows: DataFrame) -> DataFrame:
    """(conv, step, edit, role, text): the edits themselves in order, with each turn that results; deleted rows have none."""
    return _named(_streamed(rows).mapInPandas(_stream(False), EDITS), rows)

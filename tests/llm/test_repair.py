"""Conversation repair against a plain search over all edits."""

import functools
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from trialspark.llm import queries, repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, key string, place long, kind int, conv string, `a.b` int"
SPACES = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    """(conv, turn, role, text) -> the same after damage; dropped ones have role None."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text
        role = None if fault == 0 else "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def brute_repair(rows):
    """Rows (turn, role, text) in order -> the digest."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    named = {"u": "user", "a": "assistant"}

    @functools.lru_cache(None)
    def best(i, state, inserted):
        """(cost, audit, repaired turns) from row i on, when the last role's initial is state."""
        found = []
        free = [x for x in legal[state] if x != "s"]
        if inserted < 3:
            for x in free:
                c, a, r = best(i, x, inserted + 1)
                found.append((c + 3, "I" + a, (f"{named[x]}:", r)))
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            _, role, text = rows[i]
            c, a, r = best(i + 1, state, 0)
            found.append((c + 4, "D" + a, r))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if role[:1] and role[:1] in legal[state]:
                    c, a, r = best(i + 1, role[:1], 0)
                    found.append((c + more, "K" + a, (f"{role}:{text}", r)))
                for x in free:
                    c, a, r = best(i + 1, x, 0)
                    found.append((c + 3 + more, "R" + a, (f"{named[x]}:{text}", r)))
        return min(found, key=lambda f: f[:2], default=(10**9, "", ()))

    cost, audit, rest = best(0, "", 0)
    lines = []
    while rest:
        line, rest = rest
        lines.append(line)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:], strict=False))
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute(rows):
    convs = {}
    for conv, turn, role, text in brute_damage(rows):
        own = convs.setdefault(conv, [])
        if role is not None:
            own.append((turn, role, text))
    return [(c, *brute_repair(tuple(sorted(own, key=lambda r: (r[0] is not None, r[0]))))) for c, own in convs.items()]


def columns(rows):
    return [tuple(r[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 5, 3, "c", 1) for r in rows], SCHEMA)


def made(rng, convs, most):
    texts = ["Yes.", "No!", "and so", "", " \n", "What?", "x", "naïve é.", "a. b"]
    return [(c, t + rng.choice([0, 0, 0, 3]), rng.choice(["user", "assistant", "system", "tool", "", None, "user"]), rng.choice([*texts, None, f"own {c} {t}."])) for c in range(convs) for t in range(0, rng.randint(1, most) * 4, 4)]


def run(spark, rows):
    return columns(repair.repair_digests(repair.damaged(frame(spark, rows))).withColumnRenamed("conv", "conv_id").collect())


def by_id(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("step", [256, 1, 3])
def test_made_conversations_as_brute_force(spark, monkeypatch, step):
    monkeypatch.setattr(repair, "BLOCK_STEP", step)
    rng = random.Random(step)
    rows = [*made(rng, 60, 9), *((100 + c, t, r, x) for c, t, r, x in made(rng, 2, 90))]
    assert by_id(run(spark, rows)) == by_id(brute(rows))


def test_query_as_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert by_id(columns(queries.op11_structure_repair(spark, SF).collect())) == by_id(brute(rows))


def test_nulls_ties_and_dropped_conversations(spark):
    same = [(7, 1, "user", "Hello.")] * 5
    none = [(None, None, None, None), (None, 2, "user", "No id."), (8, None, "assistant", "No turn."), (8, None, "assistant", "No turn.")]
    gone = [(c, 0, "user", "All dropped.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    long = [(9, t, "user" if t % 2 == 0 else "assistant", "word " * 20_000 + "end.") for t in range(4)]
    rows = [*same, *none, *gone, *long]
    assert gone
    assert by_id(run(spark, rows)) == by_id(brute(rows))
    lone = [r for r in run(spark, gone) if r[0] == gone[0][0]]
    assert lone == [(gone[0][0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_edits_make_the_digest(spark):
    rows = made(random.Random(4), 20, 7)
    convs = repair.damaged(frame(spark, rows))
    steps = {}
    for r in repair.repair_edits(convs).orderBy("conv", "step").collect():
        steps.setdefault(r["conv"], []).append(r)
    for r in repair.repair_digests(convs).collect():
        own = steps.get(r["conv"], [])
        assert "".join(e["edit"] for e in own) == r["audit"]
        assert hashlib.sha256("\n".join(f"{e['role']}:{e['text']}" for e in own if e["edit"] != "D").encode()).hexdigest() == r["repaired_sha256"]


def test_blocks_grow_with_the_square_root(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_STEP", 4)
    at = spark.range(0, 20_000).withColumn("block", F.floor((F.sqrt(8 * F.col("id") / 4 + 1) - 1) / 2))
    sizes = at.groupBy("block").count()
    most, n = sizes.agg(F.max("count"), F.count("*")).first()
    assert n <= 101 and most <= 4 * 101

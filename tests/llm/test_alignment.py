"""Cross-tokenizer alignment against a plain count of all documents."""

import bisect
import collections
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trialspark.llm import alignment, queries
from trialspark.llm.packing import byte_signs

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id long, radix string, batch int, `a.b` string"


def brute(rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = {c: b for b, c in byte_signs().items()}
    found = []
    for _, text in rows:
        links, groups = [], []
        if text:
            whole = (" " + text).encode()
            ea, eb = tok.encode(" " + text, add_special_tokens=False), sp.encode(text)
            a = [(i, bytes(back[c] for c in t)) for i, t in zip(ea.ids, ea.tokens, strict=True)]
            b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in eb]
            if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                spans = []
                for side in (a, b):
                    at, out = 0, []
                    for i, t in side:
                        out.append((i, at, at + len(t)))
                        at += len(t)
                    spans.append(out)
                cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
                split = [collections.defaultdict(list) for _ in spans]
                for side, of in zip(spans, split, strict=True):
                    for s in side:
                        of[bisect.bisect_right(cuts, s[1])].append(s)
                for k in range(len(cuts)):
                    x, y = (of[k] for of in split)
                    groups.append(",".join(str(s[0]) for s in x) + "|" + ",".join(str(s[0]) for s in y))
                    links += [(p[0], q[0]) for p in x for q in y if p[1] < q[2] and q[1] < p[2]]
                found.append((len(a), len(b), groups, links))
                continue
        found.append((0, 0, [], []))
    held = collections.Counter(p for *_, links in found for p in set(links))
    most = collections.defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [(i, na, nb, len(g), len(x), sum(held[p] == most[p[0]] for p in x), sum(held[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for (i, _), (na, nb, g, x) in zip(rows, found, strict=True)]


def key(r):
    return [str(x) for x in r]


AWKWARD = [(1, None), (2, ""), (3, "   \n\t "), (4, "same words here"), (4, "same words here"), (5, " led by a space"), (6, "two  spaces and\ttab\n\nlines "), (None, "no id, same words"), (7, "word " * 20_000 + "end"), (8, "x" * 5000), (9, "a ▁ sign"), (10, "<|endoftext|> <s> <unk> <0x41> plain"), (11, "naïve 日本語 \U0001f600 é \x00 nul"), (12, " "), (13, "\n"), (14, "don't 123,456.7   nbsp em")]


def test_awkward_rows_as_brute_force(spark):
    rows = spark.createDataFrame([(i, t, 7, "x", 1, "z") for i, t in AWKWARD], SCHEMA)
    got = alignment.aligned_documents(rows).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute(AWKWARD)))


def test_query_as_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_token_alignment(spark, SF).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute(rows)))


def test_many_batches_give_the_same_rows(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    whole = alignment.aligned_documents(rows).collect()
    parts = alignment.aligned_documents(rows.repartition(17)).collect()
    assert sorted(map(key, whole)) == sorted(map(key, parts))


def test_merged_runs():
    import numpy as np

    rng = np.random.default_rng(5)
    runs, held = [], collections.Counter()
    for _ in range(9):
        pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 12, (60, 2))})
        docs = rng.integers(1, 5, len(pairs))
        runs.append(tuple(np.array(x, dtype=np.int64) for x in (*zip(*pairs, strict=True), docs)))
        held.update({p: int(n) for p, n in zip(pairs, docs, strict=True)})
    told = [[] for _ in runs]
    for found in alignment.merged(runs):
        for k, count, best in found:
            told[k] += zip(count.tolist(), best.tolist(), strict=True)
    for (a, b, _), t in zip(runs, told, strict=True):
        assert t == [(held[p], held[p] == max(n for q, n in held.items() if q[0] == p[0])) for p in zip(a.tolist(), b.tolist(), strict=True)]


def test_empty_table(spark):
    assert alignment.aligned_documents(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("a, b, want", [([1, 2], [9], "1,2|9"), ([1, 2], [8, 9], "1|8;2|9")])
def test_groups(a, b, want):
    sizes = {1: 1, 2: 2, 9: 3, 8: 1}
    b_sizes = [3] if b == [9] else [1, 2]
    assert alignment.aligned(a, [sizes[x] for x in a], b, b_sizes)[1] == want

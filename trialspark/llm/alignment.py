"""Cross-tokenizer alignment: links between two tokenizers' tokens, weighed by how many documents hold each pair of ids.

Alignment. A single space between two words begins a token of either tokenizer, so a text's tokens are those of its chunks
" word", and a chunk's groups and links are worked out once in a task. Texts where that doesn't hold (white space beside
white space, spaces at an end) are encoded whole.

Counting. A scan cuts the documents into batches. Each batch writes, for each radix of the A id, a run: its distinct pairs in
order (A id, then B id) with the number of its documents that hold each, compressed with zstd. So a pair that all documents
hold is one record a batch. A radix merges its runs through a heap of their next A ids: when all runs have given up an A id,
its pairs are counted and their highest count is known; each run is then told the counts of its records, in its own order.
A batch adds up what it is told, over the links of its documents, which it kept beside its runs.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import itertools
import math
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import written
from trialspark.llm.packing import ChunkTokenizer, byte_signs, default_tokenizer, rising_ranks
from trialspark.llm.pitman_yor import pack, unpack

#: Links of a batch at most, unless one text has more; chunks that a task remembers.
BATCH_LINKS, REMEMBERED = 1_000_000, 200_000
#: Characters of text for each radix, of which there are at most MOST_RADIXES.
RADIX_CHARS, MOST_RADIXES = 50_000_000, 4096
RUNS = "batch long, radix int, body binary"
RESULT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def aligned(a: list[int], a_sizes: list[int], b: list[int], b_sizes: list[int]) -> tuple[int, str, list[int]]:
    """Groups of two tokenizations of the same bytes: their number, their text, and the links as A id << 32 | B id.

    One sweep over both: each step links the two tokens that lie at the place, and goes on to whichever ends first. Where
    both end, a group ends.
    """
    links, groups = [], []
    i = j = begin_a = begin_b = 0
    end_a, end_b = a_sizes[0], b_sizes[0]
    while True:
        links.append(a[i] << 32 | b[j])
        if end_a == end_b:
            groups.append(",".join(map(str, a[begin_a : i + 1])) + "|" + ",".join(map(str, b[begin_b : j + 1])))
            i, j = i + 1, j + 1
            if i == len(a):
                return len(groups), ";".join(groups), links
            begin_a, begin_b = i, j
            end_a, end_b = end_a + a_sizes[i], end_b + b_sizes[j]
        elif end_a < end_b:
            i += 1
            end_a += a_sizes[i]
        else:
            j += 1
            end_b += b_sizes[j]


class _Chunks:
    """What is known of chunks: those met lately, and those met before; of the latter, what isn't met again is forgotten."""

    def __init__(self, most: int):
        self.new: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}
        self.most = most

    def missing(self, chunks: set[str]) -> list[str]:
        """The unknown ones; all others are made new."""
        if len(self.new) + len(chunks) > self.most:
            self.old, self.new = self.new, {}
        unknown = []
        for c in chunks:
            if c not in self.new:
                if c in self.old:
                    self.new[c] = self.old.pop(c)
                else:
                    unknown.append(c)
        return unknown


#: Letters, digits and signs of Latin scripts, and line breaks within: of these every pre-tokenizer thinks alike.
TAME = re.compile(r"[!-~\xa1-\xac\xae-\u024f](?:[\n!-~\xa1-\xac\xae-\u024f]*[!-~\xa1-\xac\xae-\u024f])?")


class Aligner:
    """Tokens of both tokenizers, by their bytes; what is known of chunks."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.a = ChunkTokenizer(a_path)
        self.a.tokenizer.encode_special_tokens, self.a.added = True, []
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = {c: b for b, c in byte_signs().items()}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=False)
        self.a_bytes = {i: bytes(back[c] for c in t) for t, i in vocabulary.items() if all(c in back for c in t)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: Chunks of B can be told apart at a space if a piece has none but at its beginning.
        self.chunked = self.a.chunked and not any("▁" in p[1:] and p.strip("▁") for p in pieces)
        ranks = rising_ranks(a_path)
        self.quick = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.known = _Chunks(REMEMBERED)
        self.a_sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.a_sizes[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_sizes = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        #: An id's text by what stands behind it: another of its side, or the end of its part of a group.
        self.a_text = [f"{i}{end}" for end in ",|" for i in range(len(self.a_sizes))]
        self.text = np.array([*self.a_text, *(f"{i}{end}" for end in ",;" for i in range(len(self.b_sizes)))], dtype=object)
        self.text_sizes = np.array([len(x) for x in self.text])

    def one(self, a: list[int], text: str) -> tuple[int, int, int, str, bytes] | None:
        """(A tokens, B tokens, groups, their text, links) of space and text; none if the bytes of either side differ from it."""
        b = self.b.encode(text)
        x, y, whole = [self.a_bytes.get(i, b"") for i in a], [self.b_bytes[i] for i in b], (" " + text).encode("utf-8", "surrogatepass")
        if b"".join(x) != whole or b"".join(y) != whole:
            return None
        n, groups, links = aligned(a, [len(t) for t in x], b, [len(t) for t in y])
        return len(a), len(b), n, groups, np.array(links, dtype=np.int64).tobytes()

    def chunk(self, chunk: str) -> tuple | None:
        ids = np.frombuffer(self.a._chunk(chunk), dtype=np.uint16 if self.a.code == "H" else np.uint32)
        return self.one(ids.tolist(), chunk)

    def many(self, chunks: list[str]) -> list[tuple | None]:
        """The same for many tame chunks at once, as the sweep would find it: where a token of either side ends, a link ends.

        The chunks are encoded end to end, each with the space before it, so that both sides' bytes lie in one line.
        """
        whole = (" " + " ".join(chunks)).encode()
        a = self.quick.encode_to_numpy(whole.decode()).astype(np.int64)
        lists = self.b.encode(chunks)
        b = np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.cumsum([len(c.encode()) + 1 for c in chunks])
        n_b = np.array([len(x) for x in lists])
        same = b"".join([self.a_bytes[i] for i in a.tolist()]) == whole == b"".join([self.b_bytes[i] for i in b.tolist()])
        if not same or not np.array_equal(b_ends[np.cumsum(n_b) - 1], ends):
            return [self.chunk(c) for c in chunks]
        cuts = np.union1d(a_ends, b_ends)
        i, j = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
        both = cuts[(a_ends[i] == cuts) & (b_ends[j] == cuts)]
        links, upto = (a[i] << 32 | b[j]).tobytes(), np.searchsorted(cuts, ends, "right")
        group_a, group_b = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        at = np.concatenate([a + len(self.a_sizes) * (both[group_a] == a_ends), len(self.a_text) + b + len(self.b_sizes) * (both[group_b] == b_ends)])
        at = at[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")]
        text = "".join(self.text[at].tolist())
        n_a = np.diff(np.searchsorted(a_ends, ends, "right"), prepend=0)
        n_groups = np.diff(np.searchsorted(both, ends, "right"), prepend=0)
        marks = np.append(0, np.cumsum(self.text_sizes[at])[np.cumsum(n_a + n_b) - 1]).tolist()
        upto = np.append(0, 8 * upto).tolist()
        texts = [text[lo : hi - 1] for lo, hi in zip(marks, marks[1:], strict=False)]
        links = [links[lo:hi] for lo, hi in zip(upto, upto[1:], strict=False)]
        return list(zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), texts, links, strict=True))

    def learn(self, chunks: set[str]) -> None:
        for memory in (self.a.known, self.a.words):
            if len(memory) > self.a.most:
                memory.clear()
        missing = self.known.missing(chunks)
        tame = [c for c in missing if self.quick and TAME.fullmatch(c)]
        self.known.new.update((c, self.chunk(c)) for c in set(missing) - set(tame))
        for lo in range(0, len(tame), 20_000):
            some = tame[lo : lo + 20_000]
            self.known.new.update(zip(some, self.many(some), strict=True))

    def texts(self, texts: list[str | None]) -> list[list[tuple]]:
        """The parts of each text, one after another; none if it has no tokens."""
        split = [t.split(" ") if t and self.chunked and self.a.regular(t) else None for t in texts]
        self.learn({c for s in split if s for c in s})
        known, out = self.known.new, []
        for t, s in zip(texts, split, strict=True):
            parts = [known[c] for c in s] if s else [self.one(self.a.tokenizer.encode(" " + t, add_special_tokens=False).ids, t)] if t else []
            out.append([] if None in parts else parts)
        return out


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process, which serves many tasks."""
    return Aligner(a_path, b_path)


def _runs(a_path: str, b_path: str, radixes: int):
    """(id, text) -> a batch's run for each radix, and at radix -1 its documents and their links by number of the pair.

    Pairs of a batch are numbered by radix, A id and B id.
    """

    def flush(batch: int, docs: list[tuple]) -> pd.DataFrame:
        links = [np.frombuffer(d[5], dtype=np.int64) for d in docs]
        n = np.array([len(x) for x in links], dtype=np.int64)
        pairs, number = np.unique(np.concatenate(links), return_inverse=True)
        radix = (pairs >> 32) % radixes
        order = np.argsort(radix, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        held, times = np.unique(np.repeat(np.arange(len(docs)), n) * max(1, len(pairs)) + place[number], return_counts=True)
        doc, pair = held // max(1, len(pairs)), held % max(1, len(pairs))
        holding = np.bincount(pair, minlength=len(pairs))
        own = np.bincount(doc, minlength=len(docs))
        info = pack(*(np.array([d[k] or 0 for d in docs]) for k in range(4)), n, np.array([d[0] is None for d in docs]), own, np.diff(pair, prepend=0), times, kinds="i8 u4 u4 u4 u4 u1 u4 i4 u4")
        shas = b"".join(d[4] for d in docs)
        rows = [(batch, -1, len(info).to_bytes(8, "little") + info + shas)]
        pairs, radix = pairs[order], radix[order]
        cuts = np.searchsorted(radix, np.arange(radixes + 1))
        for r in np.flatnonzero(np.diff(cuts)):
            at = slice(cuts[r], cuts[r + 1])
            rows.append((batch, r, pack(pairs[at] >> 32, pairs[at] & 0xFFFFFFFF, holding[at], kinds="+u4 u4 u4")))
        return pd.DataFrame(rows, columns=["batch", "radix", "body"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.freeze()  # what is remembered has no cycles: it isn't gone through again and again
        part, no, docs, held = TaskContext.get().partitionId(), 0, [], 0
        known = aligner(a_path, b_path)
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                some = pdf.iloc[lo : lo + 1000]
                for i, parts in zip(some["id"], known.texts(some["text"].tolist()), strict=True):
                    x, y, n, groups, links = zip(*parts, strict=True) if parts else ((), (), (), (), ())
                    sha = hashlib.sha256(";".join(groups).encode()).digest() if parts else b""
                    links = b"".join(links)
                    docs.append((None if pd.isna(i) else int(i), sum(x), sum(y), sum(n), sha.ljust(32, b"\0"), links))
                    held += len(links) // 8
                    if held >= BATCH_LINKS or len(docs) >= 100_000:
                        yield flush((part << 24) + no, docs)
                        no, docs, held = no + 1, [], 0
        if docs:
            yield flush((part << 24) + no, docs)

    return run


def merged(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Runs of (A id, B id, documents) in order -> for each A id in turn, of each run that holds it, (run, counts, highest or not).

    The heap holds the next A id of each run. The records of an A id are what is in memory of all runs at once.
    """
    starts = [np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a)) for a, _, _ in runs]
    heap = [(int(a[0]), k, 0) for k, (a, _, _) in enumerate(runs) if len(a)]
    heapq.heapify(heap)
    while heap:
        a, taken = heap[0][0], []
        while heap and heap[0][0] == a:
            _, k, at = heap[0]
            taken.append((k, slice(starts[k][at], starts[k][at + 1])))
            if at + 2 < len(starts[k]):
                heapq.heapreplace(heap, (int(runs[k][0][starts[k][at + 1]]), k, at + 1))
            else:
                heapq.heappop(heap)
        _, which = np.unique(np.concatenate([runs[k][1][s] for k, s in taken]), return_inverse=True)
        count = np.bincount(which, weights=np.concatenate([runs[k][2][s] for k, s in taken])).astype(np.int64)
        told, best, cuts = count[which], (count == count.max())[which], np.cumsum([0, *(s.stop - s.start for _, s in taken)])
        yield [(k, told[lo:hi], best[lo:hi]) for (k, _), lo, hi in zip(taken, cuts, cuts[1:], strict=False)]


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """A radix's runs -> what each run's batch is told of its records."""
    told: list[list] = [[] for _ in range(len(pdf))]
    for found in merged([tuple(x.astype(np.int64) for x in unpack(body, "+u4 u4 u4")) for body in pdf["body"]]):
        for k, count, best in found:
            told[k].append((count, best))
    bodies = [pack(*(np.concatenate([x[n] for x in t]) for n in (0, 1)), kinds="u8 u1") for t in told]
    return pd.DataFrame({"batch": pdf["batch"], "radix": pdf["radix"], "body": bodies})


def _added(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The rows of a batch's documents, by the counts of its pairs that the radixes told."""
    if not len(docs):
        return pd.DataFrame({c.split()[0]: [] for c in RESULT.split(", ")})
    body = docs["body"].iloc[0]
    size = int.from_bytes(body[:8], "little")
    ids, n_a, n_b, n_groups, n_links, null, own, steps, times = unpack(body[8 : 8 + size], "i8 u4 u4 u4 u4 u1 u4 i4 u4")
    told = [unpack(x, "u8 u1") for x in answers.sort_values("radix")["body"]]
    count, best = (np.concatenate([np.zeros(0, dtype=np.int64), *(x[k].astype(np.int64) for x in told)]) for k in (0, 1))
    pair, ends = np.cumsum(steps, dtype=np.int64), np.cumsum(own, dtype=np.int64)
    sums = [np.append(0, np.cumsum(times * x[pair]))[np.array([ends - own, ends])] for x in (best, count)]
    shas = [body[8 + size + 32 * k :][:32].hex() if n else "" for k, n in enumerate(n_links)]
    out = {"id": pd.array(ids, dtype="Int64"), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "n_best": sums[0][1] - sums[0][0], "count_sum": sums[1][1] - sums[1][0], "groups_sha256": shas}
    out = pd.DataFrame(out)
    out.loc[null > 0, "id"] = pd.NA
    return out


def aligned_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row; the method is told above.

    A encodes a space and the text by a byte-level file of `tokenizers`, B the text by a piece model that puts the space
    there itself; special tokens' strings are plain text. A link is a pair of an A and a B token that share bytes, a
    group what lies between two places where tokens of both end. The count of a pair of ids is the number of rows that hold
    it linked; n_best are links with the highest count of their A id in the corpus, ties included; count_sum adds the counts
    of all links. groups_sha256 hashes `a1,a2|b1;a3|b2,b3`.

    Null and empty texts, and those of which either side's tokens don't give the bytes back (a U+2581 in the text, say),
    have zeros and an empty string. Rows are documents one by one: repeated rows or ids come back repeated and count each,
    a row without an id keeps its null. Other columns are ignored. No rows in, no rows out.
    """
    a_path, b_path = a_path or default_tokenizer(), b_path or default_pieces()
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    radixes = min(MOST_RADIXES, 8 + math.ceil(chars / RADIX_CHARS))
    runs = written(base.mapInPandas(_runs(a_path, b_path, radixes), RUNS), "runs")
    answers = runs.filter("radix >= 0").groupBy("radix").applyInPandas(_merge, RUNS)
    return runs.filter("radix < 0").groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(_added, RESULT)

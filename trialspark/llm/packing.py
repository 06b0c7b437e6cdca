"""Packing: concatenate and cut, by two passes of prefix sums over partitions' token totals."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.common import written


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: White space other than a space or a line break; a chunk of a word and the signs after it, perhaps over a line break.
RARE = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
LETTERS, SIGNS = r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+", r"[!-/:-@\[-`{-~]*"
SIMPLE = re.compile(rf"({LETTERS})({SIGNS})(?:\n({LETTERS})({SIGNS}))?")


def byte_signs() -> dict[int, str]:
    """The sign by which a byte-level vocabulary writes each byte: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def model_merger(tokenizer):
    """A function from one pre-token to its ids by the merges of `tokenizers` itself."""
    table = str.maketrans({chr(b): c for b, c in byte_signs().items()})
    return lambda word: [t.id for t in tokenizer.model.tokenize(word.encode("utf-8").decode("latin-1").translate(table))]


def rising_ranks(path: str) -> dict[bytes, int] | None:
    """Ranks of the file's tokens by their bytes, where ids rise in the order of the merges and so are the ranks; else none."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    vocab, signs = model["vocab"], byte_signs()
    made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if not all(c in vocab for c in signs.values()) or not all(x < y for x, y in zip(made, made[1:], strict=False)) or max(vocab[c] for c in signs.values()) >= made[0]:
        return None
    back = {ord(c): b for b, c in signs.items()}
    return {bytes(back[ord(c)] for c in t): k for t, k in vocab.items() if all(ord(c) in back for c in t)}


def merger(tokenizer, path: str):
    """A function from one pre-token to its ids by the vocabulary's merges.

    Where ids rise in the order of the merges, as in byte-level vocabularies of this family, they are also the ranks that
    tiktoken merges by, which is several times as fast; else the model of `tokenizers` merges.
    """
    if ranks := rising_ranks(path):
        import tiktoken

        return tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return model_merger(tokenizer)


class _Words(dict):
    """Ids of pre-tokens: a word or a run of signs, with the space before it."""

    def __init__(self, merge, code: str):
        self.merge, self.code = merge, code

    def __missing__(self, word: str) -> bytes:
        out = self[word] = array(self.code, self.merge(word)).tobytes() if word else b""
        return out


class ChunkTokenizer:
    """Token ids of whole texts by a byte-level BPE file of `tokenizers`, each distinct chunk between single spaces once.

    The tokenizer's pre-tokens never cross a space that stands alone between two characters which aren't white space, and
    such a space begins its pre-token. So a text's ids are those of its chunks, one after another. A chunk of letters, then
    signs, is two pre-tokens, whose merges are asked for alone; any other chunk is encoded as it is. A text that holds an
    added token of the file is encoded whole, and so is every text where the file's pre-tokenizer is another one.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(Path(path).read_text(encoding="utf-8"))
        rules = told["pre_tokenizer"] or {}
        self.chunked = told["normalizer"] is None and rules.get("type") == "ByteLevel" and rules.get("use_regex") and not rules.get("add_prefix_space")
        self.added = [t["content"] for t in told["added_tokens"]]
        self.code = "H" if self.tokenizer.get_vocab_size() < 1 << 16 else "I"
        self.words = _Words(merger(self.tokenizer, path), self.code)
        self.known: dict[str, bytes] = {}
        self.most = most

    @staticmethod
    def regular(text: str) -> bool:
        """Every space stands alone between two characters that aren't white space."""
        return not ("  " in text or "\n " in text or " \n" in text or text.startswith(" ") or text.endswith(" ") or RARE.search(text))

    def _plain(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that a space begins, which is left out here."""
        if m := SIMPLE.fullmatch(chunk):
            word, signs, after, more = m.groups()
            out = self.words[" " + word] + self.words[signs]
            if after:
                out += self.words["\n"] + self.words[after] + self.words[more]
        else:
            out = self._plain(" " + chunk)
        self.known[chunk] = out
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Unsigned ids, little-endian on such machines, of 16 bits if the vocabulary fits, else of 32."""
        for memory in (self.known, self.words):
            if len(memory) > self.most:
                memory.clear()
        regular = [bool(self.chunked) and self.regular(t) and not any(a in t for a in self.added) for t in texts]
        parts = pc.split_pattern(pa.array([t if r else "" for t, r in zip(texts, regular, strict=True)], pa.large_string()), " ")
        flat = parts.flatten().dictionary_encode()
        known = self.known.get
        ids = [known(c) or self._chunk(c) for c in flat.dictionary.to_numpy(zero_copy_only=False).tolist()]
        at, ends = flat.indices.to_numpy().tolist(), parts.offsets.to_numpy().tolist()
        out = []
        for text, r, a, b in zip(texts, regular, ends, ends[1:], strict=False):
            if not r or not text:
                out.append(self._plain(text) if text else b"")
            else:
                out.append(self._plain(text[: text.find(" ")] if b - a > 1 else text) + b"".join([ids[k] for k in at[a + 1 : b]]))
        return out


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One for each worker process, which serves many tasks."""
    return ChunkTokenizer(path)


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer, part, before = chunk_tokenizer(path), TaskContext.get().partitionId(), 0
        end = array(tokenizer.code, [end_id]).tobytes()
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                some = pdf.iloc[at : at + 1000]
                ids = [x + end for x in tokenizer.encode([t or "" for t in some["text"]])]
                n = np.array([len(x) // len(end) for x in ids], dtype=np.int64)
                yield pd.DataFrame({"id": some["id"], "part": part, "before": before + np.cumsum(n) - n, "n": n, "ids": ids})
                before += int(n.sum())

    return run


def _cut(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, begin, n, ids in zip(pdf["id"], pdf["begin"], pdf["n"], pdf["ids"], strict=True):
                at, ids = 0, ids if len(ids) == 4 * n else np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()
                while at < n:
                    sequence, offset = divmod(begin + at, length)
                    take = min(length - offset, n - at)
                    rows.append((i, at, take, ids[4 * at : 4 * (at + take)], n, sequence, offset))
                    at += take
            yield pd.DataFrame(rows, columns=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """(id, part, before, n, ids): ids of a text and the end, and how many ids of its partition `part` come before; written.

    ids are stored in 16 bits each if the vocabulary fits, else in 32.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    run = _tokenise(tokenizer or default_tokenizer(), end_id)
    return written(base.mapInPandas(run, "id long, part long, before long, n long, ids binary"), "token-ids")


def packed_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, length: int = 2048) -> DataFrame:
    """All documents end to end, cut into sequences of `length` ids: (id, start, length, ids, doc_tokens, sequence_id, offset).

    First pass: each partition counts the ids before each document and its total. Prefix sums over the totals, a row for
    each partition, give global offsets. Second pass: documents are cut where a window ends, so that a document which
    crosses a boundary gives a piece to either side. Only the last sequence is short; nothing else is padded. ids are
    little-endian unsigned 32-bit numbers. A null or empty text is its end id alone. Rows without an id are packed too.
    The order is that of the scan's partitions. No rows in, no rows out.
    """
    ids = tokenised(docs, id_col, text_col, tokenizer, end_id)
    totals = ids.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    offsets = totals.withColumn("base", F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("total"))
    placed = ids.join(F.broadcast(offsets.select("part", "base")), "part").select("id", (F.col("base") + F.col("before")).alias("begin"), "n", "ids")
    return placed.mapInPandas(_cut(length), "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def piece_digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces with a checksum of their ids in place of them."""
    return pieces.select(F.col("id").alias(id_col), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

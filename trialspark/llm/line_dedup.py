"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from trialspark.llm.common import join_counted, packed, written

BLANK = b" \t\n\x0b\x0c\r"


def line_hashes(text: str | None, min_chars: int) -> list[bytes]:
    """For each line its key's 128-bit hash, or b"" where the key has under min_chars code points."""
    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
        key = line.strip(BLANK)
        long = len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode("utf-8", "surrogatepass")) >= min_chars
        out.append(hashlib.blake2b(key, digest_size=16).digest() if long else b"")
    return out


def _exploded(min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                ids, hashes = [], []
                for i, text in zip(pdf["id"].iloc[at : at + 1000], pdf["text"].iloc[at : at + 1000], strict=True):
                    found = set(line_hashes(text, min_chars)) - {b""}
                    ids += [i] * len(found)
                    hashes += found
                h = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
                yield pd.DataFrame({"h1": h[:, 0], "h2": h[:, 1], "id": np.array(ids, dtype=np.int64)})

    return run


def _reassembler(min_chars: int):
    @pandas_udf("text string, n_lines long, n_dropped long")
    def reassemble(texts: pd.Series, lost: pd.Series) -> pd.DataFrame:
        rows = []
        for text, bad in zip(texts, lost, strict=True):
            if bad is None:
                rows.append((text or "", (text or "").count("\n") + 1, 0))
                continue
            gone = {bytes(x) for x in bad}
            lines = (text or "").split("\n")
            kept = [line for line, h in zip(lines, line_hashes(text, min_chars), strict=True) if h not in gone]
            rows.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    return reassemble


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop lines whose key stands in min_docs or more documents, except in the largest id that holds it.

    Texts split at newline; a line's key is the line without ASCII white space at its ends, A-Z in lower case. Only
    keys of min_chars code points or more count. All lines of a document with a lost key go; the others stay in place.

    Returns (row, text, n_lines, n_dropped): row is the input row as a struct, text the reassembled text, n_lines counts
    before dropping. A null or empty text is one empty line and comes back empty. Rows without an id are kept whole and
    count for nothing. Rows that share an id are one document. No rows in, no rows out.
    """
    base = packed(docs, id_col, text_col)
    base = base.withColumn("id", F.col("id").cast("long"))
    holds = base.filter("id IS NOT NULL AND text IS NOT NULL").select("id", "text").mapInPandas(_exploded(min_chars), "h1 long, h2 long, id long")
    holds = written(holds.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one")).drop("one"), "lines")
    common = written(holds.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs), "common-lines")
    as_bytes = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("h1", "h2")]))
    lost = join_counted(holds, common, ["h1", "h2"], "n").filter("id <> keeper")
    lost = lost.groupBy("id").agg(F.collect_list(_little_endian(as_bytes)).alias("lost"))
    out = base.join(lost, "id", "left").withColumn("out", _reassembler(min_chars)("text", "lost"))
    return out.select("row", "out.text", "out.n_lines", "out.n_dropped")


def _little_endian(sixteen):
    """Both halves of 16 bytes turned round, as the hashes were read as little-endian numbers."""
    half = lambda at: F.concat(*[F.substring(sixteen, i, 1) for i in range(at + 7, at - 1, -1)])
    return F.concat(half(1), half(9))

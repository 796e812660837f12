"""Byte-level BPE as a monoid: halves are encoded on their own and joined by re-encoding what lies around the seam.

A text is cut in halves until a piece is short; pieces are encoded by the rank
table, and neighbours are joined up the tree. Joining re-encodes a window around
the seam that grows on either side until it meets a *fixed boundary*: a space
after a character that is no white space. No alternative of the split pattern
matches a non-space followed by a space, and what stands before such a boundary
is split without looking past it, so a boundary of that kind ends one match and
starts another in every text that contains it. Tokens outside the window are
therefore the same in the joined text, and the window's own tokens are exactly
those of the joined text. Where no fixed boundary exists the window grows to the
whole half, which is the plain encoding.

Defined results: a null text counts as empty, an empty text has no tokens, the
digest of no ids is the digest of the empty string. Repeated rows give repeated
results. Only the named columns are read, so other columns never clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import texts

PIECE = 8192
# White space of the split pattern. Runs of a million characters exhaust the library's backtracking stack, so long
# runs are cut out by the rule that the pattern states for them: all but the last character before a non-space.
LONG_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{50000,}")


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file's contents; one per Python worker."""
    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def plain(enc: tiktoken.Encoding, text: str) -> list[int]:
    """Token ids of a text without a tree."""
    if len(text) < 50_000:
        return enc.encode_ordinary(text)
    ids, done = [], 0
    for run in LONG_RUN.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        ids += enc.encode_ordinary(text[done : run.start()]) + enc._encode_single_piece(text[run.start() : stop])
        done = stop
    return ids + enc.encode_ordinary(text[done:])


def _boundary_before(text: str, start: int, seam: int) -> int:
    """The last fixed boundary in (start, seam], or ``start``."""
    at = seam if seam < len(text) and text[seam] == " " else text.rfind(" ", start + 1, seam)
    while at > start and text[at - 1].isspace():
        at = text.rfind(" ", start + 1, at)
    return at if at > start else start


def _boundary_after(text: str, seam: int, end: int) -> int:
    """The first fixed boundary in (seam, end), or ``end``."""
    at = text.find(" ", seam + 1, end)
    while at > 0 and text[at - 1].isspace():
        at = text.find(" ", at + 1, end)
    return at if at > 0 else end


def join(enc: tiktoken.Encoding, text: str, start: int, seam: int, end: int, left: list[int], right: list[int]) -> list[int]:
    """Tokens of ``text[start:end]`` from those of its two sides."""
    low = _boundary_before(text, start, seam)
    if low == seam:
        return left + right
    high = _boundary_after(text, seam, end)
    tail = len(left) if low == start else len(plain(enc, text[low:seam]))
    head = len(right) if high == end else len(plain(enc, text[seam:high]))
    return left[: len(left) - tail] + plain(enc, text[low:high]) + right[head:]


def encode_text(enc: tiktoken.Encoding, text: str, piece: int = PIECE) -> list[int]:
    """Token ids of a whole text by tree reduction."""

    def reduce(start: int, end: int) -> list[int]:
        if end - start <= piece:
            return plain(enc, text[start:end])
        seam = (start + end) // 2
        return join(enc, text, start, seam, end, reduce(start, seam), reduce(seam, end))

    return reduce(0, len(text))


def decode_ids(enc: tiktoken.Encoding, ids: list[int], piece: int = PIECE) -> bytes:
    """The bytes of token ids: decoding is a homomorphism, so halves just concatenate."""
    if len(ids) <= piece:
        return enc.decode_bytes(ids)
    half = len(ids) // 2
    return decode_ids(enc, ids[:half], piece) + decode_ids(enc, ids[half:], piece)


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``token_ids``; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    @F.pandas_udf("array<int>")
    def ids(column: pd.Series) -> pd.Series:
        enc = encoding(*shared.value)
        return pd.Series([encode_text(enc, t if isinstance(t, str) else "") for t in column], dtype=object)

    return docs.withColumn("token_ids", ids(F.col(text)))


def decode(tokens: DataFrame, ranks: bytes, pattern: str, ids: str = "token_ids") -> DataFrame:
    """All columns of ``tokens`` and ``decoded`` (binary); null ids give no bytes."""
    shared = tokens.sparkSession.sparkContext.broadcast((ranks, pattern))

    @F.pandas_udf("binary")
    def data(column: pd.Series) -> pd.Series:
        enc = encoding(*shared.value)
        return pd.Series([decode_ids(enc, [] if x is None else list(map(int, x))) for x in column], dtype=object)

    return tokens.withColumn("decoded", data(F.col(ids)))


def digests(docs: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Count and digests of each text's ids and of the bytes they decode to, in one pass; with ``keep_ids`` the ids too.

    Bytes, and ids unless kept, stay inside the task that makes them.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(*shared.value)
        names = [str(i) for i in range(enc.n_vocab)]
        for frame, batch in texts(frames, text):
            counts, of_ids, of_bytes, kept = [], [], [], []
            for t in batch:
                ids = encode_text(enc, t)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(decode_ids(enc, ids)).hexdigest())
                if keep_ids:
                    kept.append(np.array(ids, dtype="i4"))
            out = {key: frame[key], "n_tokens": counts, "ids_sha256": of_ids, "decoded_sha256": of_bytes}
            yield pd.DataFrame(out | {"token_ids": kept} if keep_ids else out)

    schema = f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids
    return docs.select(key, text).mapInPandas(run, schema)

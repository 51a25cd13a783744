"""Encoding of texts with a public byte-level vocabulary: problem 8."""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctilake.llm import codepoints as C
from ctilake.sources.tables import table

TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
CACHE_PIECES = 400_000

# Classes of code points. LSDMT and the single letters matter only behind an apostrophe.
LETTER, SDMT, EL, VE, ER, EE, NUMBER, SYMBOL, APOSTROPHE, SPACE, WHITE, RESET = range(12)
# States: what the code point just read belongs to. DONE is behind a contraction and at the start of a row.
DONE, IN_LETTERS, IN_NUMBERS, IN_SYMBOLS, AT_SPACE, AT_WHITE, QUOTE, QUOTE_L, QUOTE_V, QUOTE_R = range(10)


def _transitions() -> np.ndarray:
    """next state by (class, state)."""
    t = np.zeros((12, 10), np.uint8)
    t[LETTER : EE + 1] = IN_LETTERS
    t[NUMBER], t[SYMBOL], t[SPACE], t[WHITE], t[RESET] = IN_NUMBERS, IN_SYMBOLS, AT_SPACE, AT_WHITE, DONE
    t[APOSTROPHE] = QUOTE
    t[APOSTROPHE, [IN_SYMBOLS, AT_SPACE, QUOTE]] = IN_SYMBOLS  # inside a run of symbols no contraction begins
    t[SDMT, QUOTE] = DONE
    t[EL, QUOTE], t[VE, QUOTE], t[ER, QUOTE] = QUOTE_L, QUOTE_V, QUOTE_R
    t[EL, QUOTE_L] = t[EE, QUOTE_V] = t[EE, QUOTE_R] = DONE
    return t


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point, made by rule from the character database."""
    out = np.full(0x110000, SYMBOL, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            out[c] = LETTER
        elif kind[0] == "N":
            out[c] = NUMBER
    out[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    out[0x20], out[0x27] = SPACE, APOSTROPHE
    out[list(map(ord, "sdmt"))], out[ord("l")], out[ord("v")], out[ord("r")], out[ord("e")] = SDMT, EL, VE, ER, EE
    return out


def states(classes: np.ndarray) -> np.ndarray:
    """State behind every code point, by an associative scan over transition functions.

    A class that sends every state to the same one fixes the state by itself. The others stand
    only near apostrophes; for them the functions of a chain are composed by doubling, so a chain
    of n takes log n steps over arrays.
    """
    t = _transitions()
    fixed = np.array([len(set(row)) == 1 for row in t.tolist()])
    near = np.zeros(len(classes) + 2, bool)
    quote = np.flatnonzero(classes == APOSTROPHE)
    near[quote + 1] = near[quote + 2] = True
    near = near[: len(classes)]
    open_ = (classes == APOSTROPHE) | (near & (classes >= SDMT) & (classes <= EE))
    out = t[classes, 0]
    at = np.flatnonzero(open_ & ~fixed[classes])
    if len(at):
        chain = np.concatenate(([True], np.diff(at) != 1))
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
        f, step = t[classes[at]], 1
        while step <= rank.max():
            later = np.flatnonzero(rank >= step)
            f[later] = np.take_along_axis(f[later], f[later - step].astype(np.int64), 1)
            step *= 2
        first = at - rank
        before = np.where(first > 0, out[np.maximum(first - 1, 0)], DONE)
        out[at] = f[np.arange(len(at)), before]
    return out


@functools.cache
def _continues() -> np.ndarray:
    """Whether a code point of a class goes on with the piece of the state before it, by (state, class)."""
    t = np.zeros((10, 12), bool)
    for state in (IN_LETTERS, AT_SPACE, QUOTE_L, QUOTE_V, QUOTE_R):
        t[state, LETTER : EE + 1] = True
    for state in (IN_NUMBERS, AT_SPACE):
        t[state, NUMBER] = True
    for state in (IN_SYMBOLS, AT_SPACE, QUOTE):
        t[state, [SYMBOL, APOSTROPHE]] = True
    for state in (AT_SPACE, AT_WHITE):
        t[state, [SPACE, WHITE]] = True
    return t


def boundaries(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions where a piece begins, in order, over all rows at once; every row begins one."""
    n = len(cps)
    here = _classes()[cps]
    rows = starts[:-1][starts[:-1] < starts[1:]]
    # a reset between rows: one scan covers them all, and no piece crosses a row
    begins = np.zeros(n, np.int64)
    begins[rows] = 1
    at = np.arange(n) + np.cumsum(begins)
    padded = np.full(n + len(rows), RESET, np.uint8)
    padded[at] = here
    s = states(padded)
    before, now = s[at - 1], s[at]
    cut = ~_continues()[before, here]
    # contractions join their apostrophe, and for the long ones the letter between
    done = np.flatnonzero(now == DONE)
    cut[done] = False
    cut[done[before[done] >= QUOTE_L] - 1] = False
    # white space before a visible character: its last one stands apart from the rest of the run
    white = here >= SPACE
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:]
    last[rows[1:] - 1] = False
    last &= (before == AT_SPACE) | (before == AT_WHITE)
    cut[last] = True
    cut[rows] = True
    return np.flatnonzero(cut)


class Pieces(dict):
    """Bytes of a piece to its ids as int32 bytes; unknown pieces go through pair merging once."""

    def __init__(self, directory: str, name: str = VOCABULARY):
        import tiktoken

        path = Path(directory) / name
        with open(path if path.exists() else SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.of = {i: p for p, i in ranks.items()}
        self._merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary  # all of a piece is one match

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(self._merge(piece.decode("utf-8")), np.int32).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@functools.cache
def pieces(directory: str) -> Pieces:
    return Pieces(directory)


_sent: set[tuple[str, str]] = set()


def send_vocabulary(spark: SparkSession, directory: str) -> None:
    """Give the vocabulary file to the executors once, for those that do not have the folder."""
    sc = spark.sparkContext
    if (sc.applicationId, directory) not in _sent:
        sc.addFile(str(Path(directory) / VOCABULARY))
        _sent.add((sc.applicationId, directory))


def encode_rows(part: pa.Array, directory: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows in one array, and where each row's ids begin; null and empty rows have none."""
    cache = pieces(directory)
    if len(cache) > CACHE_PIECES:
        cache.clear()
    blob, off = C.utf8(part)
    cps, at, starts = C.decode(blob, off)
    cut = boundaries(cps, starts) if len(cps) else np.zeros(0, np.int64)
    byte = at[np.append(cut, len(cps))].tolist()
    found = [cache[blob[a:b]] for a, b in zip(byte, byte[1:])]
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    per_piece = np.concatenate(([0], np.cumsum(sizes)))
    return np.frombuffer(b"".join(found), np.int32), per_piece[np.searchsorted(cut, starts)]


def _ids(directory: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in C.chunks(batch.column(1)):
                ids, at = encode_rows(part, directory)
                out = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), out], ["key", "ids"])
                done += len(part)

    return run


def encode(df: DataFrame, key: str, text: str, directory: str = TOKENIZERS) -> DataFrame:
    """(key, ids) by byte_bpe_50k without special tokens; their strings in a text are ordinary text.

    Empty and null texts have the defined result of an empty list. Rows stay in their partition;
    a worker keeps at most CACHE_PIECES pieces.
    """
    send_vocabulary(df.sparkSession, directory)
    return df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_ids(directory), "key bigint, ids array<int>")


def _lossless(directory: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pieces(directory).of
        for batch in batches:
            done = 0
            for part in C.chunks(batch.column(1)):
                ids, at = encode_rows(part, directory)
                blob, off = C.utf8(part)
                tokens = list(map(of.__getitem__, ids.tolist()))
                size = np.concatenate(([0], np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))))
                same = b"".join(tokens) == blob and np.array_equal(size[at], off)
                n = len(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), pa.array(np.diff(at)), pa.array(np.diff(off)), pa.array(np.full(n, same))], ["key", "n_tokens", "n_bytes", "lossless"])
                done += n

    return run


def lengths(df: DataFrame, key: str, text: str, directory: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens, n_bytes, lossless): decoding by the retained offsets gives every text back."""
    send_vocabulary(df.sparkSession, directory)
    return df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_lossless(directory), "key bigint, n_tokens bigint, n_bytes bigint, lossless boolean")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document: (doc_id, ids)."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document and whether decoding its ids gives it back."""
    return lengths(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "n_bytes", "lossless")


QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip}
SQL = {"p8_round_trip": "select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as n_bytes, true as lossless from documents"}

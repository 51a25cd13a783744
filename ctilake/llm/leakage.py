"""Passages of held-out items inside training texts, found with an Aho-Corasick automaton: problem 6."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctilake.sources.tables import cut, table

WORDS = 12
BLOCK = WORDS // 2
SHARD_CHARS = 16_000_000
SHARED = 4
DIGITS = 32
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Longest runs of letters and digits, in lower case."""
    low = text.lower()
    return _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]


class Passages:
    """Automaton over the held-out texts of one shard.

    Each word of the shard is spelled with a fixed number of letters, its number in base DIGITS, and
    every place of a word has letters of its own. So a node has few children, however many words
    there are, and matches begin at words only. The patterns are the blocks of six words at every
    sixth place of an item: any twelve consecutive words hold one of them whole. A match is then
    extended in both directions. Blocks that more than SHARED items hold lead through a table of
    their twelve-word windows, so that a common phrase costs a lookup and not a list.
    """

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.numbers: dict[str, int] = {}
        self.items: dict[int, array] = {}
        for i, t in items:
            if len(ws := words(t)) >= WORDS:
                self.items[i] = array("i", [self.numbers.setdefault(x, len(self.numbers)) for x in ws])
        self.places = 1
        while DIGITS**self.places < len(self.numbers):
            self.places += 1
        self.letters = {w: "".join(chr(1 + place * DIGITS + n // DIGITS**place % DIGITS) for place in range(self.places)) for w, n in self.numbers.items()}
        self.unknown = "\0" * self.places
        by_number = list(self.letters.values())
        blocks: dict[str, list[tuple[int, int]]] = {}
        for i, ns in self.items.items():
            for at in range(0, len(ns) - BLOCK + 1, BLOCK):
                blocks.setdefault("".join([by_number[n] for n in ns[at : at + BLOCK]]), []).append((i, at))
        self.windows: dict[bytes, list[tuple[int, int]]] = {}
        self.automaton = ahocorasick.Automaton()
        for block, places in blocks.items():
            if len(places) > SHARED:
                for i, at in places:
                    for start in range(max(0, at - WORDS + BLOCK), min(at, len(self.items[i]) - WORDS) + 1):
                        held = self.windows.setdefault(self.items[i][start : start + WORDS].tobytes(), [])
                        if (i, start) not in held[-2:]:
                            held.append((i, start))
                places = None
            self.automaton.add_word(block, places)
        self.any = bool(blocks)
        if self.any:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """Items of which WORDS consecutive words stand in ``text``: {item: (first word, words) of the longest passage, the first of several}."""
        names = words(text)
        if len(names) < WORDS or not self.any:
            return {}
        get, unknown = self.letters.get, self.unknown
        ws = None
        found: dict[int, tuple[int, int]] = {}
        tried = set()
        for end, places in self.automaton.iter("".join([get(w, unknown) for w in names])):
            if ws is None:
                ws = array("i", [self.numbers.get(w, -1) for w in names])
            at = (end + 1) // self.places - BLOCK
            if places is None:
                places = [(i, start + at - first) for first in range(max(0, at - WORDS + BLOCK), min(at, len(ws) - WORDS) + 1) for i, start in self.windows.get(ws[first : first + WORDS].tobytes(), ())]
            for i, place in places:
                if (i, place - at) in tried:
                    continue
                item = self.items[i]
                a, b = at, at
                while a > 0 and place - (at - a) > 0 and ws[a - 1] == item[place - (at - a) - 1]:
                    a -= 1
                while b < len(ws) and place + (b - at) < len(item) and ws[b] == item[place + (b - at)]:
                    b += 1
                if b - a >= WORDS:
                    tried.add((i, place - at))
                    if (b - a, -a) > (found[i][1], -found[i][0]) if i in found else True:
                        found[i] = (a, b - a)
        return found


_built: dict[int, Passages] = {}


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.id not in _built:
            _built.clear()
            _built[shared.id] = Passages(shared.value)
        find = _built[shared.id].find
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if hits := find(text):
                    spans = [m.span() for m in _WORD.finditer(text)]
                    out += [(i, key, spans[a][0], spans[a + n - 1][1], n) for i, (a, n) in hits.items()]
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["text_class", "post_key", "char_start", "char_end", "n_words"])

    return run


class _Shared:
    """A broadcast with an id that workers can key their automaton by."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def leaks(items: DataFrame, item_key: str, item_text: str, posts: DataFrame, post_key: str, post_text: str) -> DataFrame:
    """(item_id, post_key, char_start, char_end, n_words): longest shared passage of at least 12 words.

    Equal item texts are one class and are expanded by a join at the end. The held-out texts are
    cut into shards of at most about SHARD_CHARS characters; the number of characters is counted
    first, so what the driver gathers and broadcasts is bounded. Larger evaluation sets take one scan
    of the posts for each shard, one after the other: a scan is finished and its shard dropped before
    the next is gathered. Null texts and texts of fewer than 12 words match nothing.
    """
    held = items.filter(F.col(item_text).isNotNull()).select(F.col(item_key).alias("item_id"), F.col(item_text).alias("_text"))
    held = held.withColumn("_class", F.xxhash64("_text")).withColumn("_class2", F.xxhash64(F.lit(3), "_text"))
    classes = cut(held.groupBy("_class", "_class2").agg(F.min("item_id").alias("text_class"), F.first("_text").alias("_text")))
    chars = classes.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()[0]
    shards = -(-chars // SHARD_CHARS)
    scanned = posts.filter(F.col(post_text).isNotNull()).select(F.col(post_key).cast("bigint").alias("key"), F.col(post_text).cast("string").alias("text"))
    schema = "text_class bigint, post_key bigint, char_start bigint, char_end bigint, n_words bigint"
    found = None
    for shard in range(max(1, shards)):
        part = [(r[0], r[1]) for r in classes.filter(F.pmod("_class", F.lit(max(1, shards))) == shard).select("text_class", "_text").toLocalIterator()]
        broadcast = items.sparkSession.sparkContext.broadcast(part)
        one = scanned.mapInArrow(_scan(_Shared(broadcast)), schema)
        if shards > 1:
            one = cut(one)
            broadcast.destroy()
        found = one if found is None else found.unionByName(one)
    member = held.join(classes.select("_class", "_class2", "text_class"), ["_class", "_class2"]).select("item_id", "text_class")
    return found.join(member, "text_class").select("item_id", "post_key", "char_start", "char_end", "n_words")


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "task1_cve_linkage").filter(F.col("split").isin("val", "test"))
    return leaks(items, "item_id", "text", table(spark, sf_dir, "forum_posts"), "post_key", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out items and the posts that hold twelve consecutive words of them: (item_id, post_key)."""
    return _all(spark, sf_dir).select("item_id", "post_key")


def p6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with the longest passage's place in the post's own characters."""
    return _all(spark, sf_dir)


QUERIES = {"p6_found": p6_found, "p6_passages": p6_passages}
SQL = {
    "p6_found": r"""
with i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from task1_cve_linkage where split <> 'train' and text is not null), p as (select post_key, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from forum_posts where text is not null),
a as (select distinct item_id, unnest([array_to_string(w[k:k + 11], ' ') for k in range(1, len(w) - 10)]) as s from i), b as (select distinct post_key, unnest([array_to_string(w[k:k + 11], ' ') for k in range(1, len(w) - 10)]) as s from p)
select distinct item_id, post_key from a join b on a.s = b.s""",
}

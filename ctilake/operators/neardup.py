"""Near-duplicates by exact set similarity of word shingles, SimHash edges, and the greedy kept set."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctilake.sources.tables import cut

SHINGLE, SIMILARITY = 5, 0.8
CELL_BITS = 16
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([^ \t\n\r\f\x0B]+)"), F.lit(1))


def shingles(ws: Column, n: int = SHINGLE) -> Column:
    """Distinct runs of ``n`` words; a shorter text is one shingle of all its words, and an empty one has none."""
    many = F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " "))
    return F.when(F.size(ws) >= n, F.array_distinct(many)).when(F.size(ws) > 0, F.array(F.array_join(ws, " "))).otherwise(F.array().cast("array<string>"))


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id): rows with the same words are one class, named by its smallest key. Null and blank texts are left out."""
    rows = df.select(F.col(key).alias("key"), F.array_join(words(F.coalesce(F.col(text), F.lit(""))), " ").alias("w")).filter("w <> ''").select("key", F.xxhash64("w").alias("h"), F.xxhash64(F.lit(1), "w").alias("g"))
    reps = rows.groupBy("h", "g").agg(F.min("key").alias("class_id"))
    return rows.join(reps, ["h", "g"]).select("key", "class_id")


def hashed_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, s, n): one row for every class of rows with the same words, under its smallest key, with the hashes of its shingles. One scan."""
    ws = words(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.explode(F.array(ws)).alias("w")).filter(F.size("w") > 0)
    rows = rows.select("key", F.xxhash64("w").alias("h"), F.xxhash64(F.lit(1), "w").alias("g"), F.transform(shingles(F.col("w")), lambda x: F.xxhash64(x)).alias("s"))
    return rows.groupBy("h", "g").agg(F.min("key").alias("key"), F.first("s").alias("s")).select("key", "s", F.size("s").alias("n"))


def _cell(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    return np.asarray(lists.flatten(), np.int64), sizes


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << CELL_BITS, np.int64)
    for batch in batches:
        total += np.bincount(_cell(_flat(batch.column(0))[0]), minlength=len(total))
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])


def _prefixes(common: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, sizes = _flat(batch.column(1))
            owner, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
            order = np.lexsort((h, common[_cell(h)], owner))
            at = np.arange(len(h)) - starts[owner]
            kept = at < (sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1)[owner]
            keys = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys[owner[kept]]), pa.array(sizes[owner[kept]], pa.int32()), pa.array(h[order][kept]), pa.array(at[kept], pa.int32())], ["key", "n", "x", "at"])

    return run


def jaccard_edges(df: DataFrame, key: str, text: str, threshold: float = SIMILARITY) -> DataFrame:
    """(a, b, jaccard), a < b: classes of rows whose shingle sets are similar, by an exact join.

    Shingles are ordered by how many of all fall in their cell of hashes, then by hash: any one order
    serves. Two sets that are similar enough share a shingle of the first few of either, so only those
    prefixes are shuffled, once; sizes and places that cannot reach the threshold are dropped in the
    join, and the rest are verified on whole sets.
    """
    sets = cut(hashed_sets(df, key, text))
    common = np.zeros(1 << CELL_BITS, np.int64)
    for cell, n in sets.select("s").mapInArrow(_count_cells, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n")).collect():
        common[cell] = n
    prefix = cut(sets.select("key", "s").mapInArrow(_prefixes(common, threshold), "key bigint, n int, x bigint, at int"))
    a, b = (prefix.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), "x", F.col("at").alias(f"p{x}")) for x in "ab")
    fits = (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9)
    # from the shared shingle on, no more can be common than either set has left, and before it no more than the places before it
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + F.least("pa", "pb")
    reach = most >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9
    pairs = a.join(b, "x").filter((F.col("a") < F.col("b")) & fits & reach).select("a", "b").distinct()
    whole = lambda side: sets.select(F.col("key").alias(side), F.col("s").alias(f"s{side}"))
    both = pairs.join(whole("a"), "a").join(whole("b"), "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.select("a", "b", (F.col("i") / (F.size("sa") + F.size("sb") - F.col("i"))).alias("jaccard")).filter(F.col("jaccard") >= threshold - 1e-9)


def _simhash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for hashes in batch.column(1).to_pylist():
            h = np.array(hashes, np.int64)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out.append(int(np.packbits(bits * 2 > len(h), bitorder="little").view(np.int64)[0]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["key", "sim"])


def simhash_edges(df: DataFrame, key: str, text: str, hamming: int = 3) -> DataFrame:
    """(a, b, distance), a < b: classes whose 64-bit SimHashes differ in at most three bits.

    The hash is cut in five blocks, two of which such hashes share: ten tables with keys of 26 bits,
    wide enough that chance pairs stay few. Pairs found in several tables are one.
    """
    if not 0 <= hamming <= 3:
        raise ValueError("two of five blocks find distances up to 3")
    sims = cut(hashed_sets(df, key, text).select("key", "s").mapInArrow(_simhash, "key bigint, sim bigint"))
    blocks = [F.shiftrightunsigned("sim", 13 * i).bitwiseAND(F.lit((1 << 13) - 1)) for i in range(5)]
    keys = F.array(*[F.shiftleft(F.shiftleft(x, 13).bitwiseOR(y), 8).bitwiseOR(F.lit(i)) for i, (x, y) in enumerate(itertools.combinations(blocks, 2))])
    keyed = sims.select("key", "sim", F.explode(keys).alias("k"))
    a, b = keyed.select(F.col("key").alias("a"), F.col("sim").alias("sa"), "k"), keyed.select(F.col("key").alias("b"), F.col("sim").alias("sb"), "k")
    d = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb")))
    return a.join(b, "k").filter((F.col("a") < F.col("b")) & (d <= hamming)).select("a", "b", d.alias("distance")).distinct()


def greedy_kept(nodes: DataFrame, edges: DataFrame, order: Column | None = None) -> DataFrame:
    """(key, kept): the set that visiting nodes in order keeps when a node goes if a kept neighbour came before.

    Rounds of two joins: nodes with a kept earlier neighbour go, nodes without an undecided earlier
    neighbour stay, until every node is decided: each round decides the first open node at least.
    Every round is cut through the checkpoint folder. ``nodes`` is (key), edges (a, b), the order by
    key unless given as a column of nodes named ``rank``.
    """
    rank = nodes.select("key", (F.col("key") if order is None else order).alias("rank"))
    e = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    e = e.join(rank.select(F.col("key").alias("a"), F.struct("rank", "key").alias("ra")), "a").join(rank.select(F.col("key").alias("b"), F.struct("rank", "key").alias("rb")), "b").filter("rb < ra")
    later = cut(e.select("a", "b"))  # a comes after its neighbour b
    touched = later.select(F.col("a").alias("key")).distinct()
    state = cut(rank.join(touched.withColumn("open", F.lit(True)), "key", "left").select("key", F.when(F.col("open"), F.lit(None).cast("boolean")).otherwise(True).alias("kept")))
    before = None
    while still_open := state.filter("kept is null").count():
        if still_open == before:
            raise ValueError("nodes wait for one another: keys must be unique")
        before = still_open
        around = later.join(state.select(F.col("key").alias("b"), F.col("kept").alias("kb")), "b").groupBy(F.col("a").alias("key")).agg(F.max(F.coalesce("kb", F.lit(False))).alias("has_kept"), F.max(F.col("kb").isNull()).alias("has_open"))
        state = cut(state.join(around, "key", "left").select("key", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("has_kept"), False).when(~F.col("has_open"), True).alias("kept")))
    return state


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs of three characters of all texts as numbers, where those of a text begin, how many it has); texts have three characters at least."""
    size = np.array([len(t) for t in texts], np.int64)
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    runs = c[:-2] | c[1:-1] << 21 | c[2:] << 42
    inside = np.arange(len(runs)) - np.repeat(np.cumsum(size) - size, size)[: len(runs)] < np.repeat(size, size)[: len(runs)] - 2
    return runs[inside], np.cumsum(size - 2) - (size - 2), size - 2


def _mixed(codes: np.ndarray) -> np.ndarray:
    return (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def _minhash(bands: int, rows: int):
    rnd = np.random.default_rng(7)
    a, b = rnd.integers(0, 2**31, bands * rows, dtype=np.uint32) * 2 + 1, rnd.integers(0, 2**32, bands * rows, dtype=np.uint32)
    weights = rnd.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    place = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, first, size = _codes(batch.column(1).to_pylist())
            n, h = [], []
            for at, many in zip(first, size):
                own = np.unique(codes[at : at + many])
                x = _mixed(own)
                low = np.full(len(a), 0xFFFFFFFF, np.uint32)
                for piece in np.array_split(x, -(-len(x) // 4096)):
                    low = np.minimum(low, ((piece[:, None] ^ b) * a).min(0))
                n.append(len(own))
                h.append((low.reshape(bands, rows).astype(np.uint64) @ weights + place).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(n) + 1, bands), pa.int32()), pa.array(np.concatenate(h)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), lists], ["key", "t", "n", "hs"])

    return run


PAIRS = 1 << 18  # pairs that a task compares at once
BITS = 512
BANDS_AT_ONCE = 4  # bands by which texts are shuffled at once
CHARS_A_TASK = 12_000_000  # characters of texts that a task holds at once


def _similar(threshold: float):
    """Function for mapInArrow over (h, key, n, t): (a, b), a < b, of the texts of equal ``h`` that are similar.

    A run of characters sets one of 512 bits of its text. Bits that one text has alone stand for a run
    each that the other lacks, which bounds what both share; pairs that the bound leaves are compared
    run by run. All rows of an ``h`` are in one partition.
    """

    def exact(a: np.ndarray, b: np.ndarray, codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Runs that each pair shares; the pairs are of one group."""
        left, ia = np.unique(a, return_inverse=True)
        right, ib = np.unique(b, return_inverse=True)
        of = lambda r: codes[np.repeat(first[r] - (np.cumsum(size[r]) - size[r]), size[r]) + np.arange(size[r].sum())]
        voc, place = np.unique(of(left), return_inverse=True)
        m = np.zeros((len(left), len(voc)), np.float32)
        m[np.repeat(np.arange(len(left)), size[left]), place] = 1
        other = of(right)
        place = np.minimum(np.searchsorted(voc, other), len(voc) - 1)
        held = voc[place] == other
        k = np.zeros((len(right), len(voc)), np.float32)
        k[np.repeat(np.arange(len(right)), size[right])[held], place[held]] = 1
        return (m @ k.T)[ia, ib]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        h = t["h"].to_numpy()
        order = np.argsort(h, kind="stable")
        begins = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
        group = np.diff(np.append(begins, len(h)))
        order, group = order[np.repeat(group > 1, group)], group[group > 1]
        if not len(group):
            return
        t = t.take(pa.array(order))
        keys, n = t["key"].to_numpy(), t["n"].to_numpy().astype(np.int64)
        codes, first, size = _codes(t["t"].to_pylist())
        bits = np.zeros((len(keys), BITS // 64), np.uint64)
        for at in range(0, len(keys), 4096):
            own = slice(first[at], first[min(at + 4096, len(keys)) - 1] + size[min(at + 4096, len(keys)) - 1])
            seen = np.zeros((len(keys[at : at + 4096]), BITS), bool)
            seen[np.repeat(np.arange(len(seen)), size[at : at + 4096]), _mixed(codes[own]) % BITS] = True
            bits[at : at + 4096] = np.packbits(seen, axis=1).view(np.uint64)
        alone = n - np.bitwise_count(bits).sum(1, dtype=np.int64)
        of = np.repeat(np.arange(len(group)), group)
        later = np.repeat(np.cumsum(group), group) - np.arange(len(keys)) - 1  # members of its group that follow a row
        upto = np.cumsum(later)
        found, lo = [], 0
        while lo < len(keys):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
            many = later[lo:hi]
            a = np.repeat(np.arange(lo, hi), many)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
            need = threshold / (1 + threshold) * (n[a] + n[b]) - 1e-9
            most = np.minimum(alone[a], alone[b]) + np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64)
            kept = most >= need
            a, b, need = a[kept], b[kept], need[kept]
            edges = np.flatnonzero(np.append(True, of[a[1:]] != of[a[:-1]])) if len(a) else []
            for x, y in zip(edges, [*edges[1:], len(a)]):
                same = exact(a[x:y], b[x:y], codes, first, size)
                ok = same >= threshold * (n[a[x:y]] + n[b[x:y]] - same) - 1e-9
                found.append(np.stack([keys[a[x:y][ok]], keys[b[x:y][ok]]]))
            lo = hi
        if found:
            pairs = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def minhash_edges(df: DataFrame, key: str, text: str, threshold: float = 0.7, bands: int = 32, rows: int = 4) -> DataFrame:
    """(a, b), a < b: rows whose sets of three-character substrings share at least ``threshold`` of their union.

    Candidates share one of 32 bands of four hashes (128 in all, as in the surveyed filter; a pair at
    0.7 is missed with probability 2e-4) and are verified exactly, where the texts of a band's key
    meet: a candidate is never written. Texts are shuffled by a few bands at a time, and what a pass
    shuffled is deleted after it. Texts of fewer than three characters take no part.
    """
    spark = df.sparkSession
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    made = df.select(F.col(key).cast("bigint").alias("key"), t.alias("t")).filter(F.length("t") >= 3).mapInArrow(_minhash(bands, rows), "key bigint, t string, n int, hs array<bigint>")
    made = cut(made)
    parts = max(spark.sparkContext.defaultParallelism, -(-(made.agg(F.sum(F.length("t"))).first()[0] or 0) * BANDS_AT_ONCE // CHARS_A_TASK))
    out, before = [], spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        for at in range(0, bands, BANDS_AT_ONCE):
            keyed = made.select(F.explode(F.slice("hs", at + 1, BANDS_AT_ONCE)).alias("h"), "key", "n", "t").repartition(parts, "h")
            out.append(cut(keyed.mapInArrow(_similar(threshold), "a bigint, b bigint").distinct()))
        return cut(reduce(DataFrame.unionByName, out).distinct())
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)

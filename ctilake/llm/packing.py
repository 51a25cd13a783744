"""Filling containers of fixed capacity with documents: problem 9."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctilake.llm import codepoints as C
from ctilake.llm.tokens import TOKENIZERS, encode_rows, send_vocabulary
from ctilake.sources.tables import broadcast_if_small, cut, table

OPEN_BINS = 64
MERGE_GROUP_BINS = 50_000


class BestFit:
    """Online best fit with a bounded number of open bins.

    Bit f of ``free`` is set while an open bin has exactly f tokens free, so the best bin for an
    item is the lowest set bit at or above its size. When more than ``limit`` bins are open, the
    fullest closes. Bins are numbered from ``first`` on.
    """

    def __init__(self, capacity: int, limit: int = OPEN_BINS, first: int = 0):
        self.capacity, self.limit, self.next = capacity, limit, first
        self.free, self.bins, self.open = 0, {}, 0

    def _put(self, room: int, bin_: int) -> None:
        if room:
            self.bins.setdefault(room, []).append(bin_)
            self.free |= 1 << room
            self.open += 1

    def _take(self, room: int) -> int:
        held = self.bins[room]
        bin_ = held.pop()
        if not held:
            del self.bins[room]
            self.free ^= 1 << room
        self.open -= 1
        return bin_

    def place(self, size: int) -> int:
        """Bin of an item of at most the capacity. An item without tokens goes to any bin."""
        fits = self.free >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            bin_ = self._take(room)
        else:
            room, bin_ = self.capacity, self.next
            self.next += 1
        self._put(room - size, bin_)
        if self.open > self.limit:
            self._take((self.free & -self.free).bit_length() - 1)
        return bin_

    def left(self) -> list[tuple[int, int]]:
        """(bin, tokens in it) of the bins still open."""
        return [(b, self.capacity - room) for room, held in self.bins.items() for b in held]


def split(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of an item: one unless it exceeds the capacity."""
    if size <= capacity:
        return [(0, size)]
    return [(at, min(capacity, size - at)) for at in range(0, size, capacity)]


def _pack(specs: list[tuple[int, int]], directory: str, limit: int):
    schema = pa.schema([("spec_id", pa.int32()), ("part", pa.int64()), ("bin", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("is_open", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packers = {i: BestFit(capacity, limit) for i, capacity in specs}
        for batch in batches:
            done = 0
            for piece in C.chunks(batch.column(1)):
                _, at = encode_rows(piece, directory)
                keys = batch.column(0).slice(done, len(piece)).to_pylist()
                sizes = np.diff(at).tolist()
                done += len(piece)
                for spec, capacity in specs:
                    place = packers[spec].place
                    rows = [(place(n), key, start, n) for key, size in zip(keys, sizes) for start, n in split(size, capacity)]
                    bins, key, start, n = zip(*rows) if rows else ((), (), (), ())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([spec] * len(rows), pa.int32()), pa.array([part] * len(rows), pa.int64()), *(pa.array(x, pa.int64()) for x in (bins, key, start, n)), pa.array([False] * len(rows))],
                        schema=schema,
                    )
        for spec, _ in specs:  # what is still open, without key: one row a bin
            left = packers[spec].left()
            yield pa.RecordBatch.from_arrays(
                [pa.array([spec] * len(left), pa.int32()), pa.array([part] * len(left), pa.int64()), pa.array([b for b, _ in left], pa.int64()), pa.array([None] * len(left), pa.int64()), pa.array([0] * len(left), pa.int64()), pa.array([n for _, n in left], pa.int64()), pa.array([True] * len(left))],
                schema=schema,
            )

    return run


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """Pour bins that partitions left open into one another, as items of best fit, the fullest first."""
    group = group.sort_values(["n_tokens", "part", "bin"], ascending=[False, True, True])
    fit = BestFit(int(group["capacity"].iloc[0]), limit=len(group) + 1)
    target = [fit.place(int(n)) for n in group["n_tokens"]]
    out = group[["spec_id", "part", "bin"]].copy()
    first = group.assign(target=target).groupby("target")[["part", "bin"]].first()
    out["to_part"], out["to_bin"] = first["part"].loc[target].to_numpy(), first["bin"].loc[target].to_numpy()
    return out


def pack(df: DataFrame, key: str, text: str, specs: DataFrame, directory: str = TOKENIZERS, limit: int = OPEN_BINS) -> DataFrame:
    """(spec_id, bin_part, bin, key, start, n_tokens): every document in a container of every capacity.

    Each partition packs its own documents in one pass, holding ``limit`` open bins per capacity,
    so nothing is shuffled. The bins that are open at the end, a number bounded by partitions and
    not by rows, are then poured into one another in groups of about MERGE_GROUP_BINS. Only a
    document above the capacity is divided, into full containers and a rest. Null and empty texts
    have no tokens and are placed all the same. Specs without a positive capacity are left out.
    """
    send_vocabulary(df.sparkSession, directory)
    known = [(int(i), int(c)) for i, c in specs.select("spec_id", "capacity").filter("capacity > 0").collect()]  # a dimension: one packer each in every task
    schema = "spec_id int, part bigint, bin bigint, key bigint, start bigint, n_tokens bigint, is_open boolean"
    rows = cut(df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_pack(known, directory, limit), schema))
    left = rows.filter("is_open").join(broadcast_if_small(specs.select("spec_id", "capacity")), "spec_id").select("spec_id", "capacity", "part", "bin", "n_tokens")
    groups = max(1, left.count() // (max(1, len(known)) * MERGE_GROUP_BINS))
    merged = left.withColumn("_g", F.pmod(F.xxhash64("part", "bin"), F.lit(groups))).groupBy("spec_id", "_g").applyInPandas(_merge, "spec_id int, part bigint, bin bigint, to_part bigint, to_bin bigint")
    placed = rows.filter("not is_open").drop("is_open").join(merged, ["spec_id", "part", "bin"], "left")
    return placed.select("spec_id", F.coalesce("to_part", "part").alias("bin_part"), F.coalesce("to_bin", "bin").alias("bin"), "key", "start", "n_tokens")


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document, or piece of one, for every capacity of pack_specs."""
    out = pack(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "pack_specs"))
    return out.withColumnRenamed("key", "doc_id")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and share of used space for every capacity."""
    packed = p9_packed(spark, sf_dir)
    bins = packed.groupBy("spec_id", "bin_part", "bin").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    total = bins.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.sum("pieces").alias("pieces"), F.max("n").alias("fullest"))
    return total.join(broadcast_if_small(table(spark, sf_dir, "pack_specs")), "spec_id").select("spec_id", "capacity", "containers", "pieces", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4).alias("used"))


def p9_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every packing keeps: all documents placed, none with a gap or an overlap between its pieces, none divided that fits, no container above its capacity."""
    packed = p9_packed(spark, sf_dir).join(broadcast_if_small(table(spark, sf_dir, "pack_specs").select("spec_id", "capacity")), "spec_id")
    each = packed.groupBy("spec_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.count_distinct("start").alias("starts"), F.max("capacity").alias("capacity"))
    wrong = (F.col("n") != F.col("end")) | (F.col("starts") != F.col("pieces"))
    divided = (F.col("pieces") > 1) & (F.col("n") <= F.col("capacity"))
    documents = each.groupBy("spec_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(wrong).alias("broken"), F.count_if(divided).alias("divided_that_fit"))
    over = packed.groupBy("spec_id", "bin_part", "bin").agg((F.sum("n_tokens") > F.max("capacity")).alias("over")).groupBy("spec_id").agg(F.count_if("over").alias("overfull"))
    return documents.join(over, "spec_id")


QUERIES = {"p9_packed": p9_packed, "p9_fill": p9_fill, "p9_whole": p9_whole}
SQL = {"p9_whole": "select spec_id, (select count(*) from documents) as documents, 0::bigint as broken, 0::bigint as divided_that_fit, 0::bigint as overfull from pack_specs where capacity > 0"}

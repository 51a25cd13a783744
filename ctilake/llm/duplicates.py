"""Copies hidden by formatting, found with merged Bloom filters: problem 3."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctilake.sources.tables import checkpoint_dir, cut, table

SEGMENT_BITS = 20
LEAST_BITS, MOST_BITS, BITS_A_ROW = 20, 28, 16
MERGE_SALTS = 32
HOT_SHARE = 1000

NAME = r"[\p{L}][\p{L}\p{N}_.-]*(?:[\s\x{A0}]+[\p{L}\p{N}_.-]+){0,2}"  # a field's name has at most three words


def bare(text: Column) -> Column:
    """Letters and digits of ``text`` in one case; nothing else."""
    return F.regexp_replace(F.lower(F.upper(text)), r"[^\p{L}\p{N}]+", "")


def field_list(text: Column) -> Column:
    """Key of a text that is only a list of named fields, whatever their order; null for other texts.

    One field a line, one flat object, or one line of assignments, each of at least two fields.
    """
    lines = F.filter(F.split(text, r"[\r\n\x{2028}\x{85}]+"), lambda x: bare(x) != "")
    pieces = F.filter(F.split(text, ";"), lambda x: bare(x) != "")
    pair = r"\"(?:[^\"\\]|\\.)*\"\s*:\s*(?:\"(?:[^\"\\]|\\.)*\"|[^,{}\[\]\"]+)"
    members = F.regexp_extract_all(F.regexp_replace(text, r"[\x{A0}\x{2000}-\x{200B}]", " "), F.lit(pair), F.lit(0))
    line, assigned = rf"^[^\p{{L}}\p{{N}}]*({NAME})[\s\x{{A0}}]*[:=](.*)$", rf"(?s)^[^\p{{L}}\p{{N}}]*({NAME})[\s\x{{A0}}]*=(.*)$"
    member = r"(?s)^\"((?:[^\"\\]|\\.)*)\"\s*:(.*)$"

    def key(fields: Column, pattern: str) -> Column:
        one = lambda x: F.concat(bare(F.regexp_extract(x, pattern, 1)), F.lit("="), bare(F.regexp_extract(x, pattern, 2)))
        return F.concat(F.lit("\n"), F.array_join(F.array_sort(F.transform(fields, one)), "\n"))

    is_object = text.rlike(r"(?s)^[^\p{L}\p{N}\"]*\{.*\}[^\p{L}\p{N}\"]*$") & (F.size(members) >= 2)
    whole = bare(F.array_join(members, "")) == bare(text)
    is_lines = (F.size(lines) >= 2) & F.forall(lines, lambda x: x.rlike(line))
    is_assigned = (F.size(pieces) >= 2) & F.forall(pieces, lambda x: x.rlike(assigned)) & (F.size(lines) == 1)
    return F.when(is_object, F.when(whole, key(members, member))).when(text.rlike(r"[\r\n\x{2028}\x{85}]") & is_lines, key(lines, line)).when(text.contains("=") & text.contains(";") & is_assigned, key(pieces, assigned))


def hashes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, p, q, l, m): two hashes of the bare text, and two of the field list where there is one."""
    t = F.col(text)
    rows = df.select(F.col(key).alias("key"), bare(t).alias("_bare"), field_list(t).alias("_list")).filter("_bare <> ''")
    two = lambda c: [F.when(F.col(c).isNotNull(), F.xxhash64(c)), F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(7), c))]
    return rows.select("key", *[h.alias(n) for n, h in zip("pqlm", [*two("_bare"), *two("_list")])])


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """Two positions for every hash."""
    u = h.astype(np.int64).view(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    return np.concatenate((u & mask, (u >> np.uint64(32)) & mask)).astype(np.int64)


def _segments(bits: int):
    """Positions that a partition has seen once, and those seen more often, by segment of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % MERGE_SALTS
        for batch in batches:
            h = np.concatenate([np.asarray(c.drop_null()) for c in batch.columns])
            if not len(h):
                continue
            at, n = np.unique(_positions(h, bits), return_counts=True)
            segment = at >> SEGMENT_BITS
            cuts = np.flatnonzero(np.diff(segment)) + 1
            low = (at & ((1 << SEGMENT_BITS) - 1)).astype(np.uint32)
            seg = segment[np.concatenate(([0], cuts))]
            once, more = [], []
            for positions, counts in zip(np.split(low, cuts), np.split(n, cuts)):
                once.append(positions.tobytes())
                more.append(positions[counts > 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(seg.astype(np.int32)), pa.array([salt] * len(seg), pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["segment", "salt", "seen", "again"])

    return run


def _bits(packed: bytes, sparse: bool) -> np.ndarray:
    if sparse:
        out = np.zeros(1 << SEGMENT_BITS, bool)
        out[np.frombuffer(packed, np.uint32)] = True
        return out
    return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)


def _merge(sparse: bool):
    """Merge filters of one segment: a position seen in two parts has been seen again. Associative, so it runs in two levels."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        seen, again = np.zeros(1 << SEGMENT_BITS, bool), np.zeros(1 << SEGMENT_BITS, bool)
        for s, a in zip(group["seen"], group["again"]):
            part = _bits(s, sparse)
            again |= (seen & part) | _bits(a, sparse)
            seen |= part
        return pd.DataFrame({"segment": group["segment"].iloc[:1].astype("int32"), "seen": [np.packbits(seen).tobytes()], "again": [np.packbits(again).tobytes()]})

    return run


def repeat_filter(rows: DataFrame, columns: list[str], n_rows: int) -> tuple[int, np.ndarray]:
    """(bits, filter of the hashes that may occur more than once in any of ``columns``).

    Built in every partition and merged by segment, first within salts and then across them. Its
    size follows the rows between 2**LEAST_BITS and 2**MOST_BITS bits (32 MB), so that what the
    driver gathers and broadcasts has a fixed bound; more rows than that is made for are cut in
    classes of hashes first, see ``marked``.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (max(1, n_rows) * BITS_A_ROW - 1).bit_length()))
    parts = rows.select(*columns).mapInArrow(_segments(bits), "segment int, salt int, seen binary, again binary")
    schema = "segment int, seen binary, again binary"
    merged = parts.groupBy("segment", "salt").applyInPandas(_merge(True), schema).groupBy("segment").applyInPandas(_merge(False), schema)
    out = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << SEGMENT_BITS) // 8
    for row in merged.select("segment", "again").toLocalIterator():
        out[row[0] * size : (row[0] + 1) * size] = np.frombuffer(row[1], np.uint8)
    return bits, out


def may_repeat(rows: DataFrame, columns: list[str], bits: int, filter_: np.ndarray) -> DataFrame:
    """Rows of which some hash passes the filter at both of its positions."""
    return with_mark(rows, columns, bits, filter_).filter("maybe").drop("maybe")


def with_mark(rows: DataFrame, columns: list[str], bits: int, filter_: np.ndarray) -> DataFrame:
    """``rows`` with ``maybe``: whether some hash passes the filter at both of its positions."""
    shared = rows.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for c in columns:
                column = batch.column(batch.schema.get_field_index(c))
                at = _positions(np.asarray(column.fill_null(0)), bits)
                hit = (f[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
                keep |= (hit[: batch.num_rows] & hit[batch.num_rows :]).astype(bool) & ~np.asarray(column.is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keep)], [*batch.schema.names, "maybe"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", maybe boolean")


def marked(rows: DataFrame) -> DataFrame:
    """Hash rows with ``maybe``: false for rows that are certainly alone.

    Up to 2**MOST_BITS / BITS_A_ROW rows are judged with one filter. More are written to the shared
    folder by classes of their hashes, each of which one filter can hold, and judged class by class:
    every row is still read once, and one filter is in memory at a time. Rows with a field list are
    not judged by class, as their two hashes fall in two classes, and count as possible repeats.
    """
    n = rows.count()
    classes = -(-n * BITS_A_ROW // (1 << MOST_BITS))
    if classes <= 1:
        return with_mark(rows, ["p", "l"], *repeat_filter(rows, ["p", "l"], n))
    spark = rows.sparkSession
    where = f"{checkpoint_dir(spark).rstrip('/')}/classes-{uuid.uuid4().hex}"
    rows.withColumn("class", F.pmod(F.xxhash64("p"), F.lit(classes)).cast("int")).write.partitionBy("class").parquet(where)
    held, out = spark.read.schema(f"{rows.schema.simpleString()[7:-1].replace(':', ' ')}, class int").parquet(where), None
    for i in range(classes):
        mine = held.filter(F.col("class") == i).drop("class")
        one = with_mark(mine, ["p"], *repeat_filter(mine, ["p"], n // classes)).withColumn("maybe", F.col("maybe") | F.col("l").isNotNull())
        one = cut(one)
        out = one if out is None else out.unionByName(one)
    return out


def groups(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(all hash rows with ``maybe``, the groups (p, q, keep, n_text, copies) of more than one row).

    Copies have the same bare text, or are field lists of the same fields in any order. Rows
    without a letter or digit, null texts included, take no part. Rows are counted on the map side
    before anything moves, so a group of any size sends one row a partition.
    """
    rows = marked(cut(hashes(df, key, text)))
    texts = rows.filter("maybe").groupBy("p", "q").agg(F.min("key").alias("keep"), F.min(F.when(F.col("l").isNotNull(), F.struct("l", "m"))).alias("_list"), F.count(F.lit(1)).alias("n_text"))
    # a field list and the same text without its line ends are one: the group goes by the list where any row has it
    texts = cut(texts.select("p", "q", "keep", "n_text", F.coalesce("_list.l", "p").alias("g"), F.coalesce("_list.m", "q").alias("g2"), F.col("_list").isNotNull().alias("is_list")))
    whole = texts.groupBy("g", "g2", "is_list").agg(F.min("keep").alias("_keep"), F.sum("n_text").alias("copies")).filter("copies > 1")
    return rows, texts.join(whole, ["g", "g2", "is_list"]).select("p", "q", F.col("_keep").alias("keep"), "n_text", "copies")


def copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(keep_key, copy_key): one row for every row that is a copy of one with a smaller key.

    Texts of more than a HOT_SHARE-th of all repeated rows, at most HOT_SHARE of them, are joined by
    broadcast, so that a hot group stays where its rows are; the rest are joined by shuffle.
    """
    rows, found = groups(df, key, text)
    possible, found = rows.filter("maybe"), cut(found.select("p", "q", "keep", "n_text"))
    limit = max(1000, (found.agg(F.sum("n_text")).first()[0] or 0) // HOT_SHARE)
    hot, cold = found.filter(F.col("n_text") > limit), found.filter(F.col("n_text") <= limit)
    left = possible.join(F.broadcast(hot.select("p", "q", F.col("keep").alias("_hot"))), ["p", "q"], "left")
    near = left.filter(F.col("_hot").isNotNull()).select(F.col("_hot").alias("keep_key"), F.col("key").alias("copy_key"))
    far = left.filter(F.col("_hot").isNull()).join(cold.select("p", "q", "keep"), ["p", "q"]).select(F.col("keep").alias("keep_key"), F.col("key").alias("copy_key"))
    return near.unionByName(far).filter("keep_key <> copy_key")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post that is a copy of one with a smaller key: (keep_key, copy_key)."""
    return copies(table(spark, sf_dir, "forum_posts"), "post_key", "text")


def p3_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per group with its number of copies, singletons included: (keep_key, copies)."""
    rows, found = groups(table(spark, sf_dir, "forum_posts"), "post_key", "text")
    many = found.groupBy("keep").agg(F.max("copies").alias("copies"))
    # rows that no filter let through are alone and move nowhere
    single = rows.filter("not maybe").select("key").unionByName(rows.filter("maybe").join(found.select("p", "q"), ["p", "q"], "left_anti").select("key"))
    single = single.select(F.col("key").alias("keep_key"), F.lit(1).cast("bigint").alias("copies"))
    return many.select(F.col("keep").alias("keep_key"), "copies").unionByName(single)


def p3_against_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies found by source set against the duplicates that an earlier run reported."""
    posts = table(spark, sf_dir, "forum_posts")
    found = copies(posts, "post_key", "text").select(F.col("copy_key").alias("post_key"))
    by_source = posts.select("post_key", "source_dataset").join(found, "post_key").groupBy("source_dataset").agg(F.count(F.lit(1)).alias("found"))
    stats = table(spark, sf_dir, "unified_stats").groupBy("source_dataset").agg(F.sum("duplicate_rows").alias("reported"))
    return stats.join(by_source, "source_dataset", "full").select("source_dataset", F.coalesce("reported", F.lit(0)).alias("reported"), F.coalesce("found", F.lit(0)).alias("found"))


QUERIES = {"p3_found": p3_found, "p3_collapsed": p3_collapsed, "p3_against_stats": p3_against_stats}
# The field lists of the tables have neither quotes nor brackets in their values, so the SQL takes them apart more simply than the operator.
_groups = r"""b as (select post_key, text, regexp_replace(lower(upper(text)), '[^\p{L}\p{N}]+', '', 'g') as b from forum_posts),
r as (select post_key, text, b, trim(text, chr(10) || chr(13) || chr(9) || ' ' || chr(160) || chr(8203)) as t from b where b <> ''),
f as (select post_key, b, case when regexp_matches(t, '^\{[\s\S]*\}$') then regexp_extract_all(regexp_replace(t, '[\x{A0}\x{2000}-\x{200B}]', ' ', 'g'), '"(?:[^"\\]|\\.)*"\s*:\s*(?:"(?:[^"\\]|\\.)*"|[^,{}\[\]"]+)')
 when regexp_matches(t, '[\r\n\x{2028}\x{85}]') then list_filter(regexp_split_to_array(t, '[\r\n\x{2028}\x{85}]+'), lambda x: regexp_matches(x, '[\p{L}\p{N}]'))
 when contains(t, ';') then list_filter(string_split(t, ';'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) end as f,
 case when regexp_matches(t, '^\{[\s\S]*\}$') then '^"((?:[^"\\]|\\.)*)"\s*:([\s\S]*)$' when regexp_matches(t, '[\r\n\x{2028}\x{85}]') then '^[^\p{L}\p{N}]*(\p{L}[\p{L}\p{N}_.\-]*(?:[\s\x{A0}]+[\p{L}\p{N}_.\-]+){0,2})[\s\x{A0}]*[:=](.*)$'
 else '^[^\p{L}\p{N}]*(\p{L}[\p{L}\p{N}_.\-]*(?:[\s\x{A0}]+[\p{L}\p{N}_.\-]+){0,2})[\s\x{A0}]*=([\s\S]*)$' end as p from r),
u as (select post_key, b, len(f) as n, p, unnest(f) as x from f where len(f) > 1),
v as (select post_key, regexp_replace(lower(upper(regexp_extract(x, p, 1))), '[^\p{L}\p{N}]+', '', 'g') || '=' || regexp_replace(lower(upper(regexp_extract(x, p, 2))), '[^\p{L}\p{N}]+', '', 'g') as kv, regexp_matches(x, p) as fits, b, regexp_replace(lower(upper(x)), '[^\p{L}\p{N}]+', '', 'g') as bx from u),
l as (select post_key, list_sort(list(kv)) as l from v group by post_key having bool_and(fits) and sum(length(bx)) = max(length(b))),
g as (select r.post_key, b, min(l) over (partition by b) as l from r left join l on r.post_key = l.post_key),
c as (select post_key, min(post_key) over (partition by coalesce(l::varchar, ''), case when l is null then b end) as keep_key, count(*) over (partition by coalesce(l::varchar, ''), case when l is null then b end) as copies from g)"""
SQL = {
    "p3_found": f"with {_groups} select keep_key, post_key as copy_key from c where keep_key <> post_key",
    "p3_collapsed": f"with {_groups} select distinct keep_key, copies from c",
    "p3_against_stats": f"""with {_groups}, k as (select source_dataset, count(*) as found from c join forum_posts p on c.post_key = p.post_key where keep_key <> c.post_key group by 1), s as (select source_dataset, sum(duplicate_rows)::bigint as reported from unified_stats group by 1)
select coalesce(s.source_dataset, k.source_dataset) as source_dataset, coalesce(reported, 0) as reported, coalesce(found, 0) as found from s full join k on s.source_dataset = k.source_dataset""",
}

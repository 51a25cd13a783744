"""Scans: line-delimited JSON, delimited text, nested documents, relational sources and pages."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_bad"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType, mode: str = "skip", limit: int | None = None, glob: str | None = None) -> DataFrame:
    """Line-delimited JSON, plain or gzipped.

    ``skip`` leaves malformed lines out, ``keep`` returns them in the column ``_bad``, ``strict``
    fails on the first. Blank lines never count. ``limit`` takes the first lines by file and
    position, ``glob`` restricts the file names of a directory.
    """
    reader = spark.read.schema(schema if mode == "strict" else T.StructType([*schema.fields, T.StructField(BAD, T.StringType())]))
    reader = reader.option("mode", "FAILFAST") if mode == "strict" else reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
    df = (reader.option("pathGlobFilter", glob) if glob else reader).json(paths)
    if limit is not None:
        columns = [c for c in df.columns if c != BAD or mode == "keep"]
        if mode == "skip":
            df = df.filter(F.col(BAD).isNull())
        return df.withColumn("_f", F.col("_metadata.file_path")).withColumn("_i", F.monotonically_increasing_id()).orderBy("_f", "_i").limit(limit).select(*columns)
    return df.filter(F.col(BAD).isNull()).drop(BAD) if mode == "skip" else df


def union_in_order(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Files read in one scan and tagged by name: source_dataset, source_format, file_rank and line_no.

    The rank is the place of the file in ``paths``, which decides which of two equal texts came
    first; missing files are skipped. ``line_no`` orders lines within a file.
    """
    fs = spark._jvm.org.apache.hadoop.fs
    there = [p for p in paths if fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs.Path(p))]
    if not there:
        return spark.createDataFrame([], T.StructType([*schema.fields, *[T.StructField(n, k) for n, k in (("source_dataset", T.StringType()), ("source_format", T.StringType()), ("file_rank", T.IntegerType()), ("line_no", T.LongType()))]]))
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl(\.gz)?$", "")
    whole = lambda p: re.sub(r"^\w+:/*(?=/)", "", fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(fs.Path(p)).toUri().getPath())
    ranks = F.create_map(*[F.lit(x) for i, p in enumerate(there) for x in (whole(p), i)])  # by whole path: two folders may hold files of one name
    path = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", r"^\w+:/*(?=/)", ""), F.lit("+"), F.lit("%2B")))
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(there)
    return df.select("*", stem.alias("source_dataset"), F.when(stem.endswith("_raw"), "raw").otherwise("forumpost").alias("source_format"), F.try_element_at(ranks, path).alias("file_rank"), F.monotonically_increasing_id().alias("line_no"))


def gzip_lines(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Gzipped JSON lines, a file a task, read up to where an archive breaks off; malformed lines are left out.

    The files lie in a folder that all executors share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                unzip, rest = zlib.decompressobj(wbits=31), b""
                with open(path, "rb") as f:
                    while block := f.read(1 << 20):
                        try:
                            lines = (rest + unzip.decompress(block)).split(b"\n")
                        except zlib.error:
                            break
                        rest = lines.pop()
                        yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())], ["line"])
                yield pa.RecordBatch.from_arrays([pa.array([rest.decode("utf-8", "replace")] if rest else [], pa.string())], ["line"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    parsed = files.mapInArrow(run, "line string").select(F.from_json("line", T.StructType([*schema.fields, T.StructField(BAD, T.StringType())]), {"columnNameOfCorruptRecord": BAD}).alias("r"), "line")
    return parsed.filter((F.trim("line") != "") & F.col(f"r.{BAD}").isNull()).select(*[f"r.{f.name}" for f in schema.fields])


def saved_splits(spark: SparkSession, root: str, columns: str) -> DataFrame:
    """All splits of a data set saved as Arrow files under ``root/<split>/``, with the split's name; ``columns`` is their schema."""
    names = [c.split()[0] for c in columns.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with pa.memory_map(path) as f:
                    try:
                        parts = list(pa.ipc.open_stream(f))
                    except pa.ArrowInvalid:
                        file = pa.ipc.open_file(f)
                        parts = [file.get_batch(i) for i in range(file.num_record_batches)]
                    for part in parts:
                        yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), pa.array([Path(path).parent.name] * part.num_rows, pa.string())], [*names, "split"])

    files = sorted(str(p) for p in Path(root).glob("*/*.arrow"))
    if not files:
        return spark.createDataFrame([], f"{columns}, split string")
    return spark.createDataFrame([(p,) for p in files], "path string").repartition(len(files)).mapInArrow(run, f"{columns}, split string")


def hdf_frames(spark: SparkSession, path: str, forums: dict[str, str], columns: list[str]) -> DataFrame:
    """The keyed frames of an HDF5 file as strings with lower-case names, each under the forum of its key; needs PyTables on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, forum in zip(frame["key"], frame["forum"]):
                df = pd.read_hdf(path, key=key).rename(columns=str.lower)
                out = pd.DataFrame({c: df[c].astype("string") if c in df else pd.Series([None] * len(df), dtype="string") for c in columns})
                yield out.assign(forum_id=forum)

    keys = spark.createDataFrame(list(forums.items()), "key string, forum string").repartition(max(1, len(forums)))
    return keys.mapInPandas(run, ", ".join(f"{c} string" for c in [*columns, "forum_id"]))


def embedding_cache(spark: SparkSession, path: str, ids: DataFrame, key: str, rows_a_task: int = 50_000) -> DataFrame:
    """(key, embedding) from a matrix file in a shared folder whose rows follow the keys' order; a sibling with another dash or underscore serves when the file is missing.

    Only the file's head is read here; every task maps its own rows. A matrix of another number of rows is an error.
    """
    file = next((p for p in (Path(path), Path(path).with_name(Path(path).name.replace("-", "_")), Path(path).with_name(Path(path).name.replace("_", "-"))) if p.exists()), None)
    if file is None:
        raise FileNotFoundError(path)
    n, where = np.load(file, mmap_mode="r").shape[0], str(file)
    if n != ids.count():
        raise ValueError(f"{file} has {n} rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.load(where, mmap_mode="r")
        for batch in batches:
            for start in batch.column(0).to_pylist():
                part = np.asarray(matrix[start : start + rows_a_task], np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(part), dtype=np.int64)), lists], ["at", "embedding"])

    rows = spark.range(0, max(1, n), rows_a_task).repartition(max(1, -(-n // rows_a_task))).mapInArrow(run, "at bigint, embedding array<float>")
    numbered = spark.createDataFrame(ids.select(key).orderBy(key).rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])), T.StructType([T.StructField(key, ids.schema[key].dataType), T.StructField("at", T.LongType())]))
    return numbered.join(rows, "at").select(key, "embedding")


def topic_posts(df: DataFrame, topic: str) -> DataFrame:
    """(topic, post, number, author, written, html) of the posts inside topics given as JSON text."""
    schema = "struct<id: bigint, title: string, post_stream: struct<stream: array<bigint>, posts: array<struct<id: bigint, post_number: int, username: string, created_at: string, cooked: string>>>>"
    t = df.select(F.from_json(topic, schema).alias("t"))
    return t.select(F.col("t.id").alias("topic"), "t.title", F.explode("t.post_stream.posts").alias("p")).select("topic", "title", F.col("p.id").alias("post"), F.col("p.post_number").alias("number"), F.col("p.username").alias("author"), F.col("p.created_at").alias("written"), F.col("p.cooked").alias("html"))


def topic_chunks(df: DataFrame, topic: str, size: int = 20) -> DataFrame:
    """(topic, chunk, posts): ids of a topic's stream that it does not hold itself, in chunks of ``size``, as they are asked for."""
    t = df.select(F.from_json(topic, "struct<id: bigint, post_stream: struct<stream: array<bigint>, posts: array<struct<id: bigint>>>>").alias("t"))
    rest = F.filter("t.post_stream.stream", lambda i: ~F.array_contains(F.transform("t.post_stream.posts", lambda p: p["id"]), i))
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("rest") / size).cast("int") - 1), lambda c: F.slice("rest", c * size + 1, size))
    return t.select(F.col("t.id").alias("topic"), rest.alias("rest")).filter(F.size("rest") > 0).select("topic", F.posexplode(chunks).alias("chunk", "posts"))


def mail_archive(spark: SparkSession, root: str, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """(year, month, path, mail) of a mailing list stored as ``root/year/Mon/*.txt``, month by month; months without a folder are left out."""
    fs, months = spark._jvm.org.apache.hadoop.fs, []
    for n in range(first[0] * 12 + first[1] - 1, last[0] * 12 + last[1]):
        path = f"{root.rstrip('/')}/{n // 12}/{MONTHS[n % 12]}"
        if fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs.Path(path)):
            months.append(path)
    if not months:
        return spark.createDataFrame([], "year int, month string, path string, mail string")
    mails = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(months, wholetext=True)
    at = lambda i: F.regexp_extract("_metadata.file_path", r"/(\d{4})/([A-Z][a-z]{2})/[^/]*$", i)
    return mails.select(at(1).cast("int").alias("year"), at(2).alias("month"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("mail"))


def delimited(spark: SparkSession, path: str, columns: list[str], sep: str = ",", multiline: bool = True) -> DataFrame:
    """CSV or TSV with a header, quoted line ends allowed, every column a string, names in lower case."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", multiline).option("quote", '"').option("escape", '"').option("enforceSchema", False).schema(schema).csv(path)
    return df.toDF(*[c.lower() for c in columns])


def with_bodies(df: DataFrame, file_column: str, root: str, name: str = "body") -> DataFrame:
    """``df`` with the whole text of the file that each row names, null where there is none."""
    root = root.rstrip("/")
    files = df.sparkSession.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("value").alias(name), F.regexp_replace("_metadata.file_path", r"^\w+:/*(?=/)", "").alias("_path"))
    return df.join(files, F.concat(F.lit(f"{root}/"), F.col(file_column)) == F.col("_path"), "left").drop("_path")


def items(df: DataFrame, path: str, schema: str) -> DataFrame:
    """One row for every element of a nested array, rows without one kept; ``path`` names a JSON text column or a nested field."""
    column = F.from_json(F.col(path), f"array<{schema}>") if dict(df.dtypes).get(path) == "string" else F.col(path)
    return df.select(*[c for c in df.columns if c != path.split(".")[0]], F.explode_outer(column).alias("item"))


def relational(spark: SparkSession, url: str, query: str, driver: str | None = None, **options: str) -> DataFrame:
    """Result of ``query`` on a relational source, joins pushed to it; the driver's jar must be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query).options(**options)
    return (reader.option("driver", driver) if driver else reader).load()


def fixes_with_commits(fixes: DataFrame, commits: DataFrame, cves: DataFrame) -> DataFrame:
    """Fixes joined with their commits and vulnerabilities, where the source gives the three tables."""
    return fixes.join(commits, ["hash", "repo_url"]).join(cves, "cve_id")


def markdown_index(df: DataFrame, text: str) -> DataFrame:
    """(name, url, status) of the rows ``| [NAME](URL) | STATUS |`` of forum index pages."""
    row = r"\|\s*\[([^\]]+)\]\(([^)\s]+)\)\s*\|\s*([^|\n]*?)\s*\|"
    line = F.explode(F.regexp_extract_all(F.col(text), F.lit(row), F.lit(0))).alias("_r")
    return df.select(line).select(*[F.regexp_extract("_r", row, i).alias(n) for i, n in ((1, "name"), (2, "url"), (3, "status"))]).withColumn("online", F.upper("status").startswith("ONLINE")).withColumn("onion", F.col("url").rlike(r"[.]onion(/|$)"))


def feed_items(df: DataFrame, xml: str) -> DataFrame:
    """(title, link, published) of the items of RSS texts."""
    get = lambda p: F.xpath(F.col(xml), F.lit(p))
    zipped = F.explode(F.arrays_zip(get("//item/title/text()").alias("title"), get("//item/link/text()").alias("link"), get("//item/pubDate/text()").alias("published"))).alias("i")
    return df.select(zipped).select("i.title", "i.link", "i.published")


def category_tree(spark: SparkSession, categories: DataFrame) -> DataFrame:
    """(id, path) of nested categories from (id, parent_id, name), by a recursive query."""
    categories.createOrReplaceTempView("ctilake_categories")
    return spark.sql("""with recursive t(id, path) as (select id, name from ctilake_categories where parent_id is null
        union all select c.id, concat(t.path, ' / ', c.name) from ctilake_categories c join t on c.parent_id = t.id) select * from t""")

"""Sources and sinks as queries: a table goes out through a sink and comes back through the matching scan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctilake.functions.common import filled, n_rows
from ctilake.operators.release import apply_policy
from ctilake.sources import html, readers, schemas, writers
from ctilake.sources.tables import checkpoint_dir, table

ITEM = "item_id bigint, cve_id string, title string, text string, split string"


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/').removeprefix('file:')}/trip-{uuid.uuid4().hex}"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "task1_cve_linkage").select("item_id", "cve_id", "title", "text", "split")


def _shape(df: DataFrame) -> DataFrame:
    return df.select(F.col("item_id").cast("bigint").alias("item_id"), "cve_id", F.md5(filled("title")).alias("title_md5"), F.md5(filled()).alias("text_md5"), "split")


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(text)


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linkage items as JSON lines, written with their count and read with blank and malformed lines skipped."""
    where = _folder(spark)
    writers.jsonl(_items(spark, sf_dir), where)
    return _shape(readers.jsonl(spark, where, _schema(ITEM)))


def json_lines_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, gzipped, through the scan that fails on a bad line."""
    where = _folder(spark)
    writers.jsonl(_items(spark, sf_dir), where, gzip=True)
    return _shape(readers.jsonl(spark, where, _schema(ITEM), mode="strict", glob="*.json.gz"))


def delimited_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linkage items as CSV in a declared order with line ends in quoted fields; a null comes back as empty text."""
    where, columns = _folder(spark), ["item_id", "split", "title", "text", "cve_id"]
    writers.csv(_items(spark, sf_dir), where, columns)
    return _shape(readers.delimited(spark, where, columns)).withColumn("cve_id", F.coalesce("cve_id", F.lit("")))


def rows_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in one folder for every split, counted from the folders."""
    where = _folder(spark)
    writers.by_key(_items(spark, sf_dir), where, "split")
    return spark.read.parquet(where).groupBy("split").agg(n_rows().alias("n"), F.count_distinct("cve_id").alias("cves"))


def result_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result log appended twice with overlapping keys: what the first run wrote is not written again."""
    where = _folder(spark)
    n = _items(spark, sf_dir).groupBy("split", F.substring("cve_id", 5, 4).alias("year")).agg(n_rows().alias("n"))
    writers.append_results(n.filter("split <> 'test'"), where, ["split", "year"])
    writers.append_results(n, where, ["split", "year"])
    return spark.read.parquet(where)


def rewritten_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced by a filtered form of itself."""
    where = _folder(spark)
    _items(spark, sf_dir).write.parquet(where)
    writers.replace(spark.read.parquet(where).filter("split = 'val'"), where)
    return spark.read.parquet(where).select("item_id", "cve_id")


def nested_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every element of an array inside JSON text, rows without one kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json("cve_refs").alias("refs"))
    return readers.items(docs, "refs", "string").select("doc_id", F.col("item").alias("cve_id"))


def thread_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts read back from pages in the markup of six engines, made from the raw posts."""
    raw = table(spark, sf_dir, "raw_posts").select("row_id", F.coalesce("author_hash", F.lit("nobody")).alias("a"), F.concat_ws(" ", F.col("forum_id"), F.lit("&amp; <b>said</b>")).alias("t"), (F.col("row_id") % 6).alias("e"))
    frames = {
        "phpbb": '<div class="post bg2"><a class="username">%a</a><time datetime="2020-01-02"></time><div class="content">%t</div></div>', "mybb": '<div class="post " id="post_1"><span class="largetext"><a href="/u">%a</a></span><span class="post_date">2020-01-02</span><div class="post_body scaleimages">%t</div><!-- end: postbit -->',
        "xenforo": '<article class="message" data-author="%a"><time datetime="2020-01-02"></time><div class="bbWrapper">%t</div></article>', "invision": '<article id="elComment_7"><h3 class="ipsType_break"><a href="/u">%a</a></h3><time datetime="2020-01-02"></time><div data-role="commentContent">%t</div></article>',
        "discourse": '<div class="topic-body crawler-post"><span itemprop="name">%a</span><time datetime="2020-01-02"></time><div class="post" itemprop="text">%t</div></div><!-- /post -->', "generic": '<li class="post"><b class="author">%a</b><time datetime="2020-01-02"></time><div class="body">%t</div><!-- end --></li>',
    }
    out = None
    for i, (engine, frame) in enumerate(frames.items()):
        one = F.replace(F.replace(F.lit(frame), F.lit("%a"), F.col("a")), F.lit("%t"), F.col("t"))
        pages = raw.filter(F.col("e") == i).select("row_id", F.concat(F.lit("<html>"), one, one, F.lit("</html>")).alias("page"))
        part = html.thread_posts(pages, "page", engine, ["row_id"]).withColumn("engine", F.lit(engine))
        out = part if out is None else out.unionByName(part)
    return out


def forum_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forums read back from a Markdown index made of them, with what their state and address say."""
    row = F.concat(F.lit("| ["), "forum_name", F.lit("](http://"), "forum_id", F.when(F.col("engine") == "phpbb", ".onion/").otherwise(".example"), F.lit(") | "), F.when(F.col("date_order") == "dmy", "ONLINE since May").otherwise("OFFLINE"), F.lit(" | x |\n"))
    return readers.markdown_index(table(spark, sf_dir, "forums").select(row.alias("md")), "md").select("name", "url", "status", "online", "onion")


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries read back from feeds made of the forums, one feed for each."""
    item = lambda k: F.concat(F.lit("<item><title>"), "forum_name", F.lit(f" {k}</title><link>http://"), "forum_id", F.lit(f".example/{k}</link><pubDate>2020-01-0{k}</pubDate></item>"))
    feeds = table(spark, sf_dir, "forums").select(F.concat(F.lit("<rss><channel>"), item(1), item(2), F.lit("</channel></rss>")).alias("xml"))
    return readers.feed_items(feeds, "xml")


def category_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forums as a tree of engines, layers and forums, with the path of every node."""
    f = table(spark, sf_dir, "forums")
    top = f.select(F.col("engine").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("engine").alias("name")).distinct()
    middle = f.select(F.concat_ws("/", "engine", "source_layer").alias("id"), F.col("engine").alias("parent_id"), F.col("source_layer").alias("name")).distinct()
    leaves = f.select(F.col("forum_id").alias("id"), F.concat_ws("/", "engine", "source_layer").alias("parent_id"), F.col("forum_name").alias("name"))
    return readers.category_tree(spark, top.unionByName(middle).unionByName(leaves))


def topic_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of topics given as nested JSON made of the threads' rows."""
    raw = table(spark, sf_dir, "raw_posts")
    topic = F.to_json(F.struct(F.col("row_id").alias("id"), F.col("thread_title").alias("title"), F.struct(F.array("row_id", F.col("row_id") + 1).alias("stream"), F.array(F.struct(F.col("row_id").alias("id"), F.lit(1).alias("post_number"), F.col("author_hash").alias("username"), F.col("timestamp").alias("created_at"), F.lit("<p>x</p>").alias("cooked"))).alias("posts")).alias("post_stream")))
    return readers.topic_posts(raw.select(topic.alias("j")), "j").select("topic", "post", "number", "author", "written")


def topic_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of twenty post ids that are still to be asked for, of topics of up to 64 posts of which one is known."""
    size = (F.col("row_id") % 64 + 1).cast("int")
    topic = F.to_json(F.struct(F.col("row_id").alias("id"), F.struct(F.sequence(F.lit(1), size).alias("stream"), F.array(F.struct(F.lit(1).alias("id"))).alias("posts")).alias("post_stream")))
    return readers.topic_chunks(table(spark, sf_dir, "raw_posts").select(topic.alias("j")), "j").select("topic", "chunk", F.size("posts").alias("n"), F.element_at("posts", 1).alias("first"))


def code_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes joined with their commits and vulnerabilities, the three tables made of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode("cve_refs").alias("cve_id")).filter("cve_id is not null")
    fixes = docs.select("cve_id", F.col("doc_id").alias("hash"), F.col("source").alias("repo_url"))
    commits = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("hash"), F.col("source").alias("repo_url"), F.length("text").alias("msg_chars")).filter("hash % 3 <> 0")
    cves = docs.select("cve_id").distinct().withColumn("year", F.substring("cve_id", 5, 4))
    return readers.fixes_with_commits(fixes, commits, cves).select("cve_id", "hash", "msg_chars", "year")


def release_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Released documents by mode, artifact and reason, written and read back."""
    where = _folder(spark)
    apply_policy(table(spark, sf_dir, "documents").select("doc_id", "source_layer", "text"), "source_layer", "text").write.parquet(where)
    return spark.read.parquet(where).groupBy("release_mode", "released_artifact", F.col("redaction_reason").isNotNull().alias("redacted")).agg(n_rows().alias("n"))


QUERIES = {f.__name__: f for f in (json_lines, json_lines_strict, delimited_text, rows_by_key, result_log, rewritten_table, nested_items, thread_pages, forum_index, feed_entries, category_paths, topic_feed, topic_requests, code_fixes, release_counts)}
_item = "select item_id, cve_id, md5(coalesce(title, '')) as title_md5, md5(coalesce(text, '')) as text_md5, split from task1_cve_linkage"
_engine = "['phpbb', 'mybb', 'xenforo', 'invision', 'discourse', 'generic'][row_id % 6 + 1]"
SQL = {
    "json_lines": _item,
    "json_lines_strict": _item,
    "delimited_text": _item.replace("cve_id,", "coalesce(cve_id, '') as cve_id,"),
    "rows_by_key": "select split, count(*) as n, count(distinct cve_id) as cves from task1_cve_linkage group by 1",
    "result_log": "select split, substr(cve_id, 5, 4) as year, count(*) as n from task1_cve_linkage group by 1, 2",
    "rewritten_table": "select item_id, cve_id from task1_cve_linkage where split = 'val'",
    "nested_items": "select doc_id, unnest(case when len(cve_refs) > 0 then cve_refs else [null] end) as cve_id from documents",
    "thread_pages": f"select row_id, u.i::int as post_index, coalesce(author_hash, 'nobody') as author, '2020-01-02' as written, forum_id || ' & said' as text, {_engine} as engine from raw_posts, range(2) u(i)",
    "forum_index": "select forum_name as name, 'http://' || forum_id || case when engine = 'phpbb' then '.onion/' else '.example' end as url, case when date_order = 'dmy' then 'ONLINE since May' else 'OFFLINE' end as status, date_order = 'dmy' as online, engine = 'phpbb' as onion from forums",
    "feed_entries": "select forum_name || ' ' || k::varchar as title, 'http://' || forum_id || '.example/' || k::varchar as link, '2020-01-0' || k::varchar as published from forums, range(1, 3) t(k)",
    "category_paths": "select distinct engine as id, engine as path from forums union all select distinct engine || '/' || source_layer, engine || ' / ' || source_layer from forums union all select forum_id, engine || ' / ' || source_layer || ' / ' || forum_name from forums",
    "topic_feed": "select row_id as topic, row_id as post, 1 as number, author_hash as author, timestamp as written from raw_posts",
    "topic_requests": "with r as (select row_id, row_id % 64 as rest from raw_posts) select row_id as topic, c::int as chunk, least(20, rest - 20 * c)::int as n, (20 * c + 2)::bigint as first from r, range(4) t(c) where 20 * c < rest",
    "code_fixes": "with f as (select doc_id, unnest(cve_refs) as cve_id, length(text)::int as msg_chars from documents where doc_id % 3 <> 0) select cve_id, doc_id as hash, msg_chars, substr(cve_id, 5, 4) as year from f where cve_id is not null",
    "release_counts": "with d as (select coalesce(case source_layer when 'vulnerability_reference' then 'redistributable_text|text' when 'advisory_reference' then 'redistributable_text|text' when 'bug_bounty_disclosure' then 'research_text_with_terms|research_text' when 'exploit_archive' then 'research_text_with_terms|research_text' end, 'metadata_or_pointer_only|pointer') as p from documents) select split_part(p, '|', 1) as release_mode, split_part(p, '|', 2) as released_artifact, p like '%pointer' as redacted, count(*) as n from d group by all",
}

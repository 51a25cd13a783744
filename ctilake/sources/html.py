"""Posts out of stored thread pages, by native pattern extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctilake.functions import text as X

# Post blocks and, within a block, author, time and body of the engines' default markup.
ENGINES = {
    "phpbb": (r'(?s)<div class="post[^"]*".*?</div>\s*</div>', r'class="username[^"]*">([^<]+)<', r'datetime="([^"]+)"', r'(?s)<div class="content">(.*?)</div>'),
    "mybb": (r'(?s)<div class="post ?[^"]*" id="post_\d+".*?<!-- end: postbit -->', r'class="largetext">(?:<a[^>]*>)?([^<]+)<', r'class="post_date">([^<]+)<', r'(?s)class="post_body[^"]*"[^>]*>(.*?)</div>'),
    "invision": (r'(?s)<article[^>]*id="elComment_\d+".*?</article>', r'class="ipsType_break">(?:<a[^>]*>)?([^<]+)<', r'datetime="([^"]+)"', r'(?s)data-role="commentContent"[^>]*>(.*?)</div>'),
    "discourse": (r'(?s)<div[^>]*class="topic-body crawler-post".*?<!-- /post -->', r'itemprop="name">([^<]+)<', r'datetime="([^"]+)"', r'(?s)itemprop="text"[^>]*>(.*?)</div>'),
    "generic": (r'(?s)<(?:article|li|div)[^>]*class="[^"]*\b(?:post|message|comment)\b[^"]*".*?<!-- end -->', r'class="[^"]*(?:author|user)[^"]*">([^<]+)<', r'datetime="([^"]+)"', r'(?s)class="[^"]*(?:body|content|text)[^"]*"[^>]*>(.*?)</div>'),
    "xenforo": (r'(?s)<article class="message.*?</article>', r'data-author="([^"]*)"', r'datetime="([^"]+)"', r'(?s)<div class="bbWrapper">(.*?)</div>'),
}


def thread_posts(pages: DataFrame, html: str, engine: str, keys: list[str]) -> DataFrame:
    """(keys, post_index, author, written, text) of every post of the pages of one engine; pages without posts give no row."""
    block, author, written, body = ENGINES[engine]
    rows = pages.select(*keys, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(block), F.lit(0))).alias("post_index", "_b"))
    get = lambda p: F.nullif(F.regexp_extract("_b", p, 1), F.lit(""))
    return rows.select(*keys, "post_index", get(author).alias("author"), get(written).alias("written"), X.strip_html(F.coalesce(get(body), F.lit(""))).alias("text"))


def links(pages: DataFrame, html: str) -> DataFrame:
    """Distinct canonical addresses that the pages link to."""
    found = pages.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""href=["']([^"'#]+)["']"""), F.lit(1))).alias("u"))
    return found.filter(F.col("u").rlike("^https?://")).select(X.canonical_url(F.col("u")).alias("url")).distinct()


# What block pages say.
BLOCKED = ["just a moment", "verify you are human", "checking your browser", "cf-browser-verification", "why do i have to complete a captcha", "attention required! | cloudflare"]


def blocked(html):
    """Whether a page is a block page; null is none."""
    return X.contains_any(F.lower(F.coalesce(html, F.lit(""))), BLOCKED)

"""Scalar functions, labels, masks and governed release as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctilake.functions.common import filled, n_rows
from ctilake.functions import text as X
from ctilake.operators.release import POLICIES, apply_policy, violations
from ctilake.sources.tables import broadcast_if_small, table



def cve_extract_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every identifier that a document mentions, once a document, in upper case."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.cve_ids(filled())).alias("cve_id"))
    return docs.select("doc_id", "cve_id", X.cve_year(F.col("cve_id")).alias("year"))


def cti_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword score of every post."""
    return table(spark, sf_dir, "forum_posts").select("post_key", X.cti_score(filled()).alias("score"))


def actionable_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of structural patterns in every exploit text."""
    return table(spark, sf_dir, "ev_pairs").select("pair_id", X.actionable_count(F.coalesce("exploit_text", F.lit(""))).alias("patterns"))


def title_cascade_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every record by the first line of its text."""
    first = F.regexp_extract(filled(), r"^([^\n]*)", 1)
    return table(spark, sf_dir, "task2_exploit_type").select("rec_id", X.title_class(first).alias("predicted"), "label")


def weak_ternary_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts by weak label and forum."""
    rows = table(spark, sf_dir, "forum_posts").select("forum_id", X.weak_label(filled(), filled().rlike(r"(?i)CVE-\d{4}-\d{4,7}")).alias("label"))
    return rows.groupBy("forum_id", "label").agg(n_rows().alias("n"))


def _with_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a severity line added by arithmetic on the key, as the tables hold none."""
    words = F.array(*map(F.lit, ("Critical", "HIGH", "medium", "Moderate", "low")))
    line = F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("\nSeverity: "), F.get(words, (F.col("doc_id") % 5).cast("int")), F.lit("\n\nCVSS: 7.5"))).when(F.col("doc_id") % 7 == 4, " a high severity flaw").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(filled(), line).alias("text"))


def severity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity word of an explicit field, with its ordinal; documents without one are left out."""
    word = F.lower(F.regexp_extract(filled(), r"(?i)\bseverity\s*[:=]\s*(critical|high|medium|moderate|low)\b", 1))
    name = F.when(word == "moderate", "medium").otherwise(word)
    ordinal = F.when(name == "critical", 3).when(name == "high", 2).when(name == "medium", 1).otherwise(0)
    return _with_severity(spark, sf_dir).filter(word != "").select("doc_id", name.alias("severity"), ordinal.alias("severity_label"))


def leakage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the strict and warning severity patterns by source."""
    flags = [F.count_if(filled().rlike(p)).alias(n) for n, p in (X.SEVERITY_STRICT | X.SEVERITY_WARNING).items()]
    return _with_severity(spark, sf_dir).groupBy("source").agg(*flags, n_rows().alias("n_rows"))


def severity_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters left when severity lines, scores, vectors and inline labels go, and then paragraphs that still name one."""
    return _with_severity(spark, sf_dir).select("doc_id", F.length(X.strip_severity(filled())).alias("chars"))


def condition_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters left of every record under each masking condition."""
    conditions = {"as_released": {}, "minus_cve_ids": {"cve": True}, "minus_urls": {"url": True}, "minus_versions": {"version": True}}
    return table(spark, sf_dir, "task2_exploit_type").select("rec_id", *[F.length(X.mask(filled(), **kw)).alias(n) for n, kw in conditions.items()])


def condition_masks_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for header lines alone and for everything together."""
    every = {"cve": True, "url": True, "version": True, "boilerplate": True}
    return table(spark, sf_dir, "task2_exploit_type").select("rec_id", F.length(X.mask(filled(), boilerplate=True)).alias("minus_boilerplate"), F.length(X.mask(filled(), **every)).alias("all_removed"))


def clean_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned text of every post that keeps some."""
    return table(spark, sf_dir, "raw_posts").select("row_id", X.clean_text(F.col("body")).alias("clean")).filter("clean <> ''")


def language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of mainly ASCII text, of none, and of the band between, by forum."""
    r = X.ascii_ratio(filled())
    gate = F.when(r >= 0.85, "accept").when(r < 0.5, "reject").otherwise("band")
    return table(spark, sf_dir, "forum_posts").groupBy("forum_id", gate.alias("gate")).agg(n_rows().alias("n"))


def preprocessing_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of the filter pipeline over the crawl in one plan: rows kept after each."""
    raw = table(spark, sf_dir, "raw_posts").select("row_id", "timestamp", "scraped_at", X.strip_html(F.coalesce("body", F.lit(""))).alias("t"))
    real = F.coalesce("timestamp", F.lit("")) != F.coalesce("scraped_at", F.lit(""))
    words = X.word_count(F.col("t"))
    stage = F.when(F.col("t") == "", 0).when(~real, 1).when(X.ascii_ratio(F.col("t")) < 0.85, 2).when(~words.between(4, 2000), 3).otherwise(4)
    staged = raw.select("row_id", stage.alias("stage"), F.when(stage == 4, X.fingerprint(F.col("t"))).alias("fp"))
    kept = staged.filter("stage = 4").groupBy("fp").agg(F.min("row_id").alias("row_id")).agg(n_rows().alias("after_dedup"))
    return staged.agg(n_rows().alias("n_rows"), *[F.count_if(F.col("stage") >= i).alias(n) for i, n in ((1, "after_text"), (2, "after_timestamp"), (3, "after_language"), (4, "after_length"))]).crossJoin(F.broadcast(kept))


def hmac_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed pseudonym of every author, and a new id made with it."""
    posts = table(spark, sf_dir, "forum_posts").filter("author_hash is not null")
    keyed = X.hmac_sha256(b"example-key", F.concat(F.lit("author_hash::"), F.col("author_hash")))
    return posts.select("post_key", keyed.alias("author")).select("post_key", "author", X.post_id(F.col("author"), F.col("post_key").cast("string")).alias("unified_id"))


def governed_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Released form of every document: texts of pointer-only sources become a hash and a length."""
    return apply_policy(table(spark, sf_dir, "documents").select("doc_id", "source_layer", "text"), "source_layer", "text")


def governed_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by release mode and the violations among them."""
    return violations(governed_redaction(spark, sf_dir))


def thread_first_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of every thread with its title as prefix, by index and key; rows without a thread are left out."""
    raw = table(spark, sf_dir, "raw_posts").filter("thread_id is not null")
    first = raw.groupBy("forum_id", "thread_id").agg(F.min_by(F.struct("row_id", "thread_title", "body"), F.struct(F.coalesce("post_index", F.lit(2**31 - 1)), "row_id")).alias("f"))
    return first.select("forum_id", "thread_id", "f.row_id", F.concat_ws("\n\n", "f.thread_title", "f.body").alias("text"))


def per_thread_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five posts of every thread by index: the feature is the cap, and the window keeps five rows a partition before it shuffles."""
    raw = table(spark, sf_dir, "raw_posts").filter("thread_id is not null").select("forum_id", "thread_id", "row_id", F.coalesce("post_index", F.lit(2**31 - 1)).alias("i"))
    w = W.partitionBy("forum_id", "thread_id").orderBy("i", "row_id")
    return raw.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("forum_id", "thread_id", "row_id", "place")


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct addresses by canonical thread address."""
    raw = table(spark, sf_dir, "raw_posts").filter("thread_url is not null")
    return raw.groupBy(X.canonical_url(F.col("thread_url")).alias("url")).agg(n_rows().alias("n"), F.count_distinct("thread_url").alias("variants"))


def engine_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected engine of every forum against the declared one."""
    raw = table(spark, sf_dir, "raw_posts").filter("thread_url is not null")
    seen = raw.groupBy("forum_id", X.engine(F.col("thread_url"), F.lit(None).cast("string")).alias("detected")).agg(n_rows().alias("n"))
    return seen.join(broadcast_if_small(table(spark, sf_dir, "forums").select("forum_id", "engine")), "forum_id").select("forum_id", "engine", "detected", "n")


def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of every body that holds markup, before and after tags and entities go."""
    raw = table(spark, sf_dir, "raw_posts").filter(F.col("body").contains("<") | F.col("body").contains("&"))
    return raw.select("row_id", F.length("body").alias("before"), F.length(X.strip_html(F.col("body"))).alias("after"))


def text_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and text joined by a blank line, equal and empty parts once, with a slug and a token estimate."""
    items = table(spark, sf_dir, "task1_cve_linkage")
    parts = F.array_distinct(F.filter(F.array(F.trim("title"), F.trim("text")), lambda p: p.isNotNull() & (p != "")))
    rows = items.select("item_id", F.array_join(parts, "\n\n").alias("text"), X.slugify(F.coalesce("title", F.lit(""))).alias("slug"))
    return rows.select("item_id", F.md5("text").alias("text_md5"), F.greatest(F.lit(1), F.floor(F.length("text") / 4).cast("int")).alias("token_estimate"), "slug")


def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and share of every label within its split."""
    n = table(spark, sf_dir, "task2_exploit_type").groupBy(F.col("_split").alias("split"), "label").agg(n_rows().alias("n"))
    return n.select("split", "label", "n", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("split")), 3).alias("pct"))


def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested access: keys of the JSON properties by type of event."""
    keys = table(spark, sf_dir, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("k"))
    return keys.groupBy("event_type", "k").agg(n_rows().alias("n"))


QUERIES = {f.__name__: f for f in (cve_extract_explode, cti_score, actionable_patterns, title_cascade_label, weak_ternary_label, severity_extract, severity_strip, leakage_flags, condition_masks, condition_masks_boilerplate, clean_posts, language_gate, preprocessing_pipeline, hmac_rekey, governed_redaction, governed_validation, thread_first_post, per_thread_cap, url_canonical, engine_detect, html_strip, text_assembly, label_distribution, props_json)}

_t = "coalesce(text, '')"
_cti = " + ".join(f"(case when contains(lower({_t}), '{k}') then {w} else 0 end)" for w, ks in X.CTI_KEYWORDS for k in ks)
_quote = lambda p: p.replace("'", "''")
_act = " + ".join(f"regexp_matches(coalesce(exploit_text, ''), '{_quote(p)}')::int" for p in X.ACTIONABLE)
_class = "case " + " ".join(f"when {' or '.join(f"contains(p, '{k}')" for k in ks)} then '{n}'" for n, ks in X.TITLE_CLASSES) + " end"
_norm = lambda c: rf"trim(regexp_replace(lower({c}), '[ \t\n\r\f\x0B]+', ' ', 'g'))"
_any = lambda ks: "(" + " or ".join(f"contains(lower({_t}), '{k}')" for k in ks) + ")"
_ratio = lambda c: rf"case when {c} = '' then 0 else length(regexp_replace({c}, '[^\x00-\x7F]', '', 'g'))::double / length({c}) end"
_sub = lambda c, p: f"regexp_replace({c}, '{_quote(p)}', ' ', 'g')"
_strip = lambda c: rf"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace({c}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\x0B]{{2,}}', ' ', 'g'), ' ')"""
_policies = ", ".join(f"('{k}', '{m}', '{a}')" for k, (m, a) in POLICIES.items())
_governed = f"""select doc_id, d.source_layer, coalesce(m, 'metadata_or_pointer_only') as release_mode, coalesce(a, 'pointer') as released_artifact,
case when coalesce(m, 'metadata_or_pointer_only') <> 'metadata_or_pointer_only' and coalesce(a, 'pointer') <> 'pointer' then text end as text,
case when coalesce(m, 'metadata_or_pointer_only') = 'metadata_or_pointer_only' or coalesce(a, 'pointer') = 'pointer' then case when {_t} = '' then '' else sha256(text) end end as text_sha256,
case when coalesce(m, 'metadata_or_pointer_only') = 'metadata_or_pointer_only' or coalesce(a, 'pointer') = 'pointer' then length({_t})::int end as text_length,
case when coalesce(m, 'metadata_or_pointer_only') = 'metadata_or_pointer_only' or coalesce(a, 'pointer') = 'pointer' then 'metadata_or_pointer_only_release_mode' end as redaction_reason
from documents d left join (values {_policies}) as p(k, m, a) on d.source_layer = p.k"""
_sev = "(select doc_id, source, coalesce(text, '') || case when doc_id % 7 = 3 then chr(10) || 'Severity: ' || ['Critical', 'HIGH', 'medium', 'Moderate', 'low'][doc_id % 5 + 1] || chr(10) || chr(10) || 'CVSS: 7.5' when doc_id % 7 = 4 then ' a high severity flaw' else '' end as text from documents)"
_flags = ", ".join(f"count(*) filter (regexp_matches({_t}, '{_quote(p)}')) as {n}" for n, p in (X.SEVERITY_STRICT | X.SEVERITY_WARNING).items())
_pad = lambda x: "".join(f"\\x{b ^ x:02X}" for b in b"example-key".ljust(64, b"\0"))
SQL = {
    "cve_extract_explode": rf"with r as (select distinct doc_id, upper(unnest(regexp_extract_all({_t}, '(?i)CVE-\d{{4}}-\d{{4,7}}'))) as cve_id from documents) select doc_id, cve_id, substr(cve_id, 5, 4)::int as year from r",
    "cti_score": f"select post_key, ({_cti})::int as score from forum_posts",
    "actionable_patterns": f"select pair_id, {_act} as patterns from ev_pairs",
    "title_cascade_label": rf"with r as (select rec_id, label, split_part({_t}, chr(10), 1) as f from task2_exploit_type), s as (select rec_id, label, lower(case when instr(f, ' - ') > 0 then substr(f, instr(f, ' - ') + 3) else f end) as p from r) select rec_id, {_class} as predicted, label from s",
    "weak_ternary_label": rf"""with r as (select forum_id, regexp_matches({_t}, '(?i)CVE-\d{{4}}-\d{{4,7}}') as c, {_any(["exploit", "payload", "shellcode", "poc", "proof of concept", "metasploit", "reverse shell"])} as a, {_any(["vulnerability", "vuln", "overflow", "injection", "bypass", "disclosure", "patch", "advisory"])} as v from forum_posts)
select forum_id, case when c and a then 2 when c or v then 1 else 0 end as label, count(*) as n from r group by 1, 2""",
    "severity_extract": rf"""with r as (select doc_id, lower(regexp_extract({_t}, '(?i)\bseverity\s*[:=]\s*(critical|high|medium|moderate|low)\b', 1)) as w from {_sev}), s as (select doc_id, case when w = 'moderate' then 'medium' else w end as severity from r where w <> '')
select doc_id, severity, case severity when 'critical' then 3 when 'high' then 2 when 'medium' then 1 else 0 end as severity_label from s""",
    "leakage_flags": f"select source, {_flags}, count(*) as n_rows from {_sev} group by 1",
    "condition_masks": f"select rec_id, length({_t})::int as as_released, length({_sub(_t, X.MASK_CVE)})::int as minus_cve_ids, length({_sub(_t, X.MASK_URL)})::int as minus_urls, length({_sub(_t, X.MASK_VERSION)})::int as minus_versions from task2_exploit_type",
    "language_gate": f"with r as (select forum_id, {_ratio(_t)} as r from forum_posts) select forum_id, case when r >= 0.85 then 'accept' when r < 0.5 then 'reject' else 'band' end as gate, count(*) as n from r group by 1, 2",
    "preprocessing_pipeline": rf"""with r as (select row_id, timestamp, scraped_at, {_strip("coalesce(body, '')")} as t from raw_posts),
s as (select row_id, t, case when t = '' then 0 when coalesce(timestamp, '') = coalesce(scraped_at, '') then 1 when {_ratio('t')} < 0.85 then 2 when not len(regexp_extract_all(t, '[^ \t\n\r\f\v]+')) between 4 and 2000 then 3 else 4 end as stage from r)
select count(*) as n_rows, count(*) filter (stage >= 1) as after_text, count(*) filter (stage >= 2) as after_timestamp, count(*) filter (stage >= 3) as after_language, count(*) filter (stage >= 4) as after_length, (select count(distinct {_norm('t')}) from s where stage = 4) as after_dedup from s""",
    "hmac_rekey": rf"""with r as (select post_key, sha256('{_pad(0x5C)}'::blob || unhex(sha256('{_pad(0x36)}'::blob || encode('author_hash::' || author_hash)))) as author from forum_posts where author_hash is not null)
select post_key, author, substr(sha256(author || '::' || post_key::varchar), 1, 20) as unified_id from r""",
    "governed_redaction": _governed,
    "governed_validation": f"with g as ({_governed}) select release_mode, count(*) as n_rows, count(text_sha256) as redacted, count(*) filter (text_sha256 is not null and text is not null) as violations from g group by 1",
    "thread_first_post": """with k as (select *, row_number() over (partition by forum_id, thread_id order by coalesce(post_index, 2147483647), row_id) as rn from raw_posts where thread_id is not null)
select forum_id, thread_id, row_id, concat_ws(chr(10) || chr(10), thread_title, body) as text from k where rn = 1""",
    "per_thread_cap": "with k as (select forum_id, thread_id, row_id, row_number() over (partition by forum_id, thread_id order by coalesce(post_index, 2147483647), row_id)::int as place from raw_posts where thread_id is not null) select * from k where place <= 5",
    "severity_strip": rf"""with r as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_t}, '(?im)^\s*\[?\s*(?:severity|sev|cvss[^:]*)\s*:\s*(?:critical|high|medium|moderate|low)\s*\]?\s*$', '', 'g'), '(?im)^\s*cvss(?:\s+(?:score|base score))?\s*:\s*[0-9.]+(?:\s*/\s*10)?\s*$', '', 'g'), '(?i)CVSS:\d\.\d/[A-Z:0-9./-]+', '', 'g'),
 '(?i)\[?\s*(?:severity|sev|cvss[^:]*)\s*:\s*(?:critical|high|medium|moderate|low)\s*\]?', '', 'g') as t from {_sev}), p as (select doc_id, regexp_split_to_array(t, '\n\s*\n') as ps from r),
k as (select doc_id, array_to_string(list_filter(list_transform(list_filter(ps, lambda p: not (contains(lower(p), 'severity') and regexp_matches(p, '(?i)critical|high|medium|moderate|low')) and not (contains(lower(p), 'cvss') and regexp_matches(p, '\b[0-9](?:\.[0-9])?\s*(?:/10)?\b'))), lambda p: trim(p, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda p: p <> ''), chr(10) || chr(10)) as t from p)
select doc_id, length(trim(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))::int as chars from k""",
    "condition_masks_boilerplate": f"""with r as (select rec_id, {_sub(_t, X.MASK_BOILERPLATE)} as b from task2_exploit_type) select rec_id, length(b)::int as minus_boilerplate, length({_sub(_sub(_sub('b', X.MASK_CVE), X.MASK_URL), X.MASK_VERSION)})::int as all_removed from r""",
    "url_canonical": r"""with r as (select thread_url, lower(regexp_extract(thread_url, '^([A-Za-z]+)://', 1)) as s, lower(regexp_extract(thread_url, '^[A-Za-z]+://([^/?#]*)', 1)) as h, regexp_extract(thread_url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as p, regexp_extract(thread_url, '^[^?#]*\?([^#]*)', 1) as q from raw_posts where thread_url is not null),
p as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '/+', '/', 'g'), '(?i)/(unread|latest|new-post|last-post)/?$', '/'), '(?i)/page-\d+/?$', '/'), '(?i)/page/\d+/?$', '/') as c, array_to_string(list_filter(string_split(q, '&'), lambda x: regexp_matches(x, '^(?i:t|tid|thread|thread_id|topic|topic_id|showtopic|f|fid|forum|forum_id|id)=.+$')), '&') as k from r)
select s || '://' || h || case when c = '/' then c else regexp_replace(c, '/+$', '') end || case when k <> '' then '?' || k else '' end as url, count(*) as n, count(distinct thread_url) as variants from p group by 1""",
    "engine_detect": r"""select r.forum_id, engine, case when regexp_matches(thread_url, '(?i)view(forum|topic)\.php') then 'phpbb' when regexp_matches(thread_url, '(?i)(forumdisplay|showthread)\.php') then 'mybb' when regexp_matches(thread_url, '(?i)\?app=forums') then 'invision' else 'unknown' end as detected, count(*) as n
from raw_posts r join forums f on r.forum_id = f.forum_id where thread_url is not null group by 1, 2, 3""",
    "html_strip": f"select row_id, length(body)::int as before, length({_strip('body')})::int as after from raw_posts where contains(body, '<') or contains(body, '&')",
    "text_assembly": r"""with r as (select item_id, trim(title, ' ') as a, trim(text, ' ') as b, regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from task1_cve_linkage),
s as (select item_id, slug, case when coalesce(a, '') = '' then coalesce(b, '') when coalesce(b, '') = '' or a = b then a else a || chr(10) || chr(10) || b end as t from r) select item_id, md5(t) as text_md5, greatest(1, length(t) // 4)::int as token_estimate, slug from s""",
    "label_distribution": "select _split as split, label, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (partition by _split), 3) as pct from task2_exploit_type group by 1, 2",
    "props_json": "select event_type, k, count(*) as n from (select event_type, unnest(json_keys(props)) as k from events) group by 1, 2",
}

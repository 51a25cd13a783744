import hashlib
import hmac
import html
import json
import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctilake.functions import text as X
from ctilake.operators import metrics as M
from ctilake.operators import neardup as D
from ctilake.operators import release
from ctilake.operators import retrieval as R
from ctilake.operators.dedup import keep_first, keep_last, keep_priority
from ctilake.operators.sampling import balanced, per_stratum, round_robin
from ctilake.plans import corpus, splits
from ctilake.sources import html as H
from ctilake.sources import readers, schemas, writers
from ctilake.sources.paged import PagedJson


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()[0]


def test_clean_text(spark):
    raw = "<b>Caf&eacute;</b> é [quote=x]hi[/quote]\n> old line\nsee http://a.example/x?y=1 and `rm -rf` now\n\n\n\nend  "
    assert one(spark, X.clean_text(F.col("x")), raw) == "Café é hi \n\nsee <URL> and <CODE> now\n\nend".replace("hi \n\nsee", "hi \n\nsee")
    assert one(spark, X.clean_text(F.col("x")), None) == ""


def test_strip_html(spark):
    assert one(spark, X.strip_html(F.col("x")), "<p>Hello <b>world</b></p>") == "Hello world"
    assert one(spark, X.strip_html(F.col("x")), "&amp; &lt;p&gt; &quot;test&quot;") == '& "test"'


def test_hmac(spark):
    for key in (b"k", b"long" * 40):
        assert one(spark, X.hmac_sha256(key, F.col("x")), "author_hash::abc") == hmac.new(key, b"author_hash::abc", hashlib.sha256).hexdigest()


def test_labels_and_dates(spark):
    assert one(spark, X.title_class(F.col("x")), "Tool 1.0 - SQL Injection / RCE") == "rce"
    assert one(spark, X.title_class(F.col("x")), "Some Heap Overflow") == "memory_corruption"
    assert one(spark, X.title_class(F.col("x")), "hello") is None
    assert one(spark, X.date_split(X.iso_date(F.col("x"))), "2022-01-01T00:00:00") == "val"
    assert one(spark, X.date_split(X.iso_date(F.col("x"))), "2024") is None
    assert one(spark, X.cve_ids(F.col("x")), "cve-2020-1234 CVE-2020-1234 CVE-1999-00001") == ["CVE-2020-1234", "CVE-1999-00001"]
    assert one(spark, X.word_count(F.col("x")), "") == 0
    assert one(spark, X.canonical_url(F.col("x")), "HTTP://A.Example//t/1/page-3/?a=1&TID=7&f=#p4") == "http://a.example/t/1?TID=7"


def test_dedup_and_ties(spark):
    df = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 5, "y"), (3, "a", 9, "z"), (4, None, 1, "n"), (5, None, 1, "m")], "id int, k string, p int, v string")
    assert sorted(map(tuple, keep_first(df, ["k"], "id").collect()), key=str) == [("a", 1), (None, 4)]
    assert {(r["k"], r["id"], r["removed"]) for r in keep_priority(df, ["k"], "p", "id").collect()} == {("a", 3, 2), (None, 4, 1)}
    assert {tuple(r) for r in keep_last(df, ["k"], "id", "v").collect()} == {("a", "z"), (None, "m")}
    assert keep_priority(df.limit(0), ["k"], "p", "id").count() == 0


def test_samples_are_stable(spark):
    df = spark.createDataFrame([(i, i % 3, int(i % 7 == 0)) for i in range(300)], "id int, s int, y int")
    a, b = per_stratum(df, ["s"], "id", 5), per_stratum(df.repartition(7), ["s"], "id", 5)
    assert a.count() == 15 and set(map(tuple, a.collect())) == set(map(tuple, b.collect()))
    by = {(r["s"], r["y"]): r["n"] for r in balanced(df, ["s"], "y", "id").groupBy("s", "y").agg(F.count("*").alias("n")).collect()}
    assert all(by[s, 0] == by[s, 1] for s in range(3))
    assert [r["turn"] for r in round_robin(df, "s", "id", 7).collect()] == [1, 1, 1, 2, 2, 2, 3]


def test_release_leaves_no_text(spark):
    df = spark.createDataFrame([(1, "hacker_community", "secret"), (2, "advisory_reference", "open"), (3, None, None), (4, "unknown", "")], "id int, layer string, text string")
    out = {r["id"]: r for r in release.apply_policy(df, "layer", "text").collect()}
    assert out[1]["text"] is None and out[1]["text_sha256"] == hashlib.sha256(b"secret").hexdigest() and out[1]["text_length"] == 6
    assert out[2]["text"] == "open" and out[2]["text_sha256"] is None
    assert out[3]["text_sha256"] == "" and out[4]["text_length"] == 0
    assert all(r["violations"] == 0 for r in release.violations(release.apply_policy(df, "layer", "text")).collect())


def test_ranks_and_metrics(spark):
    scores = spark.createDataFrame([(1, d, s) for d, s in enumerate((0.9, 0.8, 0.8, 0.8, 0.1))], "q int, d int, score double")
    r = R.gold_ranks(scores, spark.createDataFrame([(1, 2)], "q int, d int")).first()
    assert (r["rank"], r["rank_opt"], r["rank_pes"]) == (3, 2, 4)
    ranks = spark.createDataFrame([("m", x, x, x) for x in (1, 2, 3, 10, 20, None)], "g string, rank int, rank_opt int, rank_pes int")
    m = M.ir_metrics(ranks, ["g"]).first()
    assert m["n"] == 6 and m["recall_1"] == round(1 / 6, 6) and m["missing"] == 1
    import math

    assert abs(m["ndcg_10"] - sum(1 / math.log2(x + 1) for x in (1, 2, 3, 10)) / 6) < 1e-6
    rows = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    assert M.auc(rows, "y", "s").first()["auc"] == 0.875


def test_bm25_against_brute_force(spark):
    import math
    from collections import Counter

    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choice("alpha beta gamma delta eps zeta eta".split()) for _ in range(rnd.randint(0, 12)))) for i in range(40)]
    qs = [(i, " ".join(rnd.choice("alpha beta gamma delta none".split()) for _ in range(4))) for i in range(8)]
    d, q = spark.createDataFrame(docs, "id int, t string"), spark.createDataFrame(qs, "id int, t string")
    got = {(r["q"], r["d"]): r["score"] for r in R.bm25(R.postings(q, "id", F.col("t")), R.postings(d, "id", F.col("t"))).collect()}
    tf = {i: Counter(t.split()) for i, t in docs if t}
    n, avg = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    df = Counter(w for c in tf.values() for w in c)
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    mean = sum(raw.values()) / len(raw)
    for (i, j), s in got.items():
        c = tf[j]
        e = sum((0.25 * mean if raw[w] < 0 else raw[w]) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) for w in dict(qs)[i].split() if w in c)
        assert abs(s - e) < 2e-6


def test_dense_search_is_exact(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(60, 8))
    v[5] = v[6]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id int, e array<double>")
    got = {}
    for r in R.dense_top_k(df, "id", "e", df.filter("id < 9"), 5, block=4).collect():
        got.setdefault(r["q"], []).append((r["place"], r["d"]))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(9):
        s = np.round(u @ u[q], 6)
        assert [d for _, d in sorted(got[q])] == sorted(range(60), key=lambda d: (-s[d], d))[:5]


def brute_edges(rows, threshold=0.8):
    sets = {}
    for k, t in sorted(rows):
        w = (t or "").lower().split()
        if w and tuple(w) not in {s[0] for s in sets.values()}:
            sets[k] = (tuple(w), {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a][1] & sets[b][1]) >= threshold * len(sets[a][1] | sets[b][1]) - 1e-9}


def test_jaccard_edges_lose_nothing(spark):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefgh") for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(70):
        w = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = "zz"
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "one two"), (103, "ONE  two"), (104, "x " * 20000)]
    df = spark.createDataFrame(rows, "id bigint, t string").withColumn("key", F.lit(1)).withColumn("s", F.lit(2)).withColumn("h", F.lit(3))
    assert {(r["a"], r["b"]) for r in D.jaccard_edges(df, "id", "t").collect()} == brute_edges(rows)
    assert D.jaccard_edges(df.limit(0), "id", "t").count() == 0
    near = D.simhash_edges(df, "id", "t")
    assert near.count() == near.select("a", "b").distinct().count()


def test_greedy_kept_equals_the_loop(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        n = 30
        edges = sorted({tuple(sorted(rnd.sample(range(n), 2))) for _ in range(45)})
        kept = set()
        for v in range(n):
            if not any((u, v) in set(edges) for u in kept):
                kept.add(v)
        nodes = spark.createDataFrame([(i,) for i in range(n)], "key int")
        out = D.greedy_kept(nodes, spark.createDataFrame(edges, "a int, b int"))
        assert {r["key"] for r in out.filter("kept").collect()} == kept


def test_greedy_kept_decides_long_chains(spark):
    n = 120
    nodes = spark.createDataFrame([(i,) for i in range(n)], "key int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a int, b int")
    assert {r["key"]: r["kept"] for r in D.greedy_kept(nodes, edges).collect()} == {i: i % 2 == 0 for i in range(n)}


def test_every_year_is_counted(spark, tmp_path):
    years = [*range(1999, 2031), None]
    docs = spark.createDataFrame([("a", y and f"{y}-06-01") for y in years], "source_layer string, d string")
    docs.select("source_layer", F.to_timestamp("d").alias("published_at")).write.parquet(str(tmp_path / "documents.parquet"))
    assert {(r["year"], r["n"]) for r in corpus.source_year_counts(spark, str(tmp_path)).collect()} == {(y, 1) for y in years}


def test_every_pair_gets_a_negative(spark, tmp_path):
    rnd = random.Random(7)
    cases = {"hot": [(i, "CVE-1" if rnd.random() < 0.6 else f"CVE-{rnd.randrange(40)}") for i in range(300)] + [(999, None)], "nearly_one": [(i, "CVE-2" if i == 17 else "CVE-1") for i in range(50)], "one": [(i, "CVE-1") for i in range(5)]}
    for name, rows in cases.items():
        (tmp_path / name).mkdir()
        spark.createDataFrame(rows, "pair_id bigint, cve_id string").write.parquet(str(tmp_path / name / "ev_pairs.parquet"))
        order = sorted((r for r in rows if r[1]), key=lambda r: (hashlib.md5(f"42|{r[0]}".encode()).hexdigest(), r[0]))
        want = {p: next((q for q, d in order[i:] + order[:i] if d != c), None) for i, (p, c) in enumerate(order)}
        got = splits.negative_for_every_pair(spark, str(tmp_path / name)).collect()
        assert len(got) == len({r["pair_id"] for r in got})
        assert {r["pair_id"]: r["negative_id"] for r in got} == {p: q for p, q in want.items() if q is not None}


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=80))
def test_normal_form_is_idempotent(t):
    import re

    normal = lambda x: re.sub(r"[ \t\n\r\f\x0B]+", " ", x.lower()).strip(" ")
    assert normal(normal(t)) == normal(normal(normal(t)))


def test_jsonl_modes(spark, tmp_path):
    p = tmp_path / "a_posts.jsonl"
    p.write_text('{"id": "1", "text": "x"}\n\nnot json\n{"id": "2", "extra": 1}\n')
    assert [r["id"] for r in readers.jsonl(spark, str(p), schemas.FORUM_POST).orderBy("id").collect()] == ["1", "2"]
    assert readers.jsonl(spark, str(p), schemas.FORUM_POST, mode="keep").select("id", "_bad").collect() and len([r for r in readers.jsonl(spark, str(p), schemas.FORUM_POST, mode="keep").select("id", "_bad").collect() if r["_bad"]]) == 1
    assert [r["id"] for r in readers.jsonl(spark, str(p), schemas.FORUM_POST, limit=1).collect()] == ["1"]
    try:
        readers.jsonl(spark, str(p), schemas.FORUM_POST, mode="strict").collect()
        raise AssertionError("a bad line must fail")
    except Exception as e:  # noqa: BLE001
        assert "MALFORMED" in str(e).upper() or "JSON" in str(e).upper()


def test_union_keeps_the_first_file(spark, tmp_path):
    (tmp_path / "forum_a_posts.jsonl").write_text('{"id": "1", "text": "same text"}\n{"id": "2", "text": "Same  text"}\n')
    (tmp_path / "forum_b_raw.jsonl").write_text('{"id": "3", "text": "other"}\n')
    df = readers.union_in_order(spark, [str(tmp_path / n) for n in ("forum_a_posts.jsonl", "missing.jsonl", "forum_b_raw.jsonl")], schemas.FORUM_POST)
    rows = df.orderBy("file_rank", "line_no").collect()
    assert [(r["source_dataset"], r["source_format"], r["file_rank"]) for r in rows] == [("forum_a_posts", "forumpost", 0), ("forum_a_posts", "forumpost", 0), ("forum_b_raw", "raw", 1)]
    kept = df.groupBy(X.fingerprint(F.col("text"))).agg(F.min_by("id", F.struct("file_rank", "line_no")).alias("id"))
    assert {r["id"] for r in kept.collect()} == {"1", "3"}
    assert readers.union_in_order(spark, ["/nowhere/x.jsonl"], schemas.FORUM_POST).count() == 0


def test_delimited_bodies_and_nested(spark, tmp_path):
    (tmp_path / "x.csv").write_text('ID,file,note\n1,a.txt,"two\nlines"\n2,none.txt,""\n')
    (tmp_path / "bodies").mkdir()
    (tmp_path / "bodies" / "a.txt").write_text("body of\na")
    df = readers.with_bodies(readers.delimited(spark, str(tmp_path / "x.csv"), ["ID", "file", "note"]), "file", str(tmp_path / "bodies"))
    assert {r["id"]: (r["note"], r["body"]) for r in df.collect()} == {"1": ("two\nlines", "body of\na"), "2": (None, None)} or {r["id"]: r["body"] for r in df.collect()} == {"1": "body of\na", "2": None}
    nested = spark.createDataFrame([("r", '[{"id": 1}, {"id": 2}]'), ("s", "[]")], "k string, items string")
    assert sorted((r["k"], r["item"]["id"] if r["item"] else None) for r in readers.items(nested, "items", "struct<id:int>").collect()) == [("r", 1), ("r", 2), ("s", None)]


def test_indexes_and_pages(spark, tmp_path):
    page = "|[Alpha](http://alpha.onion/x)| ONLINE | n |\n|[Beta](https://beta.example)| OFFLINE | n |\n"
    got = readers.markdown_index(spark.createDataFrame([(page,)], "t string"), "t").orderBy("name").collect()
    assert [(r["name"], r["online"], r["onion"]) for r in got] == [("Alpha", True, True), ("Beta", False, False)]
    rss = "<rss><channel><item><title>A</title><link>u</link><pubDate>d</pubDate></item></channel></rss>"
    assert readers.feed_items(spark.createDataFrame([(rss,)], "x string"), "x").first()["title"] == "A"
    tree = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c")], "id int, parent_id int, name string")
    assert {r["path"] for r in readers.category_tree(spark, tree).collect()} == {"a", "a / b", "a / b / c"}
    for i in range(5):
        (tmp_path / f"{i}.json").write_text(json.dumps({"items": [{"id": f"{i}-{j}"} for j in range(2)]}))
    spark.dataSource.register(PagedJson)
    assert spark.read.format("pagedjson").options(path=str(tmp_path), pages="6", pagesPerPartition="2").load().count() == 10
    article = '<article class="message" data-author="bob"><time datetime="2024-01-01"></time><div class="bbWrapper">Hi <b>all</b></div></article>'
    r = H.thread_posts(spark.createDataFrame([(1, article), (2, None)], "id int, html string"), "html", "xenforo", ["id"]).collect()
    assert [(x["id"], x["author"], x["text"]) for x in r] == [(1, "bob", "Hi all")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, s string, t string")
    assert writers.jsonl(df, str(tmp_path / "j")) == 2
    assert '"t":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    writers.csv(df, str(tmp_path / "c"), ["id", "missing", "t"])
    writers.by_key(df, str(tmp_path / "k"), "s")
    assert {p.name for p in (tmp_path / "k").glob("s=*")} == {"s=a", "s=b"}
    assert writers.append_results(df, str(tmp_path / "log"), ["id"]).count() == 2
    assert writers.append_results(df.union(spark.createDataFrame([(3, "c", None)], df.schema)), str(tmp_path / "log"), ["id"]).count() == 1
    assert json.loads(writers.manifest(df, "s"))["rows"] == 2
    assert writers.file_digests(spark, str(tmp_path / "j")).count() >= 1


def test_unescape_and_composition_match_the_standard_library(spark):
    for t in ("&lt;x&gt; &#233; &notit;", "ẹ́", "plain"):
        expected = html.unescape(unicodedata.normalize("NFC", t))
        df = spark.createDataFrame([(t,)], "x string")
        assert df.select(X._compose("x")).first()[0] == expected


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_temporal_sample_against_the_loop(spark):
    import datetime as dt
    import random

    from ctilake.operators.pipeline import temporal_sample

    rnd = random.Random(3)
    rows = [(i, dt.date(2020, 1, 1) + dt.timedelta(days=rnd.choice([0, 5, 40, 300, 301, 302, 1200])), rnd.randint(0, 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "key bigint, day date, score int")
    lo, hi = min(r[1] for r in rows), max(r[1] for r in rows)
    for n, spells in ((17, 4), (50, 7), (500, 3)):
        buckets = {}
        for r in rows:
            buckets.setdefault(min(spells - 1, int((r[1] - lo).days * spells / (hi - lo).days)), []).append(r)
        chosen = []
        for spell in sorted(buckets):
            held = sorted(buckets[spell], key=lambda r: (-r[2], r[0]))
            chosen += held[: len(rows) if n >= len(rows) else max(1, round(n * len(held) / len(rows)))]
        want = {r[0] for r in (sorted(chosen, key=lambda r: -r[2])[:n] if len(chosen) > n else chosen)}
        assert {r["key"] for r in temporal_sample(df, n, spells).collect()} == want
    same = df.withColumn("day", F.lit("2020-01-01").cast("date"))
    assert temporal_sample(same, 5, 3).count() == 5 and temporal_sample(df.limit(0), 5, 3).count() == 0


def test_pipeline_stages(spark):
    from ctilake.operators.pipeline import candidates, first_of_texts

    good = "a plain text of some words about an exploit"
    rows = [
        (1, "f", None, f"<b>{good}</b>", "2020-01-01T00:00:00", "2021-01-01"), (2, "f", None, good, "2020-01-01", "2021"), (3, "f", "title that stands in for it", " ", "2020-01-01", None), (4, "f", None, None, "2020-01-01", None),
        (5, "f", None, good, "soon", "2021-02-03T10"), (6, "f", None, good, "soon", "later"), (7, "f", None, good, "2020-01-01", "2020-01-01"), (8, "f", None, "ё" * 30, "2020-01-01", None), (9, "f", None, "two words", "2020-01-01", None), (10, "spam", None, good, "2020-01-01", None), (11, None, None, good, "2020-01-01", None),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, forum_id string, thread_title string, body string, timestamp string, scraped_at string")
    got = candidates(df, "row_id", cleaner=X.strip_html, blocked=("spam",))
    assert {r["key"]: r["failed"] for r in got.collect()} == {1: None, 2: None, 3: None, 4: "text", 5: None, 6: "timestamp", 7: "real_timestamp", 8: "language", 9: "length", 10: "forum", 11: None}
    assert {r["key"] for r in first_of_texts(got).collect()} == {1, 3}
    assert candidates(df.limit(0), "row_id").count() == 0


def test_entities_once_equals_the_loop(spark, tmp_path):
    import random

    from ctilake.plans.pipeline import entities_once

    rnd = random.Random(2)
    rows = [(i, f"f{rnd.randrange(12)}", f"https://{rnd.choice(['www.', ''])}h{rnd.randrange(12)}.example/t/{i}") for i in range(60)] + [(99, "f1", None)]
    spark.createDataFrame(rows, "row_id bigint, forum_id string, thread_url string").write.parquet(str(tmp_path / "raw_posts.parquet"))
    ids, hosts, want = set(), set(), set()
    for i, f, u in rows[:-1]:
        h = u.split("/")[2].removeprefix("www.")
        if f not in ids and h not in hosts:
            ids.add(f)
            hosts.add(h)
            want.add(i)
    assert {r["key"] for r in entities_once(spark, str(tmp_path)).collect()} == want


# --- advisories -------------------------------------------------------------------------------------------------------


def test_mail_parts(spark):
    from ctilake.functions import advisories as A

    mail = 'From: "Ann Lee" <ann@x.example> (work)\nSubject: a long\n  subject\nDate: now\n\nhello\n> quoted\n\n\n\n\nworld\n-----BEGIN PGP SIGNATURE-----\nzzz\n-----END PGP SIGNATURE-----\nbye\n-----BEGIN PGP MESSAGE-----\nopen'
    cases = [(mail, "hello\n\n\nworld\nbye", "a long subject", '"Ann Lee"'), ("no headers here", "no headers here", "", "unknown"), ("", "", "", "unknown"), (None, "", "", "unknown")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, m string")
    got = df.select(A.mail_body(F.col("m")), A.header_field(F.col("m"), "Subject"), A.author_name(A.header_field(F.col("m"), "From"))).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


def test_listing_parts(spark):
    from ctilake.functions import advisories as A

    page = "Document Title:\n===\nX\nRelease Date: 2020-01-02 \n\nDescription:\n====\n the text \n===\nPoC\n"
    df = spark.createDataFrame([(page, '[{id:"a",t:"it\\\'s"},{id:"b"}]', "&lt;b&gt;x<br>y &amp;amp; z<i>!</i>\n\n", "&lt;b&gt;x</b> &eacute;")], "p string, j string, h string, u string")
    r = df.select(A.key_value(F.col("p"), "release date"), A.section_after(F.col("p"), "description"), A.section_after(F.col("p"), "nowhere"), A.js_array(F.col("j"), "id string, t string"), A.listing_text(F.col("h")), A.unescaped_text(F.col("u"))).first()
    assert r[0] == "2020-01-02" and r[1] == "the text" and r[2] == "" and [tuple(x) for x in r[3]] == [("a", "it's"), ("b", None)]
    assert r[4] == "x\ny &amp; z !" and r[5] == "x é"


# --- more sources -----------------------------------------------------------------------------------------------------


def test_broken_archive_is_read_to_its_end(spark, tmp_path):
    import gzip
    import json

    from ctilake.sources import readers

    schema = "id string, text string"
    whole = gzip.compress("\n".join([*(json.dumps({"id": str(i), "text": f"t{i} é"}) for i in range(5000)), "", "{bad"]).encode())
    (tmp_path / "a.jsonl.gz").write_bytes(whole)
    (tmp_path / "b.jsonl.gz").write_bytes(whole[: len(whole) // 2])
    from pyspark.sql.types import StructType

    paths = [str(tmp_path / f"{c}.jsonl.gz") for c in "ab"]
    a, b = (readers.gzip_lines(spark, [p], StructType.fromDDL(schema)).collect() for p in paths)
    assert len(a) == 5000 and 100 < len(b) < 5000 and [r["text"] for r in b] == [r["text"] for r in a][: len(b)]
    assert readers.gzip_lines(spark, paths, StructType.fromDDL(schema)).count() == len(a) + len(b)


def test_union_ranks_by_whole_path(spark, tmp_path):
    from pyspark.sql.types import StructType

    from ctilake.sources import readers

    paths = []
    for i, d in enumerate(("z one", "a+two")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x_posts.jsonl").write_text(f'{{"id": "{i}"}}\n')
        paths.append(str(tmp_path / d / "x_posts.jsonl"))
    got = readers.union_in_order(spark, [*paths, str(tmp_path / "missing.jsonl")], StructType.fromDDL("id string")).collect()
    assert {(r["id"], r["file_rank"]) for r in got} == {("0", 0), ("1", 1)}


def test_saved_splits_and_embedding_cache(spark, tmp_path):
    import numpy as np
    import pyarrow as pa
    import pytest

    from ctilake.sources import readers

    for split, n in (("train", 3), ("test", 2)):
        (tmp_path / split).mkdir()
        batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([split] * n)], ["n", "q"])
        with pa.OSFile(str(tmp_path / split / "data-0.arrow"), "wb") as f, (pa.ipc.new_stream if n == 3 else pa.ipc.new_file)(f, batch.schema) as w:
            w.write_batch(batch)
    got = readers.saved_splits(spark, str(tmp_path), "n bigint, q string").collect()
    assert sorted((r["n"], r["split"]) for r in got) == [(0, "test"), (0, "train"), (1, "test"), (1, "train"), (2, "train")]
    assert readers.saved_splits(spark, str(tmp_path / "none"), "n bigint").count() == 0
    m = np.arange(35, dtype=np.float32).reshape(7, 5)
    np.save(tmp_path / "mini_lm.npy", m)
    ids = spark.createDataFrame([(f"d{i}",) for i in range(7)], "id string")
    got = {r["id"]: list(r["embedding"]) for r in readers.embedding_cache(spark, str(tmp_path / "mini-lm.npy"), ids, "id", 3).collect()}
    assert got == {f"d{i}": m[i].tolist() for i in range(7)}
    with pytest.raises(ValueError):
        readers.embedding_cache(spark, str(tmp_path / "mini_lm.npy"), ids.limit(3), "id")
    with pytest.raises(FileNotFoundError):
        readers.embedding_cache(spark, str(tmp_path / "other.npy"), ids, "id")


def test_linked_pages_and_mail_archive(spark, tmp_path):
    import json

    from ctilake.sources import readers
    from ctilake.sources.paged import LinkedJson

    pages = {"a.json": ([{"id": 1}, {"id": 2}], '<b.json>; rel="next", <z>; rel="last"'), "b.json": ([{"id": 3}], '<a.json>; rel="next"')}
    for name, (items, link) in pages.items():
        (tmp_path / name).write_text(json.dumps({"items": items, "link": link}))
    spark.dataSource.register(LinkedJson)
    assert [r["id"] for r in spark.read.format("linkedjson").option("path", str(tmp_path)).option("first", "a.json").load().collect()] == ["1", "2", "3"]
    for year, month in (("2020", "Dec"), ("2021", "Jan"), ("2021", "Mar")):
        (tmp_path / "mail" / year / month).mkdir(parents=True)
        (tmp_path / "mail" / year / month / "1.txt").write_text(f"Subject: {month}\n\nbody")
    got = readers.mail_archive(spark, str(tmp_path / "mail"), (2020, 11), (2021, 2)).collect()
    assert sorted((r["year"], r["month"]) for r in got) == [(2020, "Dec"), (2021, "Jan")]
    assert readers.mail_archive(spark, str(tmp_path / "mail"), (1999, 1), (1999, 2)).count() == 0


def test_summaries_and_digests(spark, tmp_path):
    import hashlib
    from pathlib import Path

    from ctilake.sources import writers

    rows = [{"c": "b", "n": "x", "v": 2000}, {"c": "a", "n": "y", "v": 3}, {"c": "b", "n": "z", "v": 5}]
    text = writers.grouped_summary(rows, "c", "n", "v", ["b", "a"])
    assert text.index("x") < text.index("z") < text.index("y") and "2,005" in text
    assert "2,005" in writers.grouped_summary(rows, "c", "n", "v", ["b"], latex=True)
    n, files = writers.digested_jsonl(spark.range(5).coalesce(1), str(tmp_path / "out"))
    one = files.collect()
    assert n == 5 and len(one) == 1 and one[0]["sha256"] == hashlib.sha256(Path(one[0]["path"].removeprefix("file:")).read_bytes()).hexdigest()
    writers.per_query(spark.range(3).withColumnRenamed("id", "q"), str(tmp_path / "runs"), "bm25")
    assert spark.read.parquet(str(tmp_path / "runs" / "bm25")).count() == 3


def test_span_strip_and_model_answers(spark):
    from ctilake.functions import judge as J

    df = spark.createDataFrame([("say the quick brown fox jumps over", "xx the quick brown fox jumps yy", 'ok {"a": {"b": 1}, "label": "Yes"} end'), ("short", "short", "none"), (None, "x", None)], "q string, g string, m string")
    got = df.select(J.strip_spans(F.col("q"), F.col("g")), J.task_label(J.json_field(F.col("m"), "label")), J.bool_of(J.json_field(F.col("m"), "label")), J.truncated(F.col("q"), 5)).collect()
    assert [tuple(r) for r in got] == [("say" + " " * 27 + "over", "1", True, "say t...[truncated]"), ("short", "0", None, "short"), (None, "0", None, None)]


def test_every_macro_f1_replicate_has_all_records(spark):
    from ctilake.operators import metrics as M

    rows = spark.createDataFrame([(i, "ab"[i % 2], "ab"[(i // 3) % 2]) for i in range(30)], "k int, y string, p string")
    r = M.bootstrap_macro_f1(rows, "k", "y", "p", 50).first()
    assert r["n"] == 30 and r["low"] <= r["macro_f1"] <= r["high"] <= 1
    s = M.f1_summary(rows.withColumn("s", F.lit("x")), ["s"], "y", "p").first()
    assert s["macro_f1"] == r["macro_f1"]


def test_minhash_filter_equals_the_loop(spark):
    import random

    from ctilake.operators import neardup as D

    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(120)) for _ in range(8)]
    rows = []
    for i in range(60):
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 14)):
            t[rnd.randrange(len(t))] = "z"
        rows.append((i, "".join(t), rnd.randint(0, 3)))
    rows += [(100, "ab", 1), (101, None, 1), (102, "", 1), (103, "q" * 20_000, 0), (104, "q" * 20_000, 5)]
    grams = {k: {t[i : i + 3] for i in range(len(t) - 2)} for k, t, _ in rows if t}
    alike = lambda x, y: bool(grams.get(x)) and bool(grams.get(y)) and len(grams[x] & grams[y]) >= 0.7 * len(grams[x] | grams[y])
    df = spark.createDataFrame(rows, "key bigint, text string, score int")
    edges = D.minhash_edges(df, "key", "text")
    assert {tuple(r) for r in edges.collect()} == {(x, y) for x in grams for y in grams if x < y and alike(x, y)}
    stay = []
    for k, _, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        if not any(alike(k, s) for s in stay):
            stay.append(k)
    assert {r["key"] for r in D.greedy_kept(df.select("key", "score"), edges, -F.col("score")).filter("kept").collect()} == set(stay)
    assert D.minhash_edges(df.limit(0), "key", "text").count() == 0


def test_simhash_edges_against_all_pairs(spark):
    import random

    from ctilake.operators import neardup as D

    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefgh", k=4))
    base = [[word() for _ in range(300)] for _ in range(4)]
    rows = []
    for i in range(60):
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = word()
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows + [(100, None), (101, ""), (102, rows[0][1].upper())], "key bigint, text string")
    sims = {r["key"]: r["sim"] for r in D.hashed_sets(df, "key", "text").select("key", "s").mapInArrow(D._simhash, "key bigint, sim bigint").collect()}
    d = lambda a, b: bin((sims[a] ^ sims[b]) & (2**64 - 1)).count("1")
    want = {(a, b, d(a, b)) for a in sims for b in sims if a < b and d(a, b) <= 3}
    assert {tuple(r) for r in D.simhash_edges(df, "key", "text").collect()} == want and len(want) > 20


def _search(spark):
    rnd = random.Random(8)
    words = "alpha beta gamma delta eps zeta eta theta iota".split()
    text = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, n)))
    docs = [(i, text(9), rnd.choice([1, 2, None])) for i in range(150)] + [(200 + i, "beta gamma", 2) for i in range(20)] + [(300, None, 1), (301, "none", 1)]
    asked = [(i, text(6), rnd.choice([1, 2, 3, None])) for i in range(30)] + [(40, None, 1), (41, "unheard", 1)]
    return [spark.createDataFrame(x, "key bigint, text string, label bigint") for x in (asked, docs)]


def _joined(asked, docs, variant, k1=1.5):
    posts = lambda df: R.postings(df, "key", F.coalesce("text", F.lit("")))
    return R.bm25(posts(asked), posts(docs), variant, k1)


def _equal(got, wanted):
    plain = lambda df: sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert plain(got) == plain(wanted.select(got.columns))


def test_bm25_in_parts_equals_the_join(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_ASKED", 20)
    asked, docs = _search(spark)
    for variant in ("okapi", "plus", "smoke"):
        _equal(R.top_k(R.bm25_scores(asked, docs, variant, keep=7), 7), R.top_k(_joined(asked, docs, variant), 7))
    assert R.bm25_scores(asked.limit(0), docs).count() == R.bm25_scores(asked, docs.limit(0)).count() == 0


def test_lexical_and_dense_mixture_without_pairs(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(R, "MOST_ASKED", 30)
    asked, docs = _search(spark)
    unit = lambda key: (x := np.random.default_rng(key % 9).normal(size=4)) / np.linalg.norm(x)
    give = lambda df: spark.createDataFrame([(*r, unit(r["key"]).tolist()) for r in df.drop("label").collect()], "key bigint, text string, vectors array<double>")
    got = R.top_k(R.Bm25(give(asked), give(docs), [("okapi", 1.5)]).with_vectors(5), 5)
    scores = _joined(asked, docs, "okapi").toPandas()
    best = scores.groupby("q")["score"].max()
    scores["score"] = [round(0.7 * (round(float(unit(q) @ unit(d)), 6) + 1) / 2 + 0.3 * (s / best[q] if best[q] > 0 else s), 6) for q, d, s in scores[["q", "d", "score"]].itertuples(index=False)]
    _equal(got, R.top_k(spark.createDataFrame(scores), 5))


def test_fused_scores_without_pairs_equal_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_ASKED", 30)
    asked, docs = _search(spark)
    got = R.Bm25(asked, docs, [("okapi", 1.5), ("smoke", 1.2)]).fused(5)
    _equal(R.top_k(got, 5), R.top_k(R.fuse(_joined(asked, docs, "okapi"), _joined(asked, docs, "smoke", 1.2)), 5))


def test_ranks_without_pairs_equal_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_ASKED", 30)
    asked, docs = _search(spark)
    gold = asked.select(F.col("key").alias("q"), "label").join(docs.select(F.col("key").alias("d"), "label"), "label").select("q", "d")
    for variant in ("okapi", "plus", "smoke"):
        _equal(R.Bm25(asked, docs, [(variant, 1.5)]).ranks(), R.gold_ranks(_joined(asked, docs, variant), gold))


def test_high_ties_take_the_last_keys_of_one_text(spark):
    from pyspark.sql import Window as W

    asked, docs = _search(spark)
    w = W.partitionBy("q").orderBy(F.desc("score"), F.desc("d"))
    best = lambda scores: scores.withColumn("place", F.row_number().over(w)).filter("place <= 7")
    _equal(best(R.bm25_scores(asked, docs, "plus", keep=7, high=True)), best(_joined(asked, docs, "plus")))


def test_bootstraps_draw_where_they_are_used(spark):
    from ctilake.operators import metrics as M

    rows = spark.createDataFrame([(i, ["a", "b", None][i % 3], "ab"[i % 2], i * i) for i in range(40)], "k int, y string, p string, v bigint")
    draw = lambda name, rep: [int(hashlib.md5(f"{name}|{rep}|{i}".encode()).hexdigest()[:8], 16) % 40 for i in range(1, 41)]
    means = sorted(sum(i * i for i in draw("g", rep)) / 40 for rep in range(41))
    got = M.bootstrap_mean(rows.withColumn("g", F.lit("g")), "g", "k", "v", 41)
    assert tuple(got.first()) == ("g", sum(i * i for i in range(40)) / 40, round(means[1], 4), round(means[39], 4))
    below = got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[-1].split("\n", 1)[-1]
    assert "rep#" not in below, "replicates are multiplied out before they are reduced"
    assert M.bootstrap_macro_f1(rows, "k", "y", "p", 41).first()["n"] == 40


def test_cosine_in_parts_and_with_equal_texts(spark, monkeypatch):
    import math
    from collections import Counter

    monkeypatch.setattr(R, "MOST_ASKED", 20)
    asked, docs = _search(spark)
    rows, qs = ({r["key"]: Counter((r["text"] or "").split()) for r in df.collect()} for df in (docs, asked))
    rows = {k: c for k, c in rows.items() if c}
    df = Counter(w for c in rows.values() for w in c)
    for idf in (True, False):
        of = lambda c: {w: n * ((math.log((1 + len(rows)) / (1 + df[w])) + 1) if idf else 1) for w, n in c.items()}
        cos = lambda a, b: sum(a[w] * b[w] for w in a if w in b) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        wanted = [(q, d, round(s, 6)) for q, c in qs.items() if c for d, e in rows.items() if (s := cos(of(c), of(e))) > 5e-7]
        got = R.cosine_scores(asked, docs, lambda t: F.regexp_extract_all(t, F.lit("([a-z]+)"), F.lit(1)), idf, keep=7)
        _equal(R.top_k(got, 7), R.top_k(spark.createDataFrame(wanted, "q bigint, d bigint, score double"), 7))


def test_parts_bound_what_tasks_keep(spark, monkeypatch):
    asked, docs = _search(spark)
    one = R._parts(R.postings(asked, "key", F.col("text")), 7)
    monkeypatch.setattr(R, "MOST_KEPT", 50)
    assert len(one) == 1 < len(R._parts(R.postings(asked, "key", F.col("text")), 7))
    for variant in ("okapi", "smoke"):
        _equal(R.top_k(R.bm25_scores(asked, docs, variant, keep=7), 7), R.top_k(_joined(asked, docs, variant), 7))
    _equal(R.top_k(R.Bm25(asked, docs, [("okapi", 1.5), ("smoke", 1.2)]).fused(7), 7), R.top_k(R.fuse(_joined(asked, docs, "okapi"), _joined(asked, docs, "smoke", 1.2)), 7))


def test_parts_of_queries_are_given_back_one_by_one(spark, monkeypatch):
    from pyspark.core.broadcast import Broadcast

    held, most, made, given = set(), [], type(spark.sparkContext).broadcast, Broadcast.destroy

    def make(sc, value):
        shared = made(sc, value)
        held.add(id(shared))
        most.append(len(held))
        return shared

    def give(shared, blocking=False):
        held.discard(id(shared))
        given(shared, blocking)

    monkeypatch.setattr(R, "MOST_ASKED", 20)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", make)
    monkeypatch.setattr(Broadcast, "destroy", give)
    asked, docs = _search(spark)
    search = R.Bm25(asked, docs, [("okapi", 1.5), ("smoke", 1.2)])
    for scores in (lambda: R.cosine_scores(asked, docs, lambda t: F.split(t, " ")), lambda: search.fused(5), lambda: search.best(5), search.ranks_by_scorer):
        scores().collect()
        assert len(most) > 2 and max(most) == 1 and not held
        most.clear()


def test_scores_come_in_pieces_that_a_cache_holds(monkeypatch):
    import numpy as np

    from ctilake.operators import scoring as S

    monkeypatch.setattr(S, "CELLS", 12)
    rng = np.random.default_rng(3)
    shared = rng.random((40, 6)) < 0.4
    asked = rng.random((4, 6)) < 0.5
    for low in (0.5, -0.5):  # weights above zero, and some below
        weight, q = rng.random((40, 6)) + low, np.nonzero(asked)
        side = S.Side(np.arange(4), q[1], q[0], [np.ones(len(q[0])), np.full(len(q[0]), 2.0)], shared.sum(0).astype(float), 40, 0 if low > 0 else None)
        d, tok = np.nonzero(shared)
        eat, sizes = S.Ends(), []
        eat.begin(side)
        for lo, scores in side.blocks(d, tok, [weight[d, tok]] * 2, 40, eat):
            sizes.append(scores[0].size)
            eat.take(scores, None)
        full = np.where((shared.astype(int) @ asked.T) > 0, np.round((shared * weight) @ asked.T, 6), np.nan)
        got = eat.end()
        assert max(sizes) <= 12 and sum(sizes) == full.size and eat.raw == (low > 0)
        for i, x in enumerate((np.nanmin(full, 0), np.nanmax(full, 0))):
            assert np.allclose(got[1 + i], x) and np.allclose(got[3 + i], 2 * x, atol=2e-6)


def test_ranks_by_scorer_equal_those_of_each(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_ASKED", 30)
    asked, docs = _search(spark)
    gold = asked.select(F.col("key").alias("q"), "label").join(docs.select(F.col("key").alias("d"), "label"), "label").select("q", "d")
    scorers = [("okapi", 1.5), ("plus", 1.5), ("smoke", 1.2)]
    got = R.Bm25(asked, docs, scorers).ranks_by_scorer()
    for i, (variant, k1) in enumerate(scorers):
        _equal(got.filter(F.col("s") == i).drop("s"), R.gold_ranks(_joined(asked, docs, variant, k1), gold))


def test_only_similar_texts_leave_the_band_tasks(spark, monkeypatch):
    monkeypatch.setattr(D, "PAIRS", 5)
    rnd = random.Random(3)
    base = "the file NAME is written to the folder without any question when it starts 😀😁"
    rows = [(i, base.replace("NAME", "".join(rnd.choices("abcdefghij", k=rnd.choice([8, 30]))))) for i in range(60)] + [(100, rows_ := base.upper()), (101, rows_), (102, "ab"), (103, None), (104, "abc")]
    grams = {k: {t.lower()[i : i + 3] for i in range(len(t) - 2)} for k, t in rows if t and len(t) > 2}
    like = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    want = {(a, b) for a in grams for b in grams if a < b and like(a, b) >= 0.7}
    assert len(want) < len(grams) * (len(grams) - 1) / 4
    df = spark.createDataFrame(rows, "key bigint, text string")
    one = df.filter("length(text) >= 3").select("key", F.lower("text").alias("t")).mapInArrow(D._minhash(1, 1), "key bigint, t string, n int, hs array<bigint>")
    got = one.select(F.lit(1).cast("bigint").alias("h"), "key", "n", "t").coalesce(1).mapInArrow(D._similar(0.7), "a bigint, b bigint").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    before = spark.conf.get(D.CLEANUP, None)
    assert {tuple(r) for r in D.minhash_edges(df, "key", "text").collect()} <= want and spark.conf.get(D.CLEANUP, None) == before

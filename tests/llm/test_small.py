"""Small cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctilake.llm import codepoints as C
from ctilake.llm import duplicates, encoding, languages, leakage, lookalikes, overlap, packing, residue, tokens


def clash(df):
    """Columns named like those that operators make inside."""
    for c in ("h", "g", "p", "q", "l", "node", "sim", "same", "canonical", "side", "c1", "code", "lang2", "_text", "_class", "n", "piece"):
        df = df.withColumn(c, F.lit(1)) if c not in df.columns else df
    return df


def frame(spark, rows, schema="id bigint, text string"):
    return clash(spark.createDataFrame(rows, schema))


# --- code points -----------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.characters(exclude_categories=["Cs"]), max_size=30)), max_size=8))
def test_code_points_round_trip(texts):
    a = pa.array(texts, pa.string())
    got = []
    for part in C.chunks(a, limit=20):
        blob, off = C.utf8(part)
        cps, at, starts = C.decode(blob, off)
        assert len(at) == len(cps) + 1
        got += C.encode(cps, starts, np.asarray(part.is_null())).to_pylist()
    assert got == texts


# --- problem 8 -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def ids_of(texts):
    out = []
    for part in C.chunks(pa.array(texts, pa.string())):
        ids, at = tokens.encode_rows(part, tokens.TOKENIZERS)
        out += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    return out


def test_ids_equal_the_public_tokenizer(reference_tokenizer):
    rnd = random.Random(2)
    alphabet = ["'", "''", "s", "ll", "ve", "re", "d", "m", "T", " ", "  ", "\n", "\t", "　", "\xa0", "1", "²", ".", "!", "é", "é", "п", "的", "’", "<|endoftext|>", "💻", "‍"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + ["", None, "'" * 5000 + "s", "word " * 30000, "x" * 5000]
    expected = [e.ids for e in reference_tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert ids_of(texts) == expected


def test_encode_frame(spark):
    df = frame(spark, [(1, "Hello world"), (2, ""), (3, None), (1, "Hello world")])
    rows = sorted((r["key"], r["ids"]) for r in tokens.encode(df, "id", "text").collect())
    assert rows == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert all(r["lossless"] for r in tokens.lengths(df, "id", "text").collect())
    assert tokens.encode(df.limit(0), "id", "text").count() == 0


# --- problem 9 -------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=200), st.integers(1, 8))
def test_best_fit_never_overfills(sizes, limit):
    fit, used = packing.BestFit(64, limit), {}
    for s in sizes:
        b = fit.place(s)
        used[b] = used.get(b, 0) + s
        assert used[b] <= 64 and fit.open <= limit
    assert all(used[b] == n for b, n in fit.left())


def test_pack_places_everything(spark):
    rows = [(i, "word " * (i % 40)) for i in range(300)] + [(900, None), (901, ""), (902, "long " * 5000)]
    specs = spark.createDataFrame([(1, "a", 64), (2, "b", 100000), (3, "bad", 0), (4, "null", None)], "spec_id int, spec_name string, capacity bigint")
    df = frame(spark, rows)
    out = packing.pack(df, "id", "text", specs).collect()
    size = {r["key"]: r["n_tokens"] for r in tokens.lengths(df, "id", "text").collect()}
    for spec, capacity in ((1, 64), (2, 100000)):
        mine = [r for r in out if r["spec_id"] == spec]
        total, bins = {}, {}
        for r in mine:
            total[r["key"]] = total.get(r["key"], 0) + r["n_tokens"]
            bins[r["bin_part"], r["bin"]] = bins.get((r["bin_part"], r["bin"]), 0) + r["n_tokens"]
        assert total == size and max(bins.values()) <= capacity
        assert sum(1 for r in mine if r["key"] == 902) == -(-size[902] // capacity)
        assert len(bins) <= sum(size.values()) / capacity * 1.15 + 1
    assert {r["spec_id"] for r in out} == {1, 2}
    assert packing.pack(df.limit(0), "id", "text", specs).count() == 0


# --- problem 10 ------------------------------------------------------------------------------------------------------


def canon(t):
    blob, off = C.utf8(pa.array([t], pa.string()))
    cps, _, starts = C.decode(blob, off)
    return C.encode(*lookalikes.canonical(cps, starts), np.zeros(1, bool)).to_pylist()[0]


def test_canonical_form():
    assert canon("Ｆｕｌｌ－ｗｉｄｔｈ") == canon("Full-width") == "Full-width"
    assert canon("café") == canon("café") == "café"
    assert canon("a​b­c﻿") == "abc"
    assert canon("a b c\td") == "a b c d"
    assert canon("ﬁﬂ") == "fifl"
    assert canon("раураl") == canon("paypal")
    assert canon("a\r\nb\rc\nd") == "a\nb\nc\nd"
    assert canon("q̣̇") == canon("q̣̇")
    assert canon("x²") != canon("x2") and canon("A") != canon("a") and canon("é") != canon("e")
    assert canon("") == ""


@settings(max_examples=80, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_canonical_form_is_stable(t):
    assert canon(canon(t)) == canon(t)
    assert canon(unicodedata.normalize("NFD", t)) == canon(unicodedata.normalize("NFC", t))


def test_hangul_is_composed_within_a_row():
    import unicodedata as U

    for t in ("한국어 각 가", "\u1100\u1161\u11a8", "\u1100\u1100\u1161", "가\u11a8", "\u1161\u11a8", "ㄱㅏ", "각\u11a8"):
        assert canon(t) == canon(U.normalize("NFD", t)) == U.normalize("NFC", t)
    blob, off = C.utf8(pa.array(["\u1100", "\u1161", "가", "\u11a8"], pa.string()))
    cps, _, starts = C.decode(blob, off)
    assert C.encode(*lookalikes.canonical(cps, starts), np.zeros(4, bool)).to_pylist() == ["\u1100", "\u1161", "가", "\u11a8"]


def test_hot_form_is_cut_in_parts(spark, monkeypatch):
    monkeypatch.setattr(lookalikes, "HOT_ROWS", 3)
    rows = [(i, ("paypal", "раураl", "pay\u200bpal")[i % 3]) for i in range(30)]
    got = [tuple(r) for r in lookalikes.same_looking_pairs(frame(spark, rows), "id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(30) for j in range(i + 1, 30) if i % 3 != j % 3}
    assert [tuple(r) for r in lookalikes.same_looking_classes(frame(spark, rows + [(90, "x"), (91, "x")]), "id", "text").collect()] == [(0, 30, 3)]


def test_same_looking_pairs(spark):
    rows = [(1, "paypal"), (2, "раураl"), (3, "paypal"), (4, "pay​pal"), (5, "PayPal"), (6, None), (7, ""), (8, "​"), (9, "­"), (10, "x" * 3_000_000), (11, "x" * 3_000_000 + "​")]
    got = {tuple(r) for r in lookalikes.same_looking_pairs(frame(spark, rows), "id", "text").collect()}
    assert got == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (10, 11)}
    assert lookalikes.same_looking_pairs(frame(spark, rows).limit(0), "id", "text").count() == 0
    assert {r["key"]: r["canonical"] for r in lookalikes.unify_text(frame(spark, rows[:8]), "id", "text").collect()}[6] is None


# --- problem 3 -------------------------------------------------------------------------------------------------------


def test_copies(spark):
    fields = ["Product: Velm Cart", "Version: 1.2", "Notes: it breaks; badly"]
    flat = '{"product": "Velm Cart", "version": "1.2", "notes": "it breaks; badly"}'
    rows = [
        (10, "Hello, World!"), (3, "hello world"), (7, "HELLO\n WORLD..."), (8, "hello worlds"),
        (20, "\n".join(fields)), (21, "\n".join(reversed(fields))), (22, "\r\n".join(x.upper() for x in reversed(fields))), (23, flat), (24, '{"notes": "it breaks; badly", "version": "1.2", "product": "Velm Cart"}'),
        (25, "Product: 1.2\nVersion: Velm Cart\nNotes: it breaks; badly"), (26, " ".join(fields)),
        (30, "a=1; b=2"), (31, "b=2; a=1"), (32, "a=2; b=1"), (40, "first one. second one."), (41, "second one. first one."),
        (50, None), (51, ""), (52, "..."), (53, "!!!"), (60, "z" * 500_000), (61, "Z-" * 500_000),
    ]
    df = frame(spark, rows + [(90, "same")]).union(frame(spark, [(91, "same")]))
    got = {tuple(r) for r in duplicates.copies(df, "id", "text").collect()}
    assert got == {(3, 10), (3, 7), (20, 21), (20, 22), (20, 23), (20, 24), (20, 26), (30, 31), (60, 61), (90, 91)}
    assert duplicates.copies(df.limit(0), "id", "text").count() == 0


def test_more_rows_than_one_filter_holds(spark, monkeypatch):
    rows = [(i, f"text number {i % 700}" if i % 3 else f"a: {i % 50}\nb: {i % 7}") for i in range(3000)]
    df = frame(spark, rows)
    want = {tuple(r) for r in duplicates.copies(df, "id", "text").collect()}
    monkeypatch.setattr(duplicates, "MOST_BITS", duplicates.SEGMENT_BITS)
    monkeypatch.setattr(duplicates, "BITS_A_ROW", 2000)
    assert {tuple(r) for r in duplicates.copies(df, "id", "text").collect()} == want and len(want) > 1900


def test_filter_loses_no_repeat(spark):
    rnd = random.Random(4)
    values = [rnd.randint(-(2**63), 2**63 - 1) for _ in range(4000)]
    rows = values + values[:500]
    df = spark.createDataFrame([(v, None) for v in rows], "p bigint, l bigint").repartition(7)
    bits, f = duplicates.repeat_filter(df, ["p", "l"], len(rows))
    kept = [r["p"] for r in duplicates.may_repeat(df, ["p", "l"], bits, f).collect()]
    assert set(values[:500]) <= set(kept) and len(kept) < 1500


# --- problem 6 -------------------------------------------------------------------------------------------------------


def brute_leaks(items, posts):
    def runs(t):
        ws = [x.lower() for x in re.findall(r"[^\W_]+", t or "")]
        return {tuple(ws[i : i + 12]) for i in range(len(ws) - 11)}

    a, b = [(i, runs(t)) for i, t in items], [(p, runs(t)) for p, t in posts]
    return {(i, p) for i, x in a for p, y in b if x & y}


def test_leaks_against_brute_force(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 60)))) for i in range(30)] + [(100, None), (101, ""), (102, "İstanbul " * 12), (103, "common words " * 10), (104, "common words " * 10)]
    posts = []
    for k in range(1000, 1060):
        src = rnd.choice(items)[1] or ""
        ws = src.split()
        a = rnd.randint(0, max(0, len(ws) - 5))
        posts.append((k, "> " + ", ".join(rnd.choice(vocabulary) for _ in range(4)) + "\n" + "  ".join(ws[a : a + rnd.randint(5, 20)]).upper() + " end"))
    posts += [(2000, None), (2001, ""), (2002, "common words, " * 5000)]
    got = leakage.leaks(frame(spark, items, "item_id bigint, t string"), "item_id", "t", frame(spark, posts, "k bigint, body string"), "k", "body").collect()
    assert {(r["item_id"], r["post_key"]) for r in got} == brute_leaks(items, posts)
    by = dict(posts)
    assert all(len(leakage.words(by[r["post_key"]][r["char_start"] : r["char_end"]])) == r["n_words"] >= 12 for r in got)
    e = frame(spark, items, "item_id bigint, t string")
    assert leakage.leaks(e.limit(0), "item_id", "t", frame(spark, posts, "k bigint, body string"), "k", "body").count() == 0


def test_held_out_texts_in_several_shards(spark, monkeypatch):
    rnd = random.Random(7)
    items = [(i, " ".join(f"v{rnd.randrange(900)}" for _ in range(40))) for i in range(40)]
    posts = [(1000 + k, "so " + " ".join(items[k % 40][1].split()[k % 20 : k % 20 + 9 + k % 9]) + " end") for k in range(90)]
    monkeypatch.setattr(leakage, "SHARD_CHARS", 2000)
    got = leakage.leaks(frame(spark, items, "item_id bigint, t string"), "item_id", "t", frame(spark, posts, "k bigint, body string"), "k", "body").collect()
    assert {(r["item_id"], r["post_key"]) for r in got} == brute_leaks(items, posts) and len(got) > 20


# --- problem 2 -------------------------------------------------------------------------------------------------------


def test_overlap_against_brute_force(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdefghij ") for _ in range(300)) for _ in range(8)]

    def near():
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 12)):
            t[rnd.randrange(len(t))] = rnd.choice("xyz")
        return "".join(t)

    e = [(i, near()) for i in range(25)] + [(100, None), (101, ""), (102, "  "), (103, "ab"), (104, "Same  TEXT here"), (105, "q" * 50_000)]
    t = [(i, near()) for i in range(1000, 1040)] + [(2000, "AB"), (2001, None), (2002, "same text\nhere"), (2003, "same text here"), (2004, ""), (2005, "q" * 50_000)]
    norm = lambda x: re.sub(r"\s+", " ", x.lower())

    def grams(rows):
        kept = [(i, norm(x)) for i, x in rows if (x or "").strip()]
        return [(i, x, {x[k : k + 3] for k in range(len(x) - 2)}) for i, x in kept]

    expected = {(a, b) for a, x, g in grams(e) for b, y, h in grams(t) if x == y or g | h and 5 * len(g & h) >= 4 * len(g | h)}
    members, pairs = overlap.links(frame(spark, e), frame(spark, t))
    m = members.collect()
    of = lambda side, c: [r["id"] for r in m if r["side"] == side and r["text_class"] == c]
    assert {(a, b) for r in pairs.collect() for a in of(0, r["class_e"]) for b in of(1, r["class_t"])} == expected
    assert overlap.links(frame(spark, e).limit(0), frame(spark, t))[1].count() == 0


# --- problem 5 -------------------------------------------------------------------------------------------------------


def test_residue(spark):
    yes = ["404 Not Found", "Home | Forums | Search | Members\n502 Bad Gateway\nGenerated in 0.02 s", "Please enable JavaScript to view this page.", "{{post.body}}", "Hello %author%, a new reply was posted in {{ x }} by @@name@@.", "undefined", "test test test", "Lorem ipsum Nostra enima", "foo\nfoo\noof\nfoo", "Your address has been blocked for 10 minutes. Terms of use", "La page demandÃ©e est introuvable."]
    no = ["The error page leaks the path: Could not connect to the database in /x.", "replace ${host} in the script by your own lab machine before you run it", "404 Not Found is what I get for gidopa, any idea?", "null pointer in parse(), see x", "bump", None, "", "\n ", "payload: %C3%A9%C3%28 works", " ".join(f"w{i}" for i in range(100_000))]
    rows = [(i, t) for i, t in enumerate(yes)] + [(100 + i, t) for i, t in enumerate(no)] + [(0, yes[0])]
    got = sorted(r["key"] for r in residue.residue(frame(spark, rows), "id", "text").collect())
    assert got == sorted([*range(len(yes)), 0])
    assert residue.residue(frame(spark, rows).limit(0), "id", "text").count() == 0


def test_labels_spread_to_near_duplicates(spark):
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    page = "404 Not Found Fatal error: Uncaught x in y:1 " + " ".join(f"#{i} {name(i * 7)}.php({i}): {name(i * 11)}" for i in range(150))
    rows = [(1, page), (2, page + " zzz"), (3, page + " zzz yyy"), (4, "something else entirely about a module " * 3)]
    assert residue.trusted(page, frozenset()) and not residue.trusted(page + " zzz", frozenset())
    a, b = (residue.shingles(residue.masked(t)) for _, t in rows[:2])
    assert len(a & b) / len(a | b) >= 0.8
    sims = residue.simhash([a, b])
    assert bin(int(sims[0] ^ sims[1]) & (2**64 - 1)).count("1") <= residue.HAMMING
    assert sorted(r["key"] for r in residue.residue(frame(spark, rows), "id", "text").collect()) == [1, 2, 3]


# Notices that no seed covers.
HELD_OUT = [
    "Das Forum ist wegen Wartungsarbeiten geschlossen.", "Die angeforderte Seite wurde nicht gefunden.", "Le forum est en maintenance.", "Veuillez activer JavaScript pour afficher cette page.", "La pagina richiesta non è stata trovata.", "Il forum è chiuso per manutenzione.",
    "El foro está cerrado por mantenimiento.", "Este foro necesita que los scripts estén permitidos.", "A página solicitada não foi encontrada.", "Форум закрыт на техническое обслуживание.", "Для работы форума нужны скрипты и cookies.", "Bu konuyu görmek için giriş yapmalısınız.", "您访问的页面不存在。", "论坛正在维护，请稍后再试。",
    "You must be logged in to read posts in this section.", "Your session has expired.", "We need to make sure you are not a robot.", "Rate limit exceeded, slow down.", "Gateway timeout while waiting for the upstream host.", "Attachment and post could not be loaded.",
]


def test_held_out_notices_are_learned(spark):
    assert not any(residue.covered(x) for x in HELD_OUT)
    rnd = random.Random(12)
    furniture = ["Home | Forums | Search | Members", "Terms of use", "Generated in 0.021 s", "Back to index", "404 Not Found", "Register | Log in", "Powered by Board 4.12"]
    rows, notices, posts = [], set(), set()
    for i, notice in enumerate(HELD_OUT):
        for v in range(6):
            parts = [rnd.choice(furniture), notice, *rnd.sample(HELD_OUT, v % 2), rnd.choice(furniture)] if v else [notice]
            rows.append((100 * i + v, rnd.choice(["\n", " ", "\n\n"]).join(parts)))
            notices.add(100 * i + v)
    for i in range(200):
        rows.append((10_000 + i, f"The handler x{i} trusts its length field. {rnd.choice(HELD_OUT) if i % 4 == 0 else 'Thanks in advance.'} Any idea about module{i}?"))
        posts.add(10_000 + i)
    rows += [(20_000 + i, "Thanks in advance.") for i in range(30)]
    trusted, _, found = ({r["key"] for r in t.collect()} for t in residue.stages(frame(spark, rows), "id", "text"))
    assert not trusted & notices and not found & posts
    assert len(found & notices) >= 0.95 * len(notices) and not found - notices


def spread_by_brute_force(rows):
    """Keys reached from trusted bodies over pairs that are similar enough, every pair compared."""
    sets = {k: residue.shingles(residue.masked(t)) for k, t in rows}
    reached = todo = {k for k, t in rows if residue.trusted(t, frozenset())}
    while todo:
        todo = {k for k in sets if k not in reached and any(len(sets[k] & sets[j]) / len(sets[k] | sets[j]) >= residue.SIMILARITY for j in todo)}
        reached = reached | todo
    return reached


def test_labels_spread_over_any_simhash_distance(spark):
    rnd = random.Random(4)
    name = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    rows, far = [], 0
    for i in range(30):
        lines = [f"#{j} {name()}.php({j}): {name()}" for j in range(28)]
        other = lines[:]
        other[rnd.randrange(3, 25)] = f"{name()} stands here instead" if i % 3 == 0 else f"#1 {name()}.php(1): {name()} {name()}"
        page, copy = ("404 Not Found " + " ".join(x) for x in (lines, other))
        rows += [(3 * i, page), (3 * i + 1, copy), (3 * i + 2, " ".join(name() for _ in range(60)))]
        a, b = (int(x) for x in residue.simhash([residue.shingles(residue.masked(t)) for t in (page, copy)]))
        far += bin((a ^ b) & (2**64 - 1)).count("1") > residue.HAMMING
    want = spread_by_brute_force(rows)
    assert far > 15 and len(want) > 40
    assert {r["key"] for r in residue.residue(frame(spark, rows), "id", "text").collect()} == want


def test_labels_spread_along_long_chains(spark):
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    line = lambda i, v: f"#{i} {name(7 * i + v)}.php({i}): {name(11 * i + v)}"
    # every version rewrites the next five lines, so only neighbours in the chain are similar
    rows = [(v, "404 Not Found " + " ".join(line(i, 500 * ((v + 14 - i // 5) // 15)) for i in range(75)) + " zzz" * (v > 0)) for v in range(24)]
    assert [k for k, t in rows if residue.trusted(t, frozenset())] == [0]
    want = spread_by_brute_force(rows)
    assert want == set(range(24)) and spread_by_brute_force(rows[:5] + rows[6:]) == set(range(5))
    assert {r["key"] for r in residue.residue(frame(spark, rows), "id", "text").collect()} == want


# --- problem 1 -------------------------------------------------------------------------------------------------------

CLEAN = ["Die Datei wird beim Start ungefragt in den Ordner geschrieben, für ältere Geräte gibt es keine Lösung", "El módulo se llama así y está al lado de la página", "Le problème a été signalé et l’éditeur préfère répondre après", "Файл создаётся при запуске без всякого предупреждения", "O parâmetro não é verificado, então é possível", "ATENÇÃO: A VERSÃO NÃO É SEGURA", "Kayıtlarda çöküşten önce görünüyor, parolayı değiştirin"]


def test_garbled_fields(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.sample(CLEAN[i % 7].split(), 6)), None, f"s{i % 3}") for i in range(700)]
    bad = {
        5000: CLEAN[0].encode().decode("cp1252", "replace"), 5001: CLEAN[1].encode().decode("mac_roman"), 5002: CLEAN[3].encode("cp1251").decode("latin-1"), 5003: CLEAN[2].encode().decode("cp437"),
        5004: CLEAN[3].encode().decode("cp1251", "replace"), 5005: "Grüße an alle, " + CLEAN[4].encode().decode("latin-1"), 5006: "lost � here", 5007: CLEAN[6].encode("cp1254").decode("latin-1"),
    }
    good = {6000: None, 6001: "", 6002: "caf&eacute; \\u00e9 %C3%A9", 6003: "naïve résumé — 20 °C, 1543 €", 6004: "为什么" * 10_000}
    rows += [(k, t, None, "s1") for k, t in {**bad, **good}.items()] + [(7000, "ok", bad[5001], None), (5001, bad[5001], None, "s1")]
    df = frame(spark, rows, "id bigint, body string, title string, src string")
    got = encoding.garbled_fields(df, "id", ["body", "title"], "src").collect()
    assert {(r["key"], r["field"]) for r in got} == {(k, "body") for k in bad} | {(7000, "title")}
    restored = {r["key"]: r["restored"] for r in got}
    assert restored[5001] == CLEAN[1] and restored[5002] == CLEAN[3] and restored[5006] is None
    assert encoding.garbled_fields(df.limit(0), "id", ["body", "title"], "src").count() == 0


def test_unknown_page_is_learned(spark):
    """Russian whose letters one source shows as symbols in an order that no code page has."""
    import duckdb

    texts = [r[0] for r in duckdb.connect().sql("select text from '/root/testdata/sf0.01/forum_posts.parquet' where regexp_matches(text, '[а-я]{5}') order by post_key").fetchall()]
    alphabet = [chr(c) for c in range(0x430, 0x450)] + ["ё"]
    symbols = [chr(0xA1 + i) for i in range(len(alphabet))]
    random.Random(5).shuffle(symbols)
    page = {ord(c): s for c, s in zip(alphabet, symbols)}
    lower = [" ".join(re.findall(r"[а-яё]+", t.lower())) for t in texts]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)] + [(10_000 + i, t.translate(page), "odd") for i, t in enumerate(lower[:80])]
    df = frame(spark, rows, "id bigint, body string, src string")
    got = {r["key"]: r for r in encoding.garbled_fields(df, "id", ["body"], "src").collect() if r["key"] >= 10_000}
    assert len(got) >= 78 and {r["cipher"] for r in got.values()} == {encoding.LEARNED}
    same = sum(a == b for i, t in enumerate(lower[:80]) if 10_000 + i in got for a, b in zip(t, got[10_000 + i]["restored"]))
    assert same >= 0.97 * sum(map(len, lower[:80]))


# --- problem 7 -------------------------------------------------------------------------------------------------------

SAID = {
    "en": "the module is called very early in my build and nobody can see what it does before the crash", "de": "die datei wird beim start ungefragt in den ordner geschrieben und niemand kann sie löschen",
    "fr": "le problème a été signalé il y a longtemps mais personne n’a répondu à cette question", "es": "el archivo se crea al arrancar sin pedir permiso a nadie y el fallo todavía no está corregido", "ru": "файл создаётся при запуске без всякого предупреждения и никто так и не ответил на вопрос",
}


def test_relabel(spark):
    rnd = random.Random(10)
    rows = []
    for i in range(600):
        code = list(SAID)[i % 5]
        w = SAID[code].split()
        rows.append((i, " ".join(w[rnd.randint(0, 3) : len(w) - rnd.randint(0, 3)]) + ".", {"en": "en-US", "de": "German"}.get(code, code)))
    extra = [(900, SAID["de"], None), (901, SAID["fr"], "und"), (902, SAID["es"], "en"), (903, f"{SAID['en']}. {SAID['ru']}.", "en"), (904, SAID["de"].upper(), "deu"), (905, None, None), (906, "", None), (907, "x=1; y=2", "en"), (908, (SAID["en"] + ". ") * 3000, "en"), (900, SAID["de"], None)]
    df = frame(spark, rows + extra, "id bigint, text string, lang string")
    got = sorted((r["key"], r["lang"]) for r in languages.relabel(df, "id", "text", "lang").collect())
    assert got == [(900, "de"), (900, "de"), (901, "fr"), (902, "es"), (903, "en"), (903, "ru")]
    assert languages.relabel(df.limit(0), "id", "text", "lang").count() == 0
    parts = languages.label_segments(df, "id", "text", "lang").filter("key = 903").orderBy("segment").collect()
    assert [r["lang"] for r in parts] == ["en", "ru"]


def test_three_languages_without_sentence_ends():
    model = languages.fit([(t, c) for c, t in SAID.items()] * 60)
    text = "\n".join(SAID[c] for c in ("de", "es", "ru", "en"))
    assert len(languages.segments(text)) == 1
    parts = languages.classify(model, [text])[0]
    assert [lang for _, lang, _, _ in parts] == ["de", "es", "ru", "en"]
    assert [w for words, *_ in parts for w in words] == languages.segments(text)[0]
    assert languages.languages_of(parts) == ["de", "en", "es", "ru"]


def test_held_out_accuracy():
    import duckdb

    rows = duckdb.connect().sql("select text, lang from '/root/testdata/sf0.01/forum_posts.parquet' where text is not null and lang in ('en', 'de', 'fr', 'es', 'it', 'pt', 'ru', 'tr', 'zh') order by post_key").fetchall()
    model = languages.fit(rows[:2000])
    held = [languages.languages_of(x) for x in languages.classify(model, [t for t, _ in rows[2000:]])]
    assert sum(l in h for h, (_, l) in zip(held, rows[2000:])) / len(held) > 0.93  # labels are wrong in some rows


def test_residue_rests_on_no_order_of_shingles(spark, monkeypatch):
    rnd = random.Random(4)
    name = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    rows = []
    for i in range(12):
        lines = [f"#{j} {name()}.php({j}): {name()}" for j in range(28)]
        other = lines[:14] + [f"{name()} stands here instead"] + lines[15:]
        rows += [(3 * i, "404 Not Found " + " ".join(lines)), (3 * i + 1, "404 Not Found " + " ".join(other)), (3 * i + 2, " ".join(name() for _ in range(60)))]
    df, real = frame(spark, rows), residue.common_cells
    run = lambda: [sorted(r["key"] for r in t.collect()) for t in residue.stages(df, "id", "text")]
    first = run()
    assert set(first[2]) == spread_by_brute_force(rows) and len(first[2]) > len(first[1])
    for order in (lambda rows: -real(rows), lambda rows: np.random.default_rng(3).integers(0, 99, 1 << residue.SKETCH_BITS)):
        monkeypatch.setattr(residue, "common_cells", order)
        assert run() == first

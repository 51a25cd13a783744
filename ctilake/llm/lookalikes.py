"""One form for texts that look the same: problem 10."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctilake.llm import codepoints as C
from ctilake.sources.tables import cut, table

# Letters of other scripts that are drawn as Latin letters, by script: Cyrillic, Greek, Armenian, Cherokee, and letters and hyphens that have a twin.
LOOKALIKES = dict(zip(
    "аеорсухіѕјһԁԛԝѵɡӏк" "АВЕКМНОРСТУХІЅЈԌԚԜӀ" "ονραυ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "օսհոցզյՕՍՏԼ" "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏔᏙᏚᏞᏟᏢᏦᏴ" "‐‑",
    "aeopcyxisjhdqwvglk" "ABEKMHOPCTYXISJGQWI" "ovpau" "ABEZHIKMNOPTYX" "ouhngqjOUSL" "DRTAJEWMHYGZWVSLCPKB" "--",
))
# Compatibility decompositions that leave the look of a character as it is; superscripts, circles and fractions look different.
SAME_LOOK = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>"}
DROP, BLANK = (), (32,)
HOT_ROWS = 20_000  # of one canonical form, before its pairs are made in parts


def _expand(c: int) -> tuple[int, ...]:
    """What code point ``c`` becomes: nothing, one blank, or its decomposed plain characters."""
    ch = chr(c)
    kind = unicodedata.category(ch)
    if ch in "\r\n  \x85":
        return (10,)
    if ch == "\t" or kind == "Zs":
        return BLANK
    if kind in ("Cc", "Cf") or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or c in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0):
        return DROP
    parts = unicodedata.decomposition(ch).split()
    if not parts or ch in LOOKALIKES:
        return (ord(LOOKALIKES.get(ch, ch)),)
    if 0x3131 <= c <= 0x318E:
        return (c,)  # letters of Hangul that stand alone do not join
    if parts[0].startswith("<"):
        if parts[0] not in SAME_LOOK:
            return (c,)
        parts = parts[1:]
    out = tuple(x for p in parts for x in _expand(int(p, 16)))
    return BLANK if kind not in ("Ll", "Lu", "Lo", "Lm") and out and out[0] == 32 and len(out) == 1 else out


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lookup tables over all code points, made by rule from the character database.

    Length and place of each expansion, the expansions in one array, combining classes, and the
    sorted keys (base, mark) of compositions with their results.
    """
    lens, at, ccc = np.ones(0x110000, np.int64), np.zeros(0x110000, np.int64), np.zeros(0x110000, np.uint8)
    flat: list[int] = []
    single = np.arange(0x110000, dtype=np.uint32)
    pairs: dict[int, int] = {}
    for c in range(0x110000):
        if 0xD800 <= c < 0xF900 or 0x323B0 <= c < 0xE0000 or c >= 0xE0200:
            continue  # surrogates, private use, unassigned: as they are
        if 0xAC00 <= c < 0xD7A4:
            continue  # Hangul syllables stay composed
        out = _expand(c)
        if len(out) == 1:
            single[c] = out[0]
        else:
            lens[c], at[c] = len(out), len(flat) + 1
            flat.extend(out)
        ccc[c] = unicodedata.combining(chr(c))
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(c)) == chr(c):
            pairs[int(parts[0], 16) << 21 | int(parts[1], 16)] = c
    keys = np.array(sorted(pairs), np.int64)
    return lens, at, np.concatenate((np.zeros(1, np.uint32), np.array(flat, np.uint32))), ccc, keys, np.array([pairs[k] for k in keys.tolist()], np.uint32), single


def _keep(cps: np.ndarray, starts: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return cps[mask], np.concatenate(([0], np.cumsum(mask)))[starts]


def _hangul(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Conjoining letters as syllables, by the arithmetic of their code points: first with vowel, then that with last."""
    for lead, follow in (((0x1100, 0x1113), (0x1161, 0x1176)), ((0xAC00, 0xD7A4), (0x11A8, 0x11C3))):
        if len(cps) < 2:
            break
        a, b = cps[:-1].astype(np.int64), cps[1:].astype(np.int64)
        hit = (a >= lead[0]) & (a < lead[1]) & (b >= follow[0]) & (b < follow[1])
        if lead[0] == 0xAC00:
            hit &= (a - 0xAC00) % 28 == 0
        inner = starts[(starts > 0) & (starts < len(cps))]
        hit[inner - 1] = False
        i = np.flatnonzero(hit)
        if not len(i):
            continue
        cps = cps.copy()
        cps[i] = (0xAC00 + ((a[i] - 0x1100) * 21 + b[i] - 0x1161) * 28) if lead[0] == 0x1100 else a[i] + b[i] - 0x11A7
        mask = np.ones(len(cps), bool)
        mask[i + 1] = False
        cps, starts = _keep(cps, starts, mask)
    return cps, starts


def canonical(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and row offsets of the common form of all rows at once."""
    lens, at, flat, ccc, keys, results, single = tables()
    if len(cps) > 1:
        first = np.zeros(len(cps), bool)
        first[starts[:-1][starts[:-1] < len(cps)]] = True
        pair = (cps[:-1] == 13) & (cps[1:] == 10) & ~first[1:]
        if pair.any():
            cps, starts = _keep(cps, starts, ~np.append(pair, False))
    n = lens[cps]
    if (n != 1).any():
        ends = np.cumsum(n)
        source = np.repeat(np.arange(len(cps)), n)
        within = np.arange(len(source)) - (ends - n)[source]
        base = cps[source]
        place = at[base]
        out = np.where(place > 0, flat[place + np.where(place > 0, within, 0)], single[base])
        starts = np.concatenate(([0], ends))[starts]
        cps = out.astype(np.uint32)
    else:
        cps = single[cps]
    if ((cps >= 0x1161) & (cps < 0x11C3)).any():
        cps, starts = _hangul(cps, starts)
    marks = ccc[cps]
    if marks.any():
        first = np.zeros(len(cps), bool)
        first[starts[:-1][starts[:-1] < len(cps)]] = True
        if ((marks[1:] > 0) & (marks[:-1] > marks[1:]) & ~first[1:]).any():
            order = np.lexsort((marks, np.cumsum((marks == 0) | first)))
            cps = cps[order]
        while len(keys):
            marks = ccc[cps]
            i = np.flatnonzero((marks[1:] > 0) & (marks[:-1] == 0) & ~first[1:])
            if not len(i):
                break
            key = cps[i].astype(np.int64) << 21 | cps[i + 1]
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[k] == key
            if not hit.any():
                break
            cps = cps.copy()
            cps[i[hit]] = results[k[hit]]
            mask = np.ones(len(cps), bool)
            mask[i[hit] + 1] = False
            first = first[mask]
            cps, starts = _keep(cps, starts, mask)
    return cps, starts


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done, kept = 0, batch.schema.names[:-1]
        for part in C.chunks(batch.column(batch.num_columns - 1)):
            cps, _, starts = C.decode(*C.utf8(part))
            text = C.encode(*canonical(cps, starts), np.asarray(part.is_null()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(done, len(part)) for i in range(len(kept))), text], [*kept, "canonical"])
            done += len(part)


def unify_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, canonical): every text in one form; null stays null and empty stays empty.

    Width variants, joined forms and look-alike letters become their plain characters, invisible
    and control characters go, any blank becomes a space, any line end a line feed, and marks are
    composed in canonical order. Rows stay in their partition.
    """
    return df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_batches, "key bigint, canonical string")


def forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, same, h, g): a hash of every text as it is and two of its canonical form; texts with nothing visible are left out."""
    both = df.select(F.col(key).cast("bigint").alias("key"), F.xxhash64(F.col(text).cast("string")).alias("same"), F.col(text).cast("string").alias("text"))
    out = both.mapInArrow(_batches, "key bigint, same bigint, canonical string").filter(F.col("canonical").rlike(r"\S"))
    return out.select("key", "same", F.xxhash64("canonical").alias("h"), F.xxhash64(F.lit(1), "canonical").alias("g"))


def same_looking_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id_a, doc_id_b): rows with different texts of one canonical form, smaller key first.

    Texts with nothing visible and identical texts are no cases. Only hashes move: groups of one
    text are dropped before the pairs are joined. A form of more than HOT_ROWS rows is cut in as
    many parts by its keys, each joined with the whole form, so no task holds all its pairs.
    """
    rows = cut(forms(df, key, text))
    mixed = rows.groupBy("h", "g").agg(F.min("same").alias("_lo"), F.max("same").alias("_hi"), F.ceil(F.count(F.lit(1)) / HOT_ROWS).cast("int").alias("_parts")).filter("_lo <> _hi").select("h", "g", "_parts")
    rows = cut(rows.join(mixed, ["h", "g"]))
    a = rows.select("h", "g", F.pmod(F.xxhash64("key"), F.col("_parts")).cast("int").alias("_part"), F.col("key").alias("doc_id_a"), F.col("same").alias("_a"))
    b = rows.select("h", "g", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("key").alias("doc_id_b"), F.col("same").alias("_b"))
    return a.join(b, ["h", "g", "_part"]).filter((F.col("_a") != F.col("_b")) & (F.col("doc_id_a") < F.col("doc_id_b"))).select("doc_id_a", "doc_id_b")


def same_looking_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(class_id, rows, texts): every canonical form of different texts, named by its smallest key; no pair is expanded."""
    texts = forms(df, key, text).groupBy("h", "g", "same").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))
    return texts.groupBy("h", "g").agg(F.min("key").alias("class_id"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("class_id", "rows", "texts")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with different but same-looking texts: (doc_id_a, doc_id_b)."""
    return same_looking_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical text of every document: (doc_id, canonical)."""
    return unify_text(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical forms that several different texts of documents have: (class_id, rows, texts)."""
    return same_looking_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p10_found": p10_found, "p10_canonical": p10_canonical, "p10_classes": p10_classes}
SQL: dict[str, str] = {}

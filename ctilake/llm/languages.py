"""Languages of posts and of their segments: problem 7.

String-kernel classification. The feature map counts, over the words of a segment, the presence of
character n-grams of one to four letters (word ends included). The kernel of a segment against
Nystroem landmarks feeds one-versus-rest kernel ridge regression. The landmark product is linear in
the features, so the matrices multiply out to one matrix (n-gram x language): a word's scores are a
row sum of it and a segment's are the sum over its words, computed in batches.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctilake.sources.tables import table

SAMPLE_A_LABEL = 300  # labelled rows in expectation taken for each language to fit the classifier
SAMPLE_CHARS = 4000  # longer texts are not taken to fit it, so that the sample fits on the driver
LANDMARKS = 40  # for each language
RIDGE = 1.0
WORDS, LETTERS = 5, 16  # what a whole sentence has at least
HAN = 6
SPLIT_GAIN = 0.25  # of the summed scores, before a segment is taken for two languages
MARGIN = 0.7  # of the best score above the next, for a sentence to count as one of its language
CACHE_WORDS = 300_000

# Spellings of language labels.
LABELS = {
    "eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "fra": "fr", "fre": "fr", "french": "fr", "spa": "es", "spanish": "es", "ita": "it", "italian": "it",
    "por": "pt", "portuguese": "pt", "rus": "ru", "russian": "ru", "tur": "tr", "turkish": "tr", "zho": "zh", "chi": "zh", "chinese": "zh",
}
_TOKEN = re.compile(
    r"(?P<word>(?<![\w/._\-#@$%&=<>{}\\:\[])[^\W\d_⺀-鿿]+(?:['’][^\W\d_⺀-鿿]+)*(?![\w/(=@\\\]}]|[.\-]\w))"
    r"|(?P<field>(?:(?<=\n)|(?<=^)|(?<=; )|(?<=[{,] ))\"?[A-Za-z]+\"?\s*[:=])|(?P<han>[一-鿿])|(?P<end>[.!?…]+(?=[\s\"'”»)]|$)|[。！？]|\n\s*\n| - )", re.M
)
_HEX = re.compile(r"(?:\b[0-9a-f]{2}\b\s+){4,}[0-9a-f]{2}\b", re.I)
_FIELD = re.compile(r"(?:^|(?<=[;{,\n]))\s*[\"']?[A-Za-z]+[\"']?\s*[:=]\s*(?=\S)")


def label_code(label: Column) -> Column:
    """Two-letter code of a label in any spelling; null for a missing one."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)", 1)
    names = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in LABELS.items()) + ")")
    return F.when(base.isin("", "und", "unknown", "null", "none"), None).otherwise(F.coalesce(F.try_element_at(names, base), base))


def segments(text: str) -> list[list[str]]:
    """Words of every segment between sentence ends. Code, paths, numbers and field names are no words; a Han character is one."""
    if "=" in text or ":" in text:
        text = _FIELD.sub(" . ", text) if ("\n" in text or ";" in text or text.lstrip()[:1] == "{") else text
    text = _HEX.sub(" . ", text)
    out, now = [], []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "word":
            w = m.group()
            if w.isupper() or w.islower() or w[1:].islower() or not w[1:].isascii() or w[:1].islower() and w[1:].isupper():
                now.append(w.lower())
        elif kind == "han":
            now.append(m.group())
        elif now:
            out.append(now)
            now = []
    if now:
        out.append(now)
    return out


def grams(word: str) -> set[str]:
    w = f"_{word}_"
    return {w[i : i + n] for n in range(1, 5) for i in range(len(w) - n + 1)}


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("ı", "i").replace("ß", "ss")


@dataclass
class Model:
    """``weights`` (n-gram x language) and the row of each n-gram."""

    languages: list[str]
    rows: dict[str, int]
    weights: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    vectors: np.ndarray | None = None

    def __getstate__(self):
        return {"languages": self.languages, "rows": self.rows, "weights": self.weights, "known": {}, "vectors": None}

    def word(self, w: str) -> np.ndarray:
        at = [r for g in grams(w) if (r := self.rows.get(g)) is not None]
        return self.weights[at].sum(0) / (len(at) ** 0.5) if at else np.zeros(len(self.languages), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        """Places of words in ``vectors``, which grows by the words not met before and starts again past CACHE_WORDS."""
        if self.vectors is None or len(self.known) > CACHE_WORDS:
            self.known, self.vectors = {}, np.zeros((0, len(self.languages)), np.float32)
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            start = len(self.known)
            self.known.update((w, start + i) for i, w in enumerate(new))
            self.vectors = np.concatenate((self.vectors, np.stack([self.word(w) for w in new]))) if len(self.vectors) == start else np.stack([self.word(w) for w in self.known])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def fit(rows: list[tuple[str, str]]) -> Model:
    """Fit on (text, code) rows. Rows that a first fit contradicts are left out of the second."""
    examples = [(s, code) for text, code in rows for s in segments(text) if len(s) >= WORDS]
    languages = sorted({c for _, c in examples}) or ["en"]
    doubled = examples + [([_plain(w) for w in s], c) for s, c in examples if any(not w.isascii() for w in s) and c not in ("ru", "zh")]
    counts = Counter(g for s, _ in doubled for w in set(s) for g in grams(w))
    vocabulary = {g: i for i, g in enumerate(sorted(g for g, n in counts.items() if n > 3))}

    def features(part: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(part), max(1, len(vocabulary))), np.float32)
        for i, s in enumerate(part):
            for w in s:
                at = [vocabulary[g] for g in grams(w) if g in vocabulary]
                x[i, at] += 1 / max(1, len(at)) ** 0.5
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)

    def solve(part: list[tuple[list[str], str]]) -> np.ndarray:
        by = {c: [s for s, k in part if k == c] for c in languages}
        marks = features([s for c in languages for s in by[c][:: max(1, len(by[c]) // LANDMARKS)][:LANDMARKS]])
        most = max(1, min(350, max(map(len, by.values()))))
        chosen = [(s, j) for j, c in enumerate(languages) for s in by[c][:: max(1, len(by[c]) // most)][:most]]
        kernel = np.concatenate([features([s for s, _ in chosen[i : i + 300]]) @ marks.T for i in range(0, len(chosen), 300)] or [np.zeros((0, len(marks)), np.float32)])
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T  # inverse square root: the Nystroem map
        z, y = kernel @ root, np.where(np.array([[j] for _, j in chosen]).reshape(-1, 1) == np.arange(len(languages)), 1.0, -1.0)
        weight = 1 / np.maximum(1, np.bincount([j for _, j in chosen], minlength=len(languages)))[[j for _, j in chosen]][:, None] * len(chosen) / len(languages)
        beta = np.linalg.solve(z.T @ (z * weight) + RIDGE * np.eye(len(marks)), z.T @ (y * weight))
        return (marks.T @ (root @ beta)).astype(np.float32)

    if not examples:
        return Model(languages, {}, np.zeros((0, len(languages)), np.float32))
    w = solve(doubled)
    index = {c: i for i, c in enumerate(languages)}
    kept = []
    for at in range(0, len(doubled), 300):
        part = doubled[at : at + 300]
        scores = features([s for s, _ in part]) @ w
        kept += [x for x, row in zip(part, scores) if row[index[x[1]]] >= row.max() - 0.2]
    w = solve(kept)
    w -= w.mean(1, keepdims=True)
    return Model(languages, vocabulary, w)


def train(posts: DataFrame, key: str, text: str, label: str) -> Model:
    """Fit on a bounded sample: about SAMPLE_A_LABEL rows of each language, chosen by the hash of their key.

    Only the fit uses a sample; every post is classified. Languages are the labels that at least a
    thousandth of the labelled rows bear, so stray labels make no class.
    """
    coded = posts.select(F.col(key).alias("key"), F.col(text).alias("text"), label_code(F.col(label)).alias("code")).filter("code is not null")
    counts = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    share_of_all = counts.join(F.broadcast(counts.agg(F.sum("n").alias("total"))), F.col("n") * 1000 >= F.col("total"))  # at most a thousand labels
    known = {r[0]: r[1] for r in share_of_all.filter(F.length("code") == 2).select("code", "n").collect()}
    if not known:
        return fit([])
    parts = F.expr("map(" + ", ".join(f"'{c}', {min(1.0, SAMPLE_A_LABEL / n):.12f}d" for c, n in known.items()) + ")")
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / float(1 << 40)
    picked = coded.filter(F.col("code").isin(list(known)) & (share < F.try_element_at(parts, F.col("code"))) & (F.length("text") <= SAMPLE_CHARS))
    return fit([(r["text"], r["code"]) for r in sorted(picked.collect(), key=lambda r: r["key"])])


def _is_sentence(words: list[str]) -> bool:
    han = sum("一" <= w[0] <= "鿿" for w in words)
    return han >= HAN or (sum(len(w) > 1 for w in words) >= WORDS and sum(map(len, words)) >= LETTERS)


def _pieces(words: list[str], v: np.ndarray) -> list[tuple[list[str], np.ndarray]]:
    """Words and summed scores of the parts of a segment, cut again as long as a cut gains enough and leaves whole sentences.

    Neighbouring parts of one language, which an earlier cut may have parted, are one again.
    """
    out, todo = [], [(0, len(words))]
    sums = np.concatenate((np.zeros((1, v.shape[1])), np.cumsum(v, axis=0, dtype=np.float64)))
    while todo:
        a, b = todo.pop()
        total = sums[b] - sums[a]
        if b - a >= 2 * WORDS:
            gain = (sums[a:b] - sums[a]).max(1) + (sums[b] - sums[a:b]).max(1) - total.max()
            at = a + int(np.argmax(gain))
            if gain[at - a] > SPLIT_GAIN * max(float(total.max()), 1e-6) and _is_sentence(words[a:at]) and _is_sentence(words[at:b]):
                todo += [(at, b), (a, at)]
                continue
        if out and np.argmax(out[-1][1]) == np.argmax(total):
            before, score = out.pop()
            out.append((before + words[a:b], score + total))
        else:
            out.append((words[a:b], total))
    return out


def classify(model: Model, texts: list[str]) -> list[list[tuple[list[str], str, float, bool]]]:
    """For every text its segments: (words, language, confidence, whether it is a whole sentence of that language)."""
    parts = [segments(t) for t in texts]
    flat = [w for p in parts for s in p for w in s]
    if not flat:
        return [[] for _ in texts]
    v = model.vectors[ids] if (ids := model.ids(flat)) is not None else None
    ends = np.cumsum([len(s) for p in parts for s in p])
    starts = np.concatenate(([0], ends[:-1]))
    total = np.add.reduceat(v, starts, axis=0)
    before = np.cumsum(v, axis=0, dtype=np.float64) - v  # sums up to each word, over all texts
    prefix = before - np.repeat(before[starts], ends - starts, axis=0)
    whole = np.repeat(total, ends - starts, axis=0)
    gain = prefix.max(1) + (whole - prefix).max(1) - whole.max(1)
    best = np.maximum.reduceat(gain, starts)
    out, k = [], 0
    for p in parts:
        rows = []
        for s in p:
            a, b = starts[k], ends[k]
            may_split = len(s) >= 2 * WORDS and best[k] > SPLIT_GAIN * max(float(total[k].max()), 1e-6)
            pieces = _pieces(s, v[a:b]) if may_split else [(s, total[k])]
            for words, score in pieces:
                order = np.argsort(score)[::-1]
                top, second = float(score[order[0]]), float(score[order[1]]) if len(order) > 1 else 0.0
                margin = (top - second) / max(top, 1e-6) if top > 0 else 0.0
                rows.append((words, model.languages[order[0]], margin, _is_sentence(words) and margin >= MARGIN))
            k += 1
        out.append(rows)
    return out


def languages_of(rows: list[tuple[list[str], str, float, bool]]) -> list[str]:
    """Languages in which a text holds a whole sentence; of a text without one, the language of its words."""
    held = sorted({lang for _, lang, _, whole in rows if whole})
    if not held and rows:
        votes: Counter = Counter()
        for words, lang, confidence, _ in rows:
            votes[lang] += len(words) * confidence
        held = [max(votes.items(), key=lambda x: (x[1], x[0]))[0]]
    return held


def _found(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                keys, texts, codes = (batch.column(i).slice(at, 1000).to_pylist() for i in range(3))
                out = []
                for key, code, rows in zip(keys, codes, classify(m, texts)):
                    held = languages_of(rows)
                    if held and (len(held) > 1 or held != [code]):
                        out += [(key, lang) for lang in held]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["key", "lang"])

    return run


def _segments(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                keys, texts = (batch.column(i).slice(at, 1000).to_pylist() for i in range(2))
                out = [(key, i, len(w), lang, round(c, 4), whole) for key, rows in zip(keys, classify(m, texts)) for i, (w, lang, c, whole) in enumerate(rows)]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["key", "segment", "n_words", "lang", "confidence", "is_sentence"])

    return run


def _texts(posts: DataFrame, key: str, text: str, label: str) -> DataFrame:
    return posts.filter(F.length(F.trim(text)) > 0).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), label_code(F.col(label)).alias("code"))


def relabel(posts: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(key, lang): for posts with a missing or wrong label or several languages, each language held.

    Null and blank texts and texts without a word (code only) give no row. The model is a few
    megabytes whatever the size of the corpus and is broadcast; posts stay in their partition.
    """
    model = posts.sparkSession.sparkContext.broadcast(train(posts, key, text, label))
    return _texts(posts, key, text, label).mapInArrow(_found(model), "key bigint, lang string")


def label_segments(posts: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(key, segment, n_words, lang, confidence, is_sentence) of every segment of every post."""
    model = posts.sparkSession.sparkContext.broadcast(train(posts, key, text, label))
    return _texts(posts, key, text, label).mapInArrow(_segments(model), "key bigint, segment int, n_words int, lang string, confidence double, is_sentence boolean")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts whose label is missing or wrong or that mix languages, with each language held: (post_key, lang)."""
    return relabel(table(spark, sf_dir, "forum_posts"), "post_key", "text", "lang").withColumnRenamed("key", "post_key")


def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every segment of every post."""
    return label_segments(table(spark, sf_dir, "forum_posts"), "post_key", "text", "lang").withColumnRenamed("key", "post_key")


QUERIES = {"p7_found": p7_found, "p7_segments": p7_segments}
SQL: dict[str, str] = {}

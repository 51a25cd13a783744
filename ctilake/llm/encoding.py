"""Text read in the wrong character encoding: problem 1.

A swap of code pages replaces every letter by fixed symbols, so it is a substitution cipher.
Which ciphers a source uses and what its clean text looks like are learned together by
expectation-maximisation: the expectation step weighs every cipher, and the identity, for every
short piece of text by the bigrams of what it deciphers to; the maximisation step re-estimates the
bigrams and each source's cipher shares. Known pages are only the ciphers that are tried first: where
they leave a source's text unexplained, a table from symbols to letters is learned for that source
from scratch, see ``ciphers``. The chosen cipher is then applied with ``str.translate`` (or, where one
letter became several symbols, by replacing those).
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctilake.llm.ciphers import tables_of
from ctilake.sources.tables import cut, table

ROUNDS = 3
RAREST = 2e-7  # share of all pairs below which a pair is left to the smoothing, which bounds the table whatever the corpus is
STRANGE = -5.5  # mean log probability a letter below which no reading explains a piece
LEARNED, LEARNED_SHARE = "learned", 0.05
EVIDENCE = 1.0  # log likelihood ratio, priors included, from which a field counts as garbled
CLEAR = 1.5  # what a piece must reach to be evidence at all
LETTERS = 3  # characters that a piece has at least to speak for a swap of single-byte pages
BACKOFF = 5.0
LEAST_SHARE = 1e-3
PRIOR_PIECES = 20.0  # weight of the shares over all sources in those of one source
PIECE = r"[A-Za-z]{0,4}[^\x00-\x7F]{1,12}[A-Za-z]{0,4}"
_PIECE = re.compile(PIECE)
_TOKEN = re.compile(r"\S*[^\x00-\x7F]\S*(?:(?<=[ÃÂâ])\xa0\S*)?")
LOST = re.compile("[�\x80-\x84\x86-\x9f]")

# Code pages that UTF-8 is misread in (in the first seven, whole UTF-8 sequences do not look like words), and pairs (written, read) of pages that are taken for one another.
UTF8_AS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1254", "koi8_r", "cp866", "cp1253"]
PAGES = [
    ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "mac_roman"), ("mac_cyrillic", "cp1251"),
    ("cp1254", "cp1252"), ("iso8859_3", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1254", "cp1251"),
]


@functools.cache
def page(name: str) -> list[str]:
    """The 256 characters of a code page; bytes without one stand for themselves, as browsers read them."""
    return [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]


def _single(written: str, read: str) -> Callable[[str], str]:
    to = {ord(r): w for w, r in zip(page(written)[128:], page(read)[128:]) if r != w}
    return lambda text: text.translate(to)


def _utf8(read: str) -> Callable[[str], str]:
    chars = page(read)
    byte = {c: b for b, c in enumerate(chars) if b >= 128}
    of = lambda lo, hi: "[" + "".join(map(re.escape, chars[lo : hi + 1])) + "]"
    rest = of(0x80, 0xBF)
    two = of(0xC2, 0xC5)[:-1] + of(0xCE, 0xD1)[1:]  # Latin, Greek, Cyrillic; letters beyond are not in use and look like words elsewhere
    # in cp866 the leads of longer sequences and what follows them are all Cyrillic letters: words would pass for sequences
    sequence = re.compile(f"{two}{rest}" if read == "cp866" else f"{two}{rest}|{of(0xE0, 0xEF)}{rest}{{2}}|{of(0xF0, 0xF4)}{rest}{{3}}")

    def one(m: re.Match) -> str:
        try:
            return bytes(map(byte.__getitem__, m.group())).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return lambda text: sequence.sub(one, text)


def _runs(decode: Callable[[str], str]) -> Callable[[str], str]:
    run = re.compile(r"[^\x00-\x7F]{2,}")

    def one(m: re.Match) -> str:
        try:
            return decode(m.group())
        except UnicodeError:
            return m.group()

    return lambda text: run.sub(one, text)


def _gbk_as_1252(run: str) -> str:
    byte = {c: b for b, c in enumerate(page("cp1252")) if b >= 128}
    raw = bytes(byte[c] if c in byte else c.encode("latin-1")[0] for c in run)
    try:
        return raw.decode("gbk")
    except UnicodeDecodeError as e:  # a run cut within a letter keeps its end as it is
        if e.start < len(raw) - 1:
            raise
        return raw[:-1].decode("gbk") + run[-1]


def _utf8_as_gbk(run: str) -> str:
    text = run.encode("gb18030").decode("utf-8", "replace")
    if len(run) < 3 or text.count("\ufffd") * 4 > len(text):
        raise UnicodeError("other text")
    return text


@functools.cache
def ciphers() -> dict[str, Callable[[str], str]]:
    """Deciphering functions by name; none changes ASCII."""
    out = {f"utf-8 as {p}": _utf8(p) for p in UTF8_AS}
    twice = _utf8("cp1252")
    out["utf-8 as cp1252 twice"] = lambda text: text if (once := twice(text)) == text or (again := twice(once)) == once else again
    out |= {f"{w} as {r}": _single(w, r) for w, r in PAGES}
    out["gbk as cp1252"] = _runs(_gbk_as_1252)
    out["utf-8 as gbk"] = _runs(_utf8_as_gbk)
    return out


class Bigrams:
    """Smoothed log probabilities of letter pairs."""

    def __init__(self, pairs: dict[str, float]):
        self.pairs = pairs
        self.first: dict[str, float] = defaultdict(float)
        one: dict[str, float] = defaultdict(float)
        for p, n in pairs.items():
            self.first[p[0]] += n
            one[p[1]] += n
        total = sum(one.values()) + 0.1 * (len(one) + 1000)
        self.one = {c: (n + 0.1) / total for c, n in one.items()}
        self.least = 0.1 / total

    def score(self, text: str) -> float:
        t = "\n" + text.lower()
        get, out = self.pairs.get, 0.0
        for a, b in zip(t, t[1:]):
            out += math.log((get(a + b, 0.0) + BACKOFF * self.one.get(b, self.least)) / (self.first.get(a, 0.0) + BACKOFF))
        return out


def readings(piece: str, bigrams: Bigrams) -> list[tuple[str, float, str]]:
    """(cipher, log likelihood ratio against the piece as it stands, deciphered piece) of every cipher that changes it."""
    as_is, out = bigrams.score(piece), []
    for name, decipher in ciphers().items():
        if len(piece) < LETTERS and not name.startswith("utf-8"):
            continue  # one or two letters read well in any alphabet
        if (text := decipher(piece)) != piece:
            out.append((name, bigrams.score(text) - as_is, text))
    return out


def _expect(model: tuple[dict[str, float], dict[str, dict[str, float]]] | None):
    """Expected bigram and cipher counts of a batch of (source, piece, n), as (kind, source, name, n, held); ``held`` marks the sources of a bigram in 62 classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bigrams = Bigrams(model[0]) if model else None
        pairs, uses, memo, held = Counter(), Counter(), {}, defaultdict(int)
        for batch in batches:
            for source, piece, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n = math.sqrt(n)  # a title repeated in a long thread is one witness, not hundreds
                weighted = [(piece, 1.0, "")]
                if not bigrams:
                    # to begin with, symbols that happen to be whole UTF-8 sequences count as such and not as text
                    text = next((t for p in UTF8_AS[:7] if (t := ciphers()[f"utf-8 as {p}"](piece)) != piece), None)
                    weighted = [(text or piece, 1.0, "utf-8" if text else "")]
                else:
                    if piece not in memo:
                        memo[piece] = readings(piece, bigrams)
                    share = model[1].get(source, {})
                    odds = [(text, name, min(50.0, llr) + math.log(share.get(name, LEAST_SHARE))) for name, llr, text in memo[piece]]
                    top = max([0.0, *(x for *_, x in odds)])
                    whole = math.exp(-top) + sum(math.exp(x - top) for *_, x in odds)
                    weighted = [(piece, math.exp(-top) / whole, "")] + [(t, math.exp(x - top) / whole, name) for t, name, x in odds if x - top > -12]
                for text, w, name in weighted:
                    if w > 1e-4:
                        uses[source, name] += w * n
                        t = "\n" + text.lower()
                        bit = 1 << xxhash.xxh3_64_intdigest(source) % 62
                        for a, b in zip(t, t[1:]):
                            pairs[a + b] += w * n
                            held[a + b] |= bit
        rows = [("p", "", k, v, held[k]) for k, v in pairs.items()] + [("u", s, z, v, 0) for (s, z), v in uses.items()]
        columns = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[i], pa.string()) for i in range(3)] + [pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.int64())], ["kind", "source", "name", "n", "held"])

    return run


def _strange(pairs: dict[str, float]):
    """(source, a, b, n): neighbouring symbols of the pieces that neither a known cipher nor the identity explains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bigrams, memo = Bigrams(pairs), {}
        for batch in batches:
            counts: Counter = Counter()
            for source, piece, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if piece not in memo:
                    best = bigrams.score(piece) + max([0.0, *(llr for _, llr, _ in readings(piece, bigrams))])
                    memo[piece] = best < STRANGE * len(piece) and all(ord(c) < 0x3000 for c in piece)
                if memo[piece]:
                    t = piece if piece[:1].isascii() and piece[-1:].isascii() else f"\n{piece}\n"
                    t = "".join(c.lower() if c.isascii() else c for c in t)
                    for a, b in zip(t, t[1:]):
                        counts[source, a, b] += n
            columns = list(zip(*((s, a, b, float(n)) for (s, a, b), n in counts.items()))) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[i], pa.string()) for i in range(3)] + [pa.array(columns[3], pa.float64())], ["source", "a", "b", "n"])

    return run


def learn(fields: DataFrame) -> tuple[dict[str, float], dict[str, dict[str, float]], dict[str, dict[int, str]], dict[str, float]]:
    """(bigrams, cipher shares by source, learned tables by source, bigrams of several sources) from a table (source, text), over all rows.

    Pieces are counted before anything leaves the JVM; every round is one pass over that table of
    distinct pieces. The driver holds the pairs of a share of RAREST at least, the shares of each
    source, and a table of symbols for the sources that have one; none of them grows with the rows.
    """
    pieces = fields.select("source", F.explode(F.regexp_extract_all("text", F.lit(f"({PIECE})"), F.lit(1))).alias("piece"))
    pieces = cut(pieces.groupBy("source", "piece").agg(F.count(F.lit(1)).alias("n")))
    model = None
    for _ in range(ROUNDS):
        counts = cut(pieces.mapInArrow(_expect(model), "kind string, source string, name string, n double, held bigint").groupBy("kind", "source", "name").agg(F.sum("n").alias("n"), F.bit_or("held").alias("held")))
        all_pairs = counts.filter("kind = 'p'").agg(F.sum("n")).first()[0] or 0.0
        kept = [tuple(r) for r in counts.filter((F.col("kind") == "p") & (F.col("n") >= RAREST * all_pairs)).select("name", "n", F.bit_count("held")).toLocalIterator()]
        pairs = {k: n for k, n, _ in kept}
        uses: dict[str, dict[str, float]] = defaultdict(dict)
        for r in counts.filter("kind = 'u'").select("source", "name", "n").collect():
            uses[r[0]][r[1]] = r[2]
        overall: Counter = Counter()
        for u in uses.values():
            overall.update(u)
        total = max(1e-9, sum(overall.values()))
        shares = {}
        for s, u in uses.items():
            size = sum(u.values()) + PRIOR_PIECES
            shares[s] = {z: max(LEAST_SHARE, (u.get(z, 0) + PRIOR_PIECES * n / total) / size) for z, n in overall.items() if z}
        model = pairs, shares
    # what a source alone writes may be its own cipher: it is measured by what several sources write
    common = {k: n for k, n, sources in kept if sources > 1} if max((x for *_, x in kept), default=0) > 1 else pairs
    strange = pieces.mapInArrow(_strange(common), "source string, a string, b string, n double").groupBy("source", "a", "b").agg(F.sum("n").alias("n"))
    strange = strange.repartition(fields.sparkSession.sparkContext.defaultParallelism, "source")  # small tables, much work: one task must not get them all
    tables: dict[str, dict[int, str]] = defaultdict(dict)
    for source, symbol, letter in strange.groupBy("source").applyInPandas(tables_of(common), "source string, symbol string, letter string").collect():
        tables[source][ord(symbol)] = letter
    return *model, dict(tables), common if tables else {}


class Detector:
    """Judges and restores fields with a learned model."""

    def __init__(self, model: tuple[dict[str, float], dict[str, dict[str, float]], dict[str, dict[int, str]], dict[str, float]]):
        self.bigrams, self.shares, self.tables, self.common = Bigrams(model[0]), model[1], model[2], Bigrams(model[3])
        self.memo: dict[str, list[tuple[str, float, str]]] = {}

    def of(self, piece: str) -> list[tuple[str, float, str]]:
        if piece not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[piece] = readings(piece, self.bigrams)
        return self.memo[piece]

    def judge(self, source: str, text: str) -> tuple[float, str]:
        """(evidence, cipher) for a field; the cipher is empty when none explains it."""
        sums: dict[str, float] = defaultdict(float)
        for piece in _PIECE.findall(text):
            for name, llr, _ in self.of(piece):
                if llr > CLEAR:
                    sums[name] += llr
            if source in self.tables:
                if (llr := self.common.score(piece.translate(self.tables[source])) - self.common.score(piece)) > CLEAR:
                    sums[LEARNED] += llr
        share = self.shares.get(source, {})
        utf8 = sum(v for z, v in share.items() if z.startswith("utf-8"))  # these pages agree on most sequences and share their weight
        return max(((x + math.log(max(LEAST_SHARE, utf8 if z.startswith("utf-8") else LEARNED_SHARE if z == LEARNED else share.get(z, 0))), z) for z, x in sums.items()), default=(-math.inf, ""))

    def restore(self, name: str, source: str, text: str) -> str:
        """``text`` with every token deciphered that reads better so."""
        decipher, score = (lambda t: t.translate(self.tables[source])) if name == LEARNED else ciphers()[name], (self.common if name == LEARNED else self.bigrams).score

        def one(m: re.Match) -> str:
            t = m.group()
            d = decipher(t)
            return d if d != t and score(d) > score(t) else t

        return _TOKEN.sub(one, text)


_detectors: dict[int, Detector] = {}


def _judge(model, model_id: int, restore: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_id not in _detectors:
            _detectors.clear()
            _detectors[model_id] = Detector(model.value)
        detector = _detectors[model_id]
        for batch in batches:
            out = []
            for key, field, source, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                evidence, name = detector.judge(source, text)
                if evidence > EVIDENCE or LOST.search(text):
                    cipher = name if evidence > EVIDENCE else ""
                    out.append((key, field, cipher or None, detector.restore(cipher, source, text) if restore and cipher else None))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64())] + [pa.array(columns[i], pa.string()) for i in range(1, 4)], ["key", "field", "cipher", "restored"])

    return run


def garbled_fields(df: DataFrame, key: str, fields: list[str], source: str, restore: bool = True) -> DataFrame:
    """(key, field, cipher, restored): fields with characters from a wrong encoding.

    ``cipher`` is null where characters are lost (replacement marks, stray control bytes) and no
    cipher explains the rest; ``restored`` is null when nothing can be regained. Null, empty and
    pure ASCII fields are left out before Python sees them; escapes and entities are ASCII and so
    no cases. A null source is a source of its own.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("_x")
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(source), F.lit("")).alias("source"), stacked).select("key", "_x.field", "source", "_x.text").filter(F.col("text").rlike(r"[^\x00-\x7F]"))
    model = df.sparkSession.sparkContext.broadcast(learn(rows.select("source", "text")))
    return rows.mapInArrow(_judge(model, model._jbroadcast.id(), restore), "key bigint, field string, cipher string, restored string")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies and thread titles with characters from a wrong encoding: (row_id, field)."""
    return garbled_fields(table(spark, sf_dir, "raw_posts"), "row_id", ["body", "thread_title"], "forum_id", restore=False).select(F.col("key").alias("row_id"), "field")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fields with the cipher found and the text regained: (row_id, field, cipher, restored)."""
    return garbled_fields(table(spark, sf_dir, "raw_posts"), "row_id", ["body", "thread_title"], "forum_id").withColumnRenamed("key", "row_id")


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored}
SQL: dict[str, str] = {}

"""Scoring texts for abuse with a factorization machine over hashed terms.

A text is undisguised (invisible characters, look-alike letters, digits for letters, spaced and starred words), cut into
sentences, and each sentence scored by w.x plus the pairwise interactions of its terms, so that an insult counts with a
person or a group beside it and not with a process. A text's score is that of its worst sentence. Labels are of texts,
so training is by multiple instances: of an abusive text only the sentence that scores worst so far is a positive.
Everything the machine knows of words it learns from the labelled texts; there is no word list.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import table

MAX_LABELLED = 10_000  # labelled documents the model is fitted on, at most; the documents' hash picks them
MAX_LABELLED_CHARS = 40_000_000  # and code points of their texts together, at most
BITS, RANK = 18, 8  # hashed features, and the length of their interaction vectors: together 9 MB
LEAST_TEXTS = 2  # a feature of fewer labelled texts is not learned
FOLDS, ROUNDS = 4, 2
MAX_KNOWN = 200_000  # words a task remembers before it starts anew
SEED = 7

# ---- fixed values: what disguises letters ------------------------------------------------------------------------------
LOOKALIKES = str.maketrans("аеорсухіјѕԁһԛԝАВЕКМНОРСТХУІЈЅαονικρτυ", "aeopcyxijsdhqwABEKMHOPCTXYIJSaovikptu")
LEET = str.maketrans("013457$@!+|", "oieastsaitl")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_PATH = re.compile(r"(?<!\S)[^\s/\\]*[/\\]\S*?(?=[.,;:!?)\]\"']*(?:\s|$))")
_MAYBE_SPACED = re.compile(r"[\s\"'(][^\s.,] [^\s.,] [^\s.,](?!\w)")
_SPACED = re.compile(r"(?<![\w*$@])(?:[^\W\d_]|[013457$@!](?=[-. _*]))(?:([-. _*])[^\W_]|\1[$@!])(?:\1(?:[^\W_]|[$@!])){1,}(?![\w*])")
# A word, or what ends a sentence.
_TOKEN = re.compile(r"[$@]?[^\W_](?:[\w*$@+]|!(?=[\w$])|['’](?=[^\W\d_]))*|\*+[^\W_][\w*]*|\0|[.?!…。](?=[\"'”’»)]*\s)")
_BREAK = frozenset("\0.?!…。")


def _fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).replace("ß", "ss")


def chunks(text: str) -> list[str]:
    """What stands between blanks, line ends made chunks of their own; invisible characters and words spelt with blanks
    put right."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if _MAYBE_SPACED.search(f" {text}"):
        text = _SPACED.sub(lambda m: m[0].replace(m[1], "") if m[1] else m[0], text)
    return text.replace("\n", " \0 ").split()


def tokens(chunk: str) -> list[str]:
    """The words and sentence ends of a chunk: a path is one word, letters with signs between them are put together."""
    chunk += " "
    if "/" in chunk or "\\" in chunk:
        chunk = _PATH.sub("path", chunk)
    return _TOKEN.findall(_SPACED.sub(lambda m: m[0].replace(m[1], "") if m[1] else m[0], chunk))


def plain(word: str) -> str:
    """A word in lower case without accents and disguise; starred letters stay stars, numbers are one word."""
    if not word.isascii() and re.search("[a-zA-Z]", word) and re.search("[Ͱ-ӿ]", word):
        word = word.translate(LOOKALIKES)
    word = word.lower()
    if not word.isascii():
        word = _fold(word)
    if "*" in word.rstrip("*") or word.startswith("*"):
        return word
    word = word.strip("*'’")
    if re.search(r"[\d$@!+]", word) and re.search("[a-z]", word) and not re.fullmatch(r"[a-z]+\d+|v\d\S*|\d+[a-z]{1,2}", word):
        word = word.translate(LEET)
    if word.isdigit():
        return "9"
    return re.sub(r"(.)\1{2,}", r"\1", word) if re.search(r"(.)\1\1", word) else word


def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


class Words(dict):
    """The hashes of the words of each chunk met, -1 for what ends a sentence. starred: the words that may stand behind
    stars, by length, the likeliest first."""

    def __init__(self, starred: dict[int, list[str]] | None = None) -> None:
        super().__init__()
        self.starred = starred or {}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) > MAX_KNOWN:
            self.clear()
        known = []
        for token in tokens(chunk):
            if token in _BREAK:
                known.append(-1)
                continue
            word = plain(token)
            if "*" in word:
                shape = re.compile(re.escape(word).replace(r"\*", "."))
                word = next((w for w in self.starred.get(len(word), ()) if shape.fullmatch(w)), "*masked*")
            if word:
                known.append(_hash(word))
        self[chunk] = out = tuple(known)
        return out

    def of(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, chunks(text))))


def features(texts: list[list[int]], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of hashed words in; out come (sentence, feature) pairs as two arrays, sentences ascending and numbered over
    all texts, each pair once, and the text of each sentence. Features are words and pairs of neighbours; given known,
    only those it has."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.fromiter(chain.from_iterable(texts), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    mask = (1 << BITS) - 1
    breaks = flat < 0
    fresh = np.ones(len(flat), bool)  # the first word of a sentence
    fresh[1:] = breaks[:-1] | (text[1:] != text[:-1])
    flat, text, fresh = flat[~breaks], text[~breaks], fresh[~breaks]
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh[0] = True
    sentence = np.cumsum(fresh) - 1
    one = (flat ^ (flat >> BITS)) & mask
    mixed = (flat[:-1] * 0x9E3779B1 + flat[1:] * 0x85EBCA6B + 0x165667B1) & 0xFFFFFFFFFFFF
    two = ((mixed >> 9) ^ (mixed >> 27)) & mask
    keep, inside = (np.ones(len(one), bool), ~fresh[1:]) if known is None else (known[one], known[two] & ~fresh[1:])
    pairs = np.unique(np.concatenate([sentence[keep] << BITS | one[keep], sentence[1:][inside] << BITS | two[inside]]))
    return pairs >> BITS, pairs & mask, text[fresh]


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # 2 ** BITS
    factors: np.ndarray  # 2 ** BITS x RANK
    known: np.ndarray  # whether a feature has been learned
    threshold: float = 0.0
    starred: dict[int, list[str]] = field(default_factory=dict)

    def raw(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of n sentences from their learned features; the bias for those without any. row is ascending."""
        out = np.full(n, self.bias)
        for at, to in _blocks(row):
            out[np.unique(row[at:to])] += _interact(self.linear, self.factors, row[at:to], feature[at:to])[0]
        return out


def _blocks(row: np.ndarray, size: int = 200_000) -> Iterator[tuple[int, int]]:
    """Slices of whole sentences of some size, so that their vectors fit the memory of a task."""
    at = 0
    while at < len(row):
        to = len(row) if at + size >= len(row) else int(np.searchsorted(row, row[at + size], "left"))
        if to <= at:
            to = int(np.searchsorted(row, row[at], "right"))
        yield at, to
        at = to


def _interact(linear: np.ndarray, factors: np.ndarray, row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """w.x and half the difference of squared sums and summed squares, of each sentence that has a row."""
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    v = factors[feature]
    total = _sums(v, starts)
    return _sums(linear[feature], starts) + 0.5 * (np.einsum("ij,ij->i", total, total) - _sums(np.einsum("ij,ij->i", v, v), starts)), v, total, starts


class _Learner:
    """Logistic loss by Adagrad over mini-batches; keeps its state, so that it can go on with other weights."""

    def __init__(self, size: int) -> None:
        self.rng = np.random.default_rng(SEED)
        self.linear, self.factors = np.zeros(size, np.float32), self.rng.normal(0, 0.05, (size, RANK)).astype(np.float32)
        self.gl, self.gf = np.full(size, 1e-6, np.float32), np.full((size, RANK), 1e-4, np.float32)
        self.bias, self.gb = 0.0, 1e-6

    def learn(self, starts: np.ndarray, feature: np.ndarray, good: np.ndarray, bad: np.ndarray, epochs: int, rate: float = 0.1, decay: float = 2e-5) -> None:
        """starts: where each sentence's features begin, and the end. good, bad: how much it counts as either."""
        sizes = np.diff(starts)
        taking = np.flatnonzero((sizes > 0) & (good + bad > 0))
        for _ in range(epochs):
            order = self.rng.permutation(taking)
            for at in range(0, len(order), 128):
                batch = order[at : at + 128]
                n = sizes[batch]
                first = np.cumsum(n) - n
                flat = feature[np.arange(int(n.sum())) - np.repeat(first - starts[batch], n)]
                uniq, inverse = np.unique(flat, return_inverse=True)
                w, v = self.linear[uniq], self.factors[uniq]
                each = v[inverse]
                total = _sums(each, first)
                z = self.bias + _sums(w[inverse], first) + 0.5 * (np.einsum("ij,ij->i", total, total) - _sums(np.einsum("ij,ij->i", each, each), first))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                g = p * (good[batch] + bad[batch]) - bad[batch]
                spread = np.repeat(g, n)
                dl = np.bincount(inverse, spread, len(uniq)) + decay * len(batch) * w
                pull = spread[:, None] * (np.repeat(total, n, axis=0) - each)
                df = np.stack([np.bincount(inverse, pull[:, k], len(uniq)) for k in range(RANK)], 1) + decay * len(batch) * v
                self.gl[uniq] += dl**2
                self.gf[uniq] += df**2
                self.gb += g.sum() ** 2
                self.linear[uniq] -= rate * dl / np.sqrt(self.gl[uniq])
                self.factors[uniq] -= 0.5 * rate * df / np.sqrt(self.gf[uniq])
                self.bias -= rate * g.sum() / np.sqrt(self.gb)

    def score(self, starts: np.ndarray, feature: np.ndarray) -> np.ndarray:
        out = np.full(len(starts) - 1, self.bias)
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        for at, to in _blocks(row):
            out[np.unique(row[at:to])] += _interact(self.linear, self.factors, row[at:to], feature[at:to])[0]
        return out


def _odds(words: list[list[int]], labels: np.ndarray) -> dict[int, float]:
    """Of each word of several texts how much oftener, in log-odds of texts, abusive ones have it."""
    uniq = [np.unique(np.asarray(w, np.int64)) for w in words]
    flat, of = np.concatenate(uniq), np.repeat(labels, [len(u) for u in uniq])
    word, inverse = np.unique(flat, return_inverse=True)
    bad, fine = np.bincount(inverse, of, len(word)), np.bincount(inverse, ~of, len(word))
    lead = np.log((bad + 0.5) / (labels.sum() + 1)) - np.log((fine + 0.5) / ((~labels).sum() + 1))
    keep = bad + fine >= LEAST_TEXTS
    return dict(zip(word[keep].tolist(), lead[keep].tolist()))


def fit(texts: list[str], labels: list[bool]) -> Machine:
    """A machine fitted to labelled texts. With no abusive or no fine text it finds nothing."""
    size = 1 << BITS
    y = np.asarray(labels, bool)
    if not y.any() or y.all():
        return Machine(-10.0, np.zeros(size, np.float32), np.zeros((size, RANK), np.float32), np.zeros(size, bool))
    words = Words()
    # Starred words are read as the word that fits and stands most in abusive texts.
    odds, starred = _odds([words.of(t) for t in texts], y), {}
    for word in {plain(w) for c in {c for t in texts for c in chunks(t)} for w in tokens(c) if w not in _BREAK}:
        if "*" not in word and odds.get(_hash(word), 0.0) > 1.0:
            starred.setdefault(len(word), []).append(word)
    for length, ws in starred.items():
        starred[length] = sorted(ws, key=lambda w: (-odds[_hash(w)], w))
    words = Words(starred)
    row, feature, of = features([words.of(t) for t in texts])
    n = len(of)
    # What hardly any text has only lets the machine learn single texts, and their raters' errors, by heart.
    in_text = np.unique(of[row] << BITS | feature) & (size - 1)
    known = np.bincount(in_text, minlength=size) >= LEAST_TEXTS
    learned = known[feature]
    row, feature = row[learned], feature[learned]
    starts = np.searchsorted(row, np.arange(n + 1))
    fold = (np.arange(len(texts)) % FOLDS)[of]
    abusive = y[of]
    ratio = float((~y).sum() / y.sum())
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    some = np.flatnonzero(np.diff(first) > 0)  # texts with a sentence
    # First: how much oftener a sentence's terms stand in abusive texts than in fine ones.
    bad, good = np.where(abusive, ratio, 0.0), np.where(abusive, 0.0, 1.0)
    learners = [_Learner(size) for _ in range(FOLDS)]
    scores = np.zeros(n)
    for r in range(ROUNDS + 1):
        # Each text is judged by a machine that has not seen it: raters err, and what one learned by heart would agree.
        for f, learner in enumerate(learners):
            seen = fold != f
            learner.learn(starts, feature, good * seen, bad * seen, 2 if r == 0 else 1)
            scores[~seen] = learner.score(starts, feature)[~seen]
        top = np.zeros(n, bool)
        worst = np.full(len(texts), -30.0)
        worst[some] = np.maximum.reduceat(scores, first[some])
        top[np.flatnonzero(scores == worst[of])] = True
        # An abusive text without a sentence that looks so teaches nothing, nor does a fine one teach that what looks
        # abusive all over is fine.
        bad = np.where(abusive & top & (scores > 0), 2.0, 0.0)
        good = np.where(~abusive & (scores < 2.0), 1.0, 0.0)
    last = _Learner(size)
    last.learn(starts, feature, good, bad, 3)
    # The threshold that agrees with most labels; in the middle of the gap it lies in.
    order = np.argsort(worst, kind="stable")
    right = np.cumsum(~y[order]) + y.sum() - np.cumsum(y[order])
    at = int(np.argmax(right))
    threshold = float((worst[order][at] + worst[order][min(at + 1, len(order) - 1)]) / 2)
    last.linear[~known] = 0
    last.factors[~known] = 0
    return Machine(last.bias, last.linear, last.factors, known, threshold, starred)


def labelled(documents: DataFrame, labels: DataFrame) -> tuple[list[str], list[bool]]:
    """Texts with a majority verdict, at most MAX_LABELLED of MAX_LABELLED_CHARS code points together; ties and unsure
    ones are left out."""
    votes = labels.where("verdict in ('abusive', 'fine')").groupBy("doc_id").agg((F.count_if(F.col("verdict") == "abusive") - F.count_if(F.col("verdict") == "fine")).alias("lead")).where("lead <> 0")
    votes = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    texts = documents.where("text is not null").join(F.broadcast(votes), "doc_id").select("doc_id", "text", (F.col("lead") > 0).alias("abusive"), F.xxhash64("doc_id").alias("pick"))
    # One task sums the lengths of these few rows, without their texts in the sort.
    upto = F.sum(F.length("text")).over(Window.orderBy("pick", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = texts.withColumn("upto", upto).where(F.col("upto") <= MAX_LABELLED_CHARS).select("doc_id", "text", "abusive").toPandas().sort_values(["doc_id", "text"], kind="stable")
    return rows.text.tolist(), rows.abusive.tolist()


def score_documents(documents: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, source, score, abusive: every document, also null and blank ones (score 0, not abusive).

    score is between 0 and 1, 0.5 where the machine is undecided.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(machine)  # of a fixed size, see BITS and RANK
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("score", pa.float64()), ("abusive", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        words = Words(m.starred)
        for batch in batches:
            top = np.full(batch.num_rows, -np.inf)
            held: list[list[int]] = []
            at = size = 0

            def flush() -> None:
                row, feature, of = features(held, m.known)
                if len(of):
                    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                    top[at + of[first]] = np.maximum.reduceat(m.raw(row, feature, len(of)), first)

            for i, text in enumerate(batch.column(2)):
                held.append(words.of(text.as_py() or ""))
                size += len(held[-1])
                if size > 300_000:  # bounds what a task holds of many texts at once
                    flush()
                    at, size, held = i + 1, 0, []
            flush()
            p = np.where(np.isneginf(top), 0.0, 1 / (1 + np.exp(-np.clip(top - m.threshold, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array(p >= 0.5)], schema=schema)

    return documents.select(F.col("doc_id").cast("bigint"), "source", "text").mapInArrow(run, "doc_id bigint, source string, score double, abusive boolean")


_FITTED: dict[tuple, Machine] = {}


def fitted(spark: SparkSession, sf_dir: str) -> Machine:
    """The machine of these tables, fitted once in a session as long as neither table is written anew."""
    key = [spark.sparkContext.applicationId]
    for name in ("documents", "labels"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        key += [path.toString(), fs.getFileStatus(path).getModificationTime(), fs.getContentSummary(path).getLength()]
    if tuple(key) not in _FITTED:
        _FITTED.clear()
        _FITTED[tuple(key)] = fit(*labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return _FITTED[tuple(key)]


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), fitted(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).where("abusive").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, documents, abusive_documents, rate."""
    return p9_scores(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), F.count_if("abusive").alias("abusive_documents"), F.round(F.count_if("abusive") / F.count("*"), 6).alias("rate"))


QUERIES = {"p9_found": p9_found, "p9_rates": p9_rates, "p9_scores": p9_scores}

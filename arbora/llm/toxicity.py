"""Toxicity scores of texts restored through a noisy channel.

Suspicious stretches (letters mixed with look-alike signs, spaced-out letters, letters repeated) span a lattice of
readings: a sign may stand for itself or for letters it resembles, a run of one letter for one or two of it, and a
separator for nothing or for the edge of a word.  A Viterbi search under a character trigram model of the corpus and a channel cost for every
substitution picks the likeliest reading.  Words and word beginnings of the text and of its readings are the features
of a logistic model.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import text_chunks

#: Labelled rows that the model is fitted on at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Features held at most, the labelled texts that one must be in, and its least log odds.
FEATURES, SUPPORT, ODDS = 4096, 5, 1.0
#: Symbols of the character model besides the edge of a word; other characters share one symbol.
ALPHABET = "abcdefghijklmnopqrstuvwxyz'àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
#: Characters decoded at once; longer stretches are decoded in blocks that overlap by half.
LONGEST = 40
BEGINNING = 4
#: Letters of the shortest word that is looked for inside joined ones.
LEAST = 4

# What signs are read as.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¢": "c", "µ": "u"}
#: Channel costs in nats: a look-alike, a letter written thrice or more, a doubled one, a separator, a separator that ends a
# word, a sign that means nothing, and a masked vowel.
SUBSTITUTED, REPEATED, DOUBLED, SEPARATED, BROKEN, DROPPED, MASKED = 1.0, 0.7, 2.5, 0.2, 1.5, 6.0, 1.5
MASKS = "*#%"

_SIGNS = "".join(map(re.escape, LOOKALIKES))
_SIGN = re.compile(f"[{_SIGNS}]+")
_TOKEN = re.compile(rf"[\w{_SIGNS}{MASKS}.\-]{{3,}}")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[" + _SIGNS + r"])(?:[ .\-_*#%]{1,2}(?:[^\W_]|[" + _SIGNS + r"])){2,}(?![^\W_])")
_JOINT = re.compile(r"(?<=[^\W_])[.\-_*#%]+(?=[^\W_])")
_INSIDE = re.compile(r"[^\W_]+(?:[.\-_*#%]+[^\W_]+)+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_TAIL = re.compile(r"(?:[!|+(<.\-*_]|([^\w\s])\1+)+$")
_MORE = re.compile(r"([^\W\d_])\1{3,}")
_JOINED = re.compile(r"[ .\-_*#%]")
_WORD = re.compile(r"[^\W\d_]+")


def folded(text: str) -> str:
    """Lower case without invisible characters; full-width and other compatible letters become plain ones."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = re.sub("[­​-‏⁠﻿̀-ͯ]", "", text)
    return text.lower()


# the character model

N_SYMBOLS = len(ALPHABET) + 2
_CODE = {" ": 0} | {c: i + 2 for i, c in enumerate(ALPHABET)}
_TABLE = np.ones(0x10000, np.uint8)
for _c, _i in _CODE.items():
    _TABLE[ord(_c)] = _i
_TABLE[[*range(0x41, 0x5B)]] = _TABLE[[*range(0x61, 0x7B)]]
_TABLE[[9, 10, 11, 12, 13, 32]] = 0


def trigram_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Counts of the N_SYMBOLS ** 3 trigrams over all texts; each partition sends its sums, so at most that many rows
    a partition are shuffled and as many reach the driver."""

    def run(batches):
        total = np.zeros(N_SYMBOLS**3, np.int64)
        for batch in batches:
            for _, data, _ in text_chunks(batch.column(0)):
                code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-16-le"), np.uint16)
                s = np.concatenate(([0, 0], _TABLE[code], [0])).astype(np.int64)
                total += np.bincount((s[:-2] * N_SYMBOLS + s[1:-1]) * N_SYMBOLS + s[2:], minlength=N_SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["gram", "n"])

    out = np.zeros(N_SYMBOLS**3)
    counts = docs.select(F.col(text).cast("string")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    for r in counts.collect():
        out[r.gram] = r.n
    return out


def costs_of(counts: np.ndarray) -> np.ndarray:
    """Negative log probabilities of a symbol after two others, trigrams interpolated with bigrams and unigrams."""
    c3 = counts.reshape(N_SYMBOLS, N_SYMBOLS, N_SYMBOLS)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + N_SYMBOLS)
    p2 = (c2 + 50 * p1) / (c2.sum(1, keepdims=True) + 50)
    p3 = (c3 + 20 * p2[None]) / (c3.sum(2, keepdims=True) + 20)
    return -np.log(p3).astype(np.float32)


class Decoder:
    """Viterbi search over the lattice of a stretch."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.reshape(-1).tolist()
        self.cache: dict[str, str] = {}

    def lattice(self, stretch: str) -> list[list[tuple[str, float]]]:
        """For each run of one sign, its readings and their costs."""
        out = []
        for m in re.finditer(r"(.)\1*", stretch, re.S):
            sign, n = m[1], len(m[0])
            if sign.isalpha():
                ways = [(sign, 0.0)] if n == 1 else [(sign, DOUBLED), (sign * 2, 0.0)] if n == 2 else [(sign, REPEATED), (sign * 2, REPEATED)]
                ways += [(x, SUBSTITUTED) for x in LOOKALIKES.get(sign, "")]
            elif sign in LOOKALIKES:
                ways = [(x * k, SUBSTITUTED + REPEATED * (n != k)) for x in LOOKALIKES[sign] for k in (1, 2)[: min(n, 2)]]
                if not sign.isalnum():
                    ways.append(("", DROPPED * n))
            else:
                ways = [("", SEPARATED), (" ", BROKEN)]
                if sign in MASKS:
                    ways += [(x * n, MASKED * n) for x in "aeiou"]
            out.append(ways)
        return out

    def read(self, stretch: str) -> str:
        """The likeliest reading."""
        hit = self.cache.get(stretch)
        if hit is None:
            if len(self.cache) > 50_000:
                self.cache.clear()
            hit = self.cache[stretch] = self._search(stretch)
        return hit

    def _search(self, stretch: str) -> str:
        costs, n = self.costs, N_SYMBOLS
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for ways in self.lattice(stretch):
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, path) in states.items():
                for letters, extra in ways:
                    x, y, c = a, b, cost + extra
                    for letter in letters:
                        z = _CODE.get(letter, 1)
                        c += costs[(x * n + y) * n + z]
                        x, y = y, z
                    old = new.get((x, y))
                    if old is None or c < old[0]:
                        new[x, y] = (c, path + letters)
            states = new
        return min((cost + costs[(a * n + b) * n], path) for (a, b), (cost, path) in states.items())[1]


def _around(text: str, places) -> set[str]:
    """The pieces between white space that hold one of ``places`` (matches in order)."""
    out, end = set(), 0
    for m in places:
        if m.start() < end:
            continue
        i, j, reach = m.start(), m.end(), LONGEST
        while i and not text[i - 1].isspace():
            left = text[max(0, m.start() - reach) : m.start()].split()[-1]
            i = m.start() - len(left)
            if len(left) < reach:
                break
            reach *= 2
        reach = LONGEST
        while j < len(text) and not text[j].isspace():
            right = text[m.end() : m.end() + reach].split()[0]
            j = m.end() + len(right)
            if len(right) < reach:
                break
            reach *= 2
        end = j
        out.add(text[i:end])
    return out


def _blocks(stretch: str):
    """The stretch, or blocks of LONGEST characters that overlap by half."""
    if len(stretch) <= LONGEST:
        return [stretch]
    half = LONGEST // 2
    return [stretch[k : k + LONGEST] for k in range(0, len(stretch) - half, half)]


def stretches(text: str) -> set[str]:
    """The suspicious stretches of a folded text, long ones in blocks; a letter is there three times in a run at most."""
    text = _MORE.sub(r"\1\1\1", text)
    out = set()
    for piece in _around(text, _SIGN.finditer(text)):
        for m in _TOKEN.finditer(piece):
            s = _TAIL.sub("", m[0].strip(".-*_#%"))
            if any(c.isalpha() for c in s) and any(c in LOOKALIKES for c in s):
                out.add(s)
    out.update(m[0] for m in _SPACED.finditer(text))
    for piece in _around(text, _JOINT.finditer(text)):
        out.update(m[0] for m in _INSIDE.finditer(piece))
    for piece in _around(text, _TRIPLE.finditer(text)):
        out.update(w for w in _WORD.findall(piece) if _TRIPLE.search(w))
    out = {b for s in out for b in _blocks(s)}
    return {s for s in out if len(s) > 2 and any(c.isalpha() for c in s) and not (s.isalpha() and not _TRIPLE.search(s))}


def _inner(joined: str, known) -> set[str]:
    """Words of ``known`` that cover most of ``joined`` without overlap; the fewest that do."""
    best: list[tuple[int, int, tuple]] = [(0, 0, ())]
    for j in range(1, len(joined) + 1):
        most = best[j - 1]
        for i in range(max(0, j - LONGEST), j - LEAST + 1):
            if joined[i:j] in known:
                most = max(most, (best[i][0] + j - i, best[i][1] - 1, (*best[i][2], joined[i:j])))
        best.append(most)
    return set(best[-1][2])


def features(text: str | None, decoder: Decoder, known=()) -> set[str]:
    """Words of a text and of its restored stretches, and the beginnings (marked ``^``) of longer ones.  A trigram model
    can't always tell where words that are spaced out or joined part; words of ``known`` are looked for inside them."""
    text = folded(text or "")
    words = set(_WORD.findall(text))
    for s in stretches(text):
        read = decoder.read(s)
        own = _WORD.findall(read)
        words.update(own)
        if known and _JOINED.search(s) and not known.issuperset(own):
            words.update(_inner("".join(own), known))
    return words | {"^" + w[:BEGINNING] for w in words if len(w) > BEGINNING}


class Model:
    """A character model and feature weights; ``score`` is the probability of label 1."""

    def __init__(self, costs: np.ndarray, weights: dict[str, float], bias: float):
        self.decoder, self.weights, self.bias = Decoder(costs), weights, bias
        self.known = {f for f in weights if len(f) >= LEAST and f[0] != "^"}

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[f] for f in features(text, self.decoder, self.known) & self.weights.keys())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _sample(docs: DataFrame, labels: DataFrame, text: str, ident: str, label: str) -> DataFrame:
    own = labels.select(F.col(ident).cast("long").alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y is not null")
    own = own.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    return docs.select(F.col(ident).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(own), "id").select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", label: str = "toxic") -> tuple[np.ndarray, dict[str, float], float]:
    """(character costs, feature weights, bias): the character model from all ``docs``, the rest from the texts of at
    most SAMPLE rows of ``labels``.  Without labels of both kinds every score is the share of label 1, or 0."""
    spark: SparkSession = docs.sparkSession
    costs = costs_of(trigram_counts(docs, text))
    shared = spark.sparkContext.broadcast(costs)
    sample = _sample(docs, labels, text, ident, label)

    def count(batches):
        decoder, n = Decoder(shared.value), {}
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in ("", *features(t, decoder)):
                    x = n.setdefault(f, [0, 0])
                    x[y > 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([x[0] for x in n.values()], pa.int64()), pa.array([x[1] for x in n.values()], pa.int64())], ["f", "n0", "n1"])

    counts = sample.mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = counts.filter((F.col("n0") + F.col("n1")) >= SUPPORT)
    every = counts.filter("f = ''").first()
    n0, n1 = (every.n0, every.n1) if every else (0, 0)
    if not n0 or not n1:
        return costs, {}, -30.0 if not n1 else 30.0
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    gain = F.abs(odds) * F.greatest(F.col("n0") / n0, F.col("n1") / n1)
    chosen = counts.filter("f <> ''").withColumn("odds", odds).filter(F.abs("odds") >= ODDS).orderBy(gain.desc(), "f").limit(FEATURES).collect()
    index = {r.f: i for i, r in enumerate(chosen)}

    def rows(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            hits = [sorted(index[f] for f in features(t, decoder) & index.keys()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32())), batch.column(1)], ["hits", "y"])

    table = sample.mapInArrow(rows, "hits array<int>, y int").groupBy("hits", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    weights, bias = _logistic([r.hits for r in table], np.array([r.y > 0 for r in table], float), np.array([r.n for r in table], float), len(index))
    return costs, {f: weights[i] for f, i in index.items()}, bias


def _logistic(hits: list, y: np.ndarray, n: np.ndarray, size: int, l2: float = 2e-5, steps: int = 500, rate: float = 0.02) -> tuple[list[float], float]:
    """Weights and bias of an L2-regularised logistic model over sets of features, by momentum steps scaled by each
    feature's curvature.  Each label counts for half, so that the threshold of 0.5 isn't drawn to the rarer one's side."""
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    col = np.fromiter((i for h in hits for i in h), np.int64, len(row))
    share = n * np.where(y > 0, 0.5 / max(n @ y, 1), 0.5 / max(n @ (1 - y), 1))
    curve = 0.25 * np.bincount(col, share[row], size) + l2
    w, vw, b, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for _ in range(steps):
        z = b + np.bincount(row, w[col], len(hits))
        g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        vw = 0.9 * vw - rate * (np.bincount(col, g[row], size) + l2 * w) / curve
        vb = 0.9 * vb - 4 * rate * g.sum()
        w, b = w + vw, b + vb
    # the bias is moved to the middle of the gap that parts the labels best
    z = b + np.bincount(row, w[col], len(hits))
    order = np.argsort(z)
    right = np.cumsum(np.where(y > 0, 0, share)[order]) - np.cumsum(np.where(y > 0, share, 0)[order])
    gap = np.append(np.diff(z[order]), 0.0)
    at = np.flatnonzero((right >= right[gap > 0].max(initial=-1) - 1e-12) & (gap > 0))
    if len(at):
        k = at[np.argmax(gap[at])]
        b -= z[order][k] + gap[k] / 2
    return w.tolist(), float(b)


def score(docs: DataFrame, model: tuple, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier).  A null text is scored like an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    i = names.index(text)
    schema = docs.select("*", F.lit(0.0).alias("score")).schema

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own.score(t) for t in batch.column(i).to_pylist()], pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: tuple, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``least``, whole; columns stay as they are, whatever their names.  A null
    text is scored like an empty one, and repeated rows go or stay together."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    i = docs.columns.index(text)

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t) < least for t in batch.column(i).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", label: str = "toxic", folds: int = 5) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Labels come only from rows whose crc32(id as text) mod ``folds`` isn't 0.  The score sees the text alone.  Null
    texts are empty; a null id is held out of nothing; repeated rows are scored alike; other columns are ignored.
    """
    fold = lambda c: F.crc32(F.col(c).cast("long").cast("string")) % folds == 0
    model = fit(docs, labels.filter(~fold(ident)), text, ident, label)
    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    out = score(rows, model).select("id", F.coalesce(fold("id"), F.lit(False)).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

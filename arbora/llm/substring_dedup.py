"""Exact substring de-duplication by seed and extend.

Every window of ``length`` words selects one anchor by winnowing: the smallest hash among its runs of ``seed`` words.
The choice depends on the window's words alone, so two equal windows hold the same anchor at the same place.  Anchors
that come once prove all their windows unique.  Documents are joined on the anchors that come more often, matches are
extended both ways to the windows around those seeds, and windows that come more than once merge into maximal repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Words, lists, text_chunks
from .shared import dropped, fresh, joined_by_key, released, same, written

#: Words of a window and of an anchor.
LENGTH, SEED = 35, 10


def selected_anchors(words: Words, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, index of the anchor that each selects, hash of every run of ``seed`` words by its first word)."""
    n, span = len(words.hash), length - seed + 1
    at, h = words.windows(seed)
    full = np.full(max(n, 1), np.uint64(2**64 - 1))
    full[at] = h
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), full
    best, where, width = full, np.arange(n), 1
    while width < span:
        step = min(width, span - width)
        right = best[step:] < best[:-step]
        where = np.where(right, where[step:], where[:-step])
        best = np.where(right, best[step:], best[:-step])
        width += step
    starts = np.flatnonzero(words.doc[: n - length + 1] == words.doc[length - 1 :])
    return starts, where[starts], full


def _anchors(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """Per document: n_words, SHA-256 of its words and the hash of every anchor that one of its windows selects."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_chunks(batch.column(2)):
                words = Words(data, offsets)
                _, where, full = selected_anchors(words, length, seed)
                where = where[np.concatenate(([True], where[1:] != where[:-1]))] if len(where) else where
                counts = np.bincount(words.doc[where], minlength=len(words.n))
                raw = data.tobytes()
                sha = [hashlib.sha256(b" ".join(raw[a:b].split())).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], pa.array(words.n, pa.int64()), pa.array(sha, pa.binary()), lists(full[where].view(np.int64), counts, pa.int64())], ["id", "th", "n_words", "sha", "anchors"])

    return docs.mapInArrow(run, "id long, th long, n_words long, sha binary, anchors array<long>")


def _windows(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(h, cid, pos) of every window whose anchor is among the document's repeated ones."""

    def run(batches):
        for batch in batches:
            seeds = batch.column(2)
            for part, data, offsets in text_chunks(batch.column(1)):
                words = Words(data, offsets)
                starts, where, full = selected_anchors(words, length, seed)
                mine = seeds[part]
                known = np.unique(mine.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                hit = np.isin(full[where], known) if len(known) else np.zeros(len(where), bool)
                starts = starts[hit]
                at, h = words.windows(length)
                h = h[np.searchsorted(at, starts)]
                doc = words.doc[starts]
                cid = batch.column(0)[part].to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(cid[doc], pa.int64()), pa.array((starts - words.first[doc]).astype(np.int32))], ["h", "cid", "pos"])

    return docs.select("cid", "text", "seeds").mapInArrow(run, "h long, cid long, pos int")


def _cut(docs: DataFrame, length: int, keep_text: bool) -> DataFrame:
    """The documents without the words that the windows at ``marks`` cover."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_chunks(batch.column(2)):
                words = Words(data, offsets)
                marks = batch.column(3)[part]
                counts = np.diff(marks.offsets.to_numpy()) if len(marks) else np.zeros(0, np.int64)
                flat = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(words.first, counts)
                cover = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(cover, flat, 1)
                np.add.at(cover, flat + length, -1)
                gone = np.cumsum(cover)[:-1] > 0
                removed = np.bincount(words.doc[gone], minlength=len(words.n))
                raw, sha, texts = data.tobytes(), [], []
                start, end = words.start.tolist(), words.end.tolist()
                for i in range(len(words.n)):
                    a, b = int(words.first[i]), int(words.first[i] + words.n[i])
                    sha.append(hashlib.sha256(b" ".join(raw[start[j] : end[j]] for j in range(a, b) if not gone[j])).digest())
                    if keep_text:
                        texts.append(_without(raw, int(offsets[i]), int(offsets[i + 1]), start[a:b], end[a:b], gone[a:b]))
                out = [batch.column(0)[part], batch.column(1)[part], pa.array(removed, pa.int64()), pa.array(sha, pa.binary())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.string())] * keep_text, ["id", "th", "n_removed", "sha", "text"][: 4 + keep_text])

    return docs.select("id", "th", "text", "marks").mapInArrow(run, "id long, th long, n_removed long, sha binary" + ", text string" * keep_text)


def _without(raw: bytes, a: int, b: int, start: list[int], end: list[int], gone: np.ndarray) -> str:
    """The text without its gone words; what separates two kept words stays, a removed stretch takes what follows it."""
    out, at = [], a
    for s, e, g in zip(start, end, gone.tolist(), strict=True):
        if not g:
            out.append(raw[at:e])
            at = e
        else:
            out.append(b"")
            at = e
    out.append(raw[at:b])
    return b"".join(out).decode("utf-8", "replace").strip()


def remove_repeats(docs: DataFrame, text: str = "text", ident: str = "doc_id", length: int = LENGTH, seed: int = SEED, keep_text: bool = False) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 and, if ``keep_text``, th and the remaining text.

    A word goes if a window of ``length`` words covers it whose words also start at another place of any document, the
    same one included; windows are judged on the input.  ``kept_sha256`` is of the kept words joined by one space.  A
    null text has no words, documents under ``length`` words lose none, a row without id is treated like any other, and
    repeated rows are copies of each other.  Columns other than the two named are ignored.
    """
    base = docs.select(F.col(ident).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("text"))
    table = written(_anchors(base, length, seed), "anchors")
    places = table.select("id", "th", F.explode("anchors").alias("g"))
    total = table.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()[0]
    twice = written(places.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "seeds")
    seeds = joined_by_key(places, twice, ["g"], "n", total).groupBy("id", "th").agg(F.collect_set("g").alias("seeds"))
    seeds = written(seeds, "documents-seeds")
    released(docs.sparkSession)
    found = base.alias("x").join(seeds.hint("merge").alias("s"), same(base, seeds, ["id", "th"]))
    found = found.select(F.monotonically_increasing_id().alias("cid"), "x.id", "x.th", "x.text", "s.seeds")
    found = written(found, "seeded")
    released(docs.sparkSession)
    windows = written(_windows(found, length, seed), "windows")
    total = windows.count()
    repeated = written(windows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    released(docs.sparkSession)
    marks = joined_by_key(windows, repeated, ["h"], "n", total).groupBy("cid").agg(F.collect_list("pos").alias("marks"))
    marks = written(marks, "marks")
    dropped(windows, repeated, seeds, twice)
    released(docs.sparkSession)
    cut = written(_cut(found.join(marks.hint("merge"), "cid"), length, keep_text).distinct(), "cut")
    dropped(found, marks)
    cut = cut.withColumnRenamed("sha", "left_sha")
    out = table.drop("anchors").alias("t").join(cut.hint("merge").alias("c"), same(table, cut, ["id", "th"]), "left")
    cols = [F.col("t.id").alias("id"), "t.n_words", F.coalesce("c.n_removed", F.lit(0).cast("long")).alias("n_removed"), F.lower(F.hex(F.coalesce("c.left_sha", "t.sha"))).alias("kept_sha256")]
    return out.select(*cols, *([F.col("t.th").alias("th"), F.col("c.text").alias("text")] if keep_text else []))


def cut_repeats(docs: DataFrame, text: str = "text", ident: str = "doc_id", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``docs`` with the words that ``remove_repeats`` removes cut out of the texts; documents whose words all go, go too.

    What separates two kept words stays as it was; columns stay as they are, whatever their names.  Rows with a null or
    blank text stay, rows without id are cut like any other.
    """
    changed = remove_repeats(docs, text, ident, length, seed, keep_text=True).filter("n_removed > 0")
    key, hashed, left, gone = fresh(docs, "_id", "_h", "_text", "_gone")
    changed = changed.select(F.col("id").alias(key), F.col("th").alias(hashed), F.col("text").alias(left), (F.col("n_words") == F.col("n_removed")).alias(gone))
    changed = written(changed.distinct(), "changed")
    released(docs.sparkSession)
    on = docs[ident].cast("long").eqNullSafe(changed[key]) & F.xxhash64(docs[text].cast("string")).eqNullSafe(changed[hashed])
    out = docs.join(changed.hint("merge"), on, "left").filter(~F.coalesce(F.col(gone), F.lit(False)))
    return out.select(*(F.coalesce(left, text).alias(text) if c == text else F.col(c) for c in docs.columns))

"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

The sketch follows Dahlgaard, Knudsen and Thorup (FOCS 2017): in round ``i`` every element is thrown into one of ``t``
bins with a fresh hash and a bin keeps the smallest value, earlier rounds winning over later ones; rounds ``t`` to
``2t - 1`` throw all elements into bin ``i - t``.  So every coordinate fills, two sets agree in a coordinate with the
probability of their Jaccard similarity, and the number of agreements is concentrated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Words, mix, text_chunks
from .shared import components, dropped, joined_by_key, released, written

#: Bands and coordinates a band: a pair of similarity 0.85 is missed with probability 4e-7, one of 0.8 with 4e-5.
BANDS, ROWS = 25, 5
#: 64-bit words of a set's bitmap, which bounds intersections from above.
BITMAP = 16
_ROUND = np.uint64(0x632BE59BD9B4E019)
_ROUNDS = mix(np.arange(1, 1025, dtype=np.uint64) * _ROUND)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct k-word shingles, sorted by both; fewer words are one shingle, none are no shingle."""
    at, h = words.windows(k)
    doc = words.doc[at]
    short = np.flatnonzero((words.n > 0) & (words.n < k))
    if len(short):
        own = [mix(np.array([words.n[i]], np.uint64) + np.bitwise_xor.reduce(mix(words.hash[words.first[i] : words.first[i] + words.n[i]] + np.arange(1, words.n[i] + 1, dtype=np.uint64))))[0] for i in short]
        doc, h = np.concatenate((doc, short)), np.concatenate((h, np.array(own, np.uint64)))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def sketches(doc: np.ndarray, h: np.ndarray, n: int, t: int) -> np.ndarray:
    """The (n, t) sketches of the sets; all ones where a set is empty."""
    empty = np.uint64(2**64 - 1)
    out = np.full(n * t, empty)
    for i in range(2 * t):
        if not len(h):
            break
        v = mix(h + _ROUNDS[i % 1024] + np.uint64(i))
        value = (v >> np.uint64(9)) | (np.uint64(i) << np.uint64(55))
        bins = mix(v) % np.uint64(t) if i < t else np.full(len(h), i - t, np.uint64)
        np.minimum.at(out, doc * t + bins.astype(np.int64), value)
        open_ = (out.reshape(n, t) == empty).any(1)
        keep = open_[doc]
        if not keep.all():
            doc, h = doc[keep], h[keep]
    return out.reshape(n, t)


def sketch_table(docs: DataFrame, text: str, ident: str, k: int, bands: int, rows: int) -> DataFrame:
    """Per document: id, n_shingles, two 64-bit fingerprints of its shingle set, a hash for each band, and a bitmap in
    which every shingle sets one bit."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_chunks(batch.column(1)):
                words = Words(data, offsets, lower=True)
                n = len(words.n)
                doc, h = shingle_sets(words, k)
                sizes = np.bincount(doc, minlength=n)
                f1, f2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                np.add.at(f1, doc, mix(h))
                np.add.at(f2, doc, mix(h ^ _ROUND))
                s = sketches(doc, h, n, bands * rows).reshape(n, bands, rows)
                b = np.zeros((n, bands), np.uint64)
                for r in range(rows):
                    b = mix(b + s[:, :, r])
                bits = np.zeros(n * BITMAP * 64, bool)
                bits[doc * (BITMAP * 64) + (mix(h ^ _ROUNDS[0]) % np.uint64(BITMAP * 64)).astype(np.int64)] = True
                flat, bits = pa.array(b.reshape(-1).view(np.int64)), pa.array(np.packbits(bits).view(np.int64))
                off, off2 = (pa.array(np.arange(0, n * w + 1, w, dtype=np.int32)) for w in (bands, BITMAP))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(sizes, pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.ListArray.from_arrays(off, flat), pa.ListArray.from_arrays(off2, bits)], ["id", "n_shingles", "f1", "f2", "bands", "bits"])

    return docs.select(F.col(ident).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id long, n_shingles long, f1 long, f2 long, bands array<long>, bits array<long>")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their whole shingle sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for (part, d1, o1), x in ((c, c[0]) for c in text_chunks(batch.column(2))):
                one = shingle_sets(Words(d1, o1, lower=True), k)
                for part2, d2, o2 in text_chunks(batch.column(3)[part]):
                    two = shingle_sets(Words(d2, o2, lower=True), k)
                    lo, n = part2.start, part2.stop - part2.start
                    mine = (one[0] >= lo) & (one[0] < lo + n)
                    doc = np.concatenate((one[0][mine] - lo, two[0]))
                    h = np.concatenate((one[1][mine], two[1]))
                    order = np.lexsort((h, doc))
                    doc, h = doc[order], h[order]
                    both = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (h[1:] == h[:-1])], minlength=n)
                    union = np.bincount(doc, minlength=n) - both
                    keep.append((union > 0) & (100 * both >= percent * union))
            ok = pa.array(np.concatenate(keep)) if keep else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", ident: str = "doc_id", k: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links), kept.

    Documents with equal shingle sets form a class at once.  Of each bucket, the classes are verified against the
    bucket's smallest id, and the links give components; classes of one bucket that are still apart are then verified
    against each other, so that no link found by banding is lost, while large groups cost one pair a member.
    A null or blank text is an empty set and linked with nothing; a row without id is returned with a null component
    and kept.  Rows with one id must hold one text; repeated rows are returned as often as they come.  Columns other
    than the two named are ignored.
    """
    table = written(sketch_table(docs, text, ident, k, bands, rows), "sketch")
    full = table.filter("id is not null and n_shingles > 0")
    total = full.count()
    sets = ["n_shingles", "f1", "f2"]
    groups = full.groupBy(*sets).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    groups = written(groups.filter("copies > 1"), "groups")
    member = joined_by_key(full.select("id", *sets), groups, sets, "copies", total)
    links = [written(member.select(F.col("id").alias("b"), F.col("rep").alias("a")).filter("a < b"), "copies")]

    first = full.join(links[0].select(F.col("b").alias("id")), "id", "left_anti")
    buckets = first.select("id", F.posexplode("bands").alias("band", "bucket"))
    buckets = written(buckets, "buckets")
    many = buckets.groupBy("band", "bucket").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    many = written(many, "many")
    released(docs.sparkSession)
    crowd = joined_by_key(buckets, many.withColumn("crowd", F.col("members")), ["band", "bucket"], "members", total)
    crowd = written(crowd.withColumnRenamed("crowd", "members"), "crowd")
    texts = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).cast("string").alias("text")).filter("id is not null")
    tried = written(crowd.select(F.col("pivot").alias("a"), F.col("id").alias("b")).filter("a < b").distinct(), "tried")
    links.append(written(verified(tried, texts, k, percent).distinct(), "links"))
    comp = components(links[1])
    apart = _apart(crowd, comp, tried, full, percent)
    if not apart.isEmpty():
        links.append(written(verified(apart, texts, k, percent).distinct(), "links"))
    edges = links[0]
    for x in links[1:]:
        edges = edges.unionByName(x)
    comp = components(edges)
    dropped(groups, buckets, many, crowd, tried, apart, *links)
    out = table.select("id", "n_shingles").join(comp.withColumnRenamed("node", "id"), "id", "left")
    out = out.select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)))


def _apart(crowd: DataFrame, comp: DataFrame, tried: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket in different components that haven't been verified and may be links: members not linked to
    their bucket's pivot, each against the bucket's members of other components.

    A bit that one set's bitmap has and the other's lacks proves an element that isn't shared, so the bitmaps bound the
    similarity from above; pairs bounded below the threshold are no links and are not made.
    """
    names = comp.select(F.col("node").alias("id"), "component")
    known = crowd.join(names, "id", "left").withColumn("component", F.coalesce("component", "id"))
    pivots = comp.select(F.col("node").alias("pivot"), F.col("component").alias("main"))
    known = known.join(pivots, "pivot", "left").withColumn("main", F.coalesce("main", "pivot"))
    known = written(known, "known")
    odd = written(known.filter("component <> main").groupBy("band", "bucket").agg(F.max("members").alias("members")), "odd")
    known = joined_by_key(known.drop("members"), odd, ["band", "bucket"], "members", crowd.count())
    bits = sets.dropDuplicates(["id"]).select("id", F.col("n_shingles").alias("n"), "bits")
    known = written(known.join(bits.hint("merge"), "id"), "known")
    x = known.filter("component <> main").select("band", "bucket", *(F.col(c).alias(f"x_{c}") for c in ("id", "component", "n", "bits")))
    only = lambda a, b: sum((F.bit_count(F.col(a)[i].bitwiseAND(F.bitwise_not(F.col(b)[i]))) for i in range(BITMAP)), F.lit(0))
    most = F.least(F.col("n") - only("bits", "x_bits"), F.col("x_n") - only("x_bits", "bits"))
    may = (F.col("component") != F.col("x_component")) & (most * (100 + percent) >= (F.col("n") + F.col("x_n")) * percent)
    left = known.filter("id <> pivot").join(x.hint("merge"), ["band", "bucket"]).filter(may)
    left = left.select(F.least("id", "x_id").alias("a"), F.greatest("id", "x_id").alias("b")).distinct()
    return written(left.join(tried, ["a", "b"], "left_anti"), "apart")

"""Near-duplicate lines by a segment-partition edit join.

A line within ``edits`` edits of another leaves at least one of the other's ``edits + 1`` even segments untouched.  Every
distinct line is indexed by its segments, told apart by line length and segment number, and probes the index of each
length within ``edits`` below its own with the substrings at the places where an untouched segment can lie.  Pairs of a
bucket are verified with a banded bit-parallel edit distance.  A bucket that would make many pairs is split further:
what is left of each line without the common segment is within ``edits`` again, so it is segmented and probed once more.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, dropped, fresh, joined_by_key, released, written

#: Edits between near-duplicate lines, and the characters of the shortest line that may differ by so many.
EDITS, SHORTEST = 2, 20
#: Pairs of a bucket above which it is split by another segment, and classes of characters whose counts bound edits.
BUCKET_PAIRS, CLASSES = 65_536, 24
#: Hashes of lines that a task remembers so as not to send a line twice; a line sent twice changes nothing.
SEEN = 200_000


_H = xxhash.xxh3_64_intdigest


def _hash(x: str) -> int:
    return _H(x.encode("utf-8", "surrogatepass")) - 2**63


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(begin, size) of the even segments of a string; the later ones are longer by one where it doesn't divide."""
    n = edits + 1
    small, more = divmod(length, n)
    sizes = [small] * (n - more) + [small + 1] * more
    out, at = [], 0
    for s in sizes:
        out.append((at, s))
        at += s
    return out


def allowed(length: int, edits: int, shortest: int) -> int:
    """Edits between a line of ``length`` characters and a longer one: fewer under ``shortest``, in proportion."""
    return edits if length >= shortest else edits * length // shortest


def _seed(context: int, length: int, segment: int) -> int:
    return (context * 0x9E3779B97F4A7C15 + length * 64 + segment + 1) % 2**64


def index_keys(text: str, context: int, edits: int) -> list[tuple[int, int, int]]:
    """(key, begin, end) of each segment of ``text``."""
    n, data = len(text), text.encode("utf-32-le", "surrogatepass")
    return [(_H(data[4 * a : 4 * (a + s)], _seed(context, n, i)) - 2**63, a, a + s) for i, (a, s) in enumerate(segments(n, edits))]


def probe_keys(text: str, context: int, edits, own: bool = True) -> list[tuple[int, int, int]]:
    """(key, begin, end) of each substring of ``text`` that may equal a segment of a string up to ``edits`` shorter;
    without those that are its ``index_keys``, unless ``own``.  ``edits`` is a number or a function of the shorter length.

    Segment i of the shorter string lies at its own place shifted by at most the edits to its left, which are at most
    i, and by the length difference plus at most the edits to its right, which are at most edits - i.
    """
    return [x[:3] for x in _probe_keys(text, context, edits, own)]


def _probe_keys(text: str, context: int, edits, own: bool = True) -> list[tuple[int, int, int, int]]:
    """``probe_keys`` with the edits of each."""
    of = edits if callable(edits) else lambda _: edits
    out, data, n = [], text.encode("utf-32-le", "surrogatepass"), len(text)
    for shorter in range(max(0, n - of(n)), n + 1):
        d, e = n - shorter, of(shorter)
        if d > e or not e:
            continue
        for i, (a, s) in enumerate(segments(shorter, e)):
            seed = _seed(context, shorter, i)
            for b in range(max(a - i, a + d - (e - i), 0), min(a + i, a + d + (e - i), n - s) + 1):
                if own or d or b != a:
                    out.append((_H(data[4 * b : 4 * (b + s)], seed) - 2**63, b, b + s, e))
    return out


def _index_keys(text: str, context: int, edits) -> list[tuple[int, int, int, int]]:
    """``index_keys`` with the edits of each; none where there are no edits."""
    e = edits(len(text)) if callable(edits) else edits
    return [(*x, e) for x in index_keys(text, context, e)] if e else []


def histogram(text: str) -> list[int]:
    """Counts of the characters of ``text`` by class: an edit takes one from a class, adds one to a class, or both."""
    return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % CLASSES, minlength=CLASSES).tolist()


def edit_distance(a: str, b: str, most: int) -> int:
    """The edit distance of two strings, or ``most + 1`` if it is larger; a band of diagonals is held in one integer."""
    if len(a) < len(b):
        a, b = b, a
    i, n = 0, len(b)
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : n - j]
    m, n = len(a), len(b)
    if m - n > most:
        return most + 1
    if not n or m <= 1:
        return m if m <= most else most + 1
    if m <= most:  # it is m at most: the band need not be wider than that
        most, k = m - 1, m - 1
    else:
        k = most
    width = 2 * k + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    where: dict[str, int] = {}
    for r, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << r
    # bit x of the band at column j is row j + k - (width - 1) + x of the longer string; the distance is followed along
    # the band's lowest diagonal, then along the last row
    vp, vn, dist, side = full << (width - k - 1) & full, 0, k, top >> 1
    for j, c in enumerate(b):
        shift = j + k + 1 - width
        pm = where.get(c, 0)
        x = (pm >> shift if shift >= 0 else pm << -shift) & full
        d0 = (((x & vp) + vp) ^ vp | x | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if j < m - k:
            dist += not d0 & top
        else:
            dist += bool(hp & side) - bool(hn & side)
            side >>= 1
        if dist > most + max(0, n - 1 - j) + (m - n):
            return most + 1
        vp, vn = (hn | ~(d0 >> 1 | hp)) & full, d0 >> 1 & hp
    return dist if dist <= most else most + 1


def _lines(text: str | None):
    return enumerate((text or "").split("\n"))


def _occurrences(docs: DataFrame, edits, least: int) -> DataFrame:
    """One row per line that takes part: id, line_no, h, and at its first place in a partition its index and probe keys."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                ids, numbers, hs, index, probe = [], [], [], [], []
                for i, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    for k, line in _lines(t):
                        line = line.strip()
                        if len(line) < least:
                            continue
                        h = _hash(line)
                        new = h not in seen
                        if new:
                            if len(seen) > SEEN:
                                seen.clear()
                            seen.add(h)
                        ids.append(i)
                        numbers.append(k)
                        hs.append(h)
                        index.append([x[0] for x in _index_keys(line, 0, edits)] if new else [])
                        probe.append([x[0] for x in probe_keys(line, 0, edits, own=False)] if new else [])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(hs, pa.int64()), pa.array(index, pa.list_(pa.int64())), pa.array(probe, pa.list_(pa.int64()))], ["id", "line_no", "h", "index", "probe"])

    return docs.mapInArrow(run, "id long, line_no int, h long, index array<long>, probe array<long>")


def _texts(docs: DataFrame, least: int) -> DataFrame:
    """(h, line) of the distinct lines of each partition."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                hs, lines = [], []
                for t in batch.column(1).slice(lo, 512).to_pylist():
                    for _, line in _lines(t):
                        line = line.strip()
                        if len(line) >= least and (h := _hash(line)) not in seen:
                            if len(seen) > SEEN:
                                seen.clear()
                            seen.add(h)
                            hs.append(h)
                            lines.append(line)
                yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(lines, pa.string())], ["h", "line"])

    return docs.mapInArrow(run, "h long, line string")


def _split(members: DataFrame, edits) -> DataFrame:
    """The next keys of members (key, h, indexed, probing, rest, context, edits) of crowded buckets: of each, ``rest`` without the
    part that gave ``key``, in the roles that it has.  Their edits are those of the key, which is null at first."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                for key, h, indexed, probing, rest, context, own in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                    for role, give in ((True, _index_keys), (False, _probe_keys)):
                        if not (indexed if role else probing):
                            continue
                        found = {}
                        for k, a, b, e in give(rest, context, edits if own is None else own):
                            if k == key:
                                left = rest[:a] + rest[b:]
                                for k2, *_ in give(left, key, e):
                                    found[k2, left, e] = None
                        out += [(k2, h, role, not role, left, key, e) for k2, left, e in found]
                cols = list(zip(*out, strict=True)) or [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["key", "h", "indexed", "probing", "rest", "context", "edits"])

    return members.select("key", "h", "indexed", "probing", "rest", "context", "edits").mapInArrow(run, "key long, h long, indexed boolean, probing boolean, rest string, context long, edits int")


def _buckets(keyed: DataFrame) -> DataFrame:
    """Keys that an indexed line and another line have: key, places (rows), pairs (at most so many), least (characters
    of the shortest rest)."""
    rest = F.length("rest") if "rest" in keyed.columns else F.lit(None).cast("int")
    one = keyed.groupBy("key").agg(F.min(rest).alias("least"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.count(F.lit(1)).alias("places"), F.sum(F.col("indexed").cast("long")).alias("ni"))
    return one.filter("lo < hi and ni > 0").select("key", "places", (F.col("ni") * F.col("places")).alias("pairs"), "least")


def _pairs(members: DataFrame, counts: DataFrame, edits: int) -> DataFrame:
    """The pairs of each key's indexed lines with its other lines; pairs whose character counts (``counts``: h, hist)
    differ by more than ``edits`` either way are farther apart and are not made."""
    rows = members.select("key", "h", "indexed").distinct().join(counts.hint("merge"), "h")
    left = rows.filter("indexed").select("key", F.col("h").alias("x"), F.col("hist").alias("hist_x"))
    more = lambda a, b: sum((F.greatest(F.col(a)[i] - F.col(b)[i], F.lit(0)) for i in range(CLASSES)), F.lit(0))
    near = (F.col("x") != F.col("h")) & (more("hist", "hist_x") <= edits) & (more("hist_x", "hist") <= edits)
    both = left.join(rows.drop("indexed").hint("merge"), "key").filter(near)
    return both.select(F.least("x", "h").alias("a"), F.greatest("x", "h").alias("b")).distinct()


def _histograms(lines: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([histogram(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["h", "hist"])

    return lines.select("h", "line").mapInArrow(run, "h long, hist array<int>")


def _verified(pairs: DataFrame, lines: DataFrame, edits) -> DataFrame:
    def run(batches):
        for batch in batches:
            two = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ok = pa.array([bool(e := edits(min(len(a), len(b)))) and edit_distance(a, b, e) <= e for a, b in two], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    one = pairs.join(lines.select(F.col("h").alias("a"), F.col("line").alias("la")).hint("merge"), "a")
    two = one.join(lines.select(F.col("h").alias("b"), F.col("line").alias("lb")).hint("merge"), "b")
    return two.select("a", "b", "la", "lb").mapInArrow(run, "a long, b long")


def near_links(docs: DataFrame, places: DataFrame, edits: int, of, least: int) -> DataFrame:
    """The pairs (a, b) of hashes of all different lines within ``of(length of the shorter)`` edits, ``edits`` at most."""
    spark = docs.sparkSession
    keyed = places.select("h", F.explode("index").alias("key"), F.lit(True).alias("indexed")).unionByName(places.select("h", F.explode("probe").alias("key"), F.lit(False).alias("indexed")))
    total = places.agg(F.coalesce(F.sum(F.size("index") + F.size("probe")), F.lit(0))).first()[0]
    buckets = written(_buckets(keyed), "buckets")
    released(spark)
    members = joined_by_key(keyed, buckets, ["key"], "places", total)
    # an indexed line probes its own length too: its segments serve as those probes
    members = members.groupBy("key", "h").agg(F.max("indexed").alias("indexed"), F.max("pairs").alias("pairs")).withColumn("probing", F.lit(True))
    members = written(members, "members")
    released(spark)
    lines = _texts(docs, least).join(members.select("h").distinct().hint("merge"), "h").groupBy("h").agg(F.min("line").alias("line"))
    lines = written(lines, "lines")
    released(spark)
    counts = written(_histograms(lines), "counts")
    found = [written(_pairs(members.filter(F.col("pairs") <= BUCKET_PAIRS), counts, edits), "pairs")]
    crowd = members.filter(F.col("pairs") > BUCKET_PAIRS)
    crowd = written(crowd.join(lines.withColumnRenamed("line", "rest").hint("merge"), "h").withColumn("context", F.lit(0).cast("long")).withColumn("edits", F.lit(None).cast("int")), "crowd")
    while not crowd.isEmpty():
        finer = written(_split(crowd, of), "finer")
        buckets = written(_buckets(finer), "buckets")
        finer = joined_by_key(finer, buckets, ["key"], "places", finer.count())  # a bucket goes on or ends as a whole
        done = (F.col("pairs") <= BUCKET_PAIRS) | (F.col("least") <= edits)
        found.append(written(_pairs(finer.filter(done), counts, edits), "pairs"))
        crowd = written(finer.filter(~done), "crowd")
    pairs = found[0]
    for x in found[1:]:
        pairs = pairs.unionByName(x)
    links = written(_verified(pairs.distinct(), lines, of), "links")
    dropped(members, lines, counts, *found)
    released(spark)
    return links


def duplicate_lines(docs: DataFrame, text: str = "text", ident: str = "doc_id", edits: int = EDITS, shortest: int = SHORTEST, every: bool = False) -> DataFrame:
    """One row per line of at least ``shortest`` characters, without white space at its ends: id, line_no (from 0),
    n_links (different lines within ``edits`` edits), class_id and class_line_no (the first place, by id and line
    number, of the lines reachable over links and copies), kept (whether it is that place).

    With ``every``, lines under ``shortest`` that aren't blank take part too.  Two lines of which the shorter is under
    ``shortest`` are linked within fewer edits, in proportion to its length (by default one from 10 characters on and
    none below); exact copies of any length form classes.

    Null and empty texts have no such line; rows without id form classes, but come after all others; repeated rows of
    one id are one document, and both keep its lines.  Columns other than the two named are ignored.
    """
    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    least, of = (1 if every else shortest), functools.partial(allowed, edits=edits, shortest=shortest if every else 0)
    places = written(_occurrences(rows, of, least), "places")
    links = near_links(rows, places, edits, of, least)
    both = links.select(F.col("a").alias("h"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("h"), F.col("a").alias("to")))
    degree = both.groupBy("h").agg(F.count_distinct("to").alias("n_links"))
    comp = components(links).withColumnRenamed("node", "h").withColumnRenamed("component", "class")
    first: Column = F.min(F.struct(F.coalesce("id", F.lit(2**63 - 1)).alias("i"), "line_no", "id"))
    own = places.groupBy("h").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
    own = own.join(comp.hint("merge"), "h", "left").join(degree.hint("merge"), "h", "left").filter("copies > 1 or class is not null")
    own = written(own, "classes")
    heads = own.filter("class is not null").groupBy("class").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("lines"))
    heads = written(heads, "class-heads")
    linked = joined_by_key(own.filter("class is not null"), heads, ["class"], "lines", own.count())
    own = linked.unionByName(own.filter("class is null").withColumn("head", F.col("first")))
    own = own.select("h", "copies", "head", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    own = written(own, "heads")
    total = places.count()
    known = joined_by_key(places.select("id", "line_no", "h"), own, ["h"], "copies", total, how="left")
    known = known.select("id", "line_no", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("head")["id"]).alias("class_id"), F.coalesce(F.col("head")["line_no"], F.col("line_no")).alias("class_line_no"))
    return known.withColumn("kept", F.col("class_id").eqNullSafe(F.col("id")) & (F.col("class_line_no") == F.col("line_no")))


def without_duplicate_lines(docs: DataFrame, text: str = "text", ident: str = "doc_id", edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` without the lines of any length that ``duplicate_lines`` doesn't keep; documents that lose all their text go.

    Columns stay as they are, whatever their names; rows without id and rows with a null text stay whole.
    """
    gone = duplicate_lines(docs, text, ident, edits, shortest, every=True).filter(~F.col("kept") & F.col("id").isNotNull())
    gone = written(gone.groupBy("id").agg(F.collect_set("line_no").alias("lines")), "gone")
    released(docs.sparkSession)
    names = docs.columns
    at = names.index(text)

    def run(batches):
        for batch in batches:
            texts, stay = [], []
            for t, lines in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if lines:
                    out = set(lines)
                    t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in out)
                texts.append(t)
                stay.append(not lines or bool(t.strip()))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stay, pa.bool_()))

    key, drop = fresh(docs, "_id", "_lines")
    gone = gone.select(F.col("id").alias(key), F.col("lines").alias(drop))
    joined = docs.join(gone.hint("merge"), F.col(ident).cast("long") == F.col(key), "left").drop(key)
    return joined.mapInArrow(run, docs.schema)

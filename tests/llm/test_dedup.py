"""Near-dedup, line dedup and substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("arbora.llm")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from arbora.llm import line_dedup, minhash, substring_dedup  # noqa: E402
from arbora.llm.shared import components  # noqa: E402

from .cases import documents, prose, texts  # noqa: E402

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t):
    w = words((t or "").translate(LOW))
    return frozenset([tuple(w[j : j + 5]) for j in range(len(w) - 4)] or ([tuple(w)] if w else []))


class Forest:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def families(n=25, seed=5):
    """Groups of near copies around the threshold, of which some are linked only over others."""
    r = random.Random(seed)
    out, ident = [], 100
    for f in range(4):
        base = words(prose(150, 50 + f))
        for _ in range(n):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = f"x{r.randrange(9)}"
            out.append((ident, " ".join(w)))
            ident += 1
    return out


def test_near_duplicates(spark):
    rows = texts() + families() + [(900, "ONE two THREE"), (901, "Äb one two three four five"), (902, "äb one two three four five")]
    got = {(r.id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(documents(spark, rows)).collect() if r.id is not None}
    sets = {i: shingles(t) for i, t in rows if i is not None}
    forest = Forest(sets)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                forest.join(a, b)
    assert got == {(i, len(s)): (forest.find(i), forest.find(i) == i) for i, s in sets.items()}
    out = minhash.near_duplicates(documents(spark, rows))
    assert out.count() == len(rows) and out.filter("id is null and component_id is null and kept").count() == 2


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    assert minhash.near_duplicates(documents(spark, [(1, None), (2, "")])).filter("kept and component_id = id").count() == 2


def test_sketch_coordinates_fill_and_agree_like_jaccard():
    import numpy as np

    rng = np.random.default_rng(1)
    hits = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 80).astype(np.uint64)
        b = np.concatenate((a[:60], rng.integers(0, 2**63, 20).astype(np.uint64)))
        s = minhash.sketches(np.repeat([0, 1, 2], [80, 80, 1]), np.concatenate((a, b, a[:1])), 3, 125)
        assert (s != np.uint64(2**64 - 1)).all()
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - 0.6) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(70)] + [(200, 300), (300, 250), (5, 5), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(71)}, 200: 200, 250: 200, 300: 200}


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(1, 4))
def test_edit_distance_and_segments(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    assert line_dedup.edit_distance(a, b, most) == min(row[-1], most + 1)
    short, long_ = sorted((a, b), key=len)
    if row[-1] <= most < len(short):
        assert {k[0] for k in line_dedup.index_keys(short, 0, most)} & {k[0] for k in line_dedup.probe_keys(long_, 0, most)}


def line_cases():
    r = random.Random(8)
    base = [prose(12, 300 + i).replace("\n", " ") for i in range(25)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(6):
            x = list(r.choice(base))
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(x))
                x[k : k + r.randint(0, 1)] = r.choice("abcé")
            lines.append(" " * r.randint(0, 2) + "".join(x))
        rows.append((500 + d, "\n".join([*lines, "short", ""])))
    return rows


@pytest.mark.parametrize("pairs", [65_536, 4])
def test_duplicate_lines(spark, monkeypatch, pairs):
    monkeypatch.setattr(line_dedup, "BUCKET_PAIRS", pairs)
    rows = line_cases() + [t for t in texts() if t[0] not in (7, None)]
    places = defaultdict(list)
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if len(x.strip()) >= 20:
                places[x.strip()].append((i, k))
    forest, degree = Forest(places), Counter()
    for a in places:
        for b in places:
            if a < b and abs(len(a) - len(b)) <= 2 and line_dedup.edit_distance(a, b, 2) <= 2:
                forest.join(a, b)
                degree[a] += 1
                degree[b] += 1
    head = {}
    for x, p in places.items():
        f = forest.find(x)
        head[f] = min(head.get(f, p[0]), min(p))
    want = {p: (head[forest.find(x)], degree[x], head[forest.find(x)] == p) for x, ps in places.items() for p in ps}
    got = {(r.id, r.line_no): ((r.class_id, r.class_line_no), r.n_links, r.kept) for r in line_dedup.duplicate_lines(documents(spark, rows)).collect()}
    assert sum(degree.values()) > 50 and got == want


@pytest.mark.parametrize("pairs", [4])
def test_lines_of_every_length(spark, monkeypatch, pairs):
    monkeypatch.setattr(line_dedup, "BUCKET_PAIRS", pairs)
    r, base = random.Random(9), [prose(3, 600 + i)[: 7 + i].strip() for i in range(18)]
    rows = []
    for d in range(30):
        lines = []
        for _ in range(6):
            x = list(r.choice(base))
            for _ in range(r.randint(0, 2)):
                k = r.randrange(len(x))
                x[k : k + r.randint(0, 1)] = r.choice("ab")
            lines.append("".join(x))
        rows.append((500 + d, "\n".join([*lines, "Les.", "x", " "])))
    places = defaultdict(list)
    for i, t in rows:
        for k, x in enumerate(t.split("\n")):
            if x.strip():
                places[x.strip()].append((i, k))
    forest, degree = Forest(places), Counter()
    for a in places:
        for b in places:
            e = min(2, min(len(a), len(b)) // 10)
            if a < b and e and line_dedup.edit_distance(a, b, e) <= e:
                forest.join(a, b)
                degree[a] += 1
                degree[b] += 1
    head = {}
    for x, p in places.items():
        f = forest.find(x)
        head[f] = min(head.get(f, p[0]), min(p))
    want = {p: (head[forest.find(x)], degree[x], head[forest.find(x)] == p) for x, ps in places.items() for p in ps}
    got = {(r.id, r.line_no): ((r.class_id, r.class_line_no), r.n_links, r.kept) for r in line_dedup.duplicate_lines(documents(spark, rows), every=True).collect()}
    assert sum(degree.values()) > 50 and got == want


def test_documents_without_duplicate_lines(spark):
    long_ = "this line is long enough to take part"
    rows = [(1, f"{long_}\nand another line that stays here"), (2, f"{long_}\nmine is a line of its own, too"), (3, long_ + "s"), (4, None), (5, ""), (None, long_)]
    docs = documents(spark, rows)
    got = {r.doc_id: r.text for r in line_dedup.without_duplicate_lines(docs).collect()}
    assert got == {1: rows[0][1], 2: "mine is a line of its own, too", 4: None, 5: "", None: long_}
    assert line_dedup.without_duplicate_lines(docs).columns == docs.columns
    assert line_dedup.duplicate_lines(documents(spark, [])).count() == 0


def brute_repeats(rows, n=35):
    count = Counter(tuple(w[j : j + n]) for _, t in rows for w in [words(t)] for j in range(len(w) - n + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if count[tuple(w[j : j + n])] > 1:
                gone[j : j + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_substring_repeats(spark):
    inner = prose(200, 77)
    rows = texts() + [(20, inner + " " + prose(3, 78) + " " + inner[: len(inner) // 2]), (21, "w " * 40), (22, "w " * 34), (23, "only here " + " ".join(words(inner)[20:55]))]
    got = sorted((r.id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(documents(spark, rows)).collect())
    want = brute_repeats(rows)
    assert got == sorted((x[0] or -1, *x[1:4]) for x in want)
    cut = {r.doc_id: " ".join(words(r.text)) for r in substring_dedup.cut_repeats(documents(spark, rows)).collect() if r.doc_id is not None}
    assert cut == {x[0]: x[4] for x in want if x[0] is not None and (x[4] or not x[2])}


def test_substring_repeats_of_nothing(spark):
    assert substring_dedup.remove_repeats(documents(spark, [])).count() == 0

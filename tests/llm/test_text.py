"""Packing, toxicity, quality rules and SentencePiece against the public libraries and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("arbora.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")
import numpy as np  # noqa: E402
import xxhash  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from arbora.llm import packing, quality_rules, sentencepiece_codec, toxicity  # noqa: E402

from .cases import documents, prose, texts  # noqa: E402

BPE, PIECES, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
DATA = "/root/testdata/sf0.01"
ODD = ["a", "b", " ", "  ", "▁", "é", "日", "本", "\n", "\t", "😀", "the", "ing", "1", "​", "<s>", "<0x41>", "﷽", "\x00", ".", " ", "²", "a,b", "x²y", "'s", "<|endoftext|>", "\r\n", "a" * 60, "the" * 30, "('", "|"]


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 12))) for _ in range(n)]


# packing


def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    own = packing.Tokenizer(BPE, PATTERN)
    named = ["<|endoftext|>", "a <|endoftext|>b", "x<|endoftext|><|endoftext|> y\n", " <|endoftext| > <|endoftext|>"]
    for t in odd_texts(1500) + named + [t for _, t in texts() if t]:
        assert own.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def brute_cost(x, w, limit, short):
    f = [0.0] + [math.inf] * (len(x) - 1)
    for j in range(1, len(x)):
        for i in range(j):
            n = x[j] - x[i]
            if n <= limit:
                f[j] = min(f[j], f[i] + w[j] + (limit - n))
                if n in short:
                    f[j] = min(f[j], f[i] + w[j] + packing.SHORT_COST)
    return f[-1]


def test_cuts_are_optimal():
    r = random.Random(3)
    for _ in range(200):
        x = [0]
        while len(x) < 40:
            x.append(x[-1] + r.randint(1, 12))
        w = [0] + [r.choice([0, 2, 16]) for _ in x[1:]]
        cuts = packing.best_cuts(np.array(x), np.array(w), 64, (8, 16, 32))
        cost = 0
        for a, b in zip(cuts, cuts[1:]):
            n = b - a
            assert 0 < n <= 64
            cost += w[x.index(b)] + (min(64 - n, packing.SHORT_COST) if n in (8, 16, 32) else 64 - n)
        assert cost == brute_cost(x, w, 64, {8, 16, 32})


@pytest.mark.parametrize("block", [1_000_000, 3_000])
def test_pieces_tile_documents_and_sequences(spark, monkeypatch, block):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BLOCK", block)
    lib = Tokenizer.from_file(BPE)
    rows = [(i if i is not None else -1, t) for i, t in texts() if i != 7] + [(40 + i, prose(300, i)) for i in range(30)]
    out = packing.pack(documents(spark, rows), BPE, PATTERN).toPandas()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*lib.encode(t or "", add_special_tokens=False).ids, 0])
    for i, want in ids.items():
        want = want[0] if i != -1 else None
        if want is None:
            continue
        mine = out[out["id"] == i].sort_values("start")
        at = 0
        for p in mine.itertuples():
            assert p.start == at and p.doc_tokens == len(want)
            assert p.ids_crc32 == zlib.crc32(np.array(want[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(want)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() == s["sequence_tokens"].iloc[0] <= 1024
        n = s["length"].sum()
        assert s["sequence_padded"].iloc[0] == (n if n & (n - 1) == 0 else 1024)
    assert packing.pack(documents(spark, []), BPE, PATTERN).count() == 0


def test_padding_is_little(spark):
    out = packing.pack(spark.read.parquet(f"{DATA}/documents.parquet").coalesce(1), BPE, PATTERN)
    s = out.groupBy("sequence_id").agg(F.max("sequence_padded").alias("p"), F.sum("length").alias("n")).agg(F.sum("p"), F.sum("n")).first()
    assert s[0] / s[1] < 1.015


# SentencePiece


def test_encoding_is_the_librarys():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec = sentencepiece_codec.Codec(PIECES)
    for t in odd_texts(3000, 2) + [t for _, t in texts() if t]:
        ids = lib.encode(t)
        assert codec.encode(t) == ids
        assert codec.decode(ids) == lib.decode(ids)
        n, a, b, where, end = codec.digest(t)
        assert (n, a) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert b == hashlib.sha256(lib.decode(ids).encode()).hexdigest() and end == len(t.encode())
        spans = codec.encode_spans(t)
        assert [s[0] for s in spans] == ids
        assert where == sentencepiece_codec.span_digest([s[1:] for s in spans])
        at = 0
        for _, a, b in spans:
            assert a <= b and a <= at
            at = max(at, b)
        assert at == len(t.encode())


def test_longest_prefix_normalisation_keeps_offsets():
    # a hand-made double array: "a" -> "x", "ab" -> "yz", with the offset rule of the format
    units = [0] * 512

    def put(at, label, offset, leaf):
        units[at] = (offset << 10) | (256 if leaf else 0) | label

    units[0] = 1 << 10  # root: children at 1 ^ label
    a = 1 ^ ord("a")
    put(a, ord("a"), 128, True)
    ab = (a ^ 128) ^ ord("b")
    put(ab, ord("b"), 3, True)
    units[a ^ 128] = (1 << 31) | 0
    units[ab ^ 3] = (1 << 31) | 2
    blob = (4 * len(units)).to_bytes(4, "little") + b"".join(u.to_bytes(4, "little") for u in units) + b"x\0yz\0"
    m = sentencepiece_codec.CharsMap(blob)
    assert m.longest(b"abc", 0) == (2, b"yz") and m.longest(b"ac", 0) == (1, b"x") and m.longest(b"cab", 0) is None
    codec = sentencepiece_codec.Codec(PIECES)
    codec.map, codec.plain, codec.trim = m, False, True
    assert codec.normalised("  ab  éa ") == ("▁yz▁éx", [(2, 2), (2, 4), (2, 4), (4, 5), (6, 8), (8, 9)])


def test_encoded_documents(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [t for t in texts() if t[0] is not None]
    for r in sentencepiece_codec.encode_documents(documents(spark, rows), PIECES).collect():
        t = next(t for i, t in rows if i == r.id) or ""
        assert list(r.ids) == lib.encode(t) and r.decoded == lib.decode(list(r.ids)) and len(r.begins) == len(r.ends) == len(r.ids)
    codec = sentencepiece_codec.Codec(PIECES)
    table = [*rows, (7001, "▁ a▁▁ b"), (7002, " \U0001f600\U0001f600▁"), (7003, "")]
    for r in sentencepiece_codec.encode_digests(documents(spark, table), PIECES).collect():
        t = next(t for i, t in table if i == r.id) or ""
        spans = codec.encode_spans(t)
        assert r.spans_sha256 == sentencepiece_codec.span_digest([s[1:] for s in spans]) and r.n_tokens == len(spans) and r.n_bytes == len(t.encode())
    assert sentencepiece_codec.encode_digests(documents(spark), PIECES).count() == len(texts())
    assert sentencepiece_codec.encode_digests(documents(spark, []), PIECES).count() == 0


# toxicity


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    return toxicity.Model(*toxicity.fit(docs, labels))


@pytest.mark.parametrize("text, word", [("an 1d10t", "idiot"), ("s t u p i d one", "stupid"), ("st.up.id", "stupid"), ("stuuuupid", "stupid"), ("l0s3r", "loser"), ("path3t!c", "pathetic"), ("$cum", "scum"), ("tr@$h", "trash"), ("ＩＤＩＯＴ", "idiot"), ("cl*wn", "clown"), ("m.0.r.0.n", "moron")])
def test_restoring(model, text, word):
    folded = toxicity.folded(text)
    assert word in {w for s in toxicity.stretches(folded) | {folded} for w in model.decoder.read(s).split()} | set(folded.split())


@pytest.mark.parametrize("text, word", [("st" + "u" * 50 + "pid", "stupid"), ("you are a i d i o t", "idiot"), ("y o u i d i o t", "idiot"), ("you.are.a.very.very.very.very.silly.person.st.up.id", "stupid"), ("it's " + "a b c d e f g h i j k l m " * 2 + "s t u p i d", "stupid"), ("cl#wn", "clown"), ("cl%wn", "clown"), ("x" * 3 + "." + "so.much.of.this.is.here.and.then.comes.an.1d10t", "idiot")])
def test_restoring_long_spaced_and_masked(model, text, word):
    assert word in toxicity.features(text, model.decoder, {"idiot", "stupid", "clown", "person"})
    assert word not in re.findall(r"\w+", text)


def test_plain_words_are_no_stretches():
    assert toxicity.stretches(toxicity.folded("The better book, well: it's 1984 or 3.5 at all!")) <= {"it's"}


def test_reading_is_the_cheapest_path(model):
    import itertools

    d = model.decoder
    n = toxicity.N_SYMBOLS

    def cost(text):
        a = b = 0
        total = 0.0
        for c in text:
            z = toxicity._CODE.get(c, 1)
            total += d.costs[(a * n + b) * n + z]
            a, b = b, z
        return total + d.costs[(a * n + b) * n]

    for s in ("1d10t", "h3l1", "caaat", "a-b0"):
        best = min((sum(w[1] for w in ways) + cost("".join(w[0] for w in ways)), "".join(w[0] for w in ways)) for ways in itertools.product(*d.lattice(s)))
        assert cost(d.read(s)) <= best[0] + 1e-9 and d.read(s) == best[1]


def test_held_out_accuracy_and_edges(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = toxicity.toxicity(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), "id")
    r = out.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.count_if("held_out")).first()
    assert r[0] > 0.95 and r[1] > 20
    edges = toxicity.toxicity(documents(spark), spark.createDataFrame([(1, 1), (6, 0), (None, 1), (8, None)], "doc_id long, toxic int"))
    assert edges.count() == len(texts()) and edges.filter("score is null or score < 0 or score > 1 or held_out is null").count() == 0
    none = toxicity.toxicity(documents(spark, []), labels.limit(0))
    assert none.count() == 0
    assert toxicity.toxicity(documents(spark), labels.limit(0)).filter("predicted = 1").count() == 0


# quality rules


def brute_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    count = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    hit = [False] * len(w)
    for j in range(len(w) - 4):
        if count[tuple(w[j : j + 5])] > 1:
            hit[j : j + 5] = [True] * 5
    seen, again = set(), 0
    for x in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            again += x in seen
            seen.add(x)
    n = sum(hit)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), again, n, len(w) < 10 or 100 * n > 20 * len(w)


def buckets(t):
    h = lambda b, seed=42: xxhash.xxh64_intdigest(b, seed=seed)
    out = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""):
        out.append(h(w.encode()) % quality_rules.BUCKETS)
        first = h(w[-3:].encode())
        out.append(h((3).to_bytes(4, "little"), first) % quality_rules.BUCKETS)
    return out


def test_rules_and_ratios(spark):
    rows = [t for t in texts() if t[0] not in (7, None)] + [(60 + i, prose(60, i) + " #% | a|b") for i in range(5)] + [(70, "same line of words\n" * 4), (71, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 x y")]
    trusted = {1, 6, 60, 61}
    labels = spark.createDataFrame([(i,) for i in (*trusted, 61, None, 999)], "doc_id long")
    got = {r.id: r for r in quality_rules.quality_rules(documents(spark, rows), labels).collect()}
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(buckets(t))
        if i in trusted:
            target.update(buckets(t))
    base = math.log((raw.total() + quality_rules.BUCKETS) / (target.total() + quality_rules.BUCKETS))
    for i, t in rows:
        r, b = got[i], buckets(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(t)
        if b:
            llr = sum(math.log((target[k] + 1) / (raw[k] + 1)) + base for k in b) / len(b)
            assert abs(r.llr - llr) < 1e-5
            assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
        else:
            assert r.llr is None and not r.kept
    assert quality_rules.quality_rules(documents(spark), labels.limit(0)).filter("llr <> 0").count() == 0
    assert quality_rules.quality_rules(documents(spark, []), labels).count() == 0


def test_ratios_count_every_trusted_document(spark):
    docs = spark.range(20_500).selectExpr("id AS doc_id", "concat('w', id) AS text")
    for threshold in ("10MB", "-1"):  # ids broadcast, and both sides shuffled
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            assert set(quality_rules.log_ratios(docs, docs, "text", "doc_id")) == {0}
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled_bytes(spark, run, group):
    """What ``run`` returns, and the bytes that its jobs wrote to shuffles."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    assert stages
    return out, sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)


def test_many_trusted_ids_move_no_text(spark, monkeypatch):
    # the ids take more than the threshold; a text is one long word, so counts are small
    n = 20_480
    docs = spark.range(n).selectExpr("id AS doc_id", "concat(%s) AS text" % ", ".join(f"sha2(string(id * 16 + {k}), 256)" for k in range(16)))
    size = n * 16 * 64
    ratios = lambda: quality_rules.log_ratios(docs, docs.select("doc_id").filter("doc_id % 3 = 0"), "text", "doc_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in ("100KB", "1KB"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            few, moved = shuffled_bytes(spark, ratios, f"op4-{threshold}")
            assert moved < size / 8
        monkeypatch.setattr(quality_rules, "BLOCKS", n // 64 - 1)  # one block too many: both sides are shuffled
        many, moved = shuffled_bytes(spark, ratios, "op4-many")
        assert moved > size / 2 and many == few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("most", [quality_rules.BLOCKS, 0])
def test_trusted_ids_at_the_edges_of_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(quality_rules, "BLOCKS", most)
    edge = [0, 1, 62, 63, 64, 65, 127, 128, 1 << 31, (1 << 32) + 31, (1 << 63) - 1]
    ids = [*edge, *(-i - 1 for i in edge)]
    docs = spark.createDataFrame([(i, f"w{i}") for i in ids] + [(None, "null")], "doc_id long, text string")
    for k in range(3):
        trusted = ids[k::3]
        labels = spark.createDataFrame([(i,) for i in (*trusted, *trusted, None, 7)], "doc_id long")
        raw, target = Counter(buckets("null")), Counter()
        for i in ids:
            raw.update(buckets(f"w{i}"))
            target.update(buckets(f"w{i}") if i in trusted else ())
        base = math.log((raw.total() + quality_rules.BUCKETS) / (target.total() + quality_rules.BUCKETS))
        want = [round((math.log((target[b] + 1) / (raw[b] + 1)) + base) * quality_rules.UNIT) for b in range(quality_rules.BUCKETS)]
        assert quality_rules.log_ratios(docs, labels, "text", "doc_id") == want


def test_rules_run_no_python(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    plan = quality_rules.quality_rules(docs, labels.filter("quality = 1"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)

"""Vector search, archives, page extraction and the pipeline."""

import hashlib
import io
import struct

import numpy as np
import pytest

pytest.importorskip("arbora.llm")
import zstandard  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from arbora.llm import ann, html_extract, warc  # noqa: E402

from .cases import EXTRA, prose  # noqa: E402

# vector search


def test_factor_one_is_exact():
    rng = np.random.default_rng(0)
    p = rng.normal(size=(3000, 12)) + 4 * rng.integers(0, 3, (3000, 1))
    q = rng.normal(size=(40, 12)) + 4 * rng.integers(0, 3, (40, 1))
    tree = ann.VPTree(p, leaf=32)
    d, rows, work = tree.search(q, 10, 1.0)
    want = np.sort(np.linalg.norm(q[:, None] - p[None], axis=2), axis=1)[:, :10]
    np.testing.assert_allclose(d, want, atol=1e-6)
    assert work < len(p) * len(q)
    assert tree.search(q, 10, 8.0)[2] < work


def vectors(spark, rows):
    fields = ", ".join(["vec_id long", "embedding array<float>", *[f"{c} string" for c in EXTRA]])
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], *["x"] * len(EXTRA)) for i, v in rows], fields)


def brute(rows, queries, k):
    out = []
    good = [(i, np.float32(v).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    for q, v in dict(good).items():
        if q in queries:
            near = sorted((-float(np.dot(v, w)), i) for i, w in dict(good).items() if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(near)]
    return sorted(out)


def test_neighbours_with_edges_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5)) for i in range(300)]
    rows += [(i, rows[20][1]) for i in range(300, 340)]
    rows += [(400, None), (401, [0.0] * 5), (402, [1, None, 2, 3, 4]), (403, [float("nan")] * 5), (404, [float("inf"), 1, 1, 1, 1]), (None, rows[0][1]), (405, [1.0, 2.0]), (20, rows[20][1])]
    queries = {i for i, _ in rows if i is not None and i % 20 == 0} | {405}
    table = vectors(spark, rows)
    out = ann.nearest(table, table.filter(F.col("vec_id").isin(list(queries))), factor=1.0)
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in out.collect())
    assert got == brute(rows, queries, 20)
    few = vectors(spark, rows[:4])
    assert ann.nearest(few, few.filter("vec_id = 0")).count() == 3
    assert ann.nearest(few.limit(0), few).count() == 0 and ann.nearest(few, few.limit(0)).count() == 0


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = rows.filter("vec_id % 20 = 0")
    one = {(r.query_id, r.vec_id) for r in ann.nearest(rows, asked).collect()}
    all_ = {(r.query_id, r.vec_id) for r in ann.nearest(rows, asked, factor=1.0).collect()}
    assert len(one & all_) / len(all_) >= 0.95


# archives


def pages(spark, rows):
    fields = ", ".join(["page_id long", "url string", "html string", *[f"{c} string" for c in EXTRA]])
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], fields).repartition(3)


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    big, bigger = "ä" + prose(300, 1), prose(400, 2) + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"
    rows = [(i, f"http://h.example/{i}\n?x", prose(40, i)) for i in range(60)] + [(100, None, None), (101, "u", ""), (110, "u", big), (112, "u", big), (111, "u", big), (113, "u", "small"), (114, "u", "small"), (115, "u", bigger), (115, "u", bigger), (None, "u", big), (116, "u", "x" * 1000), (117, "u", "x" * 1000), (118, "u", "y" * 999), (119, "u", "y" * 999)]
    folder = "file://" + str(tmp_path)
    manifest = warc.write_archives(pages(spark, rows), folder)
    out = warc.read_archives(manifest, folder).toPandas()
    assert manifest.count() > 1 and len(out) == len(rows)
    for i, u, h in rows:
        data = (h or "").encode()
        last = max((j for j, _, g in rows if g == h and j is not None), default=None)
        revisit = len(data) >= 1000 and i != last
        mine = out[out["id"].isna() if i is None else out["id"] == i]
        for r in mine.itertuples():
            assert (r.payload_bytes, r.payload_digest, r.record_type) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response")
            assert (r.refers_to == last) if revisit else r.refers_to != r.refers_to
            assert revisit or r.payload == (h or "")
    assert warc.read_archives(warc.write_archives(pages(spark, []), folder), folder).count() == 0


def test_archive_form_and_damage(tmp_path):
    w = warc.ArchiveWriter(str(tmp_path))
    records = [warc.record_bytes(i, "u", prose(60, i).encode(), hashlib.sha1(prose(60, i).encode()).hexdigest(), None) for i in range(50)]
    for r in records:
        w.add(r)
    w.close()
    data = open(w.manifest[0][0], "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and size > 0
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    first = d.decompressobj().decompress(data[8 + size :])
    assert first == records[0]
    assert len(list(warc.read_records(io.BytesIO(data)))) == 50
    assert len(list(warc.read_records(io.BytesIO(data[:-20])))) == 49  # read_archives holds this against the manifest
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(b"x" * 20)))


# pages


def layouts():
    rows = []
    for i in range(30):
        body = "".join(f"<p>{prose(25, 1000 + 10 * i + k)}</p>" for k in range(i % 4 + 1))
        text = "\n".join(" ".join(prose(25, 1000 + 10 * i + k).split()) for k in range(i % 4 + 1))
        if i % 3 == 0:
            html = f'<html><head><title>t</title><style>p{{}}</style></head><body><div class="top-menu"><a href="/">Home</a></div><div class="cookie-notice">We use cookies {i}</div><div class="content">{body}</div><div class="sidebar"><p>{prose(30, i)}</p></div><div id="comments"><p>first! {prose(20, i + 500)}</p></div><footer>&copy; us</footer></body></html>'
            host = "div.example"
        elif i % 3 == 1:
            html = f"<html><body><header><h1>Site</h1><nav><ul><li>A<li>B</ul></nav></header><main><article><h1>Title {i}</h1>{body}<form><p>Name</p><input></form><script>var x='</p><p>no';</script></article></main><aside>{prose(15, i)}</aside></body>"
            text, host = f"Title {i}\n{text}", "main.example"
        else:
            html = f"<body><table><tr><td class=nav><a href=a>x</a></td><td class=text>{body}</td></tr></table></body>"
            host = "table.example"
        rows.append((i, f"http://user@{host.upper()}:80/p{i}", html, text))
    return rows


def test_layouts(spark):
    rows = layouts()
    got = {r.id: r for r in html_extract.extract(pages(spark, [r[:3] for r in rows])).collect()}
    for i, url, _, text in rows:
        assert got[i].text == text and got[i].n_chars == len(text) and got[i].url == url


def test_page_edges(spark):
    rows = [(1, None, None), (2, "not a url", ""), (3, "http://one.example", "<p>a &amp; b&nbsp;\n c<br>d <b>e</b>f<p>g<li>h"), (3, "http://one.example", "<p>a</p>"), (None, "http://x.example", "plain <!-- no --> text"), (5, "http://y.example", "<article>" + "<p>" + "w " * 50_000 + "</article>"), (6, "http://z.example", "<script>never closed <p>x"), (7, "http://z.example", '<div title="a > b">ok</div>')]
    got = {}
    for r in html_extract.extract(pages(spark, rows)).collect():
        got.setdefault(r.id, set()).add(r.text)
    assert got == {1: {""}, 2: {""}, 3: {"a & b c d ef\ng\nh", "a"}, None: {"plain text"}, 5: {("w " * 50_000).strip()}, 6: {""}, 7: {"ok"}}
    assert html_extract.extract(pages(spark, [])).count() == 0


def test_fixed_text_of_a_host_goes_but_repeats_in_articles_stay(spark):
    rows = [(i, "http://h.example/", f"<body><div><p>Always the same words here</p><p>{prose(30, i)}</p><p>{'Common' if i % 3 else prose(5, i)}</p></div></body>") for i in range(24)]
    got = {r.id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    for i in range(24):
        assert got[i].split("\n") == [" ".join(prose(30, i).split()), "Common" if i % 3 else " ".join(prose(5, i).split())]


# pipeline


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from .test_dedup import brute_repeats, shingles

    sf = "/root/testdata/sf0.01"
    extra = ["score", "_id", "_lines", "_row", "_group", "_h", "_th", "_text", "_gone", "id"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit(c) for c in extra})
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == set(before)
            break
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.select(*extra).distinct().collect()} == {tuple(extra)}
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before)
        gone = set(before) - set(after)
        if name == "toxicity":
            assert all(after[i] == before[i] for i in after) and not any(labels.get(i) == 0 for i in gone)
            assert sum(labels.get(i) == 1 for i in gone) > 0
        elif name == "minhash":
            sets = {i: shingles(t) for i, t in before.items()}
            for i in gone:
                assert any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets if j != i)
            left = sorted(after)
            for a in left:
                for b in left:
                    assert a >= b or not sets[a] or 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b])
        elif name == "substring_dedup":
            want = {x[0]: x[4] for x in brute_repeats(list(before.items())) if x[4] or not x[2]}
            assert {i: " ".join(t.encode().decode().split()) for i, t in after.items()} == {i: " ".join(t.split()) for i, t in want.items()}
        docs = out


def test_pipeline_keeps_one_of_repeated_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    one, two, three = (prose(80, 900 + k) for k in range(3))
    rows = [(1, one), (1, one), (2, two), (None, three), (None, three), (None, two), (3, None), (3, None), (4, ""), (None, None), (None, " "), (1, prose(80, 910)), (5, prose(80, 911))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(0).cast("long")).repartition(3)
    near = pipeline.minhash(spark, docs, "")
    assert near.columns == docs.columns
    near.write.parquet(str(tmp_path / "near"))
    near = spark.read.parquet(str(tmp_path / "near"))
    key = lambda x: (x[0] or 0, x[1] or "")
    want = [(1, one), (1, prose(80, 910)), (2, two), (3, None), (4, ""), (5, prose(80, 911)), (None, three)]
    got = sorted(((r.doc_id, r.text) for r in near.collect()), key=key)
    assert [x for x in got if x[0] is not None or x[1] and x[1].strip()] == sorted(want, key=key)
    assert len(got) == len(want) + 1  # the rows with neither id nor words
    cut = pipeline.substring_dedup(spark, near, "")
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=key) == got


def test_pipeline_removes_just_what_is_near_another(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from .test_dedup import Forest, families, shingles

    base = prose(204, 950).split()
    between = [(800, " ".join(base)), (802, " ".join([*base[:8], "v", *base[9:60], "x", *base[61:120], "y", *base[121:180], "z", *base[181:]]))]
    rows = families() + between
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: shingles(t) for i, t in rows}
    forest = Forest(sets)
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                forest.join(a, b)
    assert 80 <= 100 * len(sets[800] & sets[802]) / len(sets[800] | sets[802]) < 85
    assert {r.doc_id for r in pipeline.minhash(spark, docs, "").collect()} == {i for i in sets if forest.find(i) == i}


def test_all_varying_text_of_every_layout_stays(spark):
    line = lambda n, k: " ".join(prose(n, k).split())
    rows, want = [], {}
    for i in range(24):
        head, lead, body = line(4, 2000 + i), line(12, 2100 + i), line(60, 2200 + i)
        if i % 3:
            page = f"<body><article><h1>{head}</h1><div class=lead><p>{lead}</p></div><div class=body><p>{body}</p></div></article><p>Always the same</p></body>"
        else:
            page = f"<body><div class=text><p>{head}</p><p>{lead}</p><p>{body}</p></div><div class=body><p>Only in this layout</p></div><p>Always the same</p></body>"
        rows.append((i, f"http://two.example/{i}", page))
        want[i] = f"{head}\n{lead}\n{body}"
    got = {r.id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    assert got == want


def test_copies_of_a_page_count_once(spark):
    page = f"<body><div><h1>{prose(3, 3000).strip()}</h1><p>{prose(30, 3001)}</p></div></body>"
    for n in (9, 10, 24):
        rows = [(i, f"http://copies.example/{i % 20}", page) for i in range(n)]
        got = {r.text for r in html_extract.extract(pages(spark, rows)).collect()}
        assert got == {prose(3, 3000).strip() + "\n" + " ".join(prose(30, 3001).split())}
    # boilerplate of a smaller host goes; a page of boilerplate alone keeps it
    rows = [(i, "http://small.example/", f"<body><div><p>Always the same</p>{f'<p>{prose(20, 3100 + i)}</p>' if i else ''}</div></body>") for i in range(7)]
    got = {r.id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    assert got == {0: "Always the same", **{i: " ".join(prose(20, 3100 + i).split()) for i in range(1, 7)}}


def test_template_is_of_valid_classes_nested_by_position(spark):
    # a text as frequent as an optional element is its template only inside it; small classes are none
    rows = []
    for i in range(20):
        box = "<table class=box><tr><td>Box of the host</td></tr></table>" if i < 8 else ""
        rows.append((i, "http://nest.example/", f"<body><div><p>{prose(20, 4000 + i)}</p>{'<p>Said in eight articles</p>' if i < 8 else ''}{box}</div></body>"))
    got = {r.id: r.text.split("\n")[1:] for r in html_extract.extract(pages(spark, rows)).collect()}
    assert got == {i: ["Said in eight articles"] if i < 8 else [] for i in range(20)}
    bare = [(i, "http://bare.example/", f"<p>Same{'' if i else ' not'}</p>") for i in range(9)]
    assert {r.text for r in html_extract.extract(pages(spark, bare)).collect()} == {"Same", "Same not"}

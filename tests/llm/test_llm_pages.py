import hashlib
import random

import numpy as np
import pytest

from corpuswright.llm import boosting, dom, warc
from corpuswright.llm import html_extraction as H
from corpuswright.llm.common import table

TEXT = "This is the story, told in a few words. " * 8


@pytest.fixture(scope="module")
def model():
    return H.fit()


def test_made_pages_held_out(model):
    maker = H._Maker(991)
    right = total = 0
    for _ in range(150):
        page = maker.page()
        nodes, runs = dom.read(page)
        right += H.extract([page], model)[0] == " ".join(t for i, t in runs if nodes[i].main)
        total += 1
    assert right / total >= 0.9


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("", ""),
        ("<p>", ""),
        (f"<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>{TEXT}<p>b<br>c</article><footer>&copy; x</footer>", f"T & U {TEXT.strip()} b c"),
        (f"<body><div class='sidebar'><p>{TEXT}</p></div><div id=content><p>{TEXT}&lt;b&gt;</p><form>Name<input><button>Go</button></form></div><div class=comments><p>{TEXT}</p></div>", f"{TEXT.strip()} <b>".replace(". <b>", ". <b>")),
        (f"<article><script>var a='<p>no</p>'</script><!-- <p>no</p> --><p>{TEXT}", TEXT.strip()),
        (f"<article><p>{TEXT}</p><style>p{{}}", TEXT.strip()),
    ],
)
def test_pages(model, page, wanted):
    assert H.extract([page], model)[0] == wanted


def test_hostile_pages_end(model):
    pages = ["<" * 20_000, '<a "' * 20_000, "<div>" * 5_000 + "x", "&" * 20_000, "<!--" * 5_000, "<script" * 5_000, "<p>" * 20_000]
    assert len(H.extract(pages, model)) == len(pages)


def test_decoding_keeps_a_family_together():
    nodes, _ = dom.read("<article><p>a</p><p>b</p><p>c</p></article>")
    assert H.decode(nodes, [3.0, 3.0, 2.0, -0.5, 2.0])[1:] == [True] * 4
    assert H.decode(nodes, [0.0, 3.0, 2.0, -6.0, 2.0])[2:] == [True, False, True]


def test_pages_table(spark):
    rows = [(1, "u", f"<article><p>{TEXT}</p></article>", "x"), (2, None, None, "y"), (None, "v", "", "z"), (1, "u", f"<article><p>{TEXT}</p></article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = H.main_text(df).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in found) == sorted([("1", TEXT.strip(), len(TEXT) - 1)] * 2 + [("2", "", 0), ("None", "", 0)])
    assert H.main_text(df.limit(0)).count() == 0


def test_boosting_learns_and_agrees_with_its_sql(spark):
    r = np.random.default_rng(0)
    x = r.integers(0, 10, (600, 3)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 6)).astype(float)
    trees = boosting.calibrate(boosting.fit(x[:400], y[:400], ["a", "b", "c"]), x[400:], y[400:])
    assert ((trees.margins(x[400:]) > 0) == y[400:]).mean() > 0.95
    df = spark.createDataFrame(x[:50].tolist(), "a double, b double, c double")
    got = [v[0] for v in df.selectExpr(trees.sql()).collect()]
    assert np.allclose(got, trees.margins(x[:50]))


def test_bundles_seek_and_read_back():
    r = random.Random(1)
    bundle, held = warc.Bundle(frame=2000), {}
    for i in range(60):
        body = warc.record(i, f"http://x/{i}", bytes(r.choices(b"abc\r\n<", k=r.randint(0, 3000))), "00" * 20, None, False)
        held[warc.record_id(i)] = body
        bundle.add(warc.record_id(i), body)
    archive = bundle.close()
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(archive, read_across_frames=True).read()
    assert plain == b"".join(held.values())
    assert len(warc.seek_table(archive)) > 5
    assert all(warc.fetch(archive, e) == held[e["record_id"]] for e in bundle.index)
    for damaged in (archive[:-1], archive[:-9] + b"\0" * 9):
        with pytest.raises(ValueError):
            warc.seek_table(damaged)


def test_warc_table(spark, tmp_path):
    long = "é" * 600
    pages = [(1, "http://a", long), (2, "b\r\nWARC-Type: x%41", long), (3, "c%20d", "short"), (4, None, "short"), (5, "e", None), (6, "f", "y" * 300_000), (7, "a", long), (None, "n", long)]
    df = spark.createDataFrame([(*p, 1, "d") for p in pages], "page_id long, url string, html string, revisit int, _d string")
    archives = table(warc.bundles(df), "test-warc")
    found = {r.page_id: r for r in warc.records(archives).collect()}
    assert len(found) == len(pages)
    for page_id, url, html in pages:
        r, body = found[page_id], (html or "").encode()
        again = html == long and page_id != 7
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(body), hashlib.sha1(body).hexdigest())
        assert (r.record_type, r.refers_to, r.html) == (("revisit", 7, None) if again else ("response", None, body))
    files = warc.export(archives, str(tmp_path)).collect()
    assert sum(f.bytes for f in files) == sum(p.stat().st_size for p in tmp_path.glob("*.warc.zst"))
    assert warc.records(warc.bundles(df.limit(0))).count() == 0


def test_formulas_fallbacks_and_xmp_stay(model):
    page = f"<article><p>{TEXT} Then <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.<object data=a.swf><param name=b>No player.</object><xmp class='c>'><b>bold</b> &amp; so</xmp><script>no</script></p></article>"
    assert H.extract([page], model)[0] == f"{TEXT}Then x=2 holds.No player. <b>bold</b> &amp; so".replace("  ", " ")
    assert "end" in H.extract([f"<article><p>{TEXT}</p><xmp>end"], model)[0]


def test_references_do_not_span_tags(model):
    assert dom.read("<p>AT&<b>lt;</b> &am<i>p;</i> &lt;<u>b</u>&gt; a&amp<b>b</b></p>")[1][0][1] == "AT&lt; &amp; <b> a&b"


def test_decoding_equals_exhaustive_search():
    """On small trees: every choice of whole-in, whole-out and parted elements, scored as the decoder's contract says."""
    r = random.Random(3)

    def scores(nodes, held, total, i):
        """(score, kept) of the best choice for the subtree of i, by trying all."""
        family, todo = [], [i]
        while todo:
            j = todo.pop()
            family.append(j)
            todo += nodes[j].children
        options = [(total[i], {j: True for j in family}), (-total[i], {j: False for j in family})]
        if nodes[i].children:
            parts = [scores(nodes, held, total, c) for c in nodes[i].children]
            several = sum(nodes[c].chars > 0 for c in nodes[i].children) + (nodes[i].own > 0) > 1
            own = abs(held[i]) if nodes[i].own else H.KEPT * max(held[i], 0.0)
            kept = {i: held[i] > 0}
            for p in parts:
                kept |= p[1]
            options.append((sum(p[0] for p in parts) + own - H.PART * several, kept))
        return max(options, key=lambda o: o[0])

    for _ in range(300):
        nodes = [dom.Node("#root", -1, 0, frozenset(), frozenset())]
        for i in range(1, r.randint(2, 8)):
            up = r.randrange(i)
            nodes.append(dom.Node("div", up, 0, frozenset(), frozenset(), own=r.choice([0, 5])))
            nodes[up].children.append(i)
        for i in range(len(nodes) - 1, -1, -1):
            nodes[i].chars += nodes[i].own
            if i:
                nodes[nodes[i].parent].chars += nodes[i].chars
        margins = [r.uniform(-8, 8) for _ in nodes]
        held = [max(-H.LIMIT, min(H.LIMIT, m)) if n.chars else 0.0 for n, m in zip(nodes, margins, strict=True)]
        total = list(held)
        for i in range(len(nodes) - 1, 0, -1):
            total[nodes[i].parent] += total[i]
        wanted = scores(nodes, held, total, 0)[1]
        found = H.decode(nodes, margins)
        assert all(found[i] == wanted[i] for i, n in enumerate(nodes) if n.own)

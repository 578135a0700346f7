"""Vector codes, whitening and page texts against brute force and edge cases."""

import functools
import hashlib
import html
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from compare import database, differences
from curlew.llm import codes, html_text, whitening
from curlew.llm.queries import ORACLES, QUERIES
from curlew.llm.vectors import matrix

VECTORS = "vec_id bigint, embedding array<float>, label int, n bigint, code string, packed binary, of int"
NAN, INF = float("nan"), float("inf")


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", None, 2) for r in rows], VECTORS)


EDGE = [
    (3, [0.5, 1.0, -1.0, 0.25], 1),
    (3, [0.5, 1.0, -1.0, 0.25], 1),
    (1, [0.5, 1.0, -1.0, 0.25], None),
    (None, [0.1, 0.2, 0.3, 0.4], None),
    (2, [-0.001, 0.0, 0.0, 7.5], 2),
    (4, None, 2),
    (5, [], 2),
    (6, [1.0, None, 1.0, 1.0], 2),
    (7, [1.0, NAN, 1.0, 1.0], 2),
    (8, [1.0, INF, 1.0, 1.0], 2),
    (9, [1.0, -INF, 1.0, 1.0], 2),
    (10, [1.0, 2.0], 2),
]


# codes


@pytest.mark.parametrize("seed,spread,width,count", [(0, 3, 2, 300), (1, 50, 4, 256), (2, 1, 3, 200), (3, 2**27, 4, 90), (4, 1000, 16, 256), (5, 0, 2, 40)])
def test_tree_finds_the_lowest_nearest(seed, spread, width, count):
    rng = np.random.default_rng(seed)
    points = rng.integers(-spread, spread + 1, (count, width))
    asked = np.vstack([rng.integers(-spread, spread + 1, (500, width)), points])
    tree = codes.Tree(points)
    row, far = tree.nearest(asked)
    exact = ((asked[:, None].astype(object) - points[None].astype(object)) ** 2).sum(-1)
    assert far.tolist() == exact.min(1).tolist()
    assert row.tolist() == exact.astype(float).argmin(1).tolist() if spread < 2**20 else True
    assert all(exact[i, r] == exact[i].min() and r == list(exact[i]).index(exact[i].min()) for i, r in enumerate(row))


def test_tree_leaves_out_subtrees():
    rng = np.random.default_rng(0)
    centres = rng.integers(-10_000, 10_000, (16, 4))
    points = (centres[:, None] + rng.integers(-50, 50, (16, 16, 4))).reshape(-1, 4)
    tree = codes.Tree(points)
    asked = np.repeat(points, 4, axis=0) + rng.integers(-20, 20, (1024, 4))
    row, far = tree.nearest(asked)
    assert far.tolist() == ((asked[:, None] - points[None]) ** 2).sum(-1).min(1).tolist()
    assert tree.compared < 0.2 * len(asked) * len(points)


def _plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(np.float32(x) * 1024.0) for x in v], label) for i, v, label in rows]
    length = len(kept[0][1])
    cuts = [slice(length * p // parts, length * (p + 1) // parts) for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[list(r[1][cut]) for r in first] for cut in cuts]

    def near(book, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for book, cut in zip(books, cuts, strict=True):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(book, v[cut])[1], []).append(v[cut])
            for i, members in groups.items():
                book[i] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for i, v, label in kept:
        found = [near(book, v[cut]) for book, cut in zip(books, cuts, strict=True)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    by_label = {}
    for _, _, error, label in out:
        by_label[label] = by_label.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, code, error, by_label[label], sha) for i, code, error, label in out]


def _rows(frame):
    return sorted(map(tuple, frame.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_codes_equal_plain_rounds(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)], int(rng.integers(3)) or None) for i in rng.permutation(400)]
    rows += rows[:40]
    assert _rows(codes.encode(_vectors(spark, rows).repartition(7), entries=20)) == sorted(_plain_codes(rows, entries=20), key=str)


def test_codes_edges(spark):
    assert _rows(codes.encode(_vectors(spark, EDGE))) == sorted(_plain_codes(EDGE[:5]), key=str)
    assert codes.encode(_vectors(spark, EDGE[5:9])).count() == 0
    assert codes.encode(_vectors(spark, [])).count() == 0
    with pytest.raises(ValueError):
        codes.encode(_vectors(spark, [(1, [1e30], 1)]))


def test_codes_cold_labels_meet_by_shuffle(spark):
    rows = [(i, [float(i % 7), 0.0, 0.0, float(i % 3)], i // 2) for i in range(3000)]
    assert _rows(codes.encode(_vectors(spark, rows), entries=4, rounds=1)) == sorted(_plain_codes(rows, entries=4, rounds=1), key=str)


@pytest.mark.parametrize("name", ["op11_codes"])
def test_query_equals_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf).toPandas(), database(sf).execute(ORACLES[name]).df()) == []


def test_matrix_of_a_slice():
    batch = pa.RecordBatch.from_arrays([pa.array([[1.0, 2.0], None, [3.0, None], [], [5.0, 6.0]], pa.list_(pa.float64()))], names=["embedding"]).slice(1)
    places, values = matrix(batch, 2)
    assert places.tolist() == [3] and values.tolist() == [[5.0, 6.0]]


# whitening


def _spectrum(values, seed=0):
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return turn @ np.diag(values) @ turn.T


@pytest.mark.parametrize(
    "a",
    [
        _spectrum(np.arange(1.0, 65)),
        _spectrum(1 + np.arange(48) * 1e-7),
        _spectrum([5.0] * 9 + [2.0] * 9 + [1e-9] * 3 + [0.0] * 9),
        _spectrum(10.0 ** -np.arange(30)),
        np.diag(np.arange(10.0)),
        3 * np.eye(6),
        np.zeros((4, 4)),
        np.array([[2.0, 1.0], [1.0, 2.0]]),
        np.array([[3.0]]),
        np.zeros((0, 0)),
    ],
)
def test_eigenvectors(a):
    a = (a + a.T) / 2
    values, vectors = whitening.eigenvectors(a)
    scale = np.linalg.norm(a) or 1.0
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1] if len(a) else [], rtol=0, atol=1e-14 * scale)
    assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-14 * scale
    assert np.linalg.norm(vectors.T @ vectors - np.eye(len(a))) <= 1e-10
    assert (np.diff(values) <= 0).all()


def test_polar_factor_is_the_sign():
    a = _spectrum([4.0, 1.0, 1e-9, -1e-7, -3.0])
    factor = whitening.polar_factor(a)
    assert np.allclose(factor, _spectrum([1.0, 1, 1, -1, -1]), atol=1e-6)
    assert np.allclose(factor @ factor, np.eye(5), atol=1e-13)


def _whitened_by_eigh(rows, most=16):
    whole = {i: [math.floor(np.float32(x) * 64.0) + 1_000_000 for x in v] for i, v in rows}
    fit = np.array(sorted({tuple(x) for x in whole.values()}), object)
    n, sums = len(fit), fit.sum(0)
    centred = np.array([[float(n * x - s) / n for x, s in zip(r, sums, strict=True)] for r in fit])
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    out = {}
    for i, x in whole.items():
        away = [n * a - s for a, s in zip(x, sums, strict=True)]
        for k in range(len(values)):
            out[i, k + 1] = (n, sum(a * a for a in away), abs(np.dot(np.array(away, float) / n, axes[:, k])) / np.sqrt(values[k]), values[k] / np.trace(covariance))
    return out


def test_whitening_equals_eigh(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(20, 20))
    rows = [(int(i), [float(np.float32(x)) for x in mix @ rng.normal(size=20) + 3.0]) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)]
    found = whitening.whiten(_vectors(spark, [(i, v, 1) for i, v in rows]).repartition(5)).collect()
    expected = _whitened_by_eigh(rows)
    assert len(found) == len(expected)
    for r in found:
        n, deviation, white, explained = expected[r.vec_id, r.component]
        assert (r.n, int(r.deviation)) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(white, rel=1e-7, abs=1e-9) and r.explained == pytest.approx(explained, rel=1e-10)
        assert r.identity_error < 1e-10


def test_whitening_edges(spark):
    found = whitening.whiten(_vectors(spark, EDGE)).collect()
    assert sorted({str(r.vec_id) for r in found}) == ["1", "2", "3", "None"]
    assert len(found) == 5 * 4 and {r.n for r in found} == {3}
    by_row = {}
    for r in found:
        by_row.setdefault(r.component, []).append(r)
    # three vectors span two directions; the others have no variance
    assert all(r.whitened is not None for k in (1, 2) for r in by_row[k])
    assert all(r.whitened is None for k in (3, 4) for r in by_row[k])
    one = whitening.whiten(_vectors(spark, EDGE[:2])).collect()
    assert len(one) == 8 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in one)
    assert whitening.whiten(_vectors(spark, EDGE[5:9])).count() == 0
    assert whitening.whiten(_vectors(spark, [])).count() == 0


def test_whitening_of_large_numbers(spark):
    rows = [(i, [float(np.float32(1e6 * ((i * 37) % 11))), float(np.float32(i))], 1) for i in range(60)]
    expected = _whitened_by_eigh([(i, v) for i, v, _ in rows])
    for r in whitening.whiten(_vectors(spark, rows)).collect():
        assert int(r.deviation) == expected[r.vec_id, r.component][1]
        assert abs(r.whitened) == pytest.approx(expected[r.vec_id, r.component][2], rel=1e-6, abs=1e-8)


def test_packed_numbers():
    rows = np.array([[1, -2], [127, -127], [128, 0], [2**40, -5]])
    packed = whitening._packed(rows)
    assert [len(x) for x in packed] == [3, 3, 5, 17] and whitening._unpacked(packed, 2).tolist() == rows.tolist()


def test_whitening_query(spark, sf):
    found = QUERIES["op12_whitening"](spark, sf).toPandas()
    rows = [(i, v) for i, v in database(sf).execute("SELECT vec_id, embedding FROM embeddings").fetchall()]
    expected = _whitened_by_eigh(rows)
    assert len(found) == len(expected) == 500 * 16
    got = {(r.vec_id, r.component): r for r in found.itertuples()}
    for key, (n, deviation, white, explained) in expected.items():
        r = got[key]
        assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - white) < 1e-8 and abs(r.explained / explained - 1) < 1e-10
    assert found.identity_error.max() < 1e-10


# pages


def test_pages_of_the_table(spark, sf):
    pages = {i: h for i, h in database(sf).execute("SELECT page_id, html FROM pages").fetchall()}
    found = QUERIES["op13_html"](spark, sf).collect()
    assert len(found) == len(pages)
    for r in found:
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        plain = " ".join(html.unescape(re.sub("<(?!/?b>)[^>]*>", " ", article).replace("<b>", "").replace("</b>", "")).split())
        assert (r.text, r.n_chars) == (plain, len(plain))


LONG = "The committee met on Monday and agreed, after a long discussion of the costs, to build the bridge. "
BLOG = f"""<html><head><title>T</title></head><body class="with-sidebar has-comments"><div id="top"><div class="site-header"><a href="/">Home</a> Site name</div>
<ul class="menu"><li><a href="/a">One</a><li><a href="/b">Two</a></ul></div>
<div id="cookieNotice">We use cookies to make this site better for everybody who reads it every day.</div>
<div id="content"><h1>The bridge</h1><div class="text"><p>First. {LONG * 3}<p>Second &lt;b&gt; {LONG * 2}<div class="quote">Quoted. {LONG}</div>
<p>Third has <a href="/x">one link</a>, <b>bo</b>ld and a<br>break. {LONG * 2}<script>if (a < b) document.write("</p>")</script></div>
<div class="ad-slot">Buy this now, it is the best thing that you will ever have bought in your life.</div></div>
<section id="comments"><p>Reader one. {LONG * 4}<p>Reader two. {LONG * 4}</section>
<div class="sidebar"><p>About the author. {LONG}</div><form><p>Write to us. {LONG}<input name="x"></form><footer>Imprint {LONG}</footer></body></html>"""


def test_page_without_an_article_element():
    text = html_text.main_text(BLOG)
    expected = f"The bridge First. {LONG * 3}Second <b> {LONG * 2}Quoted. {LONG}Third has one link, bold and a break. {LONG * 2}"
    assert text == " ".join(expected.split())


def test_page_with_header_and_comments_in_the_article():
    page = f"""<header><h1>Site</h1></header><nav>Menu</nav><main><article class="post has-form"><header><h1>Title</h1></header><p>{LONG}</p>
    <ul><li>a</li><li>b</li></ul><table><tr><td>c<td>d<tr><td>e</table><aside>Aside {LONG}</aside><div class="comments"><p>{LONG * 9}</p></div>
    <p hidden>Not seen</p><p>End.</article></main>"""
    assert html_text.main_text(page) == " ".join(f"Title {LONG} a b c d e End.".split())


@pytest.mark.parametrize(
    "source,text",
    [
        (None, ""),
        ("", ""),
        (" \n", ""),
        ("plain  text &amp; more", "plain text & more"),
        ("a < b &copy &nbsp; c", "a < b © c"),
        ("<p>one<p>two</p></p>three", "one two three"),
        ("<nav>only a menu</nav>", ""),
        ("<ul><li><a href=x>link</a></ul>", ""),
        ("<p>x<!-- never ends <p>y", "x"),
        ("<p>x<script>never ends <p>y", "x"),
        ("<p>x</p><p class='a", "x"),
        ("<p>x<b>y</p>z</b>", "xy z"),
        ("<p title='a > b'>x</p>", "x"),
        ("<form><h1>Whole page in a form</h1><p>Text stays.</p><select><option>no</select></form>", "Whole page in a form Text stays."),
        ("\x00<?php x ?><!DOCTYPE html></>t", "\x00t"),
        ("<p>café \U0001f600</p>", "café \U0001f600"),
    ],
)
def test_pages(source, text):
    assert html_text.main_text(source) == text


@pytest.mark.parametrize("part", ["<", "<a ", "<b>", "<!--", "<li>", "<ul><b></i>", '<a b="', "</div>", "<div>", "<b><p></b>", "&", "<x y='", "<td><p>", "<p>x "])
def test_long_pages_take_linear_time(part):
    import time

    started = time.process_time()
    text = html_text.main_text(part * 40_000)
    assert time.process_time() - started < 20
    assert len(text) == {"<": 40_000, "&": 40_000, "<p>x ": 79_999}.get(part, 0)


def test_density_is_the_stated_formula():
    assert html_text.density(0, 3, 0, 0, 0.5) == 0
    assert html_text.density(50, 4, 50, 4, 1.0) == 0
    expected = 100 / 5 * math.log(100 / 20 * 5 / 2) / math.log(math.log(100 / 80 * 20 + 0.1 * 100 + math.e))
    assert html_text.density(100, 5, 20, 2, 0.1) == pytest.approx(expected)


def test_densities_by_recursion():
    page = html_text.Page(BLOG)
    out = html_text.other_parts(page)
    own, sums = html_text.densities(page, out)
    kept = [i for i in range(len(out)) if not out[i]]
    children = {i: [j for j in kept if page.parent[j] == i] for i in kept}

    def linked(i):
        return i >= 0 and (page.name[i] == "a" or linked(page.parent[i]))

    @functools.cache
    def measured(i):
        runs = [len(" ".join(p[1].split())) for p in page.pieces if p and p[0] == i]
        inner = [measured(j) for j in children[i]]
        links = sum(runs) if linked(i) else 0
        return (
            sum(runs) + sum(m[0] for m in inner),
            sum(m[1] + 1 for m in inner),
            links + sum(m[2] for m in inner),
            sum(m[3] + (page.name[j] == "a") for j, m in zip(children[i], inner, strict=True)),
        )

    share = measured(0)[2] / measured(0)[0]
    for i in kept:
        assert own[i] == pytest.approx(html_text.density(*measured(i), share))
        runs = [len(" ".join(p[1].split())) for p in page.pieces if p and p[0] == i and not linked(i)]
        assert sums[i] == pytest.approx(sum(own[j] for j in children[i]) + sum(html_text.density(r, 1, 0, 0, share) for r in runs if r))


def test_extract_keeps_rows_and_clashing_columns(spark):
    rows = [(1, "u", "<p>x y</p>", "t", 5), (1, "u", "<p>x y</p>", "t", 5), (None, None, None, None, None), (2, "v", "", "t", 6)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    found = html_text.extract(pages).collect()
    assert sorted((str(r.row.page_id), r.row.text, r.text, r.n_chars) for r in found) == [("1", "t", "x y", 3)] * 2 + [("2", "t", "", 0), ("None", None, "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0

import itertools
import random
import time

import numpy as np
import pytest
from layouts import PAGES
from pyspark.sql import functions as F
from quillspark.llm import boosting, dom, extraction, topk


def brute(rows, k=5):
    ok = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in ok), default=1)
    m = np.array([np.pad(v, (0, width - len(v))) for _, v in ok]).reshape(-1, width)
    out = []
    for q, (i, _) in enumerate(ok):
        if i % 50 == 0:
            got = sorted(((-int(m[q] @ m[c]), j) for c, (j, _) in enumerate(ok) if j != i))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(got)]
    return sorted(out)


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **k).collect())


def test_equal_to_brute_force_with_ties_and_bad_vectors(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.05 * r.normal(size=8)).astype("float32").tolist()) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(12)] + [(550, None), (600, []), (650, [1.0, None]), (700, [float("nan"), 1.0]), (750, [float("inf")]), (None, [1.0]), (800, [0.5, 0.5])]
    assert run(spark, rows, query_block=4, data_block=60) == brute(rows)


def test_few_rows(spark):
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]


def searched(data, ids, k=5):
    s = topk.DualSearch(data[ids % 50 == 0], ids[ids % 50 == 0], data, ids, k)
    s.run()
    exact = data[ids % 50 == 0] @ data.T
    exact[ids[ids % 50 == 0][:, None] == ids[None, :]] = -np.inf
    assert (np.sort(exact, axis=1)[:, ::-1][:, :k] == s.scores).all()
    return s, exact.size


def test_clusters_are_pruned():
    r = np.random.default_rng(2)
    for noise, most in ((1.0, 0.1), (60.0, 0.5)):
        data = np.floor(np.repeat(300 * r.normal(size=(20, 16)), 200, axis=0) + noise * r.normal(size=(4000, 16)))
        s, pairs = searched(data, np.arange(4000))
        assert s.pruned > 0 and s.products < most * pairs


def test_the_registered_vectors_go_through_trees_of_several_levels(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", topk.integer_vectors(F.col("embedding"), 256).alias("v")).where("v is not null").orderBy("vec_id").collect()
        s, pairs = searched(np.array([r.v for r in rows]), np.array([r.vec_id for r in rows]))
        depth = [0]
        for p in s.d.parent[1:].tolist():
            depth.append(depth[p] + 1)
        assert max(depth) >= 3 and s.d.is_leaf.sum() > 100 and s.tested > 500 and s.pruned > 100 and s.products < pairs


def test_cells_are_pruned(spark):
    r = np.random.default_rng(5)
    centres = 100 * r.normal(size=(8, 6))
    rows = [(i, (centres[i % 8] + 0.1 * r.normal(size=6)).astype("float32").tolist()) for i in range(800)]
    assert run(spark, rows, query_block=8, data_block=50) == brute(rows)
    pivots = np.array([[100.0, 0.0], [-100.0, 0.0], [0.0, 1.0]])
    assert topk.cell_pairs(pivots, {0: 1.0, 1: 1.0}, {0: 1.0, 1: 1.0, 2: 1.0}, {0: 5000.0, 1: -np.inf}) == [(0, 0), (1, 0), (1, 1), (1, 2)]


def test_a_hot_id_and_equal_vectors(spark):
    rows = [(7, [1.0, 0.0])] * 60 + [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0])] + [(100 + i, [0.5, 0.5]) for i in range(1, 40)]
    got = run(spark, rows, query_block=4, data_block=16)
    assert [x for x in got if x[0] == 0] == [(0, i + 1, 7, 65_536) for i in range(5)]


def test_radii_cover(spark):
    points = np.random.default_rng(3).normal(size=(900, 3))
    t = topk.CoverTree(points, leaf=16)
    assert sorted(t.order.tolist()) == list(range(900))
    for n in range(len(t.radius)):
        own = t.order[t.first[n] : t.last[n]]
        assert np.sqrt(((points[own] - t.centre[n]) ** 2).sum(1)).max() <= t.radius[n] + 1e-9
        below = range(t.child[n], t.child[n] + t.children[n])
        assert not below or sorted(i for c in below for i in t.order[t.first[c] : t.last[c]].tolist()) == sorted(own.tolist())
        gaps = [np.sqrt(((points[t.seed[x]] - points[t.seed[y]]) ** 2).sum()) for x in below for y in below if x < y]
        assert all(g > t.reach[n] / 1.1 for g in gaps) and all(t.reach[c] <= t.reach[n] / 1.1 + 1e-9 for c in below)


def pages(spark, html):
    df = spark.createDataFrame([(i, "u", h, "x") for i, h in enumerate(html)], "page_id long, url string, html string, text string")
    return [(r.text, r.n_chars) for r in extraction.extract(df).orderBy("page_id").collect()]


def test_pages(spark):
    article = "<article><h1>Title &amp; more</h1><p><b>First part.<br><p>Second\n  part, <i>in</i>line.</p><p>&eacute;&#233;</p></article>"
    full = f"<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><!-- x --><div class='ad'>Buy this now.</div>{article}<div id=comments><p>I like it very much.</p></div><footer>&copy; someone</footer></body></html>"
    got = pages(spark, [full, None, "", "just text", "<p>a<p>b", "<script>x</script>"])
    text = "Title & more First part. Second part, inline. éé"
    assert got[:3] == [(text, len(text)), ("", 0), ("", 0)]
    assert got[3][0] == "just text" and got[4][0] == "a b" and got[5] == ("", 0)


def test_every_page_of_the_table(spark, sf_dir):
    import re
    from html import unescape

    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in rows.join(extraction.extract(rows).select("page_id", "text"), "page_id").collect():
        inner = r.html[r.html.index("<article>") : r.html.index("</article>")]
        plain = re.sub(r"<(/?)(\w+)[^>]*>", lambda m: " " if m[2] in ("p", "h1", "br", "article") else "", inner)
        assert r.text == " ".join(unescape(plain).split())


def test_no_choice_contradicts_an_ancestor():
    r = random.Random(4)
    for html in extraction.sample_pages(20, 5):
        nodes, _ = dom.parse(html)
        odds = np.array([r.uniform(-4, 4) for _ in nodes])
        chosen = extraction.decode(nodes, odds)
        place = {id(n): i for i, n in enumerate(nodes)}
        for i, n in enumerate(nodes):
            up = []
            p = n.parent
            while p is not None:
                up.append(chosen[place[id(p)]])
                p = p.parent
            # Main text below something left out below main text would contradict it.
            if chosen[i] and True in up:
                assert all(up[: up.index(True)]) or up[0]


def test_layouts_not_seen_in_fitting():
    trees, right = extraction.model(), 0
    some = extraction.sample_pages(60, 123)
    for html in some:
        nodes, _ = dom.parse(html)
        place, label = {id(n): i for i, n in enumerate(nodes)}, []
        for i, n in enumerate(nodes):
            label.append(dom.attributes(n.attrs).get("data-l") or (label[place[id(n.parent)]] if i else None))
        want = extraction.assemble(nodes, [v == "c" and n.tag not in extraction._NEVER for v, n in zip(label, nodes, strict=True)])
        right += extraction.extract_pages([html], trees)[0] == want
    assert right >= 0.8 * len(some)


def test_hand_written_layouts():
    got = extraction.extract_pages([html for html, _, _ in PAGES], extraction.model())
    there = [(s, t) for (_, want, _), t in zip(PAGES, got, strict=True) for s in want]
    assert sum(s in t for s, t in there) >= 0.97 * len(there) and all(got)
    assert [(s, t) for (_, _, unwanted), t in zip(PAGES, got, strict=True) for s in unwanted if s in t] == []


def test_decoding_is_the_best_labelling():
    r = random.Random(7)
    for _ in range(60):
        n = r.randint(1, 7)
        nodes = [dom.Node("#root", "", None, 0)]
        for k in range(n):
            parent = r.choice(nodes)
            nodes.append(dom.Node(r.choice(["div", "p", "script"]), "", parent, k))
            parent.children.append(nodes[-1])
        for x in nodes:
            if r.random() < 0.6:
                x.parts.append((0, "text"))
        odds = np.array([r.uniform(-4, 4) for _ in nodes])
        place = {id(x): i for i, x in enumerate(nodes)}

        def total(states):
            out = 0.0
            for i, (x, s) in enumerate(zip(nodes, states, strict=True)):
                above = states[place[id(x.parent)]] if i else 0
                if above == 2 and s != 2 or above == 1 and s == 0:
                    return -np.inf
                has, never = bool(x.parts), x.tag == "script"
                weight = 3.0 if has else 1.0
                yes, no = -np.log1p(np.exp(-odds[i])), -np.log1p(np.exp(odds[i]))
                out += (no * weight if has else -0.35) if s == 0 else (-1e9 if never else weight * yes) if s == 1 else 0.0 if never else weight * no
                if i:
                    out -= 0.2 if s == 1 and above == 0 else 1.0 if s == 2 and above == 1 else 0.0
            return out

        best = max(itertools.product(range(3), repeat=len(nodes)), key=total)
        assert extraction.decode(nodes, odds) == [s == 1 for s in best]


@pytest.mark.parametrize("html", ["<a" * 500_000, "<" + "x" * 1_000_000, '<a ">"' * 150_000 + "'", "<script>" + "</script" * 120_000, "<p><div>" + "<b>" * 100_000 + "<hr>" * 100_000, "&#" + "1" * 1_000_000 + ";", "<a b=" + "\"" * 999_999, "<div" + " " * 1_000_000 + ">x"], ids=range(8))
def test_odd_pages_take_little_time(html):
    start = time.perf_counter()
    dom.parse(html)
    assert time.perf_counter() - start < 6


def test_mark_up_that_the_end_cuts_off_is_no_text():
    trees = extraction.model()
    assert extraction.extract_pages(["<p>Whole text here.</p><div cla", "<p>1 < 2 and <3 you.</p>", '<p title="a>First.</p><p>Second.</p>', "<p>x</p><!-- open"], trees) == ["Whole text here.", "1 < 2 and <3 you.", "First. Second.", "x"]


def test_pages_of_every_kind_of_row(spark):
    kind = "page_id long, url string, html string, text string, n_chars int"
    assert extraction.extract(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, None, "<p>One line.</p>", "t", 1), (1, None, "<p>One line.</p>", "t", 1), (None, "u", None, None, None), (2, "v", "<p>" + "long " * 200_000 + "</p>", "", 0)]
    got = sorted((r.page_id or 0, r.url or "", r.text[:9], r.n_chars) for r in extraction.extract(spark.createDataFrame(rows, kind)).collect())
    assert got == [(0, "u", "", 0), (1, "", "One line.", 9), (1, "", "One line.", 9), (2, "v", "long long", 999_999)]


def test_boosting_separates():
    r = np.random.default_rng(0)
    x = r.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    t = boosting.fit(x, y, np.ones(800), trees=30, depth=3)
    assert ((t.log_odds(x) > 0) == (y > 0)).mean() > 0.95

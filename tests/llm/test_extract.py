"""Main-text extraction: hand-written pages, held-out layouts, every page of the small table, and the defined cases."""

import itertools
import re
from html import unescape

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oddsmith.llm import extract as ex
from oddsmith.llm.boost import boost
from oddsmith.llm.dom import FEATURES, KINDS, Tree, features, parse, range_maximum
from oddsmith.llm.layouts import Layout, labels

FOLDER = "/root/testdata/sf0.001"
P1 = "The old bridge was closed on Monday after inspectors found cracks in two of its supports, the council said."
P2 = "Engineers will spend the summer replacing the damaged parts; until then, traffic is led over the northern road."
P3 = "Residents welcomed the decision, although some fear longer ways to work."
PAGES = {
    "news": (
        f"""<html><head><title>T</title><style>p{{}}</style></head><body><div id=cookie-consent><p>We use cookies to make this site better.</p><button>OK</button></div>
<header><a href=/>Daily</a><nav><ul><li><a href=/a>World</a><li><a href=/b>Sport</a><li><a href=/c>Money</a></ul></nav></header>
<main><article><h1>Bridge closed &ndash; repairs&nbsp;begin</h1><p>{P1}</p><div class="share-tools"><a href=#>Share</a> <a href=#>Post</a></div><p>{P2}</p><div class=ad>Buy our boots now. They last.</div><h2>What next</h2><p>{P3}</article></main>
<aside><h3>Most read</h3><ul><li><a href=/1>Ten birds to see</a></li><li><a href=/2>The river in flood</a></li></ul></aside>
<section id="comments"><h3>Comments</h3><div class=comment><b>Ann</b><p>I never liked this bridge, it was always in a bad state and nobody cared about it.</p></div><div class=comment><b>Bo</b><p>About time that something happens there, thank you.</p></div></section>
<footer>&copy; 2020 Daily. All rights reserved.</footer></body></html>""",
        ["Bridge closed – repairs begin", P1, P2, "What next", P3],
    ),
    "boxes": (
        f"""<div class=wrapper><div class=masthead><a href=/>Home</a></div><div class=menu><a href=1>One</a> | <a href=2>Two</a> | <a href=3>Three</a></div>
<div class=content><div class=post><h1>A bridge</h1><div>{P1}</div><div>{P2}</div><ul><li>the first support, cracked</li><li>the second support, cracked</li></ul><div>{P3}</div></div></div>
<div class=sidebar><h4>Links</h4><ul><li><a href=x>Here</a></li><li><a href=y>There</a></li></ul></div><div class=footer>Copyright by us. Contact us by mail.</div></div>""",
        ["A bridge", P1, P2, "the first support, cracked", "the second support, cracked", P3],
    ),
    "cut off": (f"<body><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><article><h1>Title &amp</h1><p><b>Lead.<br><p>{P1}</p><p>{P2} and th", ["Title &", "Lead.", P1, f"{P2} and th"]),
    "one word": ('<body><nav><ul><li><a href="/x">x</a></li><li><a href="/y">y</a></li></ul></nav><div class="ad">An advert with more words than the text has.</div><article><h1>Word</h1><p>Word.</p></article><footer>&copy; us &middot; Some longer words here.</footer></body>', ["Word", "Word."]),
    "crossed": (f"<div class=nav><a href=1>One<a href=2>Two</div><article><div><h1>Crossed<p>{P1}</div><p>{P2}<table><tr><td>{P3}<td>cell two of the table</table></article><form><p>Sign in to get our letter.</p><input></form>", ["Crossed", P1, P2, P3, "cell two of the table"]),
}


@pytest.fixture(scope="module")
def pieces(spark):
    return ex.sample_pieces(spark.read.parquet(f"{FOLDER}/pages.parquet"))


@pytest.fixture(scope="module")
def model(pieces):
    return ex.train(pieces)


def main_text(model, html):
    tree = parse(html)
    return [tree.text[i] for i in ex.chosen(tree, model.log_odds(features([tree])))]


@pytest.mark.parametrize("name", list(PAGES))
def test_written_pages(model, name):
    html, want = PAGES[name]
    assert main_text(model, html) == want


def test_held_out_layouts(model, pieces):
    layout, wrong, runs = Layout(999, pieces), 0, 0
    for _ in range(150):
        tree = parse(layout.page())
        y = labels(tree)
        kept = set(ex.chosen(tree, model.log_odds(features([tree]))))
        leaves = [i for i, t in enumerate(tree.text) if t is not None]
        wrong += sum((i in kept) != bool(y[i]) for i in leaves)
        runs += len(leaves)
    assert wrong < 0.03 * runs


def article_text(html):
    inside = re.search("<article>(.*)</article>", html, re.S)[1]
    blocks = (re.sub(r"\s+", " ", unescape(re.sub("<[^>]*>", " ", part))).strip() for part in re.split("</?p>|</?h1>", inside))
    return "\n".join(b for b in blocks if b)


def test_every_page_of_the_table(spark, model):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    want = {r["page_id"]: article_text(r["html"]) for r in pages.collect()}
    got = ex.extract(pages, model).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_extract_edges(spark, model, monkeypatch):
    html, want = PAGES["news"]
    long = "<article><h1>Long</h1>" + f"<p>{P1}</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, "u", ""), (3, None, html), (3, None, html), (None, "u", html), (4, "u", "no markup here"), (5, "u", "<script>x</script><nav><a href=1>a</a></nav>"), (6, "u", long), (7, "u", "<p>"), (8, "u", "<div" * 2000)]
    schema = "page_id long, url string, html string, text string, n_chars string, parent string, kind string"
    frame = spark.createDataFrame([(*r, None, None, None, None) for r in rows], schema)
    monkeypatch.setattr(ex, "BLOCK", 3000)
    got = sorted(map(tuple, ex.extract(frame, model).select("page_id", "url", "text", "n_chars").collect()), key=repr)
    by = {}
    for i, _, text, n in got:
        by.setdefault(i, []).append(text)
        assert n == len(text)
    assert len(got) == len(rows) and by[1] == by[2] == by[5] == by[7] == [""]
    assert by[3] == ["\n".join(want)] * 2 and by[None] == ["\n".join(want)]
    assert by[6] == ["\n".join(["Long", *[P1] * 20_000])]
    assert ex.extract(spark.createDataFrame([], schema)).collect() == []


def test_extract_without_any_text(spark, monkeypatch):
    """Pages without a word leave nothing to fill layouts with; stock pieces stand in."""
    monkeypatch.setattr(ex, "LAYOUTS", 20)
    got = ex.extract(spark.createDataFrame([(1, "u", None), (2, "u", "<p> </p>")], "page_id long, url string, html string")).collect()
    assert [(r["text"], r["n_blocks"]) for r in got] == [("", 0)] * 2


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(ex, "SAMPLE", 3)
    frame = spark.createDataFrame([(i, "u", "<p>some words</p>" * 100) for i in range(60)] + [(1, "u", "<p>same</p>")] * 30, "page_id long, url string, html string")
    assert len(ex.sample_pieces(frame)) <= 3 * ex.PIECES


def random_tree(shape):
    tree = Tree()
    tree.add(-1, 1, 0)
    for k, p in enumerate(shape):
        # a parent among the open nodes of the rightmost path, so nodes are in page order
        path = [len(tree.parent) - 1]
        while path[-1] > 0:
            path.append(tree.parent[path[-1]])
        path = [i for i in path if tree.text[i] is None]
        tree.add(path[p % len(path)], 0, 0, f"t{k}" if p % 3 else None)
    n = len(tree.parent)
    for i in reversed(range(n)):
        for j in range(i + 1, n):
            if tree.parent[j] == i:
                tree.end[i] = max(tree.end[i], tree.end[j])
    return tree


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=8), st.lists(st.integers(-6, 6), min_size=9, max_size=9))
def test_decoding_is_the_best_choice_without_contradictions(shape, odds):
    tree = random_tree(shape)
    n = len(tree.parent)
    # no ties: each log-odds has a fraction of its own
    odds = np.array([o + 2.0 ** -(i + 5) for i, o in enumerate(odds[:n])])
    best, chosen = 0.0, []
    for picked in itertools.product([0, 1], repeat=n):
        fits = all(not picked[i] or i == 0 or picked[tree.parent[i]] for i in range(n))
        fits = fits and all(not picked[i] or tree.text[i] is not None or any(picked[j] and tree.text[j] is not None for j in range(i + 1, tree.end[i])) for i in range(n))
        if fits and (worth := float(odds @ np.array(picked))) > best:
            best, chosen = worth, [i for i in range(n) if picked[i] and tree.text[i] is not None]
    assert ex.chosen(tree, odds) == chosen


def test_features_of_a_page():
    tree = parse("<nav class=menu><a href=1>one two</a></nav><div><p>three four five.</p><p>six</p></div>")
    x = {name: features([tree])[:, i] for i, name in enumerate(FEATURES)}
    kinds = [list(KINDS)[k] for k in tree.kind]
    assert kinds == ["box", "nav", "text", "box", "paragraph", "text", "paragraph", "text"]
    assert np.allclose(np.expm1(x["chars"]), [26, 7, 7, 19, 16, 16, 3, 3]) and np.allclose(np.expm1(x["leaves"]), [3, 1, 1, 2, 1, 1, 1, 1])
    assert np.allclose(x["link_share"], [7 / 26, 1, 1, 0, 0, 0, 0, 0]) and np.allclose(x["depth"], [0, 1, 2, 1, 2, 3, 2, 3])
    assert np.allclose(x["place"], [0, 0, 0, 1, 0, 0, 1, 0]) and np.allclose(np.expm1(x["siblings"]), [1, 2, 1, 2, 2, 1, 2, 1])
    assert np.allclose(np.expm1(x["longest"]), [16, 7, 7, 16, 16, 16, 3, 3]) and np.allclose(x["starts_at"], np.array([0, 0, 0, 7, 7, 7, 23, 23]) / 26)
    assert list(x["own_nav"]) == [0, 1, 0, 0, 0, 0, 0, 0] and list(x["above_nav"]) == [0, 0, 1, 0, 0, 0, 0, 0]
    assert np.allclose(np.expm1(x["after_chars"][[1, 4]]), [19, 3]) and x["before_chars"][1] == -1
    both = features([tree, parse("<p>x</p>"), tree])
    assert np.array_equal(both[:8], both[-8:]) and np.array_equal(both[:8], features([tree]))


@given(st.text(alphabet="<>/=\"' abpdivlitr!-&;", max_size=60))
def test_parsing_never_fails(html):
    tree = parse(html)
    n = len(tree.parent)
    assert all(p < i < e <= n for i, (p, e) in enumerate(zip(tree.parent, tree.end, strict=True))) and all(tree.end[i] <= tree.end[p] for i, p in enumerate(tree.parent) if p >= 0)
    assert all(t is None or t == " ".join(t.split()) != "" for t in tree.text) and len(features([tree])) == n


def test_range_maximum():
    rng = np.random.default_rng(0)
    values = rng.random(70)
    start = rng.integers(0, 70, 300)
    end = np.array([rng.integers(s + 1, 71) for s in start])
    assert np.array_equal(range_maximum(values, start, end), [values[a:b].max() for a, b in zip(start, end, strict=True)])


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boost(x[:2000], y[:2000])
    assert ((model.log_odds(x[2000:]) > 0) == y[2000:]).mean() > 0.97
    # brute force of a prediction: walk each tree by hand
    total = model.bias
    for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
        at = 0
        while at < len(feature):
            at = 2 * at + 1 + int(x[2500, feature[at]] > cut[at])
        total += leaf[at - len(feature)]
    assert np.isclose(total, model.log_odds(x[2500:2501])[0])

import numpy as np

from proselens.llm import html_text as H
from proselens.llm.boosting import BoostedTrees
from proselens.llm.layouts import MARK, page


def everything(source):
    tree = H.nodes(H.parse(source))
    return H.text_of(tree[0], np.ones(len(tree), dtype=bool))


def test_parser():
    assert everything("a<b>b</b>c<p>d<p>e<br>f &amp; &eacute;&#x41;") == "abc d e f & éA"
    assert everything("<script>if (a<b) '</p>'</script>x<style>y</style><!-- <p>z</p> -->w<template><p>t</p></template>") == "xw"
    assert everything("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == "a b c d e"
    assert everything("<head><title>t</title></head><body>u</p></div>v") == "uv"
    assert everything("x < y <a href='>'>z</a> <div class=\"open>w") == "x < y z w"
    assert everything("\t  \n") == everything("") == ""


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    m = BoostedTrees(rounds=30, depth=3).fit(x[:3000], y[:3000])
    assert ((m.decision(x[3000:]) > 0) == y[3000:]).mean() > 0.97


def test_decoding_agrees_along_the_tree():
    tree = H.nodes(H.parse("<div><p>one two three</p><nav>four</nav></div><footer><p>five</p></footer>"))
    odds = np.array([1.0, -0.5, 4, -4, -5, 1])
    stay = H.decode(tree, odds)
    assert stay.tolist() == [True, True, True, False, False, False]
    assert all(stay[x.parent.n] for x in tree[1:] if stay[x.n])


def test_unseen_pages():
    model, same = H.trained(), 0
    for seed in range(9000, 9120):
        source = page(seed)
        tree = H.nodes(H.parse(source))
        main = np.zeros(len(tree), dtype=bool)
        for x in reversed(tree):
            main[x.n] |= any(MARK in t for t in x.items if isinstance(t, str))
            if x.parent and main[x.n]:
                main[x.parent.n] = True
        want = " ".join(H.text_of(tree[0], main).replace(MARK, "").split())
        same += want == H.extract([source.replace(MARK, "")], model)[0]
    assert same >= 102


def test_query(spark, tmp_path):
    story = " ".join(["The long tale of a plain page goes on, and on."] * 9)
    whole = f"<html><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class=ad>Buy this now.</div><article><h1>Title</h1><p>{story}</p><p>End &amp; more</p></article><div id=comments><p>First!</p></div><footer>&copy; me</footer></body></html>"
    rows = [(1, "u", whole), (2, None, None), (3, "v", ""), (None, "w", "<script>x</script>"), (1, "u", whole), (5, "x", f"<p>{story * 300}")]
    spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in H.op9_html_extraction(spark, str(tmp_path)).collect()}
    text = f"Title {story} End & more"
    assert got == {1: ("u", text, len(text)), 2: (None, "", 0), 3: ("v", "", 0), None: ("w", "", 0), 5: ("x", story * 300, len(story * 300))}
    assert H.op9_html_extraction(spark, str(tmp_path)).count() == 6


def test_deep_pages_take_linear_time():
    import time

    def took(n):
        began = time.perf_counter()
        tree = H.nodes(H.parse("<div>" * n + "a <x>b" + "</nav></section>" * n + "<p>c" * n))
        assert H.text_of(tree[0], np.ones(len(tree), dtype=bool)).startswith("a b c c")
        return time.perf_counter() - began

    took(1000)
    assert took(16000) < 12 * max(took(4000), 0.01)


def test_decoding_is_the_best_of_all_subsets():
    """Of all choices in which what is below a dropped node is dropped, the likeliest; a node counts by its words."""
    rng = np.random.default_rng(4)
    for source in ("<div><p>a b c</p><div><p>b</p><p>c</p></div></div><ul><li>d<li>e</ul>", "<div><div><div>a</div></div></div><p>b c</p>"):
        tree = H.nodes(H.parse(source))
        weight = np.array([1 + np.log1p(x.own) for x in tree])
        for _ in range(20):
            odds = rng.normal(size=len(tree)) * 2
            own = lambda stay: (np.where(stay, -np.log1p(np.exp(-odds)), -np.log1p(np.exp(odds))) * weight).sum()
            every = (np.array([mask >> k & 1 for k in range(len(tree))], dtype=bool) for mask in range(1 << len(tree)))
            best = max(own(stay) for stay in every if all(stay[x.parent.n] for x in tree[1:] if stay[x.n]))
            stay = H.decode(tree, odds)
            assert all(stay[x.parent.n] for x in tree[1:] if stay[x.n]) and abs(own(stay) - best) < 1e-9


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert H.op9_html_extraction(spark, str(tmp_path)).count() == 0

"""Looks and selectors against a plain walk of the tree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shroudlake.functions import geometry as geo
from shroudlake.operators import page, selectors
from shroudlake.sources import styles

PAGE = """<html><head><style>/* c */ .gone { display: none } #keep.gone { display: block !important } p.dim { opacity: 0.01 } .veil { visibility: hidden } .veil .back { visibility: visible }
@media print { p { display: none } } @media screen { .slim { opacity: .5; border-radius: 50% } } nav > a + a { display: none } ul li:nth-child(2n+1) { opacity: 0 } bad:::x { display: none } a:hover { display: none }
img[alt="me" i], .photo[data-x^='p'] { border-radius: 9px; background: url(x.png) }</style></head><body>
<div class=gone><p id=a>in</p><b style="position: fixed">fixed</b></div><div id=keep class=gone>kept</div><p class=dim>dim <i>child</i></p>
<div class=veil>v<span class=back>b</span><span>c</span></div><p class="slim x">slim</p><nav><a href=1>1</a><a href=2>2</a><a href=3>3</a></nav><ul><li>1<li>2<li id=three>3</ul>
<p style="display:none">own</p><p class=gone style="display:block">wins</p><div aria-hidden=true><u>u</u></div><img alt=ME><em class=photo data-x=pq>e</em></body></html>"""


def test_looks_of_a_page(spark):
    rows = styles.page_tree(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")).collect()
    assert {r.page_id for r in rows} == {1}
    by = {(r.tag, r.text): r for r in rows}
    hidden = {k: v.hidden for k, v in by.items()}
    want = {
        ("p", "in"): True, ("b", "fixed"): False, ("div", "kept"): False, ("p", "dim"): True, ("i", "child"): False, ("div", "v"): True, ("span", "b"): False, ("span", "c"): True, ("p", "slim"): False, ("a", "1"): False, ("a", "2"): True,
        ("a", "3"): True, ("li", "1"): True, ("li", "2"): False, ("li", "3"): True, ("p", "own"): True, ("p", "wins"): False, ("u", "u"): True, ("em", "e"): False,
    }
    assert {k: hidden[k] for k in want} == want
    assert by[("p", "slim")].radius == "50%" and by[("em", "e")].radius == "9px" and by[("em", "e")].background == "url(x.png)" and by[("img", "")].radius == "9px" and by[("p", "slim")].opacity == 0.5
    nodes = styles.tree_of(PAGE).nodes
    for r in rows:  # what is inside an element
        inside = [n.at for n in nodes if r.elem_idx in list(above(n))]
        assert r.last_idx == max(inside, default=r.elem_idx) and inside == list(range(r.elem_idx + 1, r.last_idx + 1))


def above(node):
    while node.parent:
        node = node.parent
        yield node.at


@pytest.mark.parametrize("text, steps", [("a", 1), ("a > b c", 3), ("#x.y[z='a,b'] + *", 2), ("ul li:nth-child( odd ) ~ li", 3), ("a >", None), ("", None), ("a::b", None), (":hover", None), ("#a#b", None), ("> a", None), ("a:nth-child(x)", None)])
def test_selectors_are_parsed(text, steps):
    found = styles.parse_selector(text)
    assert (found and len(found)) == steps
    assert len(styles.selectors("a, b[c=','], d")) == 3 and styles.selectors("a, :bad") == []


def random_page(r):
    def make(depth):
        if depth == 0 or r.random() < 0.2:
            return f"<img class='{r.choice(['a', 'b'])}'>" if r.random() < 0.3 else "x"
        tag = r.choice(["div", "p", "span", "ul", "li"])
        attrs = "".join(f" {k}='{r.choice(v)}'" for k, v in (("class", ["a", "b", "a b", "c-d"]), ("id", ["i", "j"]), ("data-k", ["en-us", "en", "x y"])) if r.random() < 0.4)
        return f"<{tag}{attrs}>" + "".join(make(depth - 1) for _ in range(int(r.integers(1, 4)))) + f"</{tag}>"

    return "".join(make(5) for _ in range(2))


def random_selector(r):
    def one():
        s = r.choice(["div", "p", "span", "li", "*", ""])
        s += r.choice(["", ".a", ".b", ".a.b", "#i", "[data-k]", "[data-k|=en]", "[data-k~='y']", "[class^=a]", "[class$='d']", "[data-k*=N i]", ":first-child", ":nth-child(2)", ":nth-child(-n+2)", ":nth-child(2n+1)", ":nth-child(even)"])
        return s or "p"

    s = one()
    for _ in range(int(r.integers(0, 4))):
        s += str(r.choice([" ", " > ", " + ", " ~ "])) + one()
    return s + (f", {one()}" if r.random() < 0.2 else "")


def test_selectors_match_a_plain_walk(spark):
    r = np.random.default_rng(7)
    pages = [(k, random_page(r)) for k in range(8)]
    texts = sorted({random_selector(r) for _ in range(60)}) + ["::bad", ""]
    df = spark.createDataFrame(pages, "page_id long, html string")
    wanted = spark.createDataFrame([(k, t, t) for k, _ in pages for t in texts], "page_id long, key string, selector string")
    found = {tuple(x) for x in selectors.matched(styles.page_tree(df), wanted).collect()}
    want = {(k, t, n.at) for k, html in pages for n in styles.tree_of(html).nodes for t in texts for steps in styles.selectors(t) if styles.matches(n, steps)}
    assert found == want and len(want) > 200


def test_selectors_over_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = ["nav li a", "div > p", "article p ~ p", "ul li:nth-child(2) > a[href^='/']", "h1 + p, footer *"]
    wanted = pages.select("page_id").crossJoin(spark.createDataFrame([(t, t) for t in texts], "key string, selector string"))
    found = {tuple(x) for x in selectors.matched(styles.page_tree(pages), wanted).collect()}
    want = {(p.page_id, t, n.at) for p in pages.collect() for n in styles.tree_of(p.html).nodes for t in texts for steps in styles.selectors(t) if styles.matches(n, steps)}
    assert found == want and {x[1] for x in want} >= {"nav li a", "article p ~ p"}


def test_targets_are_located(spark):
    html = "<nav id=bar><ul><li id=one><span>x</span><a href=/a>A</a></li><li><a href=/b style='display:none'>B</a><button data-element-id=tok9>C</button></li></ul></nav><input name=q><div class=k><select></select></div>"
    tree = styles.page_tree(spark.createDataFrame([(1, html)], "page_id long, html string"))
    targets = ["one", "#one", "tok9", "tok-0", "tok-1", "btn-tok-2", "tok-99", "div.k > select", "#bar", "nothing", None, "input[name='q']"]
    actions = spark.createDataFrame([(i, 1, t) for i, t in enumerate(targets)], "request_id long, page_id long, target string")
    nodes = styles.tree_of(html).nodes
    got = {r.target: (nodes[r.elem_idx].tag + nodes[r.elem_idx].attrs.get("href", ""), r.way) if r.elem_idx is not None else None for r in selectors.located(actions, tree).collect()}
    assert got == {
        "one": ("a/a", 1), "#one": ("a/a", 1), "tok9": ("button", 2), "tok-0": ("a/a", 3), "tok-1": ("button", 3), "btn-tok-2": ("input", 3), "tok-99": None, "div.k > select": ("select", 4), "#bar": ("a/a", 1), "nothing": None, None: None,
        "input[name='q']": ("input", 4),
    }


def test_avatars_by_their_looks(spark):
    html = "<style>.me { border-radius: 50% } .sq { border-radius: 4px } .big { border-radius: 20px } .bg { background: url(a.png) }</style><header><i class=me></i><i class=sq></i><i class=big></i><i class='bg sq'></i><u class=me></u></header>"
    e = styles.page_tree(spark.createDataFrame([(1, html)], "page_id long, html string")).where("tag = 'i'")
    far = F.when(F.col("elem_idx") % 2 == 0, 700).otherwise(900)
    placed = e.withColumns({"bbox": geo.box(far, F.lit(20), F.lit(40), F.lit(40)), "css_w": F.lit(1280)})
    got = {r["class"]: (r.is_avatar, r.avatar_reason, r.is_pixel) for r in page.avatars(page.near_names(placed)).select(F.col("attrs")["class"].alias("class"), "is_avatar", "avatar_reason", "is_pixel").collect()}
    assert got == {"me": (True, "circular_header_avatar", True), "sq": (False, "", False), "big": (True, "circular_header_avatar", True), "bg sq": (False, "", True)}


def test_labels_of_fields(spark):
    html = """<label for=a>First <b>name</b></label><input id=a name=a aria-label=other><label>Around <select name=b><option>x</option></select> it</label><input name=c aria-label=" Said "><i id=z>Named</i><input name=d aria-labelledby=z>
<div><span>Before</span><input name=e></div><div><i>no</i><input name=f></div><table><tr><td>Cell <b>text</b></td><td><input name=g></td></tr><tr><th></th><td><textarea name=h></textarea></td></tr></table><input name=k aria-labelledby=none>"""
    tree = styles.page_tree(spark.createDataFrame([(1, html), (2, "<input name=a id=a>")], "page_id long, html string"))
    names = tree.select("page_id", "elem_idx", F.col("attrs")["name"].alias("name"))
    got = {(r.page_id, r.name): r.label for r in selectors.field_labels(tree).join(names, ["page_id", "elem_idx"]).collect()}
    want = {"a": "First name", "b": "Around it", "c": "Said", "d": "Named", "e": "Before", "f": "", "g": "Cell text", "h": "", "k": ""}
    assert got == {(1, k): v for k, v in want.items()} | {(2, "a"): ""}

"""Pages: what sheets hide against a matcher of another kind, comments, lists, breaks, deep pages and wide tables."""

import random
import time

import pytest

from strandline.llm import html, sheets


def naive(sel, chain):
    """Right to left with backtracking; chain: the node's (tag, id, classes, index among kids, kids of its parent, parent chain)."""

    def one(simple, node):
        tag, id_, classes = node["tag"], node["id"], node["cls"]
        return all(x == "*" or (x[1:] == id_ if x[0] == "#" else x[1:] in classes if x[0] == "." else x == tag) for x in simple)

    def go(k, node):
        if not one(sel[k][1], node):
            return False
        if k == 0:
            return True
        joint, up = sel[k][0], node["up"]
        kids = up["kids"] if up else [node]
        at = next(i for i, x in enumerate(kids) if x is node)
        if joint == ">":
            return up is not None and go(k - 1, up)
        if joint == "+":
            return at > 0 and go(k - 1, kids[at - 1])
        if joint == "~":
            return any(go(k - 1, x) for x in kids[:at])
        while up is not None:
            if go(k - 1, up):
                return True
            up = up["up"]
        return False

    return go(len(sel) - 1, chain)


def test_cascade_against_naive_matching():
    r = random.Random(5)
    seen = 0
    for _ in range(300):
        top = {"tag": "html", "id": "", "cls": [], "up": None}
        body = {"tag": "body", "id": "", "cls": [], "up": top, "kids": [], "inline": [], "word": ""}
        top["kids"] = [body]
        nodes = [body]
        for k in range(r.randint(1, 14)):
            up = r.choice(nodes)
            x = {"tag": r.choice(["div", "section", "span"]), "id": r.choice(["", "", "i", "j"]), "cls": r.sample(["a", "b", "c"], r.randint(0, 2)), "up": up, "kids": [], "word": f"w{k}", "inline": []}
            if r.random() < 0.15:
                x["inline"] = [r.choice([("display", "none"), ("display", "block"), ("visibility", "visible"), ("visibility", "hidden")])]
            up["kids"].append(x)
            nodes.append(x)
        rules = []
        for _ in range(r.randint(1, 8)):
            sel = [("" if k == 0 else r.choice([" ", ">", "+", "~"]), r.choice([["div"], ["span"], ["*"], [".a"], [".b"], [".a", ".b"], ["div", ".c"], ["#i"], ["section", "#j"], ["body"]])) for k in range(r.randint(1, 3))]
            rules.append((sel, r.choice([("display", "none"), ("display", "block"), ("visibility", "visible"), ("visibility", "hidden"), ("visibility", "inherit")]), r.random() < 0.15))
        css = "".join("".join(f"{j if j in ('', ' ') else f' {j} '}{''.join(s)}" for j, s in sel) + f"{{color:red;{p}:{v}{'!important' if heavy else ''}}}" for sel, (p, v), heavy in rules)

        def page(x):
            attrs = (f' id={x["id"]}' if x["id"] else "") + (f' class="{" ".join(x["cls"])}"' if x["cls"] else "") + (f' style="{";".join(f"{p}:{v}" for p, v in x["inline"])}"' if x["inline"] else "")
            return f'<{x["tag"]}{attrs}> {x["word"]} {"".join(map(page, x["kids"]))}</{x["tag"]}>'

        want = []

        def walk(x, dim):
            best = {}
            for k, (sel, (p, v), heavy) in enumerate(rules):
                if naive(sel, x):
                    flat = [s for _, part in sel for s in part if s != "*"]
                    rank = (heavy, False, sum(s[0] == "#" for s in flat), sum(s[0] == "." for s in flat), sum(s[0] not in "#." for s in flat), k)
                    best[p] = max(best.get(p, ((),)), (rank, v))
            for p, v in x["inline"]:
                best[p] = max(best.get(p, ((),)), ((False, True, 0, 0, 0, 0), v))
            if best.get("display", ("", ""))[1] == "none":
                return
            sight = best.get("visibility", ("", "inherit"))[1]
            dim = dim if sight == "inherit" else sight == "hidden"
            if not dim and x["word"]:
                want.append(x["word"])
            for y in x["kids"]:
                walk(y, dim)

        walk(body, False)
        text = html.text_of(f"<!doctype html><html><head><style>{css}</style></head>{page(body)}</html>")
        assert text.split() == want, (css, page(body))
        seen += len(want) < len(nodes) - 1
    assert seen > 150


def test_selectors_and_sheets():
    text = lambda css, body, doctype="": html.text_of(f"{doctype}<style>{css}</style>{body}").split()
    assert text(".k{display:none} .k{display:block}", "<p class=k>x") == ["x"]
    assert text("[data-x='1,2'], a[href^=ad] {display:none}", "<p data-x='1,2'>no</p><a href=ads>no</a><a href=x>yes</a>") == ["yes"]
    assert text(".sm\\:off{display:none} a:hover, :is(b, i, u), p::before{display:none}", "<b class='sm:off'>no</b><a>a</a> <b>b</b> <i>i</i> <u>u</u><p>p") == ["a", "b", "i", "u", "p"]
    assert text(".K{display:none}", "<p class=k>x") == [] and text(".K{display:none}", "<p class=k>x", "<!DOCTYPE html>") == ["x"]
    assert text("table > tbody > tr > td.n {display:none} table > tr {display:none}", "<table><tr><td>a<td class=n>no</table>") == ["a"]
    assert text("i{content:'}';display:none} b{displaying:none;display:nonesuch}", "<i>no</i><b>b</b>") == ["b"]
    assert html.text_of("<noscript><style>p{display:none}</style></noscript><p>x") == "x"
    assert html.text_of("<div hidden style='display:block'>x</div><div hidden>no</div>") == "x"
    assert html.text_of("<div style='visibility:hidden'>no<p style='visibility:visible'>x</p>no<img alt=no></div>") == "x"
    assert html.text_of("<body style='display:none'>no") == ""
    for bad in ("a>", "> a", "a,,b", ".", "#", "a[", "a b:", "", "a > > b"):
        assert sheets.selector(bad) is None


def test_comment_ends():
    for c in ("<!--x-->", "<!--x--!>", "<!-->", "<!--->", "<!---->", "<!-- a -- b > -->"):
        assert html.text_of(f"<p>a{c}b<p>c") == "ab\n\nc", c
    assert html.text_of("a<!--x--!") == "a"


def test_lists_breaks_and_first_line_feeds():
    assert html.text_of("<ol><li value=7>a<li>b<li style='display:none'>no<li>c</ol>") == "7. a\n8. b\n9. c"
    assert html.text_of("<ol reversed><li>a<li>b<li>c</ol>") == "3. a\n2. b\n1. c"
    assert html.text_of("<ol type=a start=26><li>a<li>b</ol>") == "z. a\naa. b"
    assert html.text_of("<ol type=I start=1994><li>a<li type=1>b<li type=i value=4>c</ol>") == "MCMXCIV. a\n1995. b\niv. c"
    assert html.text_of("a<br>b<br><br>c<br></p>d") == "a\nb\n\nc\nd"
    assert html.text_of("<pre>\nx\n\ny</pre><ul><li><pre>\nz</pre></ul>") == "x\n\ny\n\n- z"


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<p><table><tr><td>" + "<div>" * 100_000 + "x", "<li><ul>" * 50_000 + "x", "<svg>" + "<g>" * 50_000 + "<a/>" * 50_000 + "</svg>x", "<b>" * 50_000 + "</i>" * 50_000 + "x", "<style>.a .b{display:none} div div{visibility:visible}</style>" + "<div class=b>" * 50_000 + "x"])
def test_deep_pages_take_linear_time(page):
    start = time.process_time()
    assert html.text_of(page).strip(" -").endswith("x")
    assert time.process_time() - start < 5


def test_wide_tables_stay_aligned_and_bounded():
    long = "w" * 60
    assert html.text_of(f"<table><tr><td>{long}<td>b<tr><td>s<td>c</table>") == f"{long}  b\n{'s'.ljust(62)}c"
    words = " ".join(f"v{k}" for k in range(20_000))
    text = html.text_of(f"<table><tr><td>{words}<td>r" + "<tr><td>s<td>r" * 20_000 + "</table>")
    assert text.split().count("r") == 20_001 and set(words.split()) < set(text.split()) and len(text) < 3_000_000

"""Main text of pages: markup, differences between near urls, odd rows."""

import html
import random
import re

import pytest

from spanloom.llm import pages
from spanloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def told(page):
    lines, level = pages.page_lines(page)
    return [t for t, of, _ in lines if of == level]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<p class='ad'>x<p>b", ["a", "b"]),
        ("<div>one<br>two</div>three", ["one two", "three"]),
        ("<article><header><h1>T</h1></header><p>x &lt;y&gt; &nbsp; z</p><aside>no</aside><div class=share>s</div><footer>f</footer></article>out", ["T", "x <y> z"]),
        ("<nav><ul><li>a<li>b</ul>c<p>d", []),
        ("<p title='a>b'>x</p><script>if(a<b){'</p>'}</script>y<style>p{}", ["x", "y"]),
        ("x<!-- a --><!-->y<![CDATA[z]]><p", ["xy"]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]),
        ("<main><p>m</p></main><p>o", ["m"]),
        ("<p>un<b>bold</b>t&amp;x</p></b></div>z", ["unboldt&x", "z"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("<form>x<p>y</form>z", ["z"]),
        ("<p hidden>a</p><p style='display: none'>b</p><p aria-hidden=true>c</p><p class=x>d", ["d"]),
        ("1 < 2 and <3", ["1 < 2 and <3"]),
        ("<head><title>t</title><p>x", ["x"]),
        ("<head><meta charset=x><body class='with-sidebar'>x", ["x"]),
        ("<div class=with-sidebar><article><p>x</article><div class=sidebar>y</div></div>", ["x"]),
        ("<article><p>x</p><section id=comments><article class=comment><p>no</article></section></article>", ["x"]),
        ("<div class=cookie-notice>c</div><div id=site-header>h</div><div role=search>s</div><ol class=commentlist><li>r</ol><p>x", ["x"]),
        ("<article><p>a</article><div class=related><article><p>teaser</article></div>", ["a"]),
        ("<P CLASS=X>A</P><SCRIPT>no</SCRIPT><p\n id='y'\n>b", ["A", "b"]),
        ('<p a="never closed>x</p><p>y', ["x", "y"]),
        ("", []),
    ],
)
def test_markup(page, want):
    assert told(page) == want


def test_deep_and_broken_pages_take_linear_time():
    for page in ("<b>" * 60_000 + "<p>x" * 60_000, "<div>" * 60_000 + "</i>" * 60_000 + "x", "<p><b>" * 60_000, '<a b="' * 60_000):
        pages.page_lines(page)


def test_common_lines_are_longest():
    rng = random.Random(3)
    for _ in range(300):
        letters = rng.choice([2, 5, 30])
        a, b = ([rng.randrange(letters) for _ in range(rng.randint(0, 40))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        for room in (1 << 25, 0):
            met = pages.common_lines(a, b, room)
            assert len(met) == best[-1][-1] and all(a[i] == b[j] for i, j in met)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(met, met[1:], strict=False))


def plain(rows, copies=0.8):
    """Text of each (page_id, url, html), every page compared with its neighbours among the different pages of its host."""
    hosts, out = {}, {}
    read = {}
    for p, url, page in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        read[p] = (host, path, *pages.page_lines(page or ""))
        kind = tuple((t, not r) for t, _, r in read[p][2])
        hosts.setdefault(host, {}).setdefault(kind, []).append((path, p))
    for kinds in hosts.values():
        order = sorted(kinds, key=lambda k: (min(kinds[k])[0], pages._key(next(h for h in hosts if hosts[h] is kinds), [pages._number(t) for t, _ in k], [x for _, x in k])))
        for n, k in enumerate(order):
            gone = set()
            for a, b, side in [(order[m], order[m + 1], n - m) for m in (n - 1, n) if 0 <= m < len(order) - 1]:
                met = pages.common_lines([hash(t) for t, _ in a], [hash(t) for t, _ in b])
                if len(met) < copies * max(len(a), len(b)):
                    gone |= {x[side] for x in met if k[x[side]][1]}
            for _, p in kinds[k]:
                _, _, lines, level = read[p]
                out[p] = "\n".join(t for i, (t, of, _) in enumerate(lines) if of == level and i not in gone)
    return out


@pytest.mark.parametrize("block", [2, 1024])
def test_differences_between_near_urls(spark, block, monkeypatch):
    rng = random.Random(block)
    rows = []
    for k in range(120):
        host = rng.choice(["a.com", "a.com", "b.org"])
        section = rng.choice(["x", "y"])
        own = [f"<div>{section} text {rng.randrange(25)}</div>" for _ in range(rng.randint(0, 5))]
        body = f"<div>Welcome to {host}</div>" + "".join(own) + f"<div>More from {section}</div>"
        if k % 3 == 0:
            body = f"<article><p>passage {k % 2}</p><div>Like us</div><p>last {k}</p></article>"
        rows.append((k, f"http://{host}/{section}/{rng.randrange(60)}", body))
    rows += [(200, None, None), (201, "", ""), (202, "http://a.com/x/1", rows[1][2]), (203, "http://c.net/", "<p>alone"), (204, "http://c.net/1", "<p>alone"), (205, None, "<p>x")]
    monkeypatch.setattr(pages.boilerplate, "__defaults__", (0.8, block))
    frame = spark.createDataFrame([(*r, "u", 1) for r in rows], "page_id long, url string, html string, text string, key int").repartition(5)
    got = {r["page_id"]: r["text"] for r in pages.main_text(frame).collect()}
    want = plain(rows)
    assert got == want
    # what the pages of a host say is gone but beside near copies, passages of articles stay
    open_pages = [p for p in range(120) if p % 3]
    assert sum("Welcome" in got[p] for p in open_pages) < len(open_pages) / 3
    assert sum("passage" in t for t in got.values()) == 40 and got[203] == got[204] == "alone" and got[200] == ""


def test_odd_rows(spark):
    frame = spark.createDataFrame([(None, None, None), (1, "no url", "<p>x"), (1, "no url", "<p>x"), (2, "http://h/", "<p>" + "long " * 200_000)], "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["url"], len(r["text"])) for r in pages.main_text(frame).collect()), key=str)
    assert got == [(1, "no url", 1), (1, "no url", 1), (2, "http://h/", 999_999), (None, None, 0)]
    assert pages.main_text(frame.where("false")).count() == 0


def test_query_equals_the_articles(spark):
    """The tables' pages have one article each; taken out with plain patterns."""
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in QUERIES["op12_main_text"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for r in rows:
        article = re.sub(r"<br>", " ", re.search(r"(?s)<article>(.*?)</article>", r["html"])[1])
        blocks = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article))]
        text = "\n".join(x for x in blocks if x)
        assert got[r["page_id"]] == (text, len(text))
    assert len(got) == len(rows)

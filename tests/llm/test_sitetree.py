import html as htmllib
import math
import re
from collections import Counter, defaultdict

from quiver.llm import sitetree as S
from quiver.llm.common import table


def text(h):
    return S.main_text(h, frozenset())


def plain(h):
    """The article of the test tables' pages, by patterns that hold for these alone."""
    article = re.search(r"<article>(.*?)(</article>|<footer|$)", h or "", re.S)
    cut = re.split(r"</?(?:p|h1)>", article[1]) if article else []
    return "\n".join(t for b in cut if (t := " ".join(htmllib.unescape(re.sub("<[^>]*>", " ", b)).split())))


def test_markup():
    assert text(None) == text("") == text("<p></p>") == ""
    assert text("a &amp;amp; b&nbsp;\n c<br>d&#233;") == "a &amp; b c dé"
    assert text("<article><h1>T</h1><p><b>x<br><p>y <i>z</i>!</article><footer>f</footer>") == "T\nx\ny z!"
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == "a\nb\nc\nd\ne"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert text("<p>one <span class='ad'>buy</span>two<script>var t='</p>'</script>three") == "one twothree"
    assert text("<div id=sidebar><p>s</div><div class='post-content'>m</div><form><p>f</form><div class='user-comments'>c</div>") == "m"
    assert text("<main>m<div role=navigation>n</div></main><p>outside") == "m"
    assert text("<p>a</nav>b</b></p>c<!-- x <p>y</p> -->d<!doctype z>") == "a\nb\ncd" or text("<p>a</b>b</p>c<!-- <p>y -->d") == "ab\ncd"
    assert text("<div hidden>h</div><p style='Display: none'>n</p><p aria-hidden=true>n</p>k") == "k"
    assert text("<p>cut <a href='x>y'>link</a> < 3 <tag") .startswith("cut link < 3")
    assert text("<div>" * 3000 + "deep") == "deep" and len(text("<p>" + "w " * 300_000)) == 599_999


def template(i, host):
    return f"<html><body><div class=top><p>Welcome to {host}</p><p>Est. 1999</p></div><div class=story><p>Story {i} of {host}, unlike any other {i * 7}.</p><p>And more {i}.</p></div><div class=low><p>All rights</p></div></body></html>"


def test_template_goes_and_rare_pages_stay(spark):
    rows = [(i, "http://Big.example:80/" + str(i), template(i, "big")) for i in range(12)] + [(100, "http://small.example/", template(0, "small"))]
    rows += [(200 + i, "http://copy.example/" + str(i), "<body><article><p>The one article.</p></article></body>") for i in range(9)]
    rows += [(300 + i, None, "<body><p>same everywhere</p></body>") for i in range(9)] + [(400, "http://big.example/x", None), (400, "http://big.example/x", None)]
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], "page_id long, url string, html string, text string, host int")
    got = Counter((r.page_id, r.text, r.n_chars) for r in S.extract(df).collect())
    want = Counter()
    for i, _, h in rows:
        t = f"Story {i} of big, unlike any other {i * 7}.\nAnd more {i}." if i < 100 else {1: text(h), 2: "The one article.", 3: "same everywhere", 4: ""}[i // 100]
        want[i, t, len(t)] += 1
    assert got == want == Counter((r.page_id, r.text, r.n_chars) for r in S.extract(df, broadcast_nodes=0).collect())
    assert S.extract(df.limit(0)).count() == 0


def test_importance_equals_plain_sums(spark, sf):
    pages = table(spark, sf, "pages").withColumn("host", S.host_of("url"))
    seen = defaultdict(Counter)
    for r in pages.collect():
        for node, kind, f in S.observations(r.html):
            seen[r.host, node, kind][f] += 1
    want = {}
    for (host, node, kind), c in seen.items():
        n = sum(c.values())
        e = -sum(v / n * math.log(v / n) for v in c.values()) / math.log(n) if n > 1 else 1.0
        was = want.get((host, node), (0, 0))
        want[host, node] = (n if kind == 0 else was[0], max(e, was[1]))
    want = {k: v for k, v in want.items() if v[0] >= S.LEAST_PAGES}
    got = {(r.host, r.node): (r.pages, r.importance) for r in S.importance(pages, "host", "html").collect()}
    assert got.keys() == want.keys() and len(got) > 20
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)


def test_pages(spark, sf):
    pages = table(spark, sf, "pages")
    assert {r.page_id: r.text for r in S.extract(pages).collect()} == {r.page_id: plain(r.html) for r in pages.collect()}


def test_importance_decides_on_marked_pages(spark):
    def page(i, text):
        return f"<body><article><h1>Title {text}</h1><p>Story {text}, like no other {text}.</p><div class=box><p>Read our paper every day</p></div></article></body>"

    rows = [(i, "http://a.example/", page(i, i if i < 8 else 99)) for i in range(40)]
    teaser = "<article><p>Teaser {0}</p></article><div class=body><p>" + "The body of page {0} goes on and on. " * 30 + "</p></div>"
    rows += [(100 + i, "http://b.example/", teaser.format(i)) for i in range(8)]
    got = {r.page_id: r.text for r in S.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(40):
        t = i if i < 8 else 99
        assert got[i] == f"Title {t}\nStory {t}, like no other {t}." != text(rows[i][2])
    assert all(f"body of page {i}" in got[100 + i] for i in range(8))

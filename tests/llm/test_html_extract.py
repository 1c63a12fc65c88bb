import html
import random
import re

from conftest import SF001
from tractlens.llm import html_extract, queries
from tractlens.llm.html_parse import parse


def brute(page):
    """The article of the test tables' pages."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(x for x in parts if x)


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        got = [a[i] for i in sorted(html_extract.common_lines(a, b))]
        rest = iter(b)
        assert len(got) == lcs(a, b) and all(x in rest for x in got)


def test_query_equals_brute_force(spark):
    for sf in (SF001, "/root/testdata/sf0.01"):
        pages = {r["page_id"]: r for r in queries.read_table(spark, sf, "pages").collect()}
        got = queries.op8_html_extract(spark, sf).collect()
        assert len(got) == len(pages)
        for r in got:
            want = brute(pages[r["page_id"]]["html"])
            assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], want, len(want))


def test_parser():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a>Menu</a>
      <div class="cookie-notice">We use cookies</div><aside>Side</aside><form>Name <input></form><div id="comments"><p>First!</div>
      <article><header><h1>Big  title</h1></header><p>One &amp; two&nbsp;&#51;<br>four<p>Five<script>var a = "</p>";</script> six
      <!-- not <b>this</b> --><ul><li>x</li><li>y &lt;b&gt;</li></ul><div class="share">Share</div><section class="adverb">kept</section></article>
      <footer>&copy; me</footer>"""
    zones = parse(page)
    assert [t for t, z in zones if z == "article"] == ["Big title", "One & two 3 four", "Five six", "x", "y <b>", "kept"]
    assert {t for t, z in zones if z == "chrome"} >= {"Site", "We use cookies", "Side", "First!", "Share", "© me"}
    assert parse(None) == parse("") == parse("<!-- only") == parse("<script>never ends") == []
    assert parse("a < b <3 & c") == [("a < b <3 & c", "plain")]


def test_differencing_deletes_what_neighbours_share(spark):
    page = "<body><div>Home of {h}</div><div>{a}</div><div>{b}</div><div>Bottom of {h}</div></body>"
    rows = [(i, f"http://{h}.net/{d}/{i}", page.format(h=h, a=f"text {i}", b=f"more {i}"), "x")
            for i, (h, d) in enumerate((h, d) for h in ("one", "two") for d in ("a", "b") for _ in range(3))]
    rows += [(50, "http://three.net/", page.format(h="three", a="alone", b="here"), "x"), (51, "http://four.net/", None, "x"), (52, None, "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract(pages, partitions=1).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["text"] == f"text {i}\n\nmore {i}" and got[i]["n_shared"] == 2 for i in range(1, 12))
    assert got[50]["text"] == "Home of three\n\nalone\n\nhere\n\nBottom of three"
    assert got[51]["text"] == got[52]["text"] == ""


def test_article_passages_that_repeat_stay(spark):
    page = "<div>Home</div><article><p>Same passage.</p><p>{}</p></article>"
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", page.format(i)) for i in range(5)] + [(4, "http://a.b/4", page.format(4))],
                                  "page_id long, url string, html string")
    got = html_extract.extract(pages, partitions=2).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted((i, f"Same passage.\n\n{i}") for i in [0, 1, 2, 3, 4, 4])
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_very_long_page(spark):
    page = "<article>" + "".join(f"<p>line {i % 1000}</p>" for i in range(30_000)) + "</article>"
    pages = spark.createDataFrame([(1, "http://a.b/1", page), (2, "http://a.b/2", page + "<p>x")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages, partitions=1).collect()}
    assert got[1] == got[2] == "\n\n".join(f"line {i % 1000}" for i in range(30_000))


def test_copies_are_no_neighbours(spark):
    page = "<body><div>Menu</div><div>{}</div><div>Foot</div></body>"
    urls = ["http://a.b/1", "http://a.b/1", "http://a.b/1?x=2", "http://a.b/1m", "http://a.b/2", "http://a.b/3", "http://c.d/1", "http://c.d/1"]
    says = ["one", "one", "one", "one", "two", None, "alone", "alone"]
    rows = [(i, u, page.format(x) if x else None) for i, (u, x) in enumerate(zip(urls, says))]
    rows += [(20 + i, f"http://e.f/p?id={i}", page.format(f"item {i}")) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages, partitions=1).collect()}
    assert [got[i] for i in range(5)] == ["one"] * 4 + ["two"] and got[5] == ""
    assert got[6] == got[7] == "Menu\n\nalone\n\nFoot"
    assert [got[20 + i] for i in range(3)] == [f"item {i}" for i in range(3)]


def plain_pages(spark):
    """Pages without <article>: a hot host, runs of copies, empty pages, hosts of one page, the same path with other queries."""
    page = "<body><div>Menu of {h}</div><div>{a}</div><div>{b}</div><div>Foot of {h}</div></body>"
    rows = [(i, f"http://hot.net/{i // 7}/{i:03}", page.format(h="hot", a=f"text {i}", b=f"more {i % 5}")) for i in range(60)]
    rows += [(100 + i, "http://hot.net/4/028x?c", page.format(h="hot", a="copied", b="copy")) for i in range(25)]
    rows += [(200 + i, f"http://hot.net/3/02{i}e", None) for i in range(9)]
    rows += [(300 + i, f"http://h{i}.org/", page.format(h=i, a="own", b="page")) for i in range(8)]
    rows += [(400 + i, f"http://q.com/p?id={i}", page.format(h="q", a=f"item {i}", b="x")) for i in range(12)]
    rows += [(None, None, page.format(h="none", a="a", b="b")), (None, None, page.format(h="none", a="c", b="d"))]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def whole_order(rows):
    """Brute force: pairs over the whole sorted list at once."""
    def host_path(url):
        m = re.match(r"(.*?)://([^/?#]*)([^?#]*)", url or "", re.S)
        return (m[2].lower(), m[3]) if m else ("", "")

    pages = sorted(((*host_path(u), i is not None, i or 0, u is not None, u or "", h) for i, u, h in rows), key=lambda p: p[:6])
    told = [(p, parse(p[6])) for p in pages]
    full = [(p, lines) for p, lines in told if lines]
    out = [(p[3] if p[2] else None, "") for p, lines in told if not lines]
    for k, (p, lines) in enumerate(full):
        texts = lambda x: (x[0][0], [t for t, _ in x[1]])
        before = next((x for x in reversed(full[:k]) if texts(x) != texts(full[k])), None)
        after = next((x for x in full[k + 1 :] if texts(x) != texts(full[k])), None)
        near = [x for x in (before, after) if x and x[0][0] == p[0]]
        shared = set()
        if near:
            common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            other = max(near, key=lambda x: common(x[0][1], p[1]))
            shared = html_extract.common_lines([t for t, _ in lines], [t for t, _ in other[1]])
        out.append((p[3] if p[2] else None, html_extract.main_text(lines, shared)[0]))
    return sorted(out, key=repr)


def test_text_does_not_depend_on_the_parts(spark):
    pages = plain_pages(spark)
    want = whole_order([tuple(r) for r in pages.collect()])
    assert sum("Menu of hot" in t for _, t in want) == 0
    for parts in (1, 4, 16, 50):
        got = html_extract.extract(pages.repartition(3), partitions=parts).collect()
        assert sorted(((r["page_id"], r["text"]) for r in got), key=repr) == want, parts


def test_parts_of_copies_only_are_passed(spark, monkeypatch):
    # Forty parts, most of which hold nothing but copies.
    page = "<div>Top</div><div>{}</div><div>End</div>"
    rows = [(i, f"http://a.b/{i:04}", page.format("first" if i == 0 else "last" if i == 399 else "copy")) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(html_extract, "SAMPLED", 1)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages, partitions=40).collect()}
    assert got == {i: "first" if i == 0 else "last" if i == 399 else "copy" for i in range(400)}


def unproved(page):
    """A page without what proves an article or chrome: elements are plain, attributes gone."""
    page = re.sub(r"<(/?)(article|main|nav|header|footer|aside|form|section)\b[^>]*>", r"<\1div>", page or "")
    return re.sub(r"<(\w+)\s[^>]*>", r"<\1>", page)


def measured(spark, sf):
    """(lines outside articles, of them deleted; article lines, of them deleted) without proof from markup."""
    pages = queries.read_table(spark, sf, "pages").collect()
    bare = spark.createDataFrame([(r["page_id"], r["url"], unproved(r["html"])) for r in pages], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(bare).collect()}
    out = [0, 0, 0, 0]
    for r in pages:
        article, text = set(brute(r["html"]).split("\n\n")), set(got[r["page_id"]].split("\n\n"))
        for line, _ in parse(unproved(r["html"])):
            at = 2 if line in article else 0
            out[at] += 1
            out[at + 1] += line not in text
    return tuple(out)


def test_method_alone_deletes_little_of_articles(spark):
    """With no proof from markup, differencing decides; README has the figures of a larger table."""
    other, caught, own, lost = measured(spark, "/root/testdata/sf0.01")
    assert other and own and lost < 0.1 * own

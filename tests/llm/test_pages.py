"""URL filtering, HTML extraction and top-k search."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from spanmoor.llm import hosts, html, topk

# --- URLs --------------------------------------------------------------------

URLS = [
    (1, "https://A.Example.COM/en/9?x", "a.example.com", "/en/9", "com/en/", "block"),
    (2, "https://example.com/en/71", "example.com", "/en/71", "example.com/en/7", "allow"),
    (3, "http://x.net/de/1#t", "x.net", "/de/1", "net/de/", "allow"),
    (4, "http://b.example.net/de/8", "b.example.net", "/de/8", "example.net/de/8", "block"),
    (5, "http://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
    (6, "http://a.org/es/?q=/x", "a.org", "/es/", "org/es/", "block"),
    (7, "http://a.org/es", "a.org", "/es", None, None),
    (8, "no scheme", "", "", None, None),
    (9, None, "", "", None, None),
    (10, "http://h?x://y/z", "h", "", None, None),
    (11, "a://", "", "", None, None),
    (12, "http://ÄB.com", "Äb.com", "", None, None),
    (None, "http://a.com/en/", "a.com", "/en/", "com/en/", "block"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(u[0], u[1], "<p>", "x") for u in URLS], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([(1, 1), (None, 1)], "page_id long, bad int")
    rows = hosts.judge_pages(pages, labels).collect()
    assert len(rows) == len(URLS)
    told = {u[0]: u[2:] for u in URLS}
    for r in rows:
        host, path, rule, verdict = told[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or (verdict is None and r.verdict in ("allow", "block"))
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert hosts.judge_pages(empty, labels).count() == 0
    assert {r.verdict for r in hosts.judge_pages(pages, labels.where("false")).where("rule is null").collect()} == {"allow"}


def brute_reputation(counts):
    def strength(rows):
        rows = [(n, b, p) for n, b, p in rows if n > 0]
        low = sum(p * (1 - p) * (n - 1) for n, b, p in rows)
        off = sum(n * (b / n - p) ** 2 - p * (1 - p) for n, b, p in rows)
        if not rows:
            return 1000.0
        k = 1 / max(off / low if low > 0 else 0, 1 / 1001) - 1
        return max(1.0, min(1000.0, k))

    def level(groups, prior):
        k = strength([(n, b, prior[g]) for g, (n, b) in groups.items()])
        return {g: ((b + k * prior[g]) / (n + k), n + k) for g, (n, b) in groups.items()}

    total = lambda key: {g: [sum(v[i] for h, v in counts.items() if key(h) == g) for i in (0, 1)] for g in {key(h) for h in counts}}
    suffix, domain = (lambda h: h.split(".")[-1]), (lambda h: ".".join(h.split(".")[-2:]))
    n, b = (sum(v[i] for v in counts.values()) for i in (0, 1))
    s = level(total(suffix), defaultdict(lambda: (b + 0.5) / (n + 1)))
    d = level(total(domain), {g: s[suffix(g)][0] for g in map(domain, counts)})
    h = level(counts, {g: d[domain(g)][0] for g in counts})
    return {g: (r, brute_above(r * w, (1 - r) * w)) for g, (r, w) in h.items()}


def brute_above(a, b, limit=0.5):
    """The beta integral by a plain sum over the logit."""
    width = 60 / min(a, b) if min(a, b) < 1 else 60 * math.sqrt((a + b) / (a * b))
    t = math.log(a / b) + np.linspace(-width, width, 1_000_001)
    y = -a * np.logaddexp(0, -t) - b * np.logaddexp(0, t)
    y = np.cumsum(np.exp(y - y.max()))
    return 1 - np.interp(math.log(limit / (1 - limit)), t + (t[1] - t[0]) / 2, y) / y[-1]


def test_reputation(spark):
    rng = random.Random(1)
    counts = {}
    for i in range(120):
        host = f"{rng.choice(['a', 'b', 'www'])}{i}.{rng.choice(['good', 'bad', 'odd'])}{i % 7}.{rng.choice(['com', 'org'])}"
        n = rng.choice([0, 1, 3, 10, 80])
        counts[host] = (n, sum(rng.random() < (0.9 if "bad" in host else 0.05) for _ in range(n)))
    df = spark.createDataFrame([(h, *v) for h, v in counts.items()], "host string, n long, bad long")
    told = brute_reputation(counts)
    for r in hosts.reputation(df).collect():
        assert (r.rate, r.above) == pytest.approx(told[r.host], abs=1e-4)
    assert any(p > 0.95 for _, p in told.values()) and any(0.05 < p < 0.95 for _, p in told.values())


def test_beta_above(spark):
    from pyspark.sql import functions as F

    pairs = [(0.01, 1.0), (1.0, 0.02), (0.5, 0.5), (3.0, 2.0), (60.0, 40.0), (50_000.0, 49_500.0), (0.3, 1000.0), (1000.0, 0.3), (20.0, 20.0)]
    for limit in (0.5, 0.2):
        found = spark.createDataFrame(pairs, "a double, b double").select("a", "b", hosts.beta_above(F.col("a"), F.col("b"), limit).alias("p")).collect()
        for r in found:
            assert r.p == pytest.approx(brute_above(r.a, r.b, limit), abs=2e-4)
    # a, b whole: the binomial sum
    tail = lambda a, b: sum(math.comb(a + b - 1, j) for j in range(a)) / 2 ** (a + b - 1)
    for a, b in ((3, 2), (7, 12), (20, 5)):
        assert spark.range(1).select(hosts.beta_above(F.lit(float(a)), F.lit(float(b)))).first()[0] == pytest.approx(tail(a, b), abs=1e-6)


def test_whole_url_query(spark, tmp_path):
    """Hosts with bad pages are blocked, with their SQL on the same tables."""
    import duckdb

    from spanmoor.llm import queries

    rng = random.Random(4)
    kinds = {"pills.spam.net": 0.97, "win.spam.net": 0.95, "news.fair.net": 0.05, "www.fair.net": 0.03, "a.shop.co.uk": 0.9, "b.home.co.uk": 0.02, "10.0.0.1": 0.9, "10.0.9.1": 0.05, "u:p@pills.spam.net:80": 0.97, "x.com": 0.1}
    pages, labels = [], []
    for i in range(1500):
        host = rng.choice(list(kinds))
        pages.append((i, f"http://{host.upper() if i % 9 == 0 else host}/{rng.choice(['en', 'de'])}/{10_000 + i}{rng.choice(['', '.html', '/', '?q=/1/2'])}", "<p>x"))
        if i % 2:
            bad = rng.random() < kinds[host]
            labels.append((10_000 + i, int(not bad) if i % 3 else 1, int(bad) if i % 3 == 0 else 0))
    pages += [(5000, "http://new.spam.net/fr/7", ""), (5001, "http://new.fair.net/fr/7", ""), (None, None, None), (None, "http://x.com/en/10001", "x"), (5002, "none", "x"), *pages[:5]]
    labels += [labels[0], (labels[1][0], 1, 1), (77, None, None), (None, 0, 0)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = queries.op8_url_filter(spark, str(tmp_path)).collect()
    assert len(found) == len(pages)
    told = {r.host: r.verdict for r in found if r.rule is None}
    blocked = {h for h, v in told.items() if v == "block"}
    assert blocked == {"pills.spam.net", "win.spam.net", "new.spam.net", "a.shop.co.uk", "10.0.0.1", "u:p@pills.spam.net:80"}
    db = duckdb.connect()
    for t in ("pages", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({hosts.JUDGE_SQL})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in columns)) for r in found)


# --- HTML --------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{a:b}</style><script>var t="</p><p>no";</script></head><body class="post">
<header><h1>Site name</h1><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div id="cookie-notice">We use cookies to make this site better for all of you.</div><!-- ad <p>no</p> --><div class="ad">Buy now.</div>
<article><header><h1>The &quot;title&quot;</h1></header><p><b>First</b>ly, a&nbsp;b
  c<br>d <a href="/x">linked words here</a> and more.<p>Short.</p><div class="comments"><p>Great article, I have read it twice today!</p></div>
<form><label>Your mail</label><input><button>Send</button></form><p>Last one &lt;b&gt;.</p></article>
<aside><p>Related: a long text beside the article which nobody wants to have in it at all.</p></aside><footer>&copy; all</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == 'The "title" Firstly, a b c d linked words here and more. Short. Last one <b>.'


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<article><p>A", "A"),
        ("<article><p>A &am", "A &am"),
        ("<article>cut <a hre", "cut"),
        ("<article>1 < 2 and 3 > 2</article>", "1 < 2 and 3 > 2"),
        ("<article><p>a</p><script>x", "a"),
        ("<nav>only a menu</nav>", ""),
        ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
        ("<article><p title='a > b'>q</p></article>", "q"),
        ("<main><p>In main.</p></main><div class='sidebar'>no</div>", "In main."),
        ("<article><p>a&#233;&#x41;</p></article>", "aéA"),
        ("<article class='search-story'><p>Found at last.</p></article>", "Found at last."),
        ("<article><p>One.</p><div class='legal-text'><p>The law of the land is told here at some length.</p></div></article>", "One. The law of the land is told here at some length."),
        ("<article><p>One.</p><div class='search'><p>Search</p><a href='x'>Go</a></div></article>", "One."),
        ("<article><p data-x=it's>q</p><p title='>'>r</p></article>", "q r"),
        ("<article><p data-x=\"it's\" y='\">'>q</p></article>", "q"),
        ("<article><header class='entry-header'><h1>Title</h1></header><p>q</p><div class=comment-body><p>I think that this is a very good article.</p></div></article>", "Title q"),
        ("<article data-class='menu'><p>q</p><!-- > --><!x><?y?></ z></article>", "q"),
        ("<article><p>a <! b> c</p></article>", "a c"),
        ("<div class='comments'><article class='comment'><p>Some reader says so.</p></article></div>", ""),
        ("<main><article class=post><p>Some text.</p></article><article class='related-post'><p>Other text.</p></article></main>", "Some text."),
    ],
)
def test_small_pages(page, text):
    assert html.main_text(page) == text


def test_blocks_against_a_parser():
    """Blocks of made pages are those that a plain HTML parser finds."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.text, self.quiet = [], "", 0

        def cut(self):
            if words := " ".join(self.text.split()):
                self.out.append(words)
            self.text = ""

        def handle_starttag(self, tag, attrs):
            if tag not in (*html.INLINE, "script"):
                self.cut()
            self.quiet += tag in ("script", "style")

        def handle_endtag(self, tag):
            if tag not in (*html.INLINE, "script"):
                self.cut()
            self.quiet -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.quiet:
                self.text += data

    rng = random.Random(5)
    attributes = ["", " class='a b'", ' title="x > y"', " data-x=it's", " hidden", ' id="n1" alt=\'"\'', " href=/a/b?c=d&amp;e=f"]
    texts = ["plain words", "a &amp; b", "1 < 2", "&eacute;&#65;", "  spread \n out ", "5 > 4", "it's"]

    def made(depth):
        if depth == 0 or rng.random() < 0.25:
            return rng.choice(texts)
        kind = rng.choice(["p", "div", "b", "a", "li", "h2", "span", "section", "!--", "br", "script", "em"])
        if kind == "!--":
            return "<!-- no <p>words</p> -->"
        if kind == "br":
            return "<br/>"
        inside = "var x = '<p>';" if kind == "script" else " ".join(made(depth - 1) for _ in range(rng.randint(0, 3)))
        return f"<{kind}{rng.choice(attributes)}>{inside}</{kind}>"

    for _ in range(400):
        page = f"<body>{' '.join(made(4) for _ in range(4))}</body>"
        reader = Reader()
        reader.feed(page)
        reader.close()
        reader.cut()
        got = [b[0] for b in html.blocks(page)]
        assert " ".join(got) == " ".join(reader.out) and got == reader.out, page


def test_tree_decides():
    """The tree knows its table, and words and links count under any name."""
    assert all(html.judge(html.tree(), r[:-1]) == bool(r[-1]) for r in html.TABLE)
    used = set()

    def walk(node):
        if not isinstance(node, int):
            used.add(node[0])
            walk(node[2])
            walk(node[3])

    walk(html.tree())
    assert {0, 1, 6, 7, 8} <= used
    prose = "Words of the article that go on for a while and have no links in them. " * 3
    links = "".join(f"<a href='{i}'>Other page {i}</a> " for i in range(9))
    assert html.main_text(f"<body><div class='tags'><p>{links}</p></div><div><p>{prose}</p><p>{prose}</p></div></body>").split() == (prose * 2).split()


def test_page_without_article():
    body = "<p>" + "words that make a paragraph of some length, as articles have, with a point. " * 3 + "</p>"
    found = html.main_text(f"<body><div><a href='x'>Menu one</a> <a href='y'>two</a></div><div>{body}{body}</div></body>")
    assert "Menu" not in found and found.count("paragraph") == 6


def test_long_page():
    assert len(html.main_text("<article>" + "<p>word <b>" * 50_000)) == 5 * 50_000 - 1
    for odd in ("<a b='", "<", "<a =", "<!--", "</", '<a b="c" d=', "<p class='x"):  # nothing is searched again and again
        assert html.main_text(odd * 50_000) is not None


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (None, None, None, 2), (3, "v", "", 3), (3, "v", "", 3)], "page_id long, url string, html string, text int")
    rows = html.extract(pages).orderBy("page_id").collect()
    assert [(r.page_id, r.url, r.n_chars) for r in rows] == [(None, None, 0), (1, "u", len(html.main_text(PAGE))), (3, "v", 0), (3, "v", 0)]
    assert html.extract(pages.where("false")).count() == 0


# --- search ------------------------------------------------------------------


def brute_top(rows, every=100, k=10):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    asked = {}
    for i, v in ok:
        if i % every == 0:
            asked[i] = max(asked.get(i, v), v)
    for q, v in asked.items():
        found = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v)))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block"), [(16_384, 1024), (90, 2)])
def test_top_k(spark, shard, block):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(12)]) for i in range(700)]
    rows += [(700 + i, rows[5][1]) for i in range(60)]  # ties
    rows += [(900, None), (1000, []), (1001, [float("nan")] * 12), (1100, [None] + [0.0] * 11), (1200, [float("inf")] * 12), (None, [0.5] * 12), (1300, [0.0] * 12), (1400, [0.5] * 3), (1401, [0.25, -0.5, 0.0]), (1500, [0.1] * 12), (1500, [0.2] * 12), (1600, [1e9] * 12)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string")
    exact = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    found = topk.top_k(df, shard=shard, block=block).collect()
    assert sorted(map(tuple, found)) == brute_top(exact)
    assert topk.top_k(df.where("false")).count() == 0


def test_threshold_stops_early():
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = (rng.normal(0, 30, (5000, 4))).astype(np.int64)
    vectors[7] = [900, 900, 900, 900]
    lists = topk.SortedLists(np.arange(5000), vectors)
    ids, scores = lists.search(-1, np.array([5, 4, 3, 2]), 1)
    assert ids.tolist() == [7] and scores.tolist() == [900 * 14]

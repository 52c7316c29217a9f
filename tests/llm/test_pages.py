"""The operators on pages, and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyarrow import fs

from tests.llm.conftest import text, with_clashes
from tidefold.llm import html_text, url_filter, warc
from tidefold.llm._shared import Tables

# 3: URL filters


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://A.example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12#f", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("x://a.com/de/1", "a.com", "/de/1", "com/de/", "block"),
        ("x://a.com/fr/1", "a.com", "/fr/1", "com/fr/", "allow"),
        ("x://example.org", "example.org", "", None, "allow"),
        ("http://a.net/p?u=http://b.com/de/", "a.net", "/p", None, "allow"),
        ("no url", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    got = url_filter.judge(spark.createDataFrame([(1, url, None)], "page_id long, url string, html string")).first()
    assert tuple(got) == (1, host, path, rule, verdict)


def link(to):
    return f'<html><head><link href="{to}" rel="canonical"></head></html>'


def test_aliases(spark):
    rows = [
        (1, "http://a.net/1", link("http://b.com/de/x")),  # blocked through its canonical address
        (2, "http://a.net/2", '<meta http-equiv="refresh" content="0; url=http://a.net/1">'),  # and through a redirect to it
        (3, "http://c.net/1", link("http://b.com/de/y")),
        (4, "http://c.net/1#again", link("http://d.org/z")),  # an allow in the component goes before the block
        (5, "http://b.com/de/y", None),  # a rule of its own stays
        (6, "http://e.net/", "<p>canonical</p>"),
        (7, None, link("http://b.com/de/x")),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string").drop("host"))).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow", 7: "allow"}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_relative_targets_and_several_rel_values(spark):
    refresh = '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "http://b.com/start", refresh.format("/de/x")),
        (2, "http://b.com/de2/start?q", link("../de/y#z")),
        (3, "http://a.net/1", refresh.format("//B.com/de/x")),
        (4, "http://a.net/2", '<link rel="alternate canonical" href="http://b.com/de/x">'),
        (5, "http://a.net/d/3", link("1-more")),
        (6, "http://a.net/d/1-more", link("http://b.com/de/x")),
        (7, "http://a.net/4", link("mailto:x@b.com/de/x")),
        (8, "http://a.net/5", '<link rel="canonical-not" href="/1">'),
        (9, "http://a.net/6", link("?again")),
        (10, "http://b.com", link("de/z")),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "allow" if k in (7, 8, 9) else "block" for k in range(1, 11)}


@pytest.mark.parametrize(
    "url,html,verdict",
    [
        ("http://a.net/i?id=1", link("http://b.com/de/q"), "block"),
        ("http://a.net/i?id=2", "<p>canonical</p>", "allow"),  # another query is another page
        ("http://a.net/i?id=1#part", None, "block"),
        ("http://a.net/j", link("/i?a=1&amp;id=1") + link("/i?id=1"), "block"),
        ("http://a.net/k", link("/k2?a=1&amp;b=2"), "block"),
        ("http://a.net/k2?a=1&b=2", link("//b.com/de/q"), "block"),
        ("http://a.net/l", f"<!-- {link('http://b.com/de/q')} -->", "allow"),
        ("http://a.net/m", f"<script>x = '{link('http://b.com/de/q')}'</script>", "allow"),
        ("http://a.net/n", f"<!-- never closed {link('http://b.com/de/q')}", "allow"),
        ("http://a.net/o", '<link data-rel="canonical" href="http://b.com/de/q">', "allow"),
        ("http://a.net/p", '<link rel=canonical data-href="http://b.com/de/q">', "allow"),
        ("http://a.net/q", '<LINK REL=CANONICAL HREF=http://b.com/de/q>', "block"),
        ("http://a.net/r", "<meta http-equiv='Refresh' content='5;URL=\"http://b.com/de/q\"'>", "block"),
        ("http://a.net/s", '<meta http-equiv="refresh" content="300">', "allow"),
        ("http://b.com/t?q", link("#x"), "allow"),
    ],
)
def test_links_and_queries(spark, url, html, verdict):
    rows = [(1, url, html), (2, "http://a.net/i?id=1", link("http://b.com/de/q")), (3, "http://a.net/k2?a=1&b=2", link("//b.com/de/q"))]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: verdict, 2: "block", 3: "block"}


def test_aliases_are_those_of_a_union_find_and_of_the_sql(spark):
    rng, rows = random.Random(5), []
    hosts = [f"{a}.{b}" for a in "abcdefgh" for b in ("net", "com", "org")] + ["x.example.org"]
    some = [f"http://{h}/{d}/{k}{q}" for h in hosts for d in ("p", "de", "fr", "es") for k in range(3) for q in ("", "?a=1", "?a=2")]
    hub = "http://hub.net/all?x=1"
    for k in range(1500):
        url, to = rng.choice(some), hub if rng.random() < 0.02 else rng.choice(some)
        kind = rng.random()
        rows.append((k, url, link(to) if kind < 0.15 else f'<meta http-equiv=refresh content="0; url={to}">' if kind < 0.2 else None))
    rows += rows[:40] + [(9000, hub, None), (9001, "http://z.net/" + "y" * 100_000, link(hub)), (9002, None, link(hub)), (None, hub, "x" * 3_000_000 + link("http://b.com/de/0"))]
    # chains of redirects, longer than a few rounds of the contraction
    rows += [(10_000 + k, f"http://chain.net/{k}", link(f"http://chain.net/{k + 1}")) for k in range(200)] + [(10_200, "http://chain.net/200", link("http://b.com/de/0?a=1"))]

    def address(url):
        h, _, rest = url.split("://", 1)[1].partition("/")
        return h.lower(), "/" + rest.split("?")[0], "?" + rest.split("?", 1)[1] if "?" in rest else ""

    def own(a):
        fits = [(len(h + p), v) for v, h, p in url_filter.RULES if (a[0] == h or a[0].endswith("." + h)) and a[1].startswith(p)]
        return max(fits)[1] if fits else None

    up = {}

    def root(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for _, url, html in rows:
        to = re.search("(?:href=\"|url=)([^\"]+)", html or "")
        if url and to:
            up[root(address(url))] = root(address(to[1]))
    theirs = {}
    for a in list(up):
        theirs.setdefault(root(a), set()).add(own(a))
    expected = Counter()
    for page, url, _ in rows:
        a = address(url) if url else None
        of = theirs.get(root(a), set()) if a in up else set()
        expected[page, "allow" if not url else own(a) or ("allow" if "allow" in of else "block" if "block" in of else "allow")] += 1
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = url_filter.judge(pages)
    assert Counter((r["page_id"], r["verdict"]) for r in got.collect()) == expected
    assert {"allow", "block"} == {v for (p, v) in expected}
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    assert Counter(con.execute(f"SELECT page_id, verdict FROM ({url_filter.ORACLE})").fetchall()) == expected


# 9: WARC


def test_round_trip(spark):
    big, bigger = "x" * 1500, "é" * 300_000
    rows = [(1, "u1", big), (2, "u2", big), (3, None, big), (4, "u4", "small"), (5, "u5", "small"), (6, "u6", bigger), (7, "u7", bigger), (8, "u8", None), (9, "a\r\nb", ""), (None, "n", big), (None, None, None), (3, None, big)]
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(3)
    expected = Counter()
    for p, _, h in rows:
        data = (h or "").encode()
        top = max((q for q, _, g in rows if g == h and q is not None), default=None) if len(data) >= 1000 else None
        revisit = top is not None and top != p
        expected[p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None] += 1
    assert Counter(map(tuple, warc.round_trip(pages).collect())) == expected
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_chunks_carry_incremental_digests(spark):
    html = "".join(chr(65 + i % 26) * 1000 for i in range(300))
    tables = Tables(spark, "t")
    root, index = warc.write_archives(spark.createDataFrame([(1, "u", html), (2, "v", "tiny\r\n\r\ntext")], "page_id long, url string, html string"), tables)
    where, path = fs.FileSystem.from_uri(root)
    assert any(f.base_name.endswith(".warc.gz") for f in where.get_file_info(fs.FileSelector(path)))
    rows = sorted(warc.read_archives(root, index).collect(), key=lambda r: (r["page_id"], r["chunk"]))
    mine = [r for r in rows if r["page_id"] == 1]
    assert len(mine) == -(-len(html) // warc.CHUNK) and [r["chunk"] for r in mine] == list(range(len(mine)))
    held = b""
    for r in mine:
        assert r["start"] == len(held) and r["size"] <= warc.CHUNK
        held += bytes(r["data"])
        assert r["digest"] == hashlib.sha1(held).hexdigest() and r["last"] == (len(held) == len(html))
    assert held.decode() == html
    assert bytes(rows[-1]["data"]) == b"tiny\r\n\r\ntext"


# 10: HTML extraction

ARTICLE = "<h1>A title &amp; more</h1><p>First <b>para</b>graph of   some length, which says a lot of things.</p><p>Second &eacute;&#233; one<br>with a break and more words to read.</p><p>Ti.</p>"
TEXT = "A title & more First paragraph of some length, which says a lot of things. Second éé one with a break and more words to read. Ti."


@pytest.mark.parametrize(
    "html,expected",
    [
        (None, ""),
        ("", ""),
        ("<p></p>", ""),
        (f"<html><head><title>T</title><style>p{{}}</style><script>var x='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article>{ARTICLE}</article><footer>&copy; me</footer></body></html>", TEXT),
        (f"<body><header><h2>Site</h2></header><aside>Side</aside><article>{ARTICLE}<form><input name=x><button>Send</button></form><div class='comments'><p>A reader says a long thing about this article, as readers do.</p></div></article>", TEXT),
        (f"<body><div id=cookie-notice>We use cookies.</div><div class='sidebar'><p>Other</p></div><main>{ARTICLE}</main>", TEXT),
        (f"<body><div class=top><a href=1>One</a> <a href=2>Two</a></div><div class=content>{ARTICLE}</div><div class='ad'>Buy this thing now, it is very good and cheap.</div>", TEXT),
        (f"<body><article>{ARTICLE}<p>cut off in the mid", TEXT + " cut off in the mid"),
        (f"<body><article><![if IE]>{ARTICLE}<!-- note --></article>", TEXT),
        (f"<body><div class='page with-sidebar'><article>{ARTICLE}</article><div class=sidebar><p>Other things that are here.</p></div></div>", TEXT),
        (f"<body><form id=aspnet><div id=menu><a href=1>One</a></div><div>{ARTICLE}</div></form>", TEXT),
        (f"<body><article>{ARTICLE}</article><section class=comments><article><p>{'A reader says a lot more than the article. ' * 20}</p></article></section>", TEXT),
        (f"<div id=header><p>Name of the site</p></div><div id=content>{ARTICLE}</div><div id=footer><p>Some words at the end.</p></div>", TEXT),
        (f"<article>{ARTICLE}<ul class='share-links'><li>Share</li></ul><aside><p>Aside of some length here.</p></aside></article>", TEXT),
        ("just a plain text", "just a plain text"),
        (f"<div class='post no-comments'>{ARTICLE}</div>", TEXT),
        (f"<article class='hentry comments-open'>{ARTICLE}</article><footer>me</footer>", TEXT),
        (f"<article class='ad-hoc-report'>{ARTICLE}</article><div class=ad>Buy now.</div>", TEXT),
        (f"<nav><a href=1>One</a></nav><div class='emergency-response responses'>{ARTICLE}</div>", TEXT),
        (f"<article>{ARTICLE}<section id=discussion><p>What this means is said here.</p></section></article>", TEXT + " What this means is said here."),
        (f"<body class=menu><div hidden>{ARTICLE}</div><div class=menu><a href=1>One</a></div></body>", TEXT),
        (f"<div class='post comments-open'>{ARTICLE}<div class=comments><p>A reader says so.</p></div></div><div class=sidebar><p>Other</p></div>", TEXT),
        (f"<div><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><div>{ARTICLE}<p><a href=3>All of this is a link.</a></p></div></div>", TEXT),
        (f"<main>{ARTICLE}<p><a href=3>All of this is a link.</a></p></main>", TEXT + " All of this is a link."),
        ("<p>a < b and &lt;tag&gt; &unknown; x</p>", "a < b and <tag> &unknown; x"),
    ],
)
def test_extraction(spark, html, expected):
    assert html_text.main_text(html) == expected


def test_extraction_on_tables(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>"), (None, None, None), (2, "v", "<article>" + "<p>word word.</p>" * 20_000), (2, "v", "<div>" * 5000 + "deep")]
    got = {(r["page_id"], r["n_chars"]) for r in html_text.extract(with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert got == {(1, len(TEXT)), (None, 0), (2, 20_000 * 11 - 1), (2, 4)}
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_markup_of_any_shape_takes_linear_time():
    import time

    n = 60_000
    shapes = ["<div>" * n + "</p>" * n, "<b>" * n + "<li>x</li>" * n, "<b>" * n + "</i>" * n, "<div class='ad'>" * n + "word " * 10, "".join(f"<div class='ad-{'x' * (k % 7)}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}'>w" for k in range(n)), "<p><a href=1>" * n, "<article>" * n + "text", "<td>" * n + "</table>" * n]
    for t in shapes:
        start = time.perf_counter()
        html_text.main_text(t)
        assert time.perf_counter() - start < 20, t[:30]


def brute_content(lines):
    """Ratios, kernel and threshold by their definitions, line by line."""
    import math

    ratio = [(len(t) - min(linked, len(t))) / tags for t, tags, linked, *_ in lines]
    r, out = max(1, math.ceil(2 * html_text.SIGMA)), []
    for k in range(len(ratio)):
        near = [j for j in range(k - r, k + r + 1) if 0 <= j < len(ratio)]
        w = [math.exp(-((j - k) ** 2) / (2 * html_text.SIGMA**2)) for j in near]
        out.append(sum(a * ratio[j] for a, j in zip(w, near, strict=True)) / sum(w))
    mean = sum(out) / len(out)
    return [x > html_text.THRESHOLD * math.sqrt(sum((y - mean) ** 2 for y in out) / len(out)) for x in out]


@pytest.mark.parametrize("tag", ["div", "section", "td"])
def test_pages_without_an_article(spark, sf, tag):
    """Ratio, smoothing and threshold against their definitions, and whole extractions where only they can tell."""
    import html
    import re

    close, caught, all_of = f"</{tag}>", 0, 0
    pages = [p["html"] for p in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    for page in pages:
        h = page.replace("<article>", f"<{tag}>").replace("</article>", close)
        lines = html_text._Lines()
        lines.feed(h)
        lines.close()
        lines.end_line()
        assert html_text.content_lines(lines.lines)[1].tolist() == brute_content(lines.lines)
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        plain = " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)).split())
        caught, all_of = caught + (html_text.main_text(h) == plain), all_of + 1
    assert caught >= 0.95 * all_of


def test_pages_of_the_test_tables(spark, sf):
    import html
    import re

    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", p["html"], re.S)[1]
        plain = re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)
        assert html_text.main_text(p["html"]) == " ".join(html.unescape(plain).split())


# the pipeline


def test_pipeline_stages_take_effect(spark, odd_docs, no_docs, sf):
    import corpus_pipeline

    docs, seen = odd_docs, [odd_docs.count()]
    tables = Tables(spark, "t")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == odd_docs.columns
        docs = tables.keep(out)
        seen.append(docs.count())
    # null, empty, blank and short texts go by the rules; of exact and near copies one stays
    assert seen[1] < seen[0] and seen[2] == seen[1] and seen[3] < seen[2] and seen[5] == seen[4]
    assert corpus_pipeline.STAGES[0][1](spark, no_docs, sf).count() == 0


def test_pipeline_finds_what_is_planted(spark, sf):
    import corpus_pipeline

    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    clean = [(i, text(i, 120), "en", f"s{i % 3}", 1) for i in range(30)]
    rows = clean + [(100, text(0, 120), "en", "s1", 1), (101, text(500, 60) + "\n" + item + "\n" + text(501, 60), "en", "s1", 1), (102, "shout IT OUT!! " * 30, "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    assert {r["doc_id"] for r in docs.collect()} == {i for i, *_ in clean}
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(kept[i] == t for i, t, *_ in clean)


def test_pipeline_keeps_one_row_of_a_group_with_repeated_and_null_ids(spark, no_docs, sf):
    import corpus_pipeline

    near = corpus_pipeline.STAGES[2][1]
    a, b, c, d = (text(i, 60) for i in (1, 2, 3, 4))
    rows = [
        (7, a), (7, a), (5, a), (None, a[:-9] + "other."),  # an id names the group, the least one
        (8, b), (8, b), (8, b[:-9] + "other."),  # an id that is repeated, with two texts
        (None, c), (None, c), (None, c[:-9] + "other."),  # no row of the group has an id
        (9, d), (None, ""), (None, None), (None, " "), (9, None), (10, ""), (10, ""),
    ]
    docs = with_clashes(spark.createDataFrame([(*r, "en", f"s{k}", 1) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")).repartition(3)
    out = near(spark, docs, sf)
    assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sum(t == a for _, t in got) == 1 and (5, a) in got and not any(i == 7 for i, _ in got)
    assert sum(i == 8 for i, _ in got) == 1 and sum(i == 9 for i, _ in got) == 2
    assert sum(i is None and bool((t or "").strip()) for i, t in got) == 1
    assert Counter(x for x in got if not (x[1] or "").strip()) == Counter(x for x in rows if not (x[1] or "").strip())
    assert near(spark, no_docs, sf).count() == 0


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="no column url, html"):
        url_filter.judge(spark.createDataFrame([(1,)], "page_id long"))


def test_damaged_payloads_raise():
    import io
    import zlib

    def record(digest):
        z, body = zlib.compressobj(wbits=31), b"HTTP/1.1 200 OK\r\n\r\npayload"
        head = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(body)}\r\n\r\n"
        return z.compress(head.encode() + body + b"\r\n\r\n") + z.flush()

    good, bad = record(hashlib.sha1(b"payload").hexdigest()), record(hashlib.sha1(b"another").hexdigest())
    assert [r[-1] for r in warc.stream_record(io.BytesIO(good), len(good))] == [b"payload"]
    with pytest.raises(ValueError, match="digest"):
        list(warc.stream_record(io.BytesIO(bad), len(bad)))

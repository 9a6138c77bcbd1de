import html as H
import re

from llm_fixtures import docs, empty  # noqa: F401

from clauselens.llm import wrappers as W
from clauselens.llm.markup import parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul>%s</ul></nav><div class="cookie-notice">We use cookies</div>
<aside class="sidebar"><p>Side</p></aside><div id="content"><article><h1>Title %d</h1><p>First &amp; %s</p><div class="ad">Buy</div>
<ul><li>one</li><li>two</li></ul><p>Second<br>line</p><form><p>Name</p></form></article></div>
<section id="comments"><p>Nice!</p></section><footer>&copy; x</footer></body></html>"""


def page(i, n=3):
    return PAGE % ("".join(f"<li><a href='/{k}'>m{k}</a></li>" for k in range(n)), i, "word " * i)


def test_wrapper_folds_repeats_and_marks_optional_items_and_slots():
    a = W.page_items(parse("<div><ul><li>a<li>b</ul><p>x</p></div>"))
    b = W.page_items(parse("<div><ul><li>c</ul><h2>h</h2><p>x</p></div>"))
    (div,) = W.align(a, b)
    kinds = {x[1]: x for x in div[4]}
    li = kinds["ul"][4][0]
    assert li[3] == 1 and li[4][0][4][0] is None          # repeated, and a slot
    assert kinds["h2"][2] == 1 and kinds["p"][2] == 0     # optional, required
    assert kinds["p"][4][0][4][0] is not None             # the same text: fixed
    (dl,) = W.page_items(parse("<dl><dt>a<dd>b<dt>c<dd>d</dl>"))
    assert dl[4][0][0] == "g" and dl[4][0][3] == 1        # a repeated group of two


def test_main_text_by_host_wrapper(spark):
    pages = [(i, f"http://{'big' if i % 3 else 'small'}.example/{i}", page(i, 1 + i % 4)) for i in range(1, 30)]
    pages += [(100, "http://big.example/c", page(3)[:400]), (101, None, None), (102, "http://lone.example/", ""),
              (103, "http://big.example/d", "<p>plain &lt;b&gt; text"), (1, "http://big.example/1", page(1)),
              (None, "http://div.example/", "<body><div class=menu><a>m</a></div><div class=story><p>Long story text</p><p>more</p></div></body>")]
    df = spark.createDataFrame([(*p, "t", "h", 0) for p in pages], "page_id long, url string, html string, text string, host string, n_chars int")
    out = W.extract(df).collect()
    assert len(out) == len(pages)
    for r in out:
        if r["page_id"] in range(1, 30):
            first = ("First & " + "word " * r["page_id"]).strip()
            assert r["text"] == f"Title {r['page_id']}\n{first}\none\ntwo\nSecond line"
        assert r["n_chars"] == len(r["text"])
    by = {r["page_id"]: r["text"] for r in out}
    assert by[101] == by[102] == "" and by[103] == "plain <b> text" and by[None] == "Long story text\nmore"
    assert W.extract(df.limit(0)).count() == 0


def test_names_that_only_mention_an_excluded_word_keep_the_article():
    article = "<article><div class='article-header'><h1>Title</h1></div><p>Text</p><div class='ad'>Buy</div></article>"
    for open_tag in ("<div class='content with-sidebar'>", "<div id='page-no-comments'>", "<div class='has-header'>",
                     "<div class='header-fixed'>", "<div class='sidebar'>"):
        assert W.main_text(f"<body>{open_tag}{article}</div></body>", None) == "Title\nText"
    for name in ("ad", "cookie-notice", "ad-slot-3", "post-comments", "sidebar_left", "site-header"):
        assert W.main_text(f"<body><article><p>Text</p><div class='x {name}'>Out</div></article></body>", None) == "Text"
    assert W.main_text("<body><div class='cookie'>We use cookies</div></body>", None) == ""
    assert W.main_text(f"<body><p>c</p><div class='sidebar'>{article}</div></body>", None) == "Title\nText"
    teaser = "<div class='related'><article><p>A much longer text of another article</p></article></div>"
    assert W.main_text(f"<body>{article}{teaser}</body>", None) == "Title\nText"


def test_hostile_markup_is_read():
    for bad in ("<", "a<b", "<scr", "<p <p>", "&#xZZ; &bogus; &amp", "<!-- open", "<script>never closed", "</div></div>x"):
        assert isinstance(W.main_text(bad, None), str)
    assert W.main_text("<div>" * 20_000 + "deep", None) == "deep"
    assert W.main_text("<article>" + "<p>x</p>" * 30_000 + "</article>", None).count("\n") == 29_999
    assert W.main_text("<article>a&nbsp;&nbsp;b\n\t c &#8364;</article>", None) == "a b c \u20ac"


def test_given_pages_against_a_plain_reader(spark):
    def plain(h):
        m = re.search(r"<article>(.*?)(</article>|$)", h, re.S)
        parts = re.split(r"<[^>]+>", re.sub(r"</?b>", "", re.sub(r"<[^>]*$", "", m[1]))) if m else []
        return "\n".join(" ".join(H.unescape(x).split()) for x in parts if x.strip())

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: plain(r["html"]) for r in df.collect()}
    assert {r["page_id"]: r["text"] for r in W.extract(df).collect()} == want


# ------------------------------------------------------------------ the wrapper makes the text

def extracted(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in W.extract(df).orderBy("page_id").collect()]


def test_fixed_texts_of_the_host_are_left_out_and_slots_stay(spark):
    pages = [f"<article><h1>Title {i}</h1><div>Share on X</div><p>Text {i} of it</p><ul><li><a href=x>More of our news</a></ul><p>Always said here</p>"
             f"<div>Author {i}</div><div>Part <b>{i}</b> of it</div></article>" for i in range(9)]
    got = extracted(spark, pages)
    assert got == [f"Title {i}\nText {i} of it\nAlways said here\nAuthor {i}\nPart {i} of it" for i in range(9)]
    # Without the wrapper the texts of the host stay; so they do on hosts with few different pages.
    assert [W.main_text(p, None) for p in pages] != got
    assert all("Share on X" in t for t in extracted(spark, pages[:4] * 5))


def test_readers_records_go_under_any_class_also_where_one_stands_alone(spark):
    def page(i, n):
        records = "".join(f"<div class='item'><span class='user'>Ann {k}</span><time>now</time><p>Nice {k}!</p></div>" for k in range(n))
        return f"<article><h1>T{i}</h1><p>Text {i}</p><p>And more {i}</p><div class='talk'>{records}</div></article>"

    pages = [page(i, n) for i, n in enumerate((3, 1, 0, 2, 1))]
    assert extracted(spark, pages) == [f"T{i}\nText {i}\nAnd more {i}" for i in range(5)]
    assert "Nice" in W.main_text(pages[1], None)              # one record alone says nothing
    # Repeated parts of an article that name nobody stay.
    steps = [f"<article><div class='step'><h2>Step {k}</h2><p>Do {k}</p></div><div class='step'><h2>Then {k}</h2><p>Go {k}</p></div></article>" for k in range(6)]
    assert extracted(spark, steps) == [f"Step {k}\nDo {k}\nThen {k}\nGo {k}" for k in range(6)]


def test_names_of_comments_and_notices():
    for name in ("discussion", "responses", "cookiebar", "commentlist", "thread", "site-discussion"):
        assert W.main_text(f"<article><p>Text</p><div class='{name}'>Out</div></article>", None) == "Text"
    assert W.main_text("<article><p>Text</p><div class='commentary'>In</div></article>", None) == "Text\nIn"


def test_own_header_stays_and_other_headers_go():
    assert W.main_text("<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>Text</p><header>Skip</header></article></body>", None) == "Title\nText"


def test_a_form_around_the_page_is_no_form(spark):
    page = "<body><form id='aspnetForm'>%s<form><p>Name</p><input></form></form></body>"
    assert W.main_text(page % "<article><h1>T</h1><p>Text</p></article>", None) == "T\nText"
    assert W.main_text(page % "<div><h1>T</h1><p>A long text of the page</p><p>and more of it</p></div>", None) == "T\nA long text of the page\nand more of it"
    assert W.main_text("<body><article><p>Text of the page that is long</p><form><p>Your name</p></form></article></body>", None) == "Text of the page that is long"
    assert extracted(spark, [page % f"<article><p>Text {i}</p></article>" for i in range(6)]) == [f"Text {i}" for i in range(6)]


def test_long_flat_pages_take_little_time_and_memory():
    import resource
    import time
    before, t0 = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.monotonic()
    pages = ["<article>" + "".join(f"line {k} of {p}<br>" for k in range(n)) + "</article>" for p, n in (("a", 50_000), ("b", 49_999))]
    w = W.merged(W.page_wrapper(pages[0]), W.page_wrapper(pages[1]))
    assert len(W.json.dumps(w)) < 10_000                       # folded, whatever the length
    assert W.main_text(pages[0], W.read_rules(W.json.dumps(W.host_rules(w)))).count("line") == 50_000
    mixed = [["<p>x</p>", "<h2>y</h2>", "<ul><li>z</ul>", "text", "<pre>q</pre>"][(k * k + s * k // 7) % 5] for s in (1, 5) for k in range(20_000)]
    W.merged(W.page_wrapper("<main>" + "".join(mixed[:20_000]) + "</main>"), W.page_wrapper("<main>" + "".join(mixed[20_000:]) + "</main>"))
    assert time.monotonic() - t0 < 60
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000     # KB


def test_unmatched_tags_do_not_stall():
    import time
    t0 = time.monotonic()
    parse("<div>" * 50_000 + "</section>" * 50_000 + "<li>" * 10)
    assert time.monotonic() - t0 < 5


def test_alignments_are_common_subsequences():
    import random
    rng = random.Random(2)
    for table in (250_000, 0):
        limit, W.MAX_TABLE = W.MAX_TABLE, table
        try:
            for _ in range(60):
                a, b = ([rng.choice("abcdefgh") + rng.choice(["", str(rng.randrange(30))]) for _ in range(rng.randint(0, 40))] for _ in range(2))
                pairs = W._common(a, b)
                assert all(a[x] == b[y] for x, y in pairs)
                assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        finally:
            W.MAX_TABLE = limit
    assert W._common(list("abcde"), list("abxde")) == [(0, 0), (1, 1), (3, 3), (4, 4)]


def test_wrapper_does_not_depend_on_the_order_of_pages(spark):
    pages = [f"<article><h1>T{i}</h1>" + "<p>x</p>" * (i % 4) + ("<div>Share on X</div>" if i % 2 else "<div>Share on X</div><ul><li>a</ul>") + f"<p>{i}</p></article>" for i in range(12)]
    df = spark.createDataFrame([(f"http://h.example/{i}", p) for i, p in enumerate(pages)], "url string, html string")
    import json
    rules = {json.dumps(W.host_rules(json.loads(W.host_wrappers(d).first()["wrapper"])))
             for d in (df.coalesce(1), df.orderBy(df.url.desc()).coalesce(1), df.repartition(7))}
    assert len(rules) == 1

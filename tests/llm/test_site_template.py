import time

from scoutline.llm.site_template import main_text, marked, parse, text_of


def text(page):
    return text_of(parse(page))


def test_article_without_chrome():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></ul></nav>
    <!-- ad --><div class="ad">Buy</div><header>Site</header><article><h1>Head  &amp; more</h1><p><b>One<br><p>Two <i>in</i>line &lt;x&gt;&nbsp;y<form>f</form><aside>s</aside>
    <section id="comments"><p>First!</p></section><div class="cookie-notice">c</div><p>Three &copy</article><footer>F</footer></body></html>"""
    assert text(page) == "Head & more\nOne\nTwo inline <x> y\nThree ©"


def test_repairs():
    assert text("") == ""
    assert text("plain & simple < 3") == "plain & simple < 3"
    assert text("<article><p>a<p>b &am") == "a\nb &am"
    assert text("<article><p>a</div></p></article>b") == "a"
    assert text("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "a\nb\nc\nd"
    assert text("<article><table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert text("<article>a<script>x</scrip") == "a"
    assert text('<article><p title="a > b">t</p><img alt="<p>">u') == "t\nu"
    assert text("<article>a<!-- open") == "a"
    assert text("<article>a <b") == "a"
    assert text("<p hidden>a</p><p style='display: none'>b</p><p>c") == "c"
    assert text("<main><div>a</div></main>x") == "a"
    assert text("<div role=main>a</div>x") == "a"


def test_deep_and_long_pages():
    assert text("<article>" + "<div>" * 20_000 + "x") == "x"
    assert len(text("<article><p>" + "word " * 200_000)) == 999_999
    assert text("<a '" * 2000) == ""


def test_recurring_subtrees_go_from_unmarked_pages(spark):
    rows = [(i, f"https://a.example/{i}", f"<div><span>Welcome</span><p>Top stories</p></div><div><p>Own {i}</p></div>", "k") for i in range(20)]
    rows += [(100 + i, "https://b.example/", f"<article><p>Same story</p></article><div>Own {i}</div>", "k") for i in range(20)]
    rows += [(200, "https://c.example/", "<div><p>Top stories</p></div>", "k"), (None, None, None, "k"), (0, "https://a.example/0", rows[0][2], "k")]
    got = sorted(((r.page_id or -1, r.text, r.n_chars) for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string, key string")).collect()))
    want = [(i or -1, f"Own {i}", 5 + (i > 9)) for i in range(20)] + [(-1, "Own 0", 5), (-1, "", 0)] + [(100 + i, "Same story", 10) for i in range(20)] + [(200, "Top stories", 11)]
    assert got == sorted(want)
    assert not marked(parse(rows[0][2])) and marked(parse(rows[25][2]))
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_recurring_subtrees_go_from_main_parts(spark):
    box, share = "<div><b>Jane Roe</b><p>writes on many things, for many years, and more often than not in long sentences.</p></div>", "<p>Pass it on</p>"
    page = lambda *own: f"<article><h1>Title {own[0]}</h1>{''.join(f'<p>{x}</p>' for x in own)}{box}{share}</article>"
    rows = [(i, "https://a.example/", page(f"Story {i}", f"Its end {i}")) for i in range(20)]
    rows += [(100 + i, "https://small.example/", page(f"Little {i}", f"Its end {i}")) for i in range(4)]
    rows += [(200 + i, "https://copies.example/", page("Same story", "Same end")) for i in range(20)]
    # Near copies: one paragraph of ten differs.
    rows += [(300 + i, "https://near.example/", page(*(f"Paragraph {j} of the story" + f" as told by {i}" * (j == i % 10) for j in range(10))).replace(box + share, "")) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(df).collect()}
    assert got == {r.page_id: r.text for r in main_text(df, broadcast=0).collect()}
    for i in range(20):
        assert got[i] == f"Title Story {i}\nStory {i}\nIts end {i}"
        assert got[200 + i] == text(rows[24][2])
    for i in range(4):
        assert got[100 + i] == f"Title Little {i}\nLittle {i}\nIts end {i}"
    for i, _, h in rows[44:]:
        assert got[i] == text(h)


def test_names_do_not_drop_the_main_part():
    story = "<article><p>Story</p></article>"
    for c in ("has-sidebar", "nav-open", "right-sidebar"):
        assert text(f"<html class={c}><body class='{c}'>{story}<nav>n</nav></body></html>") == "Story"
        assert text(f'<body><div class="{c}"><div id="{c}">{story}</div></div>') == "Story"
    assert text('<article class="post has-comments"><p>Story</p><div class="comments"><article>First!</article></div></article>') == "Story"
    assert text('<main id="login"><p>Story</p></main>') == "Story"
    assert text(f'<div class="comments"><article>First!</article></div>{story}') == "Story"
    assert text('<div class="page-nav"><main><p>Story</p></main></div><article>Teaser</article>') == "Story\nTeaser"
    assert text(f'<div class="page-nav">{story}<div class="comments"><article>First!</article></div></div>') == "Story"
    assert text('<body class="nav-open"><p>Story</p><div class="nav">n</div>') == "Story"


def test_attributes_are_read_by_name():
    assert text('<p>a <a href="/hidden-gems/">text</a> <a href=/hidden/>too</a></p><p title="a hidden treasure">b</p><p data-class="ad" data-role=menu>c</p>') == "a text too\nb\nc"
    assert text("<p title='class=ad'>a</p><p class = 'x AD'>b</p><p HIDDEN>c</p><p aria-hidden=true>d</p><p title=x hidden=''>e</p><p role=dialog>f</p><p id=ad>g</p>") == "a"
    assert text('<div data-role="main">a</div><p>b</p>') == "a\nb"


def test_headings_stay_whatever_their_id():
    assert text('<article><h2 id="social">Social life</h2><p>Story</p><h3 class="comments">On comments</h3></article>') == "Social life\nStory\nOn comments"
    assert text('<body class="single comments-open"><article><p>Story</p></article>') == "Story"
    assert text('<main class="content no-sidebar"><p>Story</p></main>') == "Story"


def recount(pages):
    """Templates of each host, by counting whole texts of elements over lists of pages; for pages of flat blocks only."""
    gone = {}
    for site in {s for s, _ in pages}:
        held = {tuple(blocks) for s, blocks in pages if s == site}
        least = min(8, max(3, -(-len(held) // 2)))
        for block in {b for blocks in held for b in blocks}:
            beside = [sorted((x for x in blocks if x != block), key=lambda x: (len(x), x), reverse=True) for blocks in held if block in blocks]
            beside = [(x + x[-1:] * 3)[:3] for x in beside if x]
            d = sorted(len({x[i] for x in beside}) for i in range(3))[1] if len(beside) >= 3 else 0
            if d >= least and d >= 0.01 * len(held) and 2 * d >= len(beside):
                gone.setdefault(site, set()).add(block)
    return gone


def test_same_as_a_recount_of_each_host(spark):
    import random

    r = random.Random(6)
    pages = []
    for i in range(240):
        site = r.choice(["a", "a", "b", "c", "d"])
        blocks = [f"story {i} line {j} " + "x" * r.randrange(40) for j in range(r.randrange(1, 5))]
        blocks += [f"box {site} {j} " + "y" * 7 * j for j in range(4) if r.random() < (0.1, 0.4, 0.7, 0.95)[j]]
        r.shuffle(blocks)
        pages.append((site, list(dict.fromkeys(blocks))))
    gone = recount(pages)
    assert sum(map(len, gone.values())) > 6
    rows = [(i, f"https://{s}.example/{i}", "<article>" + "".join(f"<div>{b}</div>" for b in blocks) + "</article>") for i, (s, blocks) in enumerate(pages)]
    got = {x.page_id: x.text for x in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join(" ".join(b.split()) for b in blocks if b not in gone.get(s, ())) for i, (s, blocks) in enumerate(pages)}


def test_rows_without_ids_and_clashing_names(spark):
    df = spark.createDataFrame([(None, None, f"<p>own {i}</p>", 1, "s", []) for i in range(30)] + [(1, None, "", 2, "t", [])], "page_id long, url string, html string, key long, site string, cut array<long>")
    assert sorted(x.text for x in main_text(df, broadcast=-1).collect()) == sorted([f"own {i}" for i in range(30)] + [""])


def test_only_whole_names_and_plain_compounds_name_an_element():
    kept = '<div class="share-price"><p>Shares fell 4 %.</p></div><table class="ad-spend"><tr><td>Spend</td></tr></table><section id="related-work"><p>Work</p></section>'
    kept += '<ul class="menu"><li>Soup</li></ul><p class="widget-intro">Intro</p><p>x <math><mi>y</mi></math></p>'
    gone = '<ul class="menu main-menu"><li><a href="/">Home</a></li></ul><div class="related-posts"><a href=x>Other</a> by us</div><div class="ad">Buy</div><div id="comment-list"><p>First</p></div>'
    assert text_of(parse(f"<article><p>t</p>{kept}{gone}</article>")) == "t\nShares fell 4 %.\nSpend\nWork\nSoup\nIntro\nx y"
    assert text_of(parse('<ul class="menu"><li>Soup</li></ul><p>t</p>')) == "t"


def test_time_does_not_grow_with_depth_times_length():
    pages = ["<div>" * 200_000, "<div>" * 20_000 + "</x>" * 100_000, "<b>" * 30_000 + "<div>" * 30_000, "<table><tr><table>" + "<b>" * 20_000 + "<td></td>" * 30_000, "<ul>" + "<b>" * 20_000 + "<li>x" * 30_000]
    for page in pages:
        began = time.process_time()
        text_of(parse(page))
        assert time.process_time() - began < 20


def test_nested_templates_as_a_recount(spark):
    page = lambda i: f"<article><div><section><p>Own text number {i} of this page</p><div><div><p>By our staff</p></div><p>Follow</p></div></section></div></article>"
    rows = [(i, f"http://h{i % 2}.org/{i}", page(i) if i % 2 == 0 else f"<article><p>Own {i}</p></article>") for i in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Own text number {i} of this page" if i % 2 == 0 else f"Own {i}" for i in range(80)}
    for broadcast in (10**6, 0):
        assert {r.page_id: r.text for r in main_text(df, broadcast).collect()} == want

import re

from corpusloom.llm import htmlmain, queries



def path(steps):
    found = 0
    for step in steps.split(">")[1:]:
        found = htmlmain.below(found, step)
    return found


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><!-- note --><div class="ad">Buy</div>
<div class="cookie-notice">We use cookies, many of them, on every page that you will ever see here.</div>
<article><header><h1>Title&nbsp;here</h1></header><p><b>First  line<br>goes on<p>Second &lt;one&gt; &eacute;t&#233;.</p>
<form><p>Search this</p><input value="x"></form><aside>Side</aside><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>
<section class="comments"><p>Reader says a lot of things here, more than the article does itself, surely and certainly.</p></section></article>
<footer>&copy; x</footer></body></html>"""


def test_blocks_and_boilerplate():
    want = "Title here\nFirst line goes on\nSecond <one> été.\na\nb\nc\nd"
    assert htmlmain.main_text(PAGE, []) == want
    assert htmlmain.main_text(PAGE, [htmlmain.vote(PAGE)]) == want
    assert htmlmain.vote(PAGE) == path(">article")


def test_names_in_content():
    """Sections, headings and items of an article whose names hold a word that boilerplate has too."""
    kept = (
        "<h2 id='related-work'>Work</h2><section id='discussion'><p>We discuss it.</p></section><section class='discussion'><p>Again.</p></section><h2 id='ad-hoc-networks'>Nets</h2>"
        "<p class='alert alert-info'>Mind this.</p><div class='share-price'>12.50</div><ul><li class='menu-item'>Soup</ul><section id='comments'><p>Our remarks.</p></section>"
    )
    gone = (
        "<div class='related'><a href=/1>Read one</a> <a href=/2>Read two</a></div><div id='sidebar'>Side</div><div class='td-sidebar'>Side</div><div class='site-footer'>Foot</div>"
        "<div class='cookie-notice'>Cookies</div><div class='comments'>Reader</div><div class='social-share'>Tweet</div><div id='related-work'><a href=/3>More</a></div>"
    )
    for tag in ("article", "div class=text"):
        page = f"<body><{tag}><p>Begin here.</p>{kept}{gone}<p>The end.</p></{tag.split()[0]}></body>"
        want = "Begin here.\nWork\nWe discuss it.\nAgain.\nNets\nMind this.\n12.50\nSoup\nOur remarks.\nThe end."
        assert htmlmain.main_text(page, [path(">article" if tag == "article" else ">div.text")]) == want


def test_states_and_layouts():
    """Class names that tell a state or the layout, and named elements that hold the page."""
    for name in ("content has-sidebar", "page no-sidebar", "post comments-open", "sidebar-open", "main with-navbar", "site-content menu-closed"):
        for tag in ("body", "div"):
            page = f"<body><{tag} class='{name}'><div class=text><p>All of the text.</p><p>And more.</p></div></{tag}></body>"
            assert htmlmain.main_text(page, []) == "All of the text.\nAnd more.", name
    inside = "<p>Before it.</p><section class='related-work'><p>Others did so.</p></section><div class='share-price'>12</div><p>Where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p>"
    assert htmlmain.main_text(f"<article>{inside}</article>", []) == "Before it.\nOthers did so.\n12\nWhere x=1 holds."
    whole = "<body><form id=aspnet><div class=widget><p>A page in a form and a widget.</p><div class=sidebar>Side</div></div></form><div class=footer>Foot</div></body>"
    assert htmlmain.main_text(whole, []) == "A page in a form and a widget."


MARKED = [
    ("<body class=blog><div id=top><div class=logo>Site</div></div><div class=navbar><a href=/>Home</a></div><div class=wrap><div class=post-body><h1>One</h1><p>First part of it.</p>"
     "<blockquote>Said so.</blockquote><p>Last part, with <a href=/x>a link</a> in it.</p></div><div class=widget>Popular</div></div><div id=footer>(c)</div></body>", "One\nFirst part of it.\nSaid so.\nLast part, with a link in it."),
    ("<body><table><tr><td class=nav><a href=/>A</a> <a href=/b>B</a></td><td class=body><h2>Old page</h2><p>Laid out by a table, as they were.</p><p>Two blocks.</p></td></tr></table></body>", "Old page\nLaid out by a table, as they were.\nTwo blocks."),
    ("<div role=navigation>Menu</div><div id=content class='clearfix main-content'><h1>Two</h1>Loose text here that has no paragraph of its own.<ul><li>eins<li>zwei</ul></div><div class='comments-area'><p>Reader one</p><p>Reader two</p></div>",
     "Two\nLoose text here that has no paragraph of its own.\neins\nzwei"),
]


def test_pages_without_article():
    for page, want in MARKED:
        assert htmlmain.main_text(page, []) == want


def test_host_paths_follow_the_page(spark):
    """A winning path around the page's own one doesn't overrule it; a ninth template has its own consensus."""
    head = "<div class=tools><p>Print this page Text size A A A Top stories today</p></div>"
    story = f"<body><div class=wrap>{head}<div class=story><p>{'The story goes on. ' * 8}</p></div></div></body>"
    plain = f"<body><div class=wrap><p>{'Written right into the wrap. ' * 8}</p></div></body>"
    rows = [(k, f"http://h.org/{k}", plain if k < 30 else story) for k in range(40)]
    rows += [(100 * t + k, f"http://many.org/{t}/{k}", f"<body><div class=lead><p>x</p></div><div class=t{'abcdefghijkl'[t]}><p>{'Template text. ' * 9}</p></div></body>") for t in range(12) for k in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.url): r.text for r in htmlmain.extract(df).collect()}
    assert got["http://h.org/35"] == " ".join(["The story goes on."] * 8) and got["http://h.org/3"] == " ".join(["Written right into the wrap."] * 8)
    assert all(t == " ".join(["Template text."] * 9) for u, t in got.items() if "many.org" in u)
    assert htmlmain.host_paths(df).where("host = 'many.org'").first().paths.__len__() == 12


ARTICLE = "<div class=post><h1>Title</h1><p>What the article says.</p><p>And its end.</p></div>"
SAID = "A reader says much more than the article ever did, and says it all over again. " * 4


def thread(name, tag="div", n=5):
    return f"<div {name}><{tag} class=c-list>" + "".join(f"<{'li' if tag in ('ul', 'ol') else 'div'} class='item depth-{k}'><p>{SAID}</p></{'li' if tag in ('ul', 'ol') else 'div'}>" for k in range(n)) + f"</{tag}></div>"


def test_long_threads():
    """Readers' comments longer than the article: by their names, and by their marks alone."""
    want = "Title\nWhat the article says.\nAnd its end."
    for name in ("id=comments class=comments-area", "class=user-comments", "class=reader-comments", "class=fb-comments", "class=commentlist", "id=disqus_thread", "class='post-comments wide'", "class=comment-section"):
        for tag in ("ol", "div"):
            page = f"<body><div class=wrap>{ARTICLE}{thread(name, tag)}</div></body>"
            assert htmlmain.main_text(page, []) == want, (name, tag)
            assert htmlmain.vote(page) == path(">div.wrap>div.post")
    marked = [
        "<div class=m><span class=author>Ann</span> <time>May 1</time><p>{}</p></div>",
        "<li class=m><img class=avatar src=x><span class=posted>May 1</span><div>{}</div></li>",
        "<div class=m><b>Ann</b><p>{}</p><a href=#r>Reply</a></div>",
        "<article class=m><p>{}</p><a href=#r class=reply-link>&rarr;</a></article>",
    ]
    for block in marked:
        page = f"<body><div class=wrap>{ARTICLE}<div class=talk>{''.join(block.format(SAID) for _ in range(4))}</div></div></body>"
        assert htmlmain.main_text(page, []) == want, block
    wordpress = f"<body><main>{ARTICLE}<section class=responses><ol>{''.join(f'<li class=comment><article class=comment-body><p>{SAID}</p></article></li>' for _ in range(3))}</ol></section></main></body>"
    assert htmlmain.main_text(wordpress, []) == want


def test_no_threads():
    """What bears some of the marks, or all of the page, is kept."""
    by = "<div class=post><h1>Title</h1><p class=byline>By <span class=author>Ann</span>, <time>May 1</time></p><p>The text of it.</p></div>"
    assert htmlmain.main_text(f"<body>{by}</body>", []) == "Title\nBy Ann, May 1\nThe text of it."
    parts = "".join(f"<div class=entry><h2>Day {k}</h2><span class=author>Ann</span> <time>May {k}</time><p>Long entry of a diary, part by part.</p></div>" for k in range(2))
    assert htmlmain.main_text(f"<body><article><h1>Diary</h1>{parts}</article></body>", []).count("Long entry") == 2
    assert htmlmain.main_text("<body><div class='single comments-open'><p>All.</p></div></body>", []) == "All."
    assert htmlmain.main_text(f"<body><div id=comments-page-wrap class=comments>{ARTICLE}</div></body>", []) == "Title\nWhat the article says.\nAnd its end."
    assert htmlmain.main_text("<body><div class=commentary><p>On the second verse.</p></div></body>", []) == "On the second verse."


def test_bars_and_adverts():
    gone = (
        "<div class=google-ad>Buy this</div><div class=cookiebar>We use cookies</div><div id=cookie-law-info-bar class=cookie-law-info>More cookies</div>"
        "<ul id=topnav><li>Home</li><li>About</li></ul><div class=sharebar>Tweet</div>"
    )
    assert htmlmain.main_text(f"<body><div class=wrap><div class=text><p>One text.</p>{gone}<p>Its end.</p></div></div></body>", [path(">div.wrap>div.text")]) == "One text.\nIts end."


def test_host_path_outweighs_the_page(spark):
    """Two pages of a host whose other eight vote for the article: blocks without marks, longer than the article, don't win."""
    page = lambda talk: f"<body><div class=story><p>{'The article of the page. ' * 6}</p></div><div class=talk>{talk}</div></body>"
    rows = [(k, f"http://h.org/{k}", page("<p>No remarks.</p>" if k < 8 else "<p>Chatter of the readers. </p>" * 20)) for k in range(10)]
    got = htmlmain.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {" ".join(["The article of the page."] * 6)}
    led = htmlmain.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    assert led.votes == [8, 2] and led.paths[0] == path(">div.story")


def test_clashing_names(spark):
    names = ["paths", "_paths", "host", "_host", "_led_host", "_led_paths", "n_chars", "path", "n"]
    df = spark.createDataFrame([(1, "http://a/", "<p>x", "t", *range(9)), (1, "http://a/", "<p>x", "t", *range(9))], "page_id long, url string, html string, text string, " + ", ".join(f"{n} int" for n in names))
    got = htmlmain.extract(df).collect()
    assert [(r.text, r.n_chars, r.paths, r._led_paths, r.n) for r in got] == [("x", 1, 0, 5, 8)] * 2


def test_odd_html():
    for page in (None, "", "<", "<div", "plain & simple", "<p>a<p>b", "</p></div>", "<a href='x>y", "<script>never ends", "<!-- never ends", '<p class="x>y</p>'):
        assert isinstance(htmlmain.main_text(page, []), str)
    assert htmlmain.main_text("plain &amp; simple", []) == "plain & simple"
    assert htmlmain.main_text("<div>" * 20_000 + "<p>deep</p>" + "</div>" * 20_000, []) == "deep"


def test_consensus_beats_own_choice(spark):
    usual = "<body><div class=box1><p>" + "long text " * 20 + "</p></div><div class=talk><p>hi</p></div></body>"
    odd = "<body><div class=box2><p>short text</p></div><div class=talk><p>" + "chatter " * 60 + "</p></div></body>"
    rows = [(k, f"http://h.org/{k}", usual) for k in range(5)] + [(9, "http://h.org/9", odd), (10, None, None), (10, None, None)]
    got = {r.page_id: r for r in htmlmain.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9].text == "short text" and got[9].n_chars == 10 and got[10].text == ""


def test_pages(spark, sf):
    """The pages' articles, cut out by a pattern and stripped, are the brute-force version."""
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op9_main_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id])[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b), r.page_id
        assert r.n_chars == len(r.text)


def test_empty_table(spark):
    assert htmlmain.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

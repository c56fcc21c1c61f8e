"""Python functions against plain versions and fixed cases."""

import random
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import fuzzy, html, text, urls
from corpusloom.operators import chunking


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for k, y in enumerate(b, 1):
            row[k], prev = (prev + 1 if x == y else max(row[k], row[k - 1])), row[k]
    return row[-1]


def plain_partial(a, b):
    short, long = sorted((a, b), key=len)
    if not long:
        return 100.0
    if not short:
        return 0.0
    n = len(short)
    windows = [long[max(0, k) : k + n] for k in range(-n + 1, len(long))]
    return max(200.0 * lcs(short, w) / (n + len(w)) for w in windows if w)


@settings(max_examples=300, deadline=None)
@given(st.text("abcd ", max_size=14), st.text("abcd ", max_size=30))
def test_ratios(a, b):
    want = plain_partial(a, b)
    assert abs(fuzzy.partial_ratio(a, b) - want) < 1e-9
    for cutoff in (40.0, 75.0, 90.0):
        got = fuzzy.partial_ratio(a, b, cutoff)
        assert abs(got - want) < 1e-9 if want >= cutoff else got == 0.0
    total = len(a) + len(b)
    assert abs(fuzzy.ratio(a, b) - (200.0 * lcs(a, b) / total if total else 100.0)) < 1e-9


def test_long_windows():
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgh ", k=900))
    short = list(long[300:420])
    for k in rng.sample(range(120), 12):
        short[k] = "z"
    assert abs(fuzzy.partial_ratio("".join(short), long) - plain_partial("".join(short), long)) < 1e-9
    assert SequenceMatcher


def test_fragments():
    assert text.fragments("one two three") == ("one two three",) * 2
    assert text.fragments("one, two three") == (None, None)
    assert text.fragments("a, b c d e f g") == ("b c d e f",) * 2
    words = " ".join(f"w{k}" for k in range(30))
    assert text.fragments(words) == ("w0 w1 w2 w3 w4", "w25 w26 w27 w28 w29")
    assert text.fragments("x, a b " * 10) == ("a b", "a b")
    assert text.fragments(None) == (None, None)


def test_filenames(spark):
    rows = spark.createDataFrame([("Été à Genève (1).PDF",), ("a%20b.docx",), (None,), ("__x__.md",)], "n string")
    got = [r[0] for r in rows.select(urls.safe_filename("n")).collect()]
    assert got == ["Ete_a_Geneve_1.PDF", "a_b.docx", None, "x.md"]


def test_url_rules(spark):
    cases = [("http://a.b/about/x", "about", True), ("http://a.b/about", "about", False), ("http://a.b/about-us/", "about", False), ("http://a.b/about/x#page=5", "/about/", True), ("not a url", "x", False), ("http://a.b/x", "", True)]
    df = spark.createDataFrame(cases, "url string, prefix string, want boolean")
    for url, prefix, want in cases:
        assert df.where(F.col("url") == url).select(urls.under_prefix(F.col("url"), prefix)).first()[0] == want
    strict = df.limit(1).select(urls.normalized_strict(F.lit("HTTP://A.b:80/x?b=2&a=1#f"))).first()[0]
    assert strict == "http://a.b/x?a=1&b=2"


def test_html_functions():
    page = "<nav>n</nav><div class='menu x'>m</div><h1>T</h1><p>one<p>two <a href='/l'>link</a><a href='/e'></a><script>var a='</p>'</script>"
    assert html.flat_links(html.without_boilerplate(html.tree(page))).text() == "T one two link"
    assert html.knowledge_text("<h2>A</h2><ul><li>x<li>y</ul><table><tr><td>1<td>2</table>") == "## A\n- x\n- y\n\n1 | 2"
    assert html.markdown("<h1>A</h1><p>b <b>c</b> <a href='u'>d</a></p><ul><li>e</li></ul>") == "# A\n\nb **c** [d](u)\n\n* e"
    assert html._sanitised("<p style='x' id=a onclick=b>t<script>s</script></p>") == '<p id="a">t</p>'


def test_chunk_functions():
    text_ = "\n## h\n" + "word " * 700 + "\n\n" + "next " * 100
    parts = chunking.recursive_chunks(text_)
    assert parts and all(len(p) <= 1700 for p in parts) and chunking.recursive_chunks("short") == ["short"]
    chunks = chunking.sentence_chunks("A b c. " * 400)
    assert all(len(chunking._TOKEN.findall(c)) <= 512 for c in chunks) and len(chunks) > 3
    t = "x" * 900 + "\n\n" + "y" * 900
    assert chunking.best_cut(t, 1000) == 902 and chunking.best_cut("z" * 100, 50) == 50

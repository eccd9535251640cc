import html
import re

import pytest

from branchwise.llm import html_text as H

LONG = "The story of the town is that it was built on the river and that the people of the place have been here for ages."

PAGES = [
    (None, ""), ("", ""), ("<p></p><br>", ""), ("just text &amp; more", "just text & more"),
    (f"<body><nav><a href=x>Home</a></nav><article><h1>A &lt;b&gt;</h1><p>{LONG}</p><p>Short one.</p></article><footer>{LONG}</footer>",
     f"A <b>\n\n{LONG}\n\nShort one."),
    (f"<div class='wrap sidebar-layout'><main><header><h1>Title</h1><p>by me</p></header><p>{LONG}<br>next\n line<br><br>new</p></main></div>"
     f"<section id=comments><article><p>{LONG}</p></article></section>", f"Title\n\n{LONG} next line\n\nnew"),
    (f"<article><p>{LONG}</p><aside><p>{LONG}</p></aside><div class='share-bar'>Share</div><div class=\"cookie-notice\"><p>{LONG}</p></div>"
     f"<form><p>{LONG}</p></form><div class='comment-list'><p>{LONG}</p></div><p>End.</p></article>", f"{LONG}\n\nEnd."),
    (f"<div><p><a href=1>One link that is quite long</a> <a href=2>Another link, long too</a></p><p>{LONG}</p><p>Brief.</p></div>",
     f"{LONG}\n\nBrief."),
    (f"<p>{LONG}</p><script>var t='</p><p>no';</script><!-- no --><style>p{{}}</style><p>&copy; someone, of the year</p>", LONG),
    ("<article><p>Xyzzy plugh frotz gnusto rezrov blorb nitfol ozmoo bozbar espnis foblub cleesh</p></article>",
     "Xyzzy plugh frotz gnusto rezrov blorb nitfol ozmoo bozbar espnis foblub cleesh"),
    ("<article><p>only short</p></article>", "only short"),
    (f"<p>{LONG}<div>{LONG}</div><b>{LONG}", "\n\n".join([LONG] * 3)),
    ("<p>" + "the word " * 200000 + "</p>", ("the word " * 200000).strip()),
    (f"<p>{LONG}</p><p hidden>{LONG}</p><p style='display: none'>{LONG}</p>", LONG),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_pages(page, text):
    assert H.main_text(page) == text


def test_inheritance_looks_both_ways():
    blocks = [(LONG, 0, 0, False), ("tie of two", 0, 0, False), (LONG, 0, 0, True), ("zz", 0, 0, False), ("zz", 0, 0, False)]
    assert H.first_pass(blocks) == [True, None, False, None, None]
    assert H.second_pass(blocks, H.first_pass(blocks)) == [True, True, False, False, False]


def test_rows_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(None, None, "u", 5), (1, f"<p>{LONG}é𝄞</p>", None, 5), (1, f"<p>{LONG}é𝄞</p>", None, 5)],
                               "page_id long, html string, url string, n_chars int")
    got = H.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and dict(got.dtypes)["n_chars"] == "bigint"
    assert sorted((r.text, r.n_chars) for r in got.collect()) == [("", 0)] + [(LONG + "é𝄞", len(LONG) + 2)] * 2
    assert H.extract(df.limit(0)).count() == 0


def test_query_against_the_articles_of_the_given_table(spark):
    """In the given pages the article element is the main text; a pattern finds its blocks."""
    sf = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want[r.page_id] = "\n\n".join(x for x in blocks if x)
    got = {r.page_id: r.text for r in H.op2_html_text(spark, sf).collect()}
    assert got == want


def test_long_paragraphs_poor_in_stop_words_without_an_article():
    polish = ["Miasto zbudowano nad rzeką przed wieloma laty, kiedy kupcy szukali bezpiecznej przystani dla swoich statków.",
              "Mieszkańcy opowiadają dzieciom, jak dawniej wyglądały ulice, targi, warsztaty oraz stare drewniane mosty."]
    nav, foot = "<nav><a href=x>Start</a></nav>", "<footer><p>Wszystkie prawa</p></footer>"
    links = "<p><a href=1>Pierwszy odnośnik prowadzi bardzo daleko</a> <a href=2>Drugi odnośnik też prowadzi daleko</a></p>"
    body = "".join(f"<div>{p}</div>" for p in polish)
    assert H.main_text(nav + body + foot) == "\n\n".join(polish)
    assert H.main_text(f"{nav}<p>{LONG}</p>{body}<p>{LONG}</p>{foot}") == "\n\n".join([LONG, *polish, LONG])
    assert H.main_text(f"<p>{LONG}</p><p>Kort.</p><p>Kort.</p>{links}<p>{polish[0]}</p>{links}") == f"{LONG}\n\nKort."


def test_given_pages_with_a_div_for_the_article(spark):
    """Every long block of the article is found again."""
    lost = long = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        want = [x for x in H.main_text(r.html).split("\n\n") if len(x) >= H.LONG]
        got = H.main_text(re.sub(r"<(/?)article\b", r"<\1div", r.html)).split("\n\n")
        long, lost = long + len(want), lost + len(set(want) - set(got))
    assert long > 500 and lost == 0, (long, lost)


def test_a_teaser_article_does_not_hide_the_page():
    body = [LONG, LONG.replace("town", "city"), LONG.replace("town", "port")]
    page = "<div class=content>" + "".join(f"<p>{p}</p>" for p in body) + f"</div><article><p>{LONG.replace('town', 'farm')}</p></article>"
    assert H.main_text(page).split("\n\n")[:3] == body
    assert H.main_text(f"<p>{LONG}</p><article><p>{body[1]}</p><p>{body[2]}</p></article>") == "\n\n".join(body[1:])


@pytest.mark.parametrize("name", ["form-factor", "legal-news", "social-history", "search-engines", "related", "hidden-gems", "searchEngines"])
def test_names_of_subjects_drop_nothing(name):
    assert H.main_text(f"<p>{LONG}</p><div class='{name}'><p>{LONG}</p></div><p>{LONG}</p>") == "\n\n".join([LONG] * 3)


@pytest.mark.parametrize("name", ["share-bar", "cookie-notice", "comment-list", "comments", "navBar", "top-menu", "sidebar", "newsletter_box", "ad"])
def test_names_of_boilerplate_drop_their_blocks(name):
    assert H.main_text(f"<p>{LONG}</p><div class='{name}'><p>{LONG}</p></div>") == LONG
    assert H.main_text(f"<p>{LONG}</p><div class='related'><p>Short one</p></div>") == LONG


def test_unclosed_tags_take_linear_time():
    import time

    n = 60_000
    for page in ("<b>x" * n + "</i>" * n, "<i>x" * n + "<div>" * n + "</i>" * n, "<a href=x>y" * n, "<p><b>" * n + "</p></b>" * n, "<div>x" * n + "</div>" * n):
        began = time.perf_counter()
        H.main_text(page)
        assert time.perf_counter() - began < 20


def test_links_count_however_deep_and_anchors_do_not():
    deep = "<b>" * 20
    assert H.main_text(f"<p>{LONG}</p><p><a href=x>{deep}{LONG}</a></p>") == LONG
    assert H.main_text(f"<a name=top><p>{LONG}</p><p>{LONG}</p>") == f"{LONG}\n\n{LONG}"


def plain_passes(blocks):
    """Both passes by looking left and right from each block."""
    def dense(text):
        words = H._WORD.findall(text.lower())
        return len(text) >= H.LONG and sum(w in H.STOP_WORDS for w in words) >= H.MIN_STOPS * max(len(words), 1)

    first = [False if b[3] and not (b[3] == H.WEAK and dense(b[0])) or b[1] > H.MAX_LINKS * len(b[0]) or b[0].startswith("©") else
             True if dense(b[0]) else None for b in blocks]

    def around(k, labels, allowed):
        for d in range(1, len(allowed)):
            at = allowed.index(k)
            sides = [labels[allowed[i]] for i in (at - d, at + d) if 0 <= i < len(allowed) and labels[allowed[i]] is not None]
            if sides:
                return sides
        return []

    labels = list(first)
    plain = [k for k, b in enumerate(blocks) if not b[2] and not b[3]]
    for k in plain:
        if first[k] is None and len(blocks[k][0]) >= H.LONG:
            found = around(k, first, plain)
            labels[k] = True if not found else found[0] if len(found) == 1 else any(found)
    out = list(labels)
    for k, b in enumerate(blocks):
        own = [i for i, c in enumerate(blocks) if c[2] == b[2] and not (c[2] and c[3])] if b[2] else list(range(len(blocks)))
        if b[2] and b[3]:
            continue
        if b[2] and not any(first[i] for i, c in enumerate(blocks) if c[2] == b[2]):
            out[k] = labels[k] is not False
        elif labels[k] is None:
            found = around(k, labels, own)
            tie = any(w in H.STOP_WORDS for w in H._WORD.findall(b[0].lower()))
            out[k] = True if not found else found[0] if len(set(found)) == 1 else tie
    sizes = [sum(len(b[0]) for b, x in zip(blocks, out) if x and bool(b[2]) == within) for within in (True, False)]
    return [bool(x and (b[2] or not sizes[0] or sizes[0] < sizes[1])) for b, x in zip(blocks, out)]


def test_both_passes_against_plain_ones():
    import random

    rnd = random.Random(7)
    poor = "Xyzzy plugh frotz gnusto rezrov blorb nitfol ozmoo bozbar espnis foblub cleesh"
    for _ in range(3000):
        blocks = [(t, len(t) if rnd.random() < 0.15 else 0, rnd.choice([0, 0, 0, 1, 2]), rnd.choice([0, 0, 0, 0, H.WEAK, H.HEADER, H.PLAIN]))
                  for t in rnd.choices([LONG, poor, "zz", "tie of two", "© me"], k=rnd.randint(0, 12))]
        assert H.second_pass(blocks, H.first_pass(blocks)) == plain_passes(blocks), blocks

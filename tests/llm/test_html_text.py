import pytest

from faultlens.llm.html_text import Page, extract_text, main_text, path_scores

LONG = "One sentence, then another. It goes on; and on!"
PAGES = [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a &amp; b&nbsp;c &lt;i&gt; &#233;", "a & b c <i> é"), ("<nav>menu</nav>", ""),
    ("<html><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>T</h1><p>x<b>y</b> z<br>w<p>last</article><footer>f</footer>", "T\n\nxy z w\n\nlast"),
    ("<article><p><b>open<br><p>next</article><aside>side</aside>", "open\n\nnext"),
    (f"<div class='top-nav'>a b. c, d.</div><div id=content><h2>H</h2><p>{LONG}</p><ul><li>i1<li>i2</ul></div><div class=cookieNotice>We, use. Cookies.</div>", f"H\n\n{LONG}\n\ni1\n\ni2"),
    (f"<article><p>{LONG}</p><form>name <input></form><div class='ad'>buy</div><section id=comments><article class=comment><p>{LONG}</p></article></section></article>", LONG),
    ("<article>a<script>var t='</p></article>';</script><style>p{}</style><!-- <p>no</p> -->b<template>no</template></article>", "ab"),
    ("<article><p title='a>b' hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
    ("<article>a</article><article>b</article>", "a\n\nb"),
    ("<main><table><tr><td>1<td>2<tr><td>3</table></main>", "1\n\n2\n\n3"),
    ("<article>\n  a \t\n b\n</article>", "a b"), ("<article>" + "<div>" * 20_000 + "deep", "deep"), ("<article>x < y & z<", "x < y & z<"), ("<article><svg><text>no</text></svg><p>t<img src=x>u</p></article>", "tu"),
]


@pytest.mark.parametrize("source, text", PAGES)
def test_main_text(source, text):
    assert main_text(source) == text


@pytest.mark.parametrize("source", [
    f"<div class='layout with-sidebar'><nav>n</nav><article><p>{LONG}</p></article><div class=sidebar>s</div></div>",
    f"<div id=search-and-content><div class=page-has-comments><p>{LONG}</p></div></div><div>x</div>",
    f"<form action=x><nav>n</nav><main><p>{LONG}</p></main><footer>f</footer></form>", f"<form><div><p>{LONG}</p></div></form>",
    f"<article><p>{LONG}</p></article><div class=related><article>teaser</article></div>",
    f"<div class='with-sidebar'><article><p>{LONG}</p></article><div class=related><article>teaser</article></div></div>",
])
def test_names_of_enclosing_elements(source):
    assert main_text(source).removesuffix("\n\nx") == LONG


@pytest.mark.parametrize("attributes", ['href="/hidden-gems"', 'title="The hidden city"', 'data-hidden="false"', 'href="?id=search"', "href=?class=ad", 'data-role="search"', 'title="style=display:none"'])
def test_names_inside_attributes(attributes):
    assert main_text(f"<article><p>one <a {attributes}>two</a> three</p></article>") == "one two three"


@pytest.mark.parametrize("frame", ["<article>%s</article>", "<main>%s</main>", "<div class=story>%s</div>"])
def test_scores_choose_inside_the_container(frame):
    """Link lists and short boxes of unknown names go; headings and short items beside or between the text stay."""
    text = " ".join([LONG] * 4)
    page = (f"<h1>Title</h1><p>{text}</p><ul><li>i1<li>i2</ul><p>{text}</p><h3>Part</h3><table><tr><td>1<td>2</table><p>{text}</p>"
            "<div class=zz><div class=more><ul><li><a href=1>Other one</a><li><a href=2>Other two</a></ul></div><div class=box><div><p>Follow us</p></div></div></div>")
    assert main_text(frame % page).split("\n\n") == ["Title", text, "i1", "i2", text, "Part", "1", "2", text]


def test_scores_choose_outside_the_named_element():
    text = " ".join([LONG] * 40)
    assert main_text(f"<article>Teaser</article><div><p>{text}</p></div>") == text


def test_table(spark):
    pages = spark.createDataFrame([(i, "u", s, 3, None) for i, (s, _) in enumerate(PAGES)] + [(0, "u", None, 3, None)], "page_id long, url string, html string, n_chars long, extra string")
    out = extract_text(pages)
    assert out.columns == ["page_id", "url", "extra", "text", "n_chars"]
    assert sorted((r.page_id, r.text, r.n_chars) for r in out.collect()) == sorted([(i, t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(0, "", 0)])
    assert extract_text(pages.limit(0)).collect() == []


ARTICLE = "This is a long paragraph of the article, with commas, and with several sentences. It goes on and on. " * 4


@pytest.mark.parametrize("body,kept,gone", [
    (f'<article><h1>Head</h1><p>{ARTICLE}</p><p class="note">Mid note between.</p><p>{ARTICLE}</p><h6>End heading</h6></article>', ["Head", "Mid note between.", "End heading"], []),
    (f'<main><section><p>{ARTICLE}</p><p>{ARTICLE}</p></section><section class="x"><p>Tiny one.</p></section></main>', ["Tiny one."], []),
    (f'<article><p>{ARTICLE}</p><div class="related-work"><p>Earlier studies, too, {ARTICLE}</p></div><p class="comment-on-law">The law says, {ARTICLE}</p></article>', ["Earlier studies", "The law says"], []),
    (f'<div><section class="notice-of-death"><p>He died, {ARTICLE}</p><p>{ARTICLE}</p></section></div>', ["He died"], []),
    (f'<div class="site-footer"><p>Legal text, {ARTICLE}</p></div><article><p>{ARTICLE}</p><div class="related-posts"><a href="/x">More of it</a></div><div class="ad-slot">Buy now.</div></article><div id="comments-list"><p>I think, {ARTICLE}</p></div>',
     [ARTICLE[:30]], ["Legal text", "More of it", "Buy now", "I think"]),
])
def test_names_delete_no_article_text(body, kept, gone):
    text = main_text(f"<html><body><nav><a href='/'>Home</a></nav>{body}<footer>Imprint</footer></body></html>")
    assert all(part in text for part in kept) and not any(part in text for part in [*gone, "Home", "Imprint"]), text


def test_path_scores_by_hand():
    """Brute force of the scores: means by path, of the paths of a parent, and of the article."""
    source = "<body><article><p>One, two.</p><p>Three four five!</p><h2>Six</h2></article><div>Seven</div></body>"
    page = Page(source)
    texts, linked = page.texts()
    assert texts == ["One, two.", "Three four five!", "Six", "Seven"]
    paths = [block.path for block in page.blocks]
    inside = {path: i < 3 for i, path in enumerate(paths)}
    for smoothed in (False, True):
        blocks = {p: [(len(t), sum(c in ".,!" for c in t)) for q, t in zip(paths, texts) if q == p] for p in paths}
        mean = [sum(len(t) for t in texts[:3]) / 3, 3 / 3]
        ratios = {}
        for p, rows in blocks.items():
            rows = rows + [tuple(mean)] if smoothed and inside[p] else rows
            ratios[p] = [sum(r[k] for r in rows) / len(rows) for k in (0, 1)]
        want = {}
        for p in ratios:
            family = [ratios[q] for q in ratios if page.paths[q][0] == page.paths[p][0]]
            a, b = ((ratios[p][k] + sum(f[k] for f in family) / len(family)) / 2 for k in (0, 1))
            want[p] = (a * (1 + b)) ** 0.5
        got = path_scores(page, texts, linked, inside if smoothed else None)
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)

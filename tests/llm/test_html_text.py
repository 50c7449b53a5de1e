import time

import duckdb
import pytest
from textgate.llm import html_text

PARAGRAPH = "This is the first paragraph of the article and it has a lot of the usual words that are in any text, which is what the rules look for in all of it."


def test_article_without_furniture():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1><p>{PARAGRAPH}</p></header><nav><ul><li><a href="/a>b">Menu</a></li></ul></nav><!-- <p>x</p> -->
    <div class="ad">{PARAGRAPH}</div><div id="cookie-notice"><p>{PARAGRAPH}</p></div>
    <article><h1>A &amp; B</h1><p><b>{PARAGRAPH}<br>more&nbsp;of\n it<p>Short.</p><aside>Aside.</aside><form><p>Name</p><input></form>
    <section class="comments"><article class="comment"><p>{PARAGRAPH}</p></article></section></article>
    <div class="sidebar"><p>{PARAGRAPH}</p></div><footer>&copy; all</footer></body></html>"""
    assert html_text.main_text(page) == f"A & B {PARAGRAPH} more of it Short."


def test_page_without_marked_article():
    page = f"<body><div><a href=x>Home</a> <a href=y>About</a></div><h2>Title</h2><p>{PARAGRAPH}</p><p>Short.</p><p>{PARAGRAPH}</p><div><a href=z>Terms</a></div></body>"
    assert html_text.main_text(page) == f"Title {PARAGRAPH} Short. {PARAGRAPH}"


def test_odd_pages(spark):
    pages = [
        (1, "u", None), (2, None, ""), (3, "u", "plain text &lt;b&gt;"), (4, "u", "<p>a<p>b</div></x>"), (5, "u", "<script>x"), (6, "u", "<"),
        (7, "u", "<p " * 5000), (8, "u", f"<article>{'<p>word word</p>' * 20000}"), (3, "u", "plain text &lt;b&gt;"), (None, None, "<p>x"),
    ]
    df = spark.createDataFrame([(*p, "c", 0) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    got = sorted([(r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(df).collect()], key=str)
    want = {1: "", 2: "", 3: "plain text <b>", 4: "a b", 5: "", 6: "<", 8: " ".join(["word word"] * 20000), None: "x"}
    assert [g for g in got if g[0] != 7] == sorted([(p[0] or 0, want[p[0]], len(want[p[0]])) for p in pages if p[0] != 7], key=str)
    assert html_text.extract(df.where("page_id > 99")).collect() == []


def test_marked_article_is_only_a_prior():
    lead, links = PARAGRAPH.replace("first", "lead"), '<ul><li><a href="/a">One story</a></li><li><a href="/b">Another story</a></li></ul>'
    page = f"""<body><div>Home of news</div><div><a href="/all">All news</a></div><h2>Lead</h2><p>{lead}</p><div>12 May</div><article><h1>Title</h1><div class="share">Share</div>
    <p>{PARAGRAPH}</p><div class="ad">Ad</div><p>Short.</p><div class="ad">Ad</div><p>{PARAGRAPH}</p>{links}<div>More of these</div>{links}</article>
    <div>By the desk</div><div>Contact us</div></body>"""
    found = html_text.blocks(page)
    html_text.label(found)
    labels = {b.text: b.label for b in found}
    # both passes run outside the article: a lead paragraph and its heading stay, short blocks around the article go
    assert labels["Lead"] == labels[lead] == "text"
    assert labels["Home of news"] == labels["By the desk"] == labels["Contact us"] == "boiler"
    # and inside: text next to furniture stays, a caption between two lists of links goes
    assert labels["Title"] == labels["Short."] == labels[PARAGRAPH] == "text"
    assert labels["More of these"] == labels["One story"] == labels["Ad"] == labels["Share"] == "boiler"


def test_article_of_undecided_blocks_stays():
    page = f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>Short.</p></article><p>{PARAGRAPH}</p><footer>Foot</footer>"
    assert html_text.main_text(page) == f"Title Short. {PARAGRAPH}"


@pytest.mark.parametrize(
    "page",
    [
        "<button-group></button-group><article><p>%s</p></article>", "<title-bar>x</title-bar><article><p>%s</p></article>", "<svg width=3 /><article><p>%s</p></article>",
        "<iframe src='x'/><p>%s</p>", '<div class="content has-sidebar"><article><p>%s</p></article></div>', '<div class="no-sidebar"><p>%s</p></div>',
        '<article class="post comments-open"><p>%s</p></article>', '<article><div class="related-reading"><p>%s</p></div></article>', '<main><div class="banner-top-article"><p>%s</p></div></main>',
        "<form id=aspnetForm><div><p>%s</p></div></form>", '<div class="banner"><button>Menu<div>x</div><article><p>%s</p></article></div>', "<div><select><option>x</div><p>%s</p>",
        '<body class="comments-open widget"><div data-state="hidden" id="page"><p>%s</p></div><div class="comment-list"><p>%s</p><p>%s</p></div>'.replace("%s", PARAGRAPH).replace(PARAGRAPH, "%s", 1),
    ],
)
def test_article_is_not_lost_to_names(page):
    assert html_text.main_text(page % PARAGRAPH) == PARAGRAPH


@pytest.mark.parametrize("name", ["cookie-notice", "site-footer", "left-sidebar", "sidebarLeft", "ad-slot", "comments-area", "newsletter-signup", "share-buttons", "related-posts", "mainNav"])
def test_furniture_by_whole_classes(name):
    assert html_text.main_text(f'<div class="x {name}"><p>{PARAGRAPH}</p></div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p>') == f"{PARAGRAPH} {PARAGRAPH}"


@pytest.mark.parametrize(
    "unit", ["<p ", '<p "', "<![CDATA[", "<p '\">", "<p \"x'>", "<div>", "<form class=ad>", "<!--", "<script ", "&", "<a<a", "<svg>", "<x a='b", "<", "</p", "<button><div>", "<li><div>", "<td><ul>"]
)
def test_long_hostile_pages_take_seconds(unit):
    for tail in ("", ">", "\">", "'\">", "</p>" * 50_000, "<dt></dt>" * 50_000, "<li></li>" * 50_000):
        began = time.time()
        html_text.main_text(unit * (400_000 // len(unit)) + tail)
        assert time.time() - began < 10


def plain_labels(found):
    """Both passes, without any shortcut: every block looks for its neighbours by itself."""
    kinds = [b.kind for b in found if not b.boiler]
    kind = next((k for k in ("article", "main") if k in kinds), "")
    first = []
    for b in found:
        words = b.text.lower().split()
        stops, inside = sum(w in html_text.STOP_WORDS for w in words) / len(words), kind != "" and b.kind == kind
        if b.boiler or (b.link_chars / len(b.text) > 0.5 and not (inside and (b.tag in ("p", "blockquote") or b.tag in html_text.HEADINGS))):
            first.append("boiler")
        elif b.tag in html_text.HEADINGS or len(b.text) < 70:
            first.append("")
        elif stops >= 0.3 and len(b.text) >= 140:
            first.append("text")
        else:
            first.append("boiler" if stops < 0.15 and not inside else "")
    if not kind and not any(first):
        return ["text"] * len(found), first
    out = []
    for i, b in enumerate(found):
        mine = kind != "" and b.kind == kind and not b.boiler
        if first[i]:
            out.append(first[i])
        elif mine:
            own = [j for j, x in enumerate(found) if x.region == b.region and x.kind == kind and not x.boiler and first[j]]
            left, right = [first[j] for j in own if j < i][-1:], [first[j] for j in own if j > i][:1]
            out.append("boiler" if left == right == ["boiler"] else "text")
        else:
            seen = ["boiler" if kind and x.kind == kind else first[j] for j, x in enumerate(found)]
            left = max((j for j in range(i) if seen[j]), default=-(1 << 30))
            right = min((j for j in range(i + 1, len(found)) if seen[j]), default=1 << 30)
            take = right if b.tag in html_text.HEADINGS or right - i < i - left else left
            out.append(seen[take] if 0 <= take < len(found) else "boiler")
    return out, first


def test_both_passes_against_a_plain_second_implementation():
    inherited = 0
    pages = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    pages += [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    for page in pages:
        found = html_text.blocks(page)
        want, first = plain_labels(found)
        html_text.label(found)
        assert [b.label for b in found] == want
        inherited += sum(not x for x in first)
    assert inherited > 1000

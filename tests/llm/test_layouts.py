"""Main text of pages written by hand, in layouts that the training pages don't copy."""

import random

import pytest

from annalist.llm import html

PAGES = [
    # a weblog of 2005: a table for the layout, text beside blocks
    (
        """<html><head><title>My journal</title></head><body bgcolor=white><center><h2><a href=/>My journal</a></h2></center>
<table width=100%><tr><td width=20% valign=top class=links><b>Friends</b><br><a href=/a>Anna</a><br><a href=/b>Bert</a><br><a href=/c>Carla</a></td>
<td class=entry><h3>A walk to the lake</h3><p>We left the house early in the morning, when the streets were still empty and cold. Nobody spoke much before the first coffee.
<p>The lake was frozen from shore to shore, and the children ran ahead of us to try the ice. It held, of course, as it does every January.</td></tr></table>
<div class=footer>Powered by nothing at all | Contact</div></body></html>""",
        ["A walk to the lake", "We left the house early in the morning, when the streets were still empty and cold. Nobody spoke much before the first coffee.", "The lake was frozen from shore to shore, and the children ran ahead of us to try the ice. It held, of course, as it does every January."],
    ),
    # news: many boxes around a short article
    (
        """<!doctype html><html lang="en"><head><meta charset="utf-8"><script type="application/ld+json">{"@type":"NewsArticle"}</script></head><body class="page">
<div id="cookie-banner"><p>We use cookies to improve your experience on this site.</p><button>Accept all</button></div>
<header class="site-header"><a class="logo" href="/">The Daily Note</a><nav aria-label="Main"><a href="/w">World</a><a href="/b">Business</a><a href="/s">Sport</a></nav></header>
<main><article><h1>Bridge reopens after two years of repairs</h1><p class="lead">Traffic returned to the old river bridge on Monday, two years after cracks were found in its pillars.</p>
<figure><img src="b.jpg" alt=""><figcaption>The bridge on Monday morning.</figcaption></figure>
<div class="ad-slot"><p>Advertisement</p></div>
<p>Engineers replaced more than four hundred bolts and poured new concrete around three of the five pillars. The work cost twice as much as planned.</p>
<h2>What comes next</h2><p>The council wants to paint the railings in spring. &ldquo;It will look like new,&rdquo; the mayor said.</p></article>
<section class="related-stories"><h3>More from the region</h3><ul><li><a href="/1">School gets a new roof</a></li><li><a href="/2">Ferry stops for winter</a></li></ul></section>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>Finally! I have waited so long for this day to come.</p></div><div class="comment"><p>And who pays for all of it in the end?</p></div></section></main>
<footer><p>&copy; The Daily Note</p><a href="/imprint">Imprint</a></footer></body></html>""",
        ["Bridge reopens after two years of repairs", "Traffic returned to the old river bridge on Monday, two years after cracks were found in its pillars.", "The bridge on Monday morning.", "Engineers replaced more than four hundred bolts and poured new concrete around three of the five pillars. The work cost twice as much as planned.", "What comes next", "The council wants to paint the railings in spring. “It will look like new,” the mayor said."],
    ),
    # documentation: side menu, list, a button in a paragraph
    (
        """<html><body><div class="layout"><aside class="sidebar"><form role="search"><input placeholder="Search"><button>Go</button></form><ul><li><a href="/start">Getting started</a></li><li><a href="/install">Install</a></li><li><a href="/faq">Questions</a></li></ul></aside>
<div class="content" role="main"><h1>Install the program</h1><p>Copy the archive to your machine and unpack it in a folder of your choice. <button>Copy</button></p><p>Then do these three things:</p><ol><li>Open a terminal in the new folder.</li><li>Start the setup and answer its questions.</li><li>Restart the machine if you are asked to.</li></ol><blockquote><p>Older systems need the legacy version of the program.</p></blockquote></div></div>
<div class="page-footer"><a href="/prev">Previous</a> <a href="/next">Next</a></div></body></html>""",
        ["Install the program", "Copy the archive to your machine and unpack it in a folder of your choice.", "Then do these three things:", "Open a terminal in the new folder.", "Start the setup and answer its questions.", "Restart the machine if you are asked to.", "Older systems need the legacy version of the program."],
    ),
    # text right in the body, menu and copyright lines beside it
    (
        """<html><head><script src="a.js"/>alert(1)</script></head><body>Home | About | Contact us<hr><article><h1>On keeping bees</h1><p>Bees need little room and less care than most people think, but they do need both at the right time of the year.</p><p>Look after the hives in spring, before the first trees flower, and again in late summer.</p></article>Copyright 2011 by the author</body></html>""",
        ["On keeping bees", "Bees need little room and less care than most people think, but they do need both at the right time of the year.", "Look after the hives in spring, before the first trees flower, and again in late summer."],
    ),
    # one paragraph with a control in it
    ("<html><body><nav><a href=/>Start</a> <a href=/x>All</a></nav><article><h1>A note</h1><p>This is the only paragraph of the article, and it has a control in it. <button>Share</button></p></article></body></html>", ["A note", "This is the only paragraph of the article, and it has a control in it."]),
    # a question page: answers of other readers are comments
    (
        """<html><body><div class=topbar><a href=/>Questions</a> <a href=/tags>Tags</a> <a href=/users>Users</a></div><div class="post"><h1>How do I sharpen a kitchen knife?</h1><div class="post-text"><p>My knife has become blunt over the years and I own nothing but a plain whetstone with two sides.</p><p>Which side comes first, and at which angle should I hold the blade?</p></div></div><div class="comments"><ul class="comment-list"><li>Use the rough side first.</li><li>Twenty degrees are enough for me.</li></ul></div><div id=footer>about - help - legal</div></body></html>""",
        ["How do I sharpen a kitchen knife?", "My knife has become blunt over the years and I own nothing but a plain whetstone with two sides.", "Which side comes first, and at which angle should I hold the blade?"],
    ),
    # a shop: little text, many parts
    (
        """<html><body><div id="top"><ul class="menu"><li><a href=/1>Tools</a><li><a href=/2>Garden</a><li><a href=/3>Sale</a></ul></div><div class="breadcrumbs"><a href=/>Home</a> &raquo; <a href=/2>Garden</a></div><div id="main"><h1>Watering can, ten litres</h1><p>A can of zinc that holds ten litres and lasts a lifetime if you empty it before the first frost.</p><table><tr><td>Weight</td><td>1.9 kilograms</td></tr><tr><td>Height</td><td>38 centimetres</td></tr></table></div><div class="newsletter"><p>Subscribe to our newsletter and save five percent.</p><form><input name=mail><button>Subscribe</button></form></div><footer>Terms | Privacy | Contact</footer></body></html>""",
        ["Watering can, ten litres", "A can of zinc that holds ten litres and lasts a lifetime if you empty it before the first frost.", "Weight", "1.9 kilograms", "Height", "38 centimetres"],
    ),
]


@pytest.fixture(scope="module")
def model():
    return html.fit_extractor()


def test_pages_written_by_hand(model):
    """F1 over blocks, and over all pages."""
    hit = got = want = 0
    for (source, blocks), text in zip(PAGES, model.texts([p for p, _ in PAGES])):
        found = text.split("\n\n")
        hit, got, want = hit + len(set(found) & set(blocks)), got + len(found), want + len(blocks)
        assert "alert" not in text
    assert 2 * hit / (got + want) >= 0.9, (hit, got, want)


def test_generated_pages_of_another_seed(model):
    right = total = 0
    for k in range(150):
        source, kept = html.sample_page(random.Random(5_000_000 + k))
        page, got = html.Page(source), set(model.texts([source])[0].split("\n\n"))
        total += len(page.text)
        right += sum((t in kept) == (t in got) for t in page.text)
    assert right / total > 0.95


def test_many_siblings_are_linear():
    page = html.Page("<dl>" + "<dt>a<dd>b" * 20_000)
    x, _ = html.node_features([page], {})
    assert len(x) == len(page.tag) >= 40_000


def test_runs_beside_blocks_are_elements():
    page = html.Page("<body>one<p>two</p>three<div>four<hr>five</div></body>")
    assert page.text == ["one", "two", "three", "four", "five"]
    assert [page.tag[k] for k in page.node] == ["run", "p", "run", "run", "run"]
    assert html.Page("a<svg/>b<script/>c</script>d<button>e</button>f").text == ["abdf"]


PROSE = [
    "Rain fell over the valley for most of the week, and the river rose by a metre before it stopped.",
    "Farmers had moved their herds to higher ground on Monday, as the council had asked them to do.",
    "Nobody was hurt, but two bridges are closed and the school bus takes another road until spring.",
]


def boxed(tag, names):
    rows = "".join(f"<{tag}>{p}</{tag}>" for p in PROSE)
    return f"<div class=hd>Valley News | Home | About</div><div{names}>{rows}</div><div class=ft>(c) 2020 Valley News</div>"


@pytest.mark.parametrize("names", [" class=content", " class=txt", "", " class=css-1q2w3e"])
@pytest.mark.parametrize("tag", ["p", "div", "section"])
def test_prose_without_telling_names(tag, names):
    """Prose in paragraphs, boxes and sections, without a heading, names that say nothing, or none: all of it and no more."""
    assert html.fit_extractor().texts([boxed(tag, names)]) == ["\n\n".join(PROSE)]


@pytest.mark.parametrize(
    ("source", "blocks"),
    [
        ("<section class=sc-a1>" + "".join(f"<div class=x{k}>{p}</div>" for k, p in enumerate(PROSE)) + "</section>", PROSE),
        (f"<p>{PROSE[0]}</p><p>{PROSE[0]}</p>", [PROSE[0]] * 2),
        ("<p>A</p><p>A</p>", ["A", "A"]),
        (f"<div>{PROSE[1]}</div>", [PROSE[1]]),
        (PROSE[2], [PROSE[2]]),
        ("<table><tr><td><a href=/>Home</a><br><a href=/a>News</a></td><td>" + "".join(f"<p>{p}</p>" for p in PROSE) + "</td></tr></table>", PROSE),
        (f"<article><h1>Rain</h1><p>{PROSE[0]}</p><p><a href=/r>{PROSE[1]}</a></p><p>{PROSE[2]}</p><footer>Filed under: rain</footer></article><a href=/n>next</a>", ["Rain", *PROSE]),
    ],
)
def test_bare_pages(source, blocks):
    assert html.fit_extractor().texts([source]) == ["\n\n".join(blocks)]

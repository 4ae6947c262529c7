"""Main text of pages with known text: every element's marks count, names of sections don't, nothing depends on length."""

import random

import pytest

from weftline.llm import pages

STORY = "<h1>The title</h1><p>" + "The story goes on in plain words that are no links at all. " * 6 + "</p><p>It ends here.</p>"
WANT = "The title " + " ".join(["The story goes on in plain words that are no links at all."] * 6) + " It ends here."


def text(source, paths=None):
    return pages.main_text(source, paths)[0]


GONE = [
    '<p class="advert">Buy this now</p>', '<p>Stay<span class="ad"> and buy</span></p>', "<p hidden>unseen</p>", '<p style="display: none">unseen</p>', '<p class="comment">A reader says so.</p>', '<li class="menu-item">Go</li>', '<td id=sidebar>x</td>',
    '<h3 class="comments-title">Three comments</h3>', '<b class="sponsored">From our partner</b>', '<div role="alert">Beware</div>', '<p class="notice">Updated</p>', "<select>" + "<option>One" * 200 + "</select>", "<noscript>" + "Please turn it on. " * 200 + "</noscript>",
    '<form><h3>Leave a reply</h3><p>' + "Your address is not shown to anyone, as we say here at some length. " * 30 + "</p></form>", '<section class="comments"><h2>Comments</h2>' + "<p>A reader says something of some length about the story, and then some more of it.</p>" * 60 + "</section>",
    '<div class="related-posts"><h3>Related</h3><ul><li><a href=/a>One more story with a long title that is a link</a></ul></div>', '<div class="wp-social-share"><a href=x>Share</a></div>', "<span aria-hidden=true>#</span>", '<p class="share">Tell others', '<div class="cookie-notice"><h3>Cookies</h3><p>' + "We use cookies to know what you read, which we tell all others. " * 5 + "</p></div>",
]


@pytest.mark.parametrize("part", GONE)
@pytest.mark.parametrize("where", ["inside", "after"])
def test_parts_go_whatever_their_length(part, where):
    page = f"<body><article>{STORY}{part}</article></body>" if where == "inside" else f"<body><div class=text>{STORY}</div>{part}</body>"
    got = text(page)
    assert got in (WANT, WANT + " Stay")


SECTIONS = ['<section id="discussion">', '<section class="related-work">', '<section class="social-science">', '<div id="search-algorithms">', '<section id="ad-hoc-networks">', '<div class="elementor-widget elementor-widget-text">', '<section id="advertising">', '<div class="market-share">', '<section id="navigation">', '<div class="menuhin">']


@pytest.mark.parametrize("tag", SECTIONS)
def test_sections_of_the_article_stay(tag):
    more = "<h2>A part</h2><p>" + "What the part says is told in sentences of its own, which are not short. " * 3 + "</p><p>Its end.</p>"
    got = text(f"<body><article>{STORY}{tag}{more}</{tag[1:].split()[0]}></article></body>")
    assert got == WANT + " A part " + " ".join(["What the part says is told in sentences of its own, which are not short."] * 3) + " Its end."


def test_headings_keep_their_names():
    assert text('<article><h2 id="comments">On comments</h2><p>Text.</p><h2 id=search>Search</h2><p>More.</p></article>') == "On comments Text. Search More."


def test_parts_of_one_article_stay_together():
    """A host's path that holds one part of this page's article does not cut off the other."""
    one, two = "<p>" + "The first part of the story is told at some length here. " * 11 + "</p>", "<p>" + "The second part of it is told as well, in other words. " * 9 + "</p>"
    page = f"<body><main><div class=part-a>{one}</div><div class=part-b>{two}</div></main></body>"
    whole = " ".join(["The first part of the story is told at some length here."] * 11 + ["The second part of it is told as well, in other words."] * 9)
    assert text(page) == whole
    assert text(page, ["body/main/div.part-a"]) == whole and text(page, ["body/main/div.part-b", "body/main/div.part-a"]) == whole
    assert text(page, ["body/main"]) == whole and text(page, ["body/none"]) == whole
    uneven = f"<body><main><div class=part-a>{one * 3}</div><div class=part-b>{two}</div></main></body>"
    assert text(uneven).endswith(whole[-50:])


def test_what_is_never_closed():
    assert text(f"<body><article>{STORY}<select><option>One</article></body>").startswith(WANT)
    assert text(f"<body><noscript><article>{STORY}</article></body>") == WANT
    assert text(f"<body><p class=ad>Buy<div>{STORY}</div></body>") == WANT
    assert text("<body><ul><li class=ad>Buy<li>One<li>Two</ul></body>") == "One Two"
    assert text("<body><p>One <span class=ad>buy<p>Two</body>") == "One Two"
    assert text("<article><p>wo<span hidden>x</span>rd</p></article>") == "word"


def test_generated_pages():
    """Articles among boilerplate of many kinds, with known text: each page is read as it should be."""
    rng = random.Random(8)
    words = "stone river light window garden letter winter morning table paper quiet distant walking carried yellow".split()

    def sentence():
        return " ".join(rng.choice(words) for _ in range(rng.randint(8, 16))).capitalize() + "."

    def paragraph():
        return " ".join(sentence() for _ in range(rng.randint(2, 6)))

    def boilerplate():
        kind = rng.randrange(9)
        links = "".join(f"<li><a href=/{i}>{rng.choice(words)} {rng.choice(words)}</a></li>" for i in range(rng.randint(3, 12)))
        return [
            f"<nav><ul>{links}</ul></nav>", f"<div class='sidebar widget-area'><h3>More</h3><ul>{links}</ul></div>", f"<aside><p>{paragraph()}</p></aside>", f"<div class=ad-slot><p>{paragraph()}</p></div>", f"<form><label>Name</label><p>{sentence()}</p></form>",
            f"<section id=comments><h2>Comments</h2>{''.join(f'<p>{paragraph()}</p>' for _ in range(rng.randint(1, 9)))}</section>", f"<footer><p>{paragraph()}</p></footer>", f"<div class='newsletter-signup'><p>{paragraph()}</p></div>", f"<p class='advert'>{sentence()}</p>",
        ][kind]

    hits = given = wanted = 0
    for _ in range(300):
        title, parts = sentence(), [paragraph() for _ in range(rng.randint(2, 8))]
        want = [title, *parts]
        body = f"<h1>{title}</h1>"
        for k, p in enumerate(parts):
            if rng.random() < 0.2:
                body += f"<h2 id={rng.choice(['search', 'discussion', 'related-work', 'part'])}>Part {k}</h2>"
                want.insert(want.index(p), f"Part {k}")
            end = rng.choice(["</p>", "", "</p>"])
            body += rng.choice(["<p>{}" + end, "<p class='body-text'>{}" + end, "<section class='social-history'><h3>Sub</h3><p>{}</p></section>"]).format(p.replace(" ", " <b>", 1).replace(".", "</b>.", 1))
            if "<h3>Sub</h3>" in body[-len(p) - 120 :] and body.endswith("</section>"):
                want.insert(want.index(p), "Sub")
            if rng.random() < 0.15:
                body += boilerplate()
        wrap = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class='post-body'>{}</div>", "<div id=content><div class=inner>{}</div></div>"])
        page = "<html><body>" + "".join(boilerplate() for _ in range(rng.randint(0, 3))) + wrap.format(body) + "".join(boilerplate() for _ in range(rng.randint(0, 4))) + "</body></html>"
        got = text(page).split()
        said = " ".join(want).split()
        from collections import Counter

        common = sum((Counter(got) & Counter(said)).values())
        hits, given, wanted = hits + common, given + len(got), wanted + len(said)
    assert hits / wanted > 0.98 and hits / given > 0.98, (hits / wanted, hits / given)

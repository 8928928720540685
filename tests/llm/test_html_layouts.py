"""Pages of many layouts, each labelled by hand: the lines that are main text."""

import pytest

from siftmill.llm import html_extract

A = ("The river rose again", ["Water reached the lower street on Monday evening, and people carried their chairs upstairs.", "By night the bridge was closed. Nobody was hurt.", "The council meets tomorrow to talk about a wall."])
B = ("How to bake rye bread", ["Mix the flour with warm water and leave it for a day.", "Knead, shape, and let the loaf rest until it has grown by half."])
C = ("Une journée à la mer", ["Le vent soufflait fort, mais le soleil brillait encore.", "Nous avons marché jusqu'au phare avant le soir.", "Puis il a plu."])
D = ("Ein kurzer Bericht", ["Der Zug kam zwei Stunden zu spät an.", "Die Reisenden warteten geduldig in der Halle; es gab Tee."])
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></nav>'
FOOT = "<footer>&copy; 2024 Some Paper. All rights reserved.</footer>"
AD = '<div class="ad">Buy two coats, pay for one!</div>'
SAID = '<div class="comments"><h3>Comments</h3><div class="comment">I was there and saw it all.</div><div class="comment">Thanks for this.</div></div>'


def ps(story):
    return "".join(f"<p>{p}</p>" for p in story[1])


def whole(story):
    return [story[0], *story[1]]


#: name -> (page, main lines) of a story
LAYOUTS = {
    "plain_div_in_article": lambda s: (f"<body>{NAV}<article><h1>{s[0]}</h1><div>{ps(s)}</div></article>{FOOT}", whole(s)),
    "plain_div_without_heading": lambda s: (f"<body>{NAV}<article><div>{ps(s)}</div></article>{FOOT}", s[1]),
    "several_plain_divs": lambda s: (f"<body><div><div><h1>{s[0]}</h1></div><div>{ps(s)}</div></div>{FOOT}</body>", whole(s)),
    "divs_three_deep": lambda s: (f"<body>{NAV}<div><div><div><h1>{s[0]}</h1>{ps(s)}</div></div></div>{FOOT}", whole(s)),
    "wrap_with_text_and_comments": lambda s: (f'<body>{NAV}<div id="wrap"><div class="txt"><h1>{s[0]}</h1>{ps(s)}</div>{SAID}</div>{FOOT}', whole(s)),
    "hero_then_body": lambda s: (f'<body>{NAV}<article><div class="hero"><h1>{s[0]}</h1></div><div class="body">{ps(s)}</div></article>{AD}{FOOT}', whole(s)),
    "two_columns": lambda s: (f'<body><div class="row"><div class="col"><article><h1>{s[0]}</h1>{ps(s)}</article></div><div class="sidebar"><h3>Read next</h3><ul><li><a href="/1">Other news of the day</a></li></ul></div></div>{FOOT}', whole(s)),
    "layout_table": lambda s: (f'<table><tr><td><a href="/">Menu</a> <a href="/x">More</a></td><td><h1>{s[0]}</h1>{ps(s)}</td></tr></table>', whole(s)),
    "sections_in_main": lambda s: (f"<body><header><a href=/>Site</a></header><main><h1>{s[0]}</h1>" + "".join(f"<section><p>{p}</p></section>" for p in s[1]) + f"</main>{FOOT}", whole(s)),
    "text_without_tags": lambda s: (" ".join(s[1]), [" ".join(s[1])]),
    "cookie_notice_first": lambda s: (f'<body><div class="cookie-banner"><p>We use cookies to improve this site.</p><button>OK</button></div><div class="container"><article><h1>{s[0]}</h1><div>{ps(s)}</div></article></div>{FOOT}', whole(s)),
    "advert_between": lambda s: (f"<body>{NAV}<div><article><h1>{s[0]}</h1><div><p>{s[1][0]}</p>{AD}<p>{s[1][1]}</p></div></article></div>{FOOT}", [s[0], *s[1][:2]]),
}


@pytest.fixture(scope="module")
def tagger():
    return html_extract.train(html_extract.labelled_pages())


def test_f1_over_forty_pages(tagger):
    right = made = wanted = 0
    wrong = []
    for name, layout in LAYOUTS.items():
        for story in (A, B, C, D):
            page, lines = layout(story)
            got = [x for x in tagger.extract(page).split("\n") if x]
            hit = len(set(got) & set(lines))
            right, made, wanted = right + hit, made + len(got), wanted + len(lines)
            if got != lines:
                wrong.append((name, got))
    f1 = 2 * right / (made + wanted)
    assert f1 >= 0.95, (f1, wrong)
    assert len(wrong) <= 0.1 * 4 * len(LAYOUTS), wrong


@pytest.mark.parametrize("name", ["plain_div_in_article", "plain_div_without_heading", "several_plain_divs", "wrap_with_text_and_comments", "text_without_tags"])
def test_no_article_is_lost(tagger, name):
    for story in (A, B, C, D):
        page, lines = LAYOUTS[name](story)
        assert tagger.extract(page).split("\n") == lines


def test_ancestors_count_at_any_depth():
    """No outer element is forgotten, and words that no model knows are not kept."""
    page = '<div class="comments">' + "<div class='x'>" * 3000 + "<p>Deep down.</p>"
    (block,) = html_extract.blocks(page)
    assert "word:comments" in block.names
    many = "".join(f'<div class="{"".join(chr(97 + int(d)) for d in str(k))}">text ' for k in range(3000))
    assert all(len(b.names) <= 1 for b in html_extract.blocks(many, frozenset(["tag:div"])))


def test_quotes_of_tags_are_read_alike_to_the_end():
    broken = "<a title='" + '<b class="x>y">' * 2000
    assert [b.text for b in html_extract.blocks(broken + '<p title="a > b">Told.</p>')][-1].endswith("Told.")
    assert [b.text for b in html_extract.blocks('<p title="a > b">One</p><p title=\'x>"\'>Two</p>')] == ["One", "Two"]

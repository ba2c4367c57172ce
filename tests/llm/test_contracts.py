"""Cases of the text operators that once lost or kept the wrong text."""

import random

import pytest

from lociframe.llm import chatformat, htmltext, tokencount

KEEP = "The story of the river and of the people who lived by it is long, and it is told here in full."

ALIENS = [
    '<ol class="comment-list"><li>Nice</li></ol>',
    '<section class="comments-area" id="comments-section"><p>Nice</p></section>',
    '<div class="post-comments"><p>Nice</p></div>',
    '<div class="comment-body"><p>Nice</p></div>',
    '<div class="share-buttons">Share</div>',
    '<div class="related-posts"><a href="/x">More</a></div>',
    '<div class="cookie-banner">We use cookies</div>',
    '<div class="ad-slot">Buy</div>',
    '<aside>Aside</aside>',
    '<div class="sidebar-widget">Links</div>',
    '<form><p>Subscribe</p></form>',
]


@pytest.mark.parametrize("alien", ALIENS)
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>"])
def test_what_is_no_article_goes_from_inside_it(alien, frame):
    assert htmltext.main_text(f"<body>{frame.format(f'<p>{KEEP}</p>{alien}<p>End.</p>')}</body>") == f"{KEEP}\n\nEnd."


def test_comment_articles_headers_and_lists():
    assert htmltext.main_text('<article><p>Main.</p></article><article class="comment"><p>Me too</p></article>') == "Main."
    assert htmltext.main_text('<article class="post has-comments"><p>Main.</p></article>') == "Main."
    assert htmltext.main_text('<article><div class="entry-header"><h1>Title</h1></div><p>Body.</p></article>') == "Title\n\nBody."
    assert htmltext.main_text('<article><ul><li><a href="x">First book</a></li><li><a href="y">Second book</a></li></ul></article>') == "First book\n\nSecond book"
    assert htmltext.main_text('<article><div class="widget-area-box"><p>Only text.</p></div></article>') == "Only text."
    assert htmltext.main_text("<body><p>Hello world.</p></body>") == "Hello world."


def test_pages_without_containers_are_judged_by_their_words():
    rng = random.Random(4)
    stop, other = "the of and a to in is was it for with as on".split(), "river stone bridge lantern market harbour winter garden".split()
    for _ in range(40):
        body = [" ".join(rng.choice(stop if rng.random() < 0.5 else other) for _ in range(rng.randint(45, 90))) + "." for _ in range(rng.randint(1, 5))]
        menu = "".join(f'<div><a href="/{w}">{w} {w}</a></div>' for w in rng.sample(other, 4))
        short = " ".join(rng.sample(stop, 5)) + "."  # between long paragraphs it is theirs
        page = f"<body><div>{menu}</div>" + "".join(f"<div>{p}</div>" for p in [body[0], short, *body[1:]]) + f"<div>{menu}</div></body>"
        assert htmltext.main_text(page) == "\n\n".join([body[0], short, *body[1:]])


def test_invalid_utf8_and_long_texts(spark):
    bad = spark.sql("select 1L doc_id, cast(X'48FF49' as string) text union all select 2L, repeat('word ', 200000) union all select 3L, null")
    import public_tokenizers

    rows = tokencount.section_tokens(bad, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert {r.doc_id for r in rows} >= {1, 2}
    turns = spark.sql("select 1L conv_id, 0L turn, 'user' role, cast(X'5573657220FF3A2068690A' as string) text union all select 1L, 1L, 'assistant', repeat('a line\\n', 50000) union all select 2L, 0L, 'user', null union all select 2L, 1L, 'user', 'Hi there.'")
    got = chatformat.parse(turns.selectExpr("*", "1 as pid", "'x' as opens"), chatformat.fit(turns)).collect()
    assert {r.conv_id for r in got} == {1, 2}
    empty = turns.limit(0)
    assert chatformat.parse(empty, chatformat.fit(empty)).collect() == []


def test_lists_with_other_items_are_text():
    page = f'<article><p>{KEEP}</p><ul><li><a href="a">Linked item</a></li><li>Plain item</li></ul><p>End.</p><ul><li><a href="b">Home</a></li><li><a href="c">About</a></li></ul></article>'
    assert htmltext.main_text(page) == f"{KEEP}\n\nLinked item\n\nPlain item\n\nEnd."

import pytest

from tracklot.llm.html_text import main_text

NONE = lambda path: 1.0
BODY = "<p>One sentence of the body.</p><p>Another sentence of it.</p>"
TEXT = "One sentence of the body. Another sentence of it."


@pytest.mark.parametrize("page", [
    f"<div class='layout has-sidebar'><article>{BODY}</article><div class='sidebar'>side</div></div>",
    f"<main class='no-sidebar'>{BODY}<div class='share'>tweet</div></main>",
    f"<article class='post comments-open'>{BODY}</article><div class='ad'>buy</div>",
    f"<div id='search-results'><article>{BODY}</article></div><div class='related'>more</div>",
    f"<div class='has-sidebar'><div class='page'>{BODY}</div><div class='sidebar'>side</div></div>",
])
def test_wrappers_with_boilerplate_names(page):
    assert main_text(f"<body><nav>go</nav>{page}<footer>foot</footer></body>", NONE) == TEXT


def test_small_named_elements_still_go():
    page = f"<div class='body'>{BODY}</div><div class='related'><article>Card one</article><article>Card two</article></div>"
    assert main_text(page, NONE) == TEXT


def test_teaser_cards_do_not_hide_the_body():
    cards = "".join(f"<article class='card'><p>Card {i}</p></article>" for i in range(3))
    page = f"<div class='body'>{BODY}</div><div class='row'>{cards}</div>"
    assert TEXT in main_text(page, NONE)
    assert main_text(page, lambda path: 0.0 if "article" in path else 1.0) == TEXT


@pytest.mark.parametrize("filler", ["x" * 5000, "x y " * 300_000, "a-" * 500_000])
def test_names_after_a_long_attribute_count(filler):
    page = f"<div class='body'>{BODY}</div><div data-a='{filler}' class='advert'>BUY NOW</div><p {filler} role='banner'>top</p>"
    assert main_text(page, NONE) == TEXT

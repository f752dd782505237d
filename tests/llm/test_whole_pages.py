"""Pages with elements that end without an end tag, or hold text of their own."""

import pytest

from loomgraph.llm import extraction

FIRST, LAST = "First sentence of the article that is long enough to read.", "Last sentence of the article that is also long enough."


def page(before="", inside="Middle words of the text stand here."):
    return f"<html><body>{before}<article><p>{FIRST}</p><p>{inside}</p><p>{LAST}</p></article></body></html>"


@pytest.mark.parametrize(
    "before",
    [
        "<form><input list=q><datalist id=q><option value=a><option value=b></datalist></form>",
        "<form><select name=s><option>One<option>Two</form>",
        "<div class=menu><svg><path d='M0'></div>",
        "<noscript><img src=x>",
        "<template><div class=ad>Buy</div>",
        "<div><math><mi>x</div>",
        "<div><object data=x></div>",
    ],
)
def test_open_elements_cut_no_page(before):
    text = extraction.main_text(page(before), extraction.trained())
    assert FIRST in text and "Middle words of the text stand here." in text and LAST in text


def test_text_of_math_and_object_stays():
    for inside, want in (("The area is <math><mi>a</mi><mo>=</mo><mn>3</mn></math> in all cases.", "The area is a=3 in all cases."), ("See <object data=x>these fallback words</object> for all details.", "See these fallback words for all details.")):
        assert extraction.main_text(page("", inside), extraction.trained()) == f"{FIRST}\n\n{want}\n\n{LAST}"


def test_raw_text_is_still_no_text():
    text = extraction.main_text(page("", "one<script>if (a < b) no()</script><style>p {}</style> two <svg><g><path/><path/></g></svg> three of them."), extraction.trained())
    assert text == f"{FIRST}\n\none two three of them.\n\n{LAST}"

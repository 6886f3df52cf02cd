"""Pruned elements without an end tag end where browsers end them."""

import pytest

from factgraph.llm.main_text import main_text

ARTICLE = "<article><p>One, two, three words.</p></article>"


@pytest.mark.parametrize(
    "before",
    [
        "<ul><li class=share>Share<li>x</ul>",
        "<ul><li class=share>Share</ul>",
        "<div><ul><li class=share>Share</div>",
        "<ul><li class=share>Share<ul><li>a<li>b</ul>c<li>x</ul>",
        "<table><tr><td class=sidebar>Side<td>x</table>",
        "<table><tr><td class=sidebar>Side<tr><td>x</table>",
        "<dl><dd class=related>More<dt>x</dl>",
    ],
)
def test_article_after_an_unclosed_pruned_element(before):
    assert main_text(before + ARTICLE) == "One, two, three words."


def test_nested_list_is_pruned_with_its_item():
    page = "<article><p>One, two.</p><ul><li class=share>Share<ul><li>a<li>b</ul>c<li>kept item</ul></article>"
    assert main_text(page) == "One, two.\nkept item"
    assert main_text("<article><ul><li class=share>Share<div>x</div></li><li>kept</ul><p>One, two.</p></article>") == "kept\nOne, two."

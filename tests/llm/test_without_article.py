"""Golden pages without article or main elements, page-wide forms, and names that are topics."""

import pytest

from factgraph.llm.main_text import main_text

P = [f"Paragraph {i} is long enough, with commas, clauses and words, to be read as prose by anyone who reads it to its end." for i in range(6)]
LONG = "".join(f"<p>{p}</p>" for p in P)
TEXT = "\n".join(P)
MENU = "<ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>About the site</a></ul>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div class=section>{LONG}</div><div class=section><h2>Outlook</h2><p>Nothing else is known yet.</p></div>", f"{TEXT}\nOutlook\nNothing else is known yet."),
        (f"<section>{LONG}</section><section><h2>Outlook</h2><p>Nothing else is known yet.</p></section>", f"{TEXT}\nOutlook\nNothing else is known yet."),
        (f"<div>{LONG}</div><div><p>Short end.</p></div>", f"{TEXT}\nShort end."),
        (f"<h1>The title</h1><div>{LONG}</div>", f"The title\n{TEXT}"),
        (f"<div>{LONG}</div><pre>x = 1</pre><div>{LONG}</div>", f"{TEXT}\nx = 1\n{TEXT}"),
        (f"<div>{LONG}</div><ul><li>First point.</li><li>Second point.</li><li>Third.</li></ul>", f"{TEXT}\nFirst point.\nSecond point.\nThird."),
        (f"<div class=post>{LONG}<div class=legal>The legal status of the treaty is open.</div></div>", f"{TEXT}\nThe legal status of the treaty is open."),
        (f"<section>{LONG}</section><section class=social>{LONG}</section>", f"{TEXT}\n{TEXT}"),
        (f"<form id=aspnet><div>{LONG}</div></form>", TEXT),
        (f"<form id=aspnet><div>{MENU}</div><div>{LONG}</div></form>", TEXT),
        (f"<article>{LONG}</article><article>{LONG}</article><article><p>Short third.</p></article>", f"{TEXT}\n{TEXT}\nShort third."),
        (f"<article>{LONG}<section class=reader-comments><p>Me too, said I.</p></section></article>", TEXT),
        (f"<article>{LONG}<div id=comment-42><p>Me too, said I.</p></div></article>", TEXT),
        (f"<article>{LONG}<div class=article-sidebar><p>Other, other things.</p></div></article>", TEXT),
        (f"<article>{LONG}<label>Your name</label></article>", TEXT),
        (f"<div>{MENU}</div><div>{LONG}</div>", TEXT),
        (f"<h3>Sections</h3>{MENU}<h1>Title</h1><p>By Ann</p><div>{LONG}</div><h3>More</h3>{MENU}", f"Title\nBy Ann\n{TEXT}"),
        (f"<div>{LONG}</div><div class=legal>All rights reserved, 2020.</div><div class=footer>{P[0]}</div><div id=comments>{LONG}</div>", TEXT),
        (f"<div class=sidebar>{P[0]}</div><div>{LONG}</div><form><p>{P[1]}</p><input></form>", TEXT),
        ("<form><label>Name</label><input><p>Send us your name.</p></form>", ""),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want
    assert main_text(f"<html><body><div id=wrap>{page}</div></body></html>") == want

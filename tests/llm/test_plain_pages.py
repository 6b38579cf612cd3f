"""Main text of pages built of plain divs, without article or main."""

import pytest

from factweave.llm.line_blocks import main_text

LONG = "A long paragraph of plain text, one of many. " * 8
BODY = f"<div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>"
TEXT = "\n".join([LONG.strip()] * 3)


@pytest.mark.parametrize("page,text", [
    (f"<div><h1>Title</h1><p>Lead.</p></div><div class='ad'>buy</div>{BODY}<aside>x</aside><p>The end.</p>", f"Title\nLead.\n{TEXT}\nThe end."),
    *[(f"<div class='{c}'>{BODY}</div>", TEXT) for c in ("page has-sidebar", "no-comments", "with-header", "without_footer", "comments-closed")],
    (f"<div class='content-sidebar-wrap'>{BODY}<div class='sidebar-left'>side</div></div>", TEXT),
    (f"<form id='all'><div class='site-header'>site</div>{BODY}</form>", TEXT),
    (f"{BODY}<p>See <a>the whole long report of the committee</a>.</p><p>After.</p>", f"{TEXT}\nSee the whole long report of the committee.\nAfter."),
    (f"<h2><a>Linked title</a></h2>{BODY}", f"Linked title\n{TEXT}"),
    (f"<ul><li><a>Home</a></li><li><a>News</a></li></ul>{BODY}<div><a>One</a> <a>Two</a></div>", TEXT),
    (f"<div class='cookie-banner'>We use cookies.</div>{BODY}<div class='comments'><p>{LONG * 9}</p></div><div hidden>{LONG * 9}</div>", TEXT),
    (f"<div class='ad'><script>{'var a;' * 900}</script>buy</div>{BODY}", TEXT),
])
def test_plain_pages(page, text):
    assert main_text(page) == text

"""Labels and hidden elements in web pages."""

import pytest

from tessella.llm.html_text import main_blocks

TEXT = "First sentence, with a comma. And a second one, longer than the first.\nMore text, here. It goes on for a while, as articles do."
BODY = "".join(f"<p>{x}</p>" for x in TEXT.split("\n"))
REMARK = "<p>Nice, I agree. So do I, and many others, who say so at length, again and again, below this text.</p>"
PAGES = {
    "wrapper with an article": f"<div class='layout sidebar-right'><article>{BODY}</article></div><p>Follow us</p>",
    "label on the text's own element": f"<div class='post-content social-share-on'>{BODY}</div><p>Follow us</p>",
    "the same inside main": f"<main><div class='post-content social-share-on'>{BODY}</div></main>",
    "comments in a labelled wrapper": f"<div class='has-x sidebar-left'><main>{BODY}<div class='comments'>{REMARK}</div></main></div>",
    "comments longer than the article": f"<article>{BODY}</article><div class='comments'>{REMARK * 4}</div>",
    "comments that are articles": f"<main>{BODY}</main><div class='comments'><article class='comment'>{REMARK * 4}</article></div>",
    "hidden as a word": f"<div title='a hidden gem' style='overflow: hidden scroll' data-class='ad'>{BODY}</div>",
    "hidden as an attribute": f"<div>{BODY}</div><div hidden>{REMARK}</div><div class='x' aria-hidden='true'>{REMARK}</div><div style='color: red; display: none'>{REMARK}</div>",
}


@pytest.mark.parametrize("page", PAGES.values(), ids=PAGES)
def test_labels_do_not_lose_the_text(page):
    assert main_blocks([f"<html><body>{page}</body></html>"]) == [TEXT]

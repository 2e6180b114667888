"""Which elements mark the article of a page."""

import pytest

from quernal.llm.htmlmain import main_text, parse


@pytest.mark.parametrize(
    "odd",
    [
        "<!-- <article> -->",
        "<script>var t = '<main>';</script>",
        "<aside><article>teaser</article></aside>",
        '<article class="comment">reader</article>',
        '<div class="comments"><article id="c1">reader</article></div>',
        "<article></article>",
    ],
)
def test_main_text_in_plain_divs(odd):
    assert main_text(parse(f"<body>{odd}<div>main text</div></body>"), frozenset()) == "main text"


def test_marked_text_alone():
    page = '<body><div>around</div><article class="post comments-open"><p>text</p><article class="comment-item">reader</article></article></body>'
    assert main_text(parse(page), frozenset()) == "text"
    assert main_text(parse('<body>around<span role="main">text</span>after</body>'), frozenset()) == "text"

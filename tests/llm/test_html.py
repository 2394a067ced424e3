"""Pages that leave out tags, and text inside elements that are no blocks."""

from contactloom.llm import html_text

HEAD, BODY = '<!DOCTYPE html><html><head><title>x</title></head><body>', "</body></html>"
PROSE = "One long sentence of the story stands here so that it counts as main text."


def _page(inner):
    return f'{HEAD}<nav><ul><li><a href="/x">menu</a></li></ul></nav><article><h1>The title</h1><p>{PROSE}</p>{inner}</article><footer>foot</footer>{BODY}'


def test_omitted_tags():
    model, page = html_text.trained(), _page(f"<p>{PROSE} Again.</p>")
    want = html_text.main_text(page, model)
    assert want == f"The title\n{PROSE}\n{PROSE} Again."
    for gone in (["</head>"], ["<body>"], ["</head>", "<body>"], ["<head>", "</head>"], ["<html>"], ["<html>", "</html>"], ["</head>", "<body>", BODY], ["</p>"]):
        less = page
        for tag in gone:
            less = less.replace(tag, "")
        assert html_text.main_text(less, model) == want, gone
    for html, kept in html_text.labelled_pages(40, 43):
        assert html_text.main_text(html.replace("</head><body>", ""), model) == html_text.main_text(html, model)


def test_unclosed_elements_do_not_swallow():
    model = html_text.trained()
    for tag in ("select", "button", "object", "svg", "math", "canvas"):
        assert f"{PROSE} Again." in html_text.main_text(_page(f"<p>{PROSE}<{tag}></p><p>{PROSE} Again.</p>"), model).split("\n"), tag


def test_text_within_a_block():
    model = html_text.trained()
    inner = "so <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math>, <button>press</button> <svg><title>t</title><g><text>label</text></g></svg> <object data='x'>other</object> end"
    assert html_text.main_text(_page(f"<p>{PROSE} {inner}</p>"), model).split("\n")[-1] == f"{PROSE} so x=2, press label other end"

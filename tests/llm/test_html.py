"""HTML extraction against a plain parser of the test pages, and awkward markup."""

from html.parser import HTMLParser

from pantrylens.llm import html_text
from pantrylens.llm.shared import table


class Article(HTMLParser):
    """The text of <article>, a line for every paragraph and heading."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.parts, self.inside, self.breaks = [], [], 0, 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.breaks += 1
            self.parts.append(" ")
            if self.breaks == 2:
                self.flush()
        elif tag not in ("b", "i", "em", "strong", "a", "span"):
            self.flush()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "em", "strong", "a", "span"):
            self.flush()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)
            if data.strip():
                self.breaks = 0


def test_pages_against_a_plain_parser(spark):
    for sf in ("sf0.001", "sf0.01"):
        got = html_text.extract(table(spark, f"/root/testdata/{sf}", "pages"))
        html = {r.page_id: r.html for r in table(spark, f"/root/testdata/{sf}", "pages").collect()}
        for r in got.collect():
            p = Article()
            p.feed(html[r.page_id] or "")
            p.close()
            p.flush()
            assert r.text == "\n".join(p.lines) and r.n_chars == len(r.text)


def test_the_tree_weighs_words_and_links_of_both_neighbours():
    assert set(html_text.FEATURES[:6]) <= html_text.splits(html_text.tree())
    x, y = html_text.labelled_rows()
    assert all(html_text.classify(html_text.tree(), row) == bool(want) for row, want in zip(x, y, strict=True))


def test_awkward_pages():
    long, more = "word " * 60, "more " * 60
    both = f"{long.strip()}\n{more.strip()}"
    assert html_text.main_text(f"<div class='content has-sidebar'><p>{long}<p>{more}</div>") == both
    assert html_text.main_text(f"<div class='post related-news'><p>{long}<p>{more}</div>") == both
    assert html_text.main_text(f"<main><div class='article-header'><h1>The head line</h1></div><p>{long}</main>") == f"The head line\n{long.strip()}"
    quote = html_text.main_text(f"<article><p title=\"x>hello there</p><p>{more}</article>")
    assert "<" not in quote and "title" not in quote
    assert html_text.main_text("<article><p title=\"x>hello</article>") == "hello"
    assert html_text.main_text(f"<article><p>a b<br>{' ' * 200}<br>c d</article>") == "a b\nc d"
    assert html_text.main_text(f"<article><p id=one class=two>{long}<table><tr><td>x<td>y &lt;z&gt;</table></article>") == f"{long.strip()}\nx\ny <z>"
    links = "".join(f"<li><a href=/{i}>more of this {i}</a>" for i in range(6))
    assert html_text.main_text(f"<article><h1>Head</h1><p>{long}<p>{more}<ul>{links}</ul></article><footer>f</footer>") == f"Head\n{both}"

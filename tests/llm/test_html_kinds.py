"""Pages of one host whose text stands in different containers."""

from docspend.llm import html_extract


def test_a_page_with_an_article_does_not_empty_the_others(spark):
    pages = {
        1: "<body><article><p>in an article</p></article></body>",
        2: "<body><main><p>in main</p></main></body>",
        3: "<body><div class='story'><p>in a div</p><p>more</p></div></body>",
    }
    rows = [(k, "https://a.example/x", v) for k, v in pages.items()]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "in an article", 2: "in main", 3: "in a div\nmore"}


def test_sibling_sections_all_stay():
    page = "<body><div><section class='intro'><p>one</p></section><section class='rest'><p>two</p><p>three</p></section></div></body>"
    assert html_extract.extracted(page, html_extract.wrapper_of(page)) == "one\ntwo\nthree"

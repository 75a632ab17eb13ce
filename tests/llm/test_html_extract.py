"""Wrapper inference on hand-made pages and on the given tables."""

import html
import json
import random
import re
from pathlib import Path

import pytest

from docspend.llm import html_extract as he
from docspend.llm.common import table

PAGES = "page_id long, url string, html string, host string, wrapper string, plan string, salt int"
DATA = "/root/testdata/sf0.01"


def read(page, *host):
    return he.extracted(page, he.wrapper_of(*(host or [page])))


def test_groups_options_slots_and_template_text():
    a = "<div class=x><h1>T</h1><p>one<p>two</div><div class=x><h1>T</h1><p>three</div><hr><section>s</section>"
    b = "<div class=x><h1>U</h1><h1>T</h1><ul><li>1<li>2</ul></div>"
    w = he.wrapper_of(a, b)
    assert he.expression(w) == "<div x>(<h1>#</h1>)+(<p>#</p>)+?(<ul>(<li>#</li>)+</ul>)?</div>".join(["(", ")+"]) + "(<section @1>#</section>)?"
    assert he.dumped(he.loaded(he.dumped(w))) == he.dumped(w)
    assert he.expression(he.wrapper_of("<p>same</p><ul><li>a</ul>", "<p>same</p><ul><li>b</ul>")) == "<p>=</p><ul><li>#</li></ul>"
    assert he.expression(he.wrapper_of("<h2>a</h2><p>b</p>" * 3 + "<hr><dl>c")) == "((<h2>#</h2>)+(<p>#</p>)+)+<dl>#</dl>"


def test_merging_is_associative_and_commutative():
    rng = random.Random(4)
    pages = [
        f"<body><nav>m</nav><article>{'<p>a</p>' * (i % 3)}{'<h2>b</h2>' * (i % 2)}<div>{'<ul><li>c' * (i % 4 > 1)}</div></article>{''.join(f'<div class=k{chr(97 + (i * 7 + j) % 26)}{chr(97 + j)}>{j}</div>' for j in range(5))}</body>" for i in range(60)
    ]
    whole = he.dumped(he.wrapper_of(*pages))
    for _ in range(6):
        rng.shuffle(pages)
        cuts = [0, *sorted(rng.sample(range(1, 60), 4)), 60]
        parts = [he.loaded(he.dumped(he.wrapper_of(*pages[a:b]))) for a, b in zip(cuts, cuts[1:])]
        out = parts[0]
        for x in parts[1:]:
            he.merge(out, x)
        assert he.dumped(out) == whole
    assert '"div *"' in whole  # more than 64 kinds of div became one


def test_wrappers_do_not_depend_on_how_rows_are_dealt(spark):
    rows = [
        (
            i, f"http://h{i % 3}.example/", f"<body><div>menu</div><div><p>text {i}</p>{'<p>more</p>' * (i % 4)}</div></body>", None, None, None, None
        ) for i in range(300)
    ]
    docs = spark.createDataFrame(rows, PAGES)
    one = {r.host: r.wrapper for r in he.infer(docs.coalesce(1)).collect()}
    many = {r.host: r.wrapper for r in he.infer(docs.repartition(150)).collect()}
    assert one == many and len(one) == 3


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{a:b}</style><script>var t="</p><article>no</article>";</script></head>
<body class="home"><div id="cookie-notice">no</div><header>no</header><nav><ul><li><a href="/">no</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">no</div><aside><p>no</p></aside><article><h1>Head &amp; more</h1><p><b>First &lt;b&gt; para<br>
goes  on<p>Second&nbsp;with <a href="x">link</a>s <img src=a alt="<no>"></p><form><label>no</label><input></form><ul><li>i<li>ii</ul>
<div class="comments">no</div><blockquote>Q &#233; &eacute;</blockquote>tail<div class="ad">no</div> text</article>
<section id="comments"><p>no</p></section><footer>no</footer>"""


def test_the_article_without_its_surroundings():
    assert read(PAGE) == "Head & more\nFirst <b> para goes on\nSecond with links\ni\nii\nQ é é\ntail\ntext"


def test_pages_without_an_article():
    main = "<body><div class=menu><p>no</div><main><p>yes</p><p>too</p></main><footer>no</footer></body>"
    plain = "<body><div><a>no</a></div><div class=c9><h1>yes</h1><p>a</p><p>b</p></div></body>"
    assert read(main) == "yes\ntoo"
    assert read(plain) == "yes\na\nb"


def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def host_without_names(rng, pages, box="<table><tr>"):
    """A menu, a changing teaser of links, a constant long box, the article and a constant footer in bare elements."""
    constant, foot = _prose(rng, 60), _prose(rng, 40)
    out = []
    for _ in range(pages):
        title, paragraphs = _prose(rng, 6), [_prose(rng, rng.randint(20, 60)) for _ in range(rng.randint(1, 5))]
        links = "".join(f"<li><a href=x>{_prose(rng, 3)}</a></li>" for _ in range(8))
        page = f"<html><body><div>home about contact</div><div><ul>{links}</ul></div><div>{constant}</div><div><h2>{title}</h2>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><div>{foot}</div></body></html>"
        out.append((page, "\n".join([title, *paragraphs])))
    return out


def test_articles_without_a_telling_tag_or_name():
    """Nothing but the alignment over the host tells the article from the boxes around it."""
    rng = random.Random(8)
    for n in (6, 40):
        host = host_without_names(rng, n)
        w = he.wrapper_of(*(p for p, _ in host))
        assert [he.extracted(p, w) for p, _ in host] == [t for _, t in host]
    alone = [read(p) == t for p, t in host]  # a page alone can't tell
    assert not any(alone)


def test_a_foreign_wrapper_changes_the_text():
    rng = random.Random(9)
    a, b = host_without_names(rng, 8), [(f"<body><div class=box><section>{t}</section></div></body>", t) for t in (_prose(rng, 20) for _ in range(8))]
    foreign = he.wrapper_of(*(p for p, _ in b))
    assert all(he.extracted(p, foreign) != t for p, t in a)
    tagged = "<html><body><article><p>text</p></article></body></html>"
    assert he.extracted(tagged, he.wrapper_of("<article><p>x</p></article>")) == ""


def test_names_are_only_a_tie_break():
    rng = random.Random(3)
    varied = [
        f"<article><h1>{_prose(rng, 4)}</h1><p>{_prose(rng, 30)}</p><div class=related><p>{_prose(rng, 30)}</p></div><div class=share>Tell others</div><div class=box7>Read all of it now</div></article>" for _ in range(12)
    ]
    w = he.wrapper_of(*varied)
    for p in varied:  # prose that changes stays, a box that repeats goes whatever its name
        want = [html.unescape(x) for x in re.findall(r"<(?:h1|p)>(.*?)</", p)]
        assert he.extracted(p, w).split("\n") == want
    assert read("<article><header><h1>T</h1></header><p>a</p><div class=share>no</div></article>") == "T\na"


def test_copies_on_one_host_stay():
    page = "<html><body><nav>n</nav><article><h1>T</h1><p>one</p><p>two</p></article><footer>f</footer></body></html>"
    assert read(page, *[page] * 50) == "T\none\ntwo"


def test_unclosed_elements_do_not_swallow_the_page():
    for tag in ("svg", "object", "math"):
        assert read(f"<body><article><h1>T</h1><{tag} x=1><p>stays</p></article></body>") == "T\nstays"


def test_deep_and_alternating_pages():
    deep = "<article>" + "<div>" * 5000 + "x"
    assert read(deep) == "x"
    long = "<article>" + "<h2>a</h2><p>b</p>" * 3000
    assert he.expression(he.wrapper_of(long)) == "<article>((<h2>#</h2>)+(<p>#</p>)+)+</article>"
    assert read(long, long, long + "<ul><li>c") == "\n".join(["a", "b"] * 3000)


def test_odd_rows_and_empty_table(spark):
    rows = [
        (1, None, None, "h", "w"), (2, "http://a.b/", "", None, None), (2, "http://a.b/", "<article>x", None, None),
        (None, "not a url", "<<<>>> & <p", None, None), (3, "http://a.b/", "<p>" * 4000 + "deep", None, None),
        (4, "http://A.b:80/x", "<article><p>" + "long " * 100_000, None, None), (5, "u", "<script>never closed <article>x</article>", None, None)
    ]
    rows = [(*r, "p", 3) for r in rows]
    got = he.main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {(r.page_id, r.n_chars): r.text for r in got}
    assert by[(2, 1)] == "x" and by[(1, 0)] == "" and by[(5, 0)] == "" and (4, 499_999) in by and by[(3, 4)] == "deep"
    assert he.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_salted_and_broadcast_readings_agree(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "http://h.example/", p, None, None, None, None) for i, (p, _) in enumerate(host_without_names(rng, 30))]
    docs = spark.createDataFrame(rows, PAGES)
    one = sorted(map(tuple, he.main_text(docs).collect()))
    monkeypatch.setattr(he, "BROADCAST", -1)
    assert sorted(map(tuple, he.main_text(docs).collect())) == one and all(r[3] for r in one)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_given_pages_equal_their_articles(spark):
    pages = table(spark, DATA, "pages")
    got = {r.page_id: r.text for r in he.main_text(pages).collect()}
    for page_id, page in ((r.page_id, r.html) for r in pages.collect()):
        body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
        parts = (" ".join(html.unescape(re.sub(r"<(?:b|br)>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body.replace("<br>", " ")))
        assert got[page_id] == "\n".join(x for x in parts if x)


def test_plans_are_plain_json():
    w = he.wrapper_of("<body><p>x</p></body>")
    assert json.loads(json.dumps(he.reading(w)))[0] == "page"

import pytest

from html.parser import HTMLParser

from selenite.llm import html_extraction
from selenite.llm.html_extraction import Tree, aligned, expression, extracted, host_rule, main_text, parsed, skeleton

PAGE = """<!DOCTYPE html><html><head><title>No &amp; no</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body class="page"><header class="site-header"><h2>No header</h2></header><nav><ul><li><a href="/a">No nav</a></li></ul></nav>
<!-- <p>no comment</p> --><div class="ad">No ad</div><div class="cookie-notice"><p>No cookies</p></div>
<article><h1>Title &eacute;&#233;</h1><p>One <b>bold</b>
  <a href=x>link</a>.<p>Two<br>lines&nbsp;here<ul><li>first<li>second</ul><aside>No aside</aside>
<form><p>No form</p></form><div id="comments"><p>No reader comment</p></div><table><tr><td>cell</td><td>other</td></tr></table></article>
<div class="sidebar">No sidebar</div><footer>&copy; No footer</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "Title éé\nOne bold link.\nTwo lines here\nfirst\nsecond\ncell\nother"
    assert main_text(None) == main_text("") == main_text("<p") == ""
    assert main_text("<article><p>cut of") == "cut of"
    assert main_text("<article><p>a &lt; b &amp") == "a < b &"


def wrapper(*pages):
    """The pages' wrapper, by way of its packed form."""
    whole = None
    for page in pages:
        tree = Tree.of(skeleton(*parsed(page)).packed())
        whole = tree if whole is None else Tree.of(aligned(whole, tree).packed())
    return whole


def test_wrapper_alignment():
    whole = wrapper("<body><div class=x><p>a</p><p>b</p><h2>c</h2></div></body>", "<body><div class=x><p>a</p><ul><li>q</li><li>r</li></ul></div><div class=y>z</div></body>")
    assert expression(whole) == "<body> <div.x> (<p> #text </p>)+ (<h2> #text </h2>)? (<ul> (<li> #text </li>)+ </ul>)? </div> (<div.y> #text </div>)? </body>"
    assert expression(wrapper("<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p></div>", "<div><h2>e</h2><p>f</p></div>")) == "<div> ((<h2> #text </h2>)+ (<p> #text </p>)+)* </div>"
    assert expression(wrapper("<div><i>a</i></div><p>Top</p>", "<div>b</div><p>Top</p>")) == "<div> #text </div> <p> #fixed1 </p>"
    assert expression(wrapper("<p>a</p><h2>b</h2>", "<h2>c</h2><p>d</p>")) == "(<p> #text </p> <h2> #text </h2>)*"


def test_lines_of_the_template():
    """What all pages of a host say is template, unless it is in an article element or the pages are the same."""
    page = lambda i, t="div": f"<body><{t} class=c><p>Share this page</p><p>Text {i} of some length</p><div class=related-work><p>Work {i}</p></div></{t}></body>"
    rule = host_rule(wrapper(*(page(i) for i in range(5))))
    assert rule[0] == ["body", "div.c"]
    assert main_text(page(7), rule[0], frozenset(rule[1])) == "Text 7 of some length\nWork 7"
    rule = host_rule(wrapper(*(page(i, "article") for i in range(5))))
    assert main_text(page(7, "article"), rule[0], frozenset(rule[1])) == "Share this page\nText 7 of some length\nWork 7"
    rule = host_rule(wrapper(*[page(1)] * 9))
    assert main_text(page(1), rule[0], frozenset(rule[1])).startswith("Share")


def test_rare_parts_count():
    """Text in parts that only one page has counts for the part around them, however many they are."""
    word = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(4))
    whole = None
    for i in range(335):
        parts = "".join(f"<section class={word(60 * i + k)}>{i % 10}{k:03d}</section>" for k in range(60))
        tree = skeleton(*parsed(f"<body><div class=one><p>Lines of {i}</p></div><div class=two>{parts}</div></body>"))
        whole = tree if whole is None else aligned(whole, tree)
    assert len(whole.names) == 5 + 335 * 60 and host_rule(whole)[0] == ["body", "div.two"]
    assert host_rule(Tree.of(whole.packed()))[0] == ["body", "div.two"]


def test_wrappers_folded_two_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(html_extraction, "BYTES", 1)
    page = lambda i: f"<body><div class=c><p>Same line</p><p>Text {i} of some length</p></div><div class=x{i % 7 * 'y'}>z</div></body>"
    frame = spark.createDataFrame([(f"http://h/{i}", page(i)) for i in range(50)], "url string, html string").repartition(9)
    (row,) = html_extraction.wrappers(frame).collect()
    tree = Tree.of(row.wrapper)
    assert tree.pages[0] == 50 and sum(p for p, n in zip(tree.pages, tree.names) if n.startswith("div.x")) == 50
    assert host_rule(tree)[0] == ["body", "div.c"] and len(host_rule(tree)[1]) == 1


def test_words_within_class_words():
    keep = ("related-work", "search-algorithms", "notice-of-theorem", "adder", "menuhin", "commentary", "article-header")
    drop = ("related-posts", "search-box", "notice", "ad", "ad-slot", "site-nav", "comments", "comment-list", "cookie-banner", "site-header", "user-comments", "sidebar")
    for word in keep + drop:
        assert main_text(f"<main><p>One</p><div class='x {word}'><p>Two</p></div></main>") == ("One\nTwo" if word in keep else "One"), word


def test_deep_and_long_pages(spark):
    import time

    begin = time.time()
    deep = "<div>" * 100_000 + "deep" + "</b></section>" * 100_000
    every = "".join(f"<div>{i}" for i in range(20_000))
    long = "<body>" + "".join(f"<h2>head {i}</h2><p>line {i}</p>" for i in range(10_000)) + "</body>"
    pages = spark.createDataFrame([(1, "http://a/", deep), (2, "http://a/", every), (3, "http://a/", long), (4, "http://a/", long + "<p>x")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extracted(pages).collect()}
    assert got[1] == "deep" and got[2].count("\n") == 19_999 and got[3].count("\n") == 19_999 and got[4].endswith("\nx")
    assert time.time() - begin < 60


def test_hosts_without_article_elements(spark):
    body = lambda i: f"<html><body><div class=top>Home page {i % 2}</div><div class=c><p>{'word ' * 50}{i}</p><p>more text of {i}</p></div><div class=box><a href=/>all links here {i}</a></div></body></html>"
    pages = [(i, f"http://h.example/{i}", body(i), "k") for i in range(150)] + [(900, "http://other.example/", PAGE, "k"), (901, None, "", "k"), (902, None, None, "k"), (None, "http://h.example/z", "<p>short", "k"), (900, "http://other.example/", PAGE, "k")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, path string").repartition(6)
    got = sorted(((r.page_id, r.text, r.n_chars) for r in extracted(frame).collect()), key=str)
    want = [(i, f"{'word ' * 50}{i}\nmore text of {i}") for i in range(150)] + [(900, main_text(PAGE))] * 2 + [(901, ""), (902, ""), (None, "short")]
    assert got == sorted(((i, t, len(t)) for i, t in want), key=str)
    assert extracted(frame.limit(0)).count() == 0


class Article(HTMLParser):
    """An expected text by other means: the lines of article elements, without the elements that the contract names."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.out = 0
        self.lines = [""]

    def handle_starttag(self, tag, attrs):
        words = (dict(attrs).get("class") or "").split()
        self.inside += tag == "article"
        if self.out or tag in ("aside", "form", "nav", "footer", "script", "style") or {"ad", "comments", "sidebar", "notice", "cookie"} & set(words):
            self.out += tag not in ("br", "img", "input", "hr")
        if tag not in ("b", "i", "em", "strong", "a", "span", "code", "br", "img"):
            self.lines.append("")
        elif tag == "br" and self.inside:
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        self.out -= bool(self.out)
        self.inside -= tag == "article"
        if tag not in ("b", "i", "em", "strong", "a", "span", "code", "br", "img"):
            self.lines.append("")

    def handle_data(self, data):
        if self.inside and not self.out:
            self.lines[-1] += data

    @classmethod
    def of(cls, page):
        one = cls()
        one.feed(page)
        one.close()
        return "\n".join(x for x in (" ".join(line.split()) for line in one.lines) if x)


def test_all_pages_against_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: Article.of(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in extracted(pages).collect()}
    assert [k for k in want if got[k] != want[k]] == []


@pytest.mark.parametrize("html,path", [("<body><main><p>x</p><article><p>y</p></article></main></body>", ["body", "main", "article"]), ("<body><div class=entry-content><p>x</p></div><div><p>yyyyyyyyyyyy</p></div></body>", ["body", "div.entry-content"])])
def test_article_path(html, path):
    assert host_rule(wrapper(html))[0] == path


@pytest.mark.parametrize("before", ["<datalist><option value=a><option value=b></datalist>", "<div><button>Menu</div>", "<div><button>Menu<button>More</div>", "<button>Menu", "<div><video src=x><source src=y></div>", "<object data=x>", "<div><svg><path d=x></div>", "<select><optgroup><option>a<option>b<optgroup><option>c</select>"])
def test_elements_left_open(before):
    assert main_text(f"<body>{before}<article><p>One</p><p>Two</p></article></body>") == "One\nTwo"


def test_elements_within_a_line():
    assert main_text("<article><p>One <svg><g><path d=x /></g><text>no</text></svg>two <button>no</button>three <select><option>no<option>no</select>four<p>Five <button>no</p><p>six</article>") == "One two three four\nFive\nsix"
    assert main_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</article>") == "So x=2 holds"
    assert main_text("<body><template><article><p>no</article></template><article><p>yes</article>") == "yes"

import html
from html.parser import HTMLParser

from pyspark.sql import functions as F

from newsward.functions import html as H


class Model(HTMLParser):
    """The text nodes of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "template")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "template")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def model_text(source):
    parser = Model()
    parser.feed(source)
    parser.close()
    return "".join(parser.parts)


PAGES = [
    "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body><p>a<b>b</b> 1 < 2</p></body></html>",
    '<a title="x > y" href=\'z\'>link</a><!-- no <b> --><script>var t="</p>";</script>end',
    "caf&eacute; &#233;&#xE9; &amp;lt; &nbsp;| &#128; &unknown; &copy 2024 a&b",
    "<template><p>hidden</p></template>seen",
    "",
    "no tags & no end",
]


def test_html_text_equals_the_parser_model(apply):
    assert apply(H.html_text, PAGES) == [model_text(p) for p in PAGES]


def test_html_text_on_all_stored_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.select("html", H.html_text(F.col("html")).alias("text")).collect()
    assert [r["text"] for r in rows] == [model_text(r["html"]) for r in rows]


def test_unescape_does_not_decode_twice(apply):
    texts = ["&amp;amp;lt;", "&amp;#38;lt;", "&#x1F600;&#0;&#xD800;", "&notin;&not;", "&"]
    assert apply(H.unescape, texts) == [html.unescape(t) for t in texts]


def test_long_tag_does_not_overflow(apply):
    page = "<a title='" + "x y " * 200_000 + "'>t</a>" + "<b " + "c " * 200_000 + ">u</b>"
    assert apply(H.html_text, [page]) == ["tu"]


def test_title_headline_anchors(apply):
    page = """<title> A
      b </title><h1> One <i>x</i></h1><h1>Two</h1><a name=q>n</a><a class="k" HREF='/u?a=1&amp;b=2'>l</a><a href=bare>m</a>"""
    assert apply(H.page_title_keyword, [page, "<p>none"]) == ["A b", None]
    assert apply(H.headline, [page, "<p>none"]) == ["One x", None]
    assert apply(H.headlines, [page]) == [["One x", "Two"]]
    assert apply(H.anchors, [page]) == [["/u?a=1&b=2", "bare"]]


def test_paragraphs_end_at_the_next_one(apply):
    page = "<p> one <b>b</b><p class='x'>two</p>out<div><p>three</div>out<pre>no</pre><script>'<p>s</p>'</script>"
    assert apply(H.paragraphs, [page]) == [["one b", "two", "three"]]
    assert apply(H.paragraph_text, [page]) == ["one b\ntwo\nthree"]


def test_what_starts_first_is_hidden(apply):
    from newsward.functions import html as H

    pages = [
        '<p>a</p><script>var s="<!--";</script><p>Article text</p>',
        "<p>a</p><!-- <script> --><p>b</p>",
        "<p>a</p><!-- open <p>b</p>",
        "<p>a</p><style>x <!-- y --> z<p>b</p>",
    ]
    assert apply(H.html_text, pages) == ["aArticle text", "ab", "a", "a"]

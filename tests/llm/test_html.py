import html as entities
import re

import pytest
from pyspark.sql import functions as F

from almanac.llm import html


@pytest.fixture(scope="module")
def tree(spark):
    return html.grown(spark)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="nav">
<header><a href="/">Home</a> Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice"><p>We use cookies on this site.</p></div>
<main><article><header><h1>The &amp; title</h1></header><p>First <b>bo</b>ld
line<br>two&nbsp;x</p><p><a href="/y">only a link</a></p><aside>side words here</aside><form><p>sign up</p><input></form><ul><li>one</li><li>two</li></ul>
<section id="comments"><p>Nice article, I liked it very much indeed.</p></section><blockquote>quoted</blockquote></article></main>
<div class="ad">Buy now</div><footer>&copy; x</footer></body></html>"""


def test_parts(tree):
    assert html.main_text(PAGE, tree).split("\n\n") == ["The & title", "First bold line two x", "only a link", "one", "two", "quoted"]


def test_labelled_table_is_learned(tree):
    rows = html.labelled_blocks()
    assert len(rows) > 100 and all(html.is_text(tree, x[:-1]) == bool(x[-1]) for x in rows)


#: Pages that the tree has not seen, labelled in the same way.
HELD_OUT = [
    "<div><a>{2}</a></div><div><a>{1}</a></div><div><a>{2}</a></div><h1>§{7}</h1><p>§{65}</p><p>§{40}</p><p>§{8}</p><p>§{75}</p><div><a>{3}</a></div><div><a>{4}</a></div>",
    "<div>{2}</div><article><h2>§{5}</h2><p>§{12}</p><ul><li>§<a>{3}</a></li><li>§<a>{4}</a></li></ul></article><div class=share>{6}</div><div>{50}</div>",
    "<div class=banner>{30}</div><p>§{44}</p><p>§{51} <a>{3}</a></p><div id=comments><p>{33}</p><p>{20}</p></div><div><a>{2}</a></div>",
    "<table><tr><td><a>{1}</a></td><td><a>{1}</a></td></tr></table><p>§{100}</p><p>§{5}</p><p>§{64}</p><div><a>{6}</a></div>",
    "<ul><li><a>{2}</a></li><li><a>{3}</a></li></ul><div>§{38}</div><div>§{29} <a>{2}</a></div><div>§{47}</div><ul><li><a>{8}</a></li><li><a>{9}</a></li></ul>",
]


def test_held_out_blocks(tree):
    rows = html.labelled_blocks(HELD_OUT)
    assert sum(html.is_text(tree, x[:-1]) == bool(x[-1]) for x in rows) >= 0.95 * len(rows)


@pytest.mark.parametrize("inside", ["<svg class='x'/>", "<svg><text>no</text></svg>", "<datalist><option value=a><option value=b>no</datalist>", "<select><option>no</select>", "<button>", "<canvas>", "<object data='a/>b'/>", "<option>no<option>no", "<template>", "<math/>", "<textarea>no</textarea>", "<iframe src=x></iframe>"])
def test_no_element_swallows_the_rest(tree, inside):
    assert html.main_text(f"<head><meta charset=x><body><article><p>Hello there</p>{inside}<p>World text</p></article>", tree) == "Hello there\n\nWorld text"


def test_column_in_place(spark, tree):
    rows = html.extracted(spark.createDataFrame([(1, PAGE)], "page_id long, html string"), into="html", tree=tree)
    assert rows.columns == ["page_id", "html"] and rows.first().html.startswith("The & title")


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("<p>", ""), ("<script>x", ""), ("plain &am", None), ("<article><p>a<p>b", "a\n\nb"), ("<html><head><title>t</title><article>a", "a"), ('<article><p title=\'a>b\' class="x>y">c</p>', "c"), ("<article>\x00 <p>&#x41;&bogus;</p>", None), ("<article>" + "<div>" * 3000 + "deep", "deep")])
def test_odd_pages(tree, page, text):
    got = html.main_text(page, tree)
    assert text is None or got == text


def test_density_decides_without_an_article(tree):
    long = "word " * 60
    page = f'<body><div><a href="/">Home</a></div><div><a href="/b">News</a></div><p>{long}</p><p>short one</p><p>{long}</p><div><a href="/c">More</a></div></body>'
    assert html.main_text(page, tree).split("\n\n") == [long.strip(), "short one", long.strip()]


def test_every_page_of_the_table(spark, small):
    rows = html.op8_html(spark, small).join(spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        own = re.search(r"(?s)<article>(.*?)(?:</article>|$)", r.html)[1].replace("<br>", " ")
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", own)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_odd_table(spark, tree):
    df = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<article>a"), (2, "v", PAGE)], "page_id long, url string, html string").withColumn("text", F.lit("kept no more"))
    assert sorted(len(r.text) for r in html.extracted(df, tree=tree).collect())[:3] == [0, 0, 1]
    assert html.extracted(df.limit(0), tree=tree).count() == 0

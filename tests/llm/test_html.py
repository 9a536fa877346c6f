import pytest

from quillon.llm.html_layout import extract, render

CASES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<div>a</div><div>b<br>c</div>", "a\nb\nc"),
    ("a <b> b</b>  c<i> </i>d", "a b c d"),
    ("<ul><li>x<li>y<ul><li>z</ul><li>w</ul>", "* x\n* y\n  * z\n* w"),
    ("<ol start=3><li>x</li><li>y</li></ol>after", "3. x\n4. y\n\nafter"),
    ("<title>t</title><script>var x='</p>'</script><style>p{}</style><p hidden>h</p><p>v</p>", "v"),
    ('<div style="display: NONE">no<div>no</div></div>yes<span aria-hidden=true>, too</span>', "yes, too"),
    ("<!-- c <p>x</p> -->k<!doctype html><template>t</template>", "k"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>x<td>22</table>", "Name       N\nlong name  1\nx          22"),
    ("<table><tr><td colspan=2>a<td>b<tr><td>cc<td>dd<td>e</table>", "a       b\ncc  dd  e"),
    ("<table><tr><td rowspan=2>A<td>B<tr><td>C<tr><td>D<td>E</table>", "A  B\n   C\nD  E"),
    ("<table><tr><td>a<td rowspan=0 colspan=2>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  b    c\nd       e\nf       g"),
    ("<table><tr><td rowspan=x>a<td rowspan=" + "9" * 5000 + ">b<tr><td>c</table>", "a  b\nc"),
    ("<ol><li>x<li value=5>y<li>z<li value=q>w</ol>", "1. x\n5. y\n6. z\n7. w"),
    ("<table><tr><td>a<p>b</td><td>c</td></tr></table>z", "a  c\n\nb\n\nz"),
    ("<table><tr><td>o<table><tr><td>i1<td>i2</table></table>", "o\n\ni1  i2"),
    ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n    d1\n    d2"),
    ("x</p>y</div></b><", "x\n\ny<"),
    ("<a href='x>y' title=\"a>b\">link</a><img alt='pic' src=x> <input type=hidden value=v>", "linkpic"),
    ("<h1>H</h1>text<hr>more<blockquote>q</blockquote>", "H\n\ntext\n\n---\n\nmore\n\nq"),
    ("<select><option>a<option>b</select>k<textarea> raw &lt;</textarea>", "k raw <"),
    ("a&#" + "9" * 5000 + ";b &#x" + "f" * 5000 + "; &#000065;", "a\ufffdb \ufffd A"),
    ("&#" + "0" * 5000 + "65;&#x0000000041;", "AA"),
    ("<table><tr><td colspan='²'>a<td colspan=" + "9" * 5000 + ">b</table>", "a  b"),
    ("<p title=it's>Hello</p><p>world</p>", "Hello\n\nworld"),
    ('<p class="a"">Hello</p><p>world</p>', "Hello\n\nworld"),
    ("<p title='a>b\"c'>x</p><p title = \"d>e'f\" hidden=>y</p>z", "x\n\nz"),
    ("<img alt='5\" tall' src=x> k<p class='a>b", "5\" tall k\n\nb"),
    ("<p a'b=c \"d\" = e>x<p ='f'>y</p x='>'>z", "x\n\ny\n\nz"),
    ("<!-- a --!>b<!-->c<!--->d<!-- e", "bcd"),
    ("<p style='display:none;display:block'>a<p style='display:none !important; display:block'>b<p style='DISPLAY : None'>c", "a"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b><li>c</div>d", "b\nd"),
    ("<details>x<summary>s</summary>y<summary>t</summary></details>z<details open><summary>s</summary>y</details>", "s\nz\ns\ny"),
    ("<input type=submit value='Go on'> <input value=typed><input type=checkbox value=v><input type=image alt=im>", "Go on im"),
    ("&copy; &middot; &#x41;&#66; &nosuch; &am", "© · AB &nosuch; &am"),
]


@pytest.mark.parametrize(("source", "text"), CASES)
def test_rendering(source, text):
    assert render(source) == text


def test_every_visible_word_is_kept_in_order():
    words = [f"w{i}" for i in range(300)]
    tags = ["div", "p", "li", "td", "span", "tr", "table", "ul", "h2", "b", "dd", "section"]
    source = "".join(f"<{tags[(i * 7) % 12]}>{w} " + (f"</{tags[(i * 5) % 12]}>" if i % 3 else "") for i, w in enumerate(words))
    assert sorted(render(source).split()) == sorted([*words, *["*"] * render(source).split().count("*")])


def test_deep_and_long_pages():
    assert render("<div>" * 20_000 + "x") == "x"
    assert render("<p>word " * 50_000).count("word") == 50_000
    assert render("<" * 20_000).count("<") == 20_000


def test_frame(spark):
    pages = spark.createDataFrame([(1, "<p>a", "k"), (1, "<p>a", "k"), (None, None, None)], "page_id long, html string, text string")
    out = extract(pages)
    assert out.columns == [*pages.columns, "__text"]
    assert sorted(map(str, out.select("page_id", "__text").collect())) == sorted(["Row(page_id=1, __text='a')"] * 2 + ["Row(page_id=None, __text='')"])
    assert extract(pages.limit(0)).count() == 0


def test_padding_stays_in_proportion():
    page = "<table>" + "<tr><td>ab<td>cd" * 2000 + "<tr><td>" + "w" * 200_000 + "<td>x</table>"
    text = render(page)
    assert len(text) < 2 * len(page) and text.startswith("ab  cd\nab  cd\n") and text.endswith("w  x")


def test_spans_stay_in_proportion():
    for page in ("<table><tr>" + "<td colspan=1000>" * 2000, "<table>" + "<tr><td colspan=1000><td>x" * 2000, "<table><tr><td rowspan=0 colspan=1000>" + "<tr><td>x" * 2000):
        assert len(render(page)) < 4 * len(page)
        assert render(page).count("x") == page.count("x")


def test_clashing_name(spark):
    pages = spark.createDataFrame([("<p>a", "k")], "html string, __text string")
    assert extract(pages).first().asDict() == {"html": "<p>a", "__text": "k", "__text_": "a"}

"""Blocks of hand-made pages: attributes, inner tags, entities, links, mixed content, missing end tags."""

import pytest

from quirework.operators import markup as M

CASES = [
    ('<p class="x" id=\'a\'>One <a href="/b">link &amp; more</a> after</p>', [("p", 1, "One link & more after", 1)]),
    ("<div>before<p>in</p>between<p>two<br>lines</p>behind</div>", [("div", 1, "before", 0), ("p", 2, "in", 0), ("div", 1, "between", 0), ("p", 2, "two lines", 0), ("div", 1, "behind", 0)]),
    ("<body><p>no end<p>next<h2 a='>'>Title</h2>loose</body>", [("p", 2, "no end", 0), ("p", 2, "next", 0), ("h2", 2, "Title", 0), ("body", 1, "loose", 0)]),
    ("<ul><li>one<li>two <b>bold</b></li></ul>", [("li", 2, "one", 0), ("li", 2, "two bold", 0)]),
    ("<table><tr><td>a</td><td>b<td>c</tr></table>", [("td", 3, "a", 0), ("td", 3, "b", 0), ("td", 3, "c", 0)]),
    ("<nav><ul><li><a href='x'>x</a></li></ul></nav><article><h1>T</h1></article><footer>f</footer>", [("h1", 2, "T", 0)]),
    ("<!-- <p>no</p> --><script>var t='</p>';</script><style>p{}</style><p>yes &lt;b&gt;</p>", [("p", 1, "yes <b>", 0)]),
    ("<level1><doctitle>Book</doctitle><level2><p>text<pagenum id='p1'>7</pagenum></p></level2></level1>", [("doctitle", 2, "Book", 0), ("p", 3, "text", 0), ("pagenum", 3, "7", 0)]),
    ("plain only", []),
    ("", []),
    (None, []),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "page int, html string")
    out = {}
    for r in sorted(M.blocks(df, "page", "html").collect(), key=lambda r: (r.page, r.ordinal)):
        out.setdefault(r.page, []).append((r.tag, r.depth, r.text, r.links))
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_blocks(found, i):
    assert found.get(i, []) == CASES[i][1]

"""Main text of pages of many shapes; the clustering by plain sums; hostile markup."""

import math
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trailweave.llm import html_extract as H

S = "Some longer sentence of an article that has many words in it and goes on for a while. "
MENU = "<ul>" + "".join(f"<li><a href=/{k}>Item {k}</a></li>" for k in range(6)) + "</ul>"
BODY = f"<h1>Title</h1><p>{S * 3}</p><h2>Part</h2><p>{S * 2}</p><ul><li>one<li>two</ul><p>Short end.</p>"
WANT = "\n".join(["Title", (S * 3).strip(), "Part", (S * 2).strip(), "one", "two", "Short end."])
AROUND = (f"<nav>{MENU}</nav><header>Site name</header>", f"<section class='comments'><p>{S * 9}</p></section><footer>Imprint</footer>")
SHAPES = {
    "article": f"<article>{BODY}</article>",
    "main": f"<main>{BODY}</main>",
    "neither": f"<div id=content>{BODY}</div>",
    "wrapper names that only sound like marks": f"<div class='site no-sidebar'><article class='post comments-open'>{BODY}</article></div>",
    "a form around everything": f"<form id=whole><div>{BODY}</div><input><label>Name</label></form>",
    "marks in names of text blocks": f"<article>{BODY.replace('<p>Short', '<p class=re-search>Short')}</article>",
    "an article of nested divisions": f"<div><div><div>{BODY}</div></div></div>",
    "an end tag too many": f"<article>{BODY.replace('<h2>', '</div><h2>')}</article>",
    "a teaser list after it": f"<main>{BODY}</main><div>{MENU}</div>",
    "an advert inside": f"<article>{BODY.replace('<h2>', '<div class=ad-slot>Buy now</div><aside>See also</aside><h2>')}</article>",
    "unknown declarations": f"<article><![foo[bar]]><!what>{BODY}<![CDATA[x]]><!--c--></article>",
    "a table of data": f"<article>{BODY.replace('<ul><li>one<li>two</ul>', '<table><tr><td>one<td>two</table>')}</article>",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(shape):
    assert H.main_text(AROUND[0] + SHAPES[shape] + AROUND[1]) == WANT


def test_more_shapes():
    assert H.main_text(f"{AROUND[0]}<article>{BODY}</article><article>{BODY}</article>{AROUND[1]}") == WANT + "\n" + WANT
    assert H.main_text(f"<nav>{MENU}<article>{BODY}</article>") == WANT == H.main_text(f"<nav>{MENU}<div>{BODY}</div>")
    assert H.main_text(f"<main>Word</main><div>{BODY}</div>").endswith(WANT)
    assert H.main_text(f"<article><p>It <span class=search-term>was</span> x<sup>2</sup> = <math><mi>y</mi></math> as<script>x</script> said.</p><p>{S}</p></article>") == f"It was x2 = y as said.\n{S.strip()}"
    assert H.main_text("<head><title>T</title><p>text") == "text" and H.main_text(f"{AROUND[0]}{AROUND[1]}") == ""


def test_cluster_is_the_plain_one():
    """Smoothing and threshold, sum by sum."""
    page = H.Page()
    lines = page.read("".join(AROUND) + "".join(SHAPES.values()))
    for sigma, spread in ((1.0, 0.5), (0.3, 1.0), (3.0, 0.2), (2.0, 9.0)):
        r = max(1, math.ceil(2 * sigma))
        smooth = []
        for i in range(len(lines)):
            near = [(math.exp(-((i - j) ** 2) / (2 * sigma**2)), lines[j].ratio) for j in range(max(0, i - r), min(len(lines), i + r + 1))]
            smooth.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
        mean = sum(smooth) / len(smooth)
        least = spread * math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
        want = [x >= least for x in smooth]
        assert H.clustered(lines, sigma, spread).tolist() == (want if any(want) else [True] * len(want))


def test_the_cluster_selects():
    """Without article and main, ratios alone tell content from what stands around it."""
    plain = f"<div>{MENU}</div><div><p>Sign here</p><p>Now</p></div><div>{BODY}</div><div>Imprint</div><div>{MENU}</div>"
    assert H.main_text(plain) == WANT
    pages = [plain, f"<div><p>{S}</p></div><div>{MENU}</div><div>{BODY}</div>", *SHAPES.values(), f"<article>{S}</article><div><p>{S * 2}</p></div>"]
    chosen = {(a, b): [H.main_text(p, a, b) for p in pages] for a, b in ((1.0, 0.5), (0.2, 0.5), (4.0, 0.5), (1.0, 1.5), (1.0, 0.0))}
    assert len(set(map(tuple, chosen.values()))) >= 4


@pytest.mark.parametrize("html", [
    "<a " * 300_000, "<!--" * 200_000, "<!-- > " * 120_000, "<article>" * 20_000 + "</p>" * 20_000, "<div>" * 60_000 + "</div>" * 30_000, ('<a x="' * 3 + ">") * 40_000, "<" * 200_000, "<![x" * 200_000 + ">",
    "<table>" + "<div>" * 20_000 + "<td></td>" * 20_000, "<ul><li>" * 40_000, "<table><tr><td>" * 20_000 + "</tr>" * 20_000, "<script>" * 100_000, "<p>x" * 60_000,
], ids=range(13))
def test_hostile_markup_takes_linear_time(html):
    began = time.perf_counter()
    H.main_text(html)
    assert time.perf_counter() - began < 12


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<nav>", "</nav>", "<![a[", "]]>", "<!--", "-->", "<!", "<?", "</", "<a \"'", ">", "text ", "&amp;", "&#x", "<svg>", "<head>", "<option>", "</body>", "<br/>", "<h1>", "\x00"]), max_size=25))
def test_any_markup_is_read(parts):
    text = H.main_text("".join(parts))
    assert text == "\n".join(" ".join(x.split()) for x in text.split("\n"))


def test_tables(spark):
    rows = [(1, "u", "<p>a b"), (1, "u", "<p>a b"), (None, None, None), (2, "v", "")]
    table = spark.createDataFrame([(*r, 7) for r in rows], "page_id bigint, url string, html string, n_chars int")
    got = sorted((tuple(r) for r in H.extract_pages(table).collect()), key=repr)
    assert got == sorted([(1, "u", "a b", 3), (1, "u", "a b", 3), (None, None, "", 0), (2, "v", "", 0)], key=repr)
    with pytest.raises(ValueError, match="n_chars"):
        H.extract_pages(table, keep=("page_id", "n_chars"))

"""Articles stay whole: their lists, tables and summaries at the border of the region, lines, marks and names."""

import os

import pytest

from trailmark.llm import html_extract as h

WORDS = "Some words of a paragraph that is long enough to be content, and then a few more of them."
PS = f"<p>{WORDS}</p><p>{WORDS}</p>"
LINES = f"{WORDS}\n{WORDS}"
MENU = '<nav><a href="/">Home</a><a href="/x">News</a></nav>'


@pytest.fixture(scope="module", params=["prior", "learned"])
def weight(request, spark):
    if request.param == "prior":
        return h.Weights({})
    d = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(d):
        pytest.skip("no test tables here")
    return h.learn(spark, spark.read.parquet(d))


@pytest.mark.parametrize("inside, want", [
    (f"{PS}<ul><li>One</li><li>Two</li></ul>", f"{LINES}\nOne\nTwo"), (f"<table><tr><td>a</td><td>b</td></tr></table>{PS}", f"a\nb\n{LINES}"), (f"{PS}<table><tr><td>a</td></tr></table>", f"{LINES}\na"),
    (f"{PS}<details><summary>More</summary>Text here</details>", f"{LINES}\nMore\nText here"), (f'{PS}<h2>References</h2><ul><li><a href="a">First link</a></li><li><a href="b">Second</a></li></ul>', f"{LINES}\nReferences\nFirst link\nSecond"),
    (f'<ul><li><a href="#a">Part</a></li></ul>{PS}', f"Part\n{LINES}"), (f"Lead <picture><source><img></picture> more{PS}", f"Lead more\n{LINES}"), (f"Sum <math><mi>x</mi></math> is{PS}", f"Sum x is\n{LINES}"),
])
def test_marked_articles_are_whole(weight, inside, want):
    for page in (f"<html><body>{MENU}<article>{inside}</article><footer>Imprint</footer></body></html>", f"{MENU}<main><h1>Title</h1>{inside}</main><footer>x</footer>", f'{MENU}<div role="main">{inside}</div><div>Beside it stand <b>other</b> words</div>'):
        assert h.extract(page, weight) == (f"Title\n{want}" if "<h1>" in page else want)


def test_ends_of_an_unmarked_region_are_completed(weight):
    page = f"{MENU}<div class=text>{PS}<ul><li>One</li><li><a href=x>Two</a></li></ul></div><footer>Imprint</footer>"
    got = h.extract(page, weight)
    assert got in (f"{LINES}\nOne\nTwo", LINES)


@pytest.mark.parametrize("tag", ["<img>", "<input>", "<wbr>", "<x-icon></x-icon>", "<button>push</button>", "<svg><text>t</text></svg>", "<picture><img></picture>", "<math></math>", "<select><option>o</option></select>"])
def test_tags_within_a_line(weight, tag):
    want = f"{WORDS} {WORDS}"
    assert h.extract(f"<article><p>{WORDS} {tag} {WORDS}</p></article>", weight) == want


@pytest.mark.parametrize("name", ["reader-comments", "user-comments", "commentlist", "newsletter-signup-form", "adsbygoogle", "comments", "post-comments", "user-reviews-comments"])
def test_what_is_no_content(weight, name):
    if name == "user-reviews-comments":  # says something else too
        assert not h.named(name)
        return
    page = f'<article>{PS}<p>{WORDS}</p><div class="{name}"><p>Mine is a remark of my own.</p></div></article><section id="{name}"><p>Nor is this one.</p></section>'
    assert h.extract(page, weight) == f"{LINES}\n{WORDS}"


def test_given_pages_give_their_article(spark):
    d = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(d):
        pytest.skip("no test tables here")
    pages = spark.read.parquet(d)
    got = h.extracted(spark, pages, ["page_id"]).collect()
    few = h.learn(spark, pages, sample=40)
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    assert len(got) == len(html) and all(h.extract(html[r["page_id"]], few) == r["text"] for r in got)


def test_null_ids_and_pages(spark):
    rows = spark.createDataFrame([(None, "u", f"<article>{PS}</article>"), (1, None, None), (1, None, "")], "page_id long, url string, html string")
    assert sorted((r["text"], r["n_chars"]) for r in h.extracted(spark, rows, ["page_id", "url"]).collect()) == [("", 0), ("", 0), (LINES, len(LINES))]

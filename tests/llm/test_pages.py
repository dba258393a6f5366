import os
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tesserae.llm import pages as p
from tests.llm.helpers import rows

ARTICLE = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href='/x'>Menu</a></nav><div class='ad'>Buy</div><article><h1>Head &amp; title</h1><p>First <b>bold</b>\n text<br>line.<p>Second &lt;p&gt;.</p><div class='comments'>Reader</div><form>Name <input></form></article><footer>&copy; site</footer></body></html>"


def pages(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string")


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        shared = p.shared_lines(a, b)
        it = iter(b)
        assert sum(shared) == lcs(a, b) and all(x in it for x, s in zip(a, shared, strict=True) if s)


def test_article():
    assert p.main_text(p.lines_of(ARTICLE), []) == "Head & title First bold text line. Second <p>."


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain words", "plain words"), ("<p>cut &am", "cut &am"), ("<!-- open <p>x", ""), ("<nav>never closed<article>main</article>", "main"), ("<main>a<aside>b</aside>c</main>", "a c"), ("<p>1 < 2</p>", "1 < 2"), ("<div hidden>x</div><div id='main'>y</div>", "y"), ("<p title='a>b'>q</p>", "q")])
def test_odd_pages(page, text):
    assert p.main_text(p.lines_of(page), []) == text


@pytest.mark.parametrize("page, text", [("<main class='site-main with-sidebar'><p>a</p></main>", "a"), ("<article class='post social'>b<div class='share'>x</div></article>", "b"), ("<article class='sponsored'>x</article><article>c</article>", "c"), ("<article class='comment'>x</article><p>d</p>", "d"), ("<html><head><title>T</title><meta charset=utf-8><body><nav>x</nav><article>e</article>", "e"), ("<head><title>T</title><p>f</p>", "f"), ("<head><title>T</title></head><body>g</body>", "g")])
def test_markup_that_must_not_empty_a_page(page, text):
    assert p.main_text(p.lines_of(page), []) == text


def site(i, body):
    return f"<html><body><div>Site name</div><p>Welcome here</p>{body}<p>All about us</p></body></html>"


def test_shared_lines_go(spark):
    data = [(i, f"http://h.example/a/{i}", site(i, f"<p>Story {i}</p><p>End {i}</p>")) for i in range(40)]
    data += [(200 + i, f"http://runs.example/{i:02d}", site(0, "<p>Same</p>") if i not in (0, 9) else site(0, f"<p>Other {i}</p>")) for i in range(10)]
    data += [(100, "http://alone.example/x", site(0, "<p>Only</p>")), (101, None, None), (102, "http://copy.example/1", site(1, "<p>C</p>")), (103, "http://copy.example/2", site(1, "<p>C</p>"))]
    got = {r["page_id"]: r for r in p.extract(pages(spark, data)).collect()}
    assert all(got[i]["text"] == f"Story {i} End {i}" for i in range(40))
    assert got[100]["text"] == "Site name Welcome here Only All about us"
    assert {got[200 + i]["text"] for i in range(1, 9)} == {"Same"} and got[209]["text"] == "Other 9"
    assert got[101]["text"] == "" and got[101]["n_chars"] == 0 and got[101]["url"] is None
    assert got[102]["text"] == got[103]["text"] == "Site name Welcome here C All about us"


def test_rows_columns_and_none(spark):
    data = [(1, "http://a/x", ARTICLE), (1, "http://a/x", ARTICLE), (None, "http://a/y", "<article>" + "<p>word</p>" * 20000 + "</article>")]
    df = pages(spark, data).withColumn("bucket", F.lit("x")).withColumn("k", F.lit("x"))
    got = rows(p.extract(df))
    assert len(got) == 3 and max(r[3] for r in got) == 20000 * 5 - 1
    assert rows(p.extract(pages(spark, []))) == []


def by_hand(page):
    """The article's text by the standard library's parser: another reader than the operator's."""
    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.inside, self.left_out = [], 0, []

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside += 1
            marks = set(re.split("[^a-z]+", " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()))
            if tag in ("form", "script", "style", "nav", "aside", "header", "footer") or marks & (p.HINTS | p.COMMENTS):
                self.left_out.append(tag)
            elif self.left_out and self.left_out[-1] == tag:
                self.left_out.append(tag)
            if tag not in p.INLINE:
                self.out.append(" ")

        def handle_endtag(self, tag):
            if tag == "article":
                self.inside -= 1
            if self.left_out and self.left_out[-1] == tag:
                self.left_out.pop()
            if tag not in p.INLINE:
                self.out.append(" ")

        def handle_data(self, data):
            if self.inside and not self.left_out:
                self.out.append(data)

    reader = Reader()
    reader.feed(page or "")
    reader.close()
    return " ".join("".join(reader.out).split())


def test_every_page_of_the_driver(spark, sf):
    for size in ("sf0.001", "sf0.01"):
        pages_ = spark.read.parquet(f"{sf}/../{size}/pages.parquet")
        want = {r["page_id"]: by_hand(r["html"]) for r in pages_.collect()}
        assert {r["page_id"]: r["text"] for r in p.extract(pages_).collect()} == want


def test_pages_without_articles_by_hand(spark):
    """The whole operator against a plain sort, the nearest different pages of a host, and the
    quadratic table of common subsequences."""
    rng = random.Random(5)
    data = []
    for i in range(160):
        host, path = rng.choice(["a.example", "b.example", "c.example"]), f"{rng.choice(['x', 'y/z'])}/{rng.randrange(60):03d}"
        words = [rng.choice(["Menu", "Top", f"w{rng.randrange(30)}", f"w{rng.randrange(30)}"]) for _ in range(rng.randint(1, 7))]
        data.append((i, f"https://{host}/{path}", "".join(f"<p>{w}</p>" for w in words)))
    order = sorted((p.sort_key(*p.host_and_path(u), i), *p.host_and_path(u), i, re.findall("<p>(.*?)</p>", h)) for i, u, h in data)
    got = {r["page_id"]: r["text"] for r in p.extract(pages(spark, data)).collect()}
    for at, (_, host, path, i, lines) in enumerate(order):
        ahead = next((r for r in order[at + 1 :] if r[1] != host or r[4] != lines), None)
        behind = next((r for r in reversed(order[:at]) if r[1] != host or r[4] != lines), None)
        near = sorted((r for r in (ahead, behind) if r and r[1] == host), key=lambda r: -len(os.path.commonprefix([r[2], path])))
        sizes = [len(lines) - lcs(lines, r[4]) for r in near]
        kept = next((n for n in sizes if n), len(lines))
        assert len(got[i].split()) == kept

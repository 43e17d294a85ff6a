"""The element tree of listing pages, against hand-made pages and an independent reader of well-formed ones."""

import random
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hearthlake.session import spread_small_scan
from hearthlake.sources import elements, markup


def words(source):
    return " ".join(elements.parse(source).text(" ").split())


@pytest.mark.parametrize(("source", "want"), [
    ("<p title=it's>x</p> mid <b>don't</b> end", "x mid don't end"),
    ("<p title=it's>alpha</p><p>don't beta</p><p title='z'>gamma</p>", "alpha don't beta gamma"),
    ("a<!-->b<!--->c<!--x--!>d<!-- - -- >e-->f", "a b c d f"),
    ("a<!x>b<?y>c</ z>d</>e", "a b c d e"),
    ("a < b &amp; <c d='1>2' e=\"'\" f=g/>h", "a < b & h"),
    ("a<b x=>c</b><plaintext><i>d", "a c <i>d"),
    ("<textarea><b>&lt;</textarea>e<script>no</scriptx></script>f", "<b>< e f"),
    ("kept<b title='never closed>lost", "kept"),
    ("kept<b title", "kept"),
    ("", ""),
])
def test_tokens_follow_the_attribute_states(source, want):
    assert words(source) == want


def test_implied_ends_parents_and_siblings():
    page = elements.parse("<ul><li>x<ul><li>n</ul><li>y</ul><p>a<p>b<div>c</div><table><tr><td>1<td>2<tr><td>3</table>")
    lists = list(page.all("ul"))
    assert [li.text() for li in lists[0].children] == ["xn", "y"] and lists[1].inside("li", lists[0])
    assert lists[0].next_sibling().text() == "a" and page.first("div").parent is page
    assert [len([c for c in r.children]) for r in page.all("tr")] == [2, 1]
    deep = elements.parse("<div>" * 5000 + "x")
    assert deep.text() == "x"


class Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out = []

    def handle_data(self, data):
        self.out.append(data)


def test_well_formed_pages_keep_their_words():
    rng = random.Random(4)
    values = ["it's", 'a "b"', "x > y", "</p>", "<li>", "ok", "", "é&"]
    for _ in range(300):
        parts = []

        def grow(depth):
            for _ in range(rng.randrange(4)):  # noqa: B023
                tag = rng.choice(["div", "span", "b", "section", "i"])
                name = rng.choice(["title", "data-x", "class"])
                parts.append(f'<{tag} {name}="{escape(rng.choice(values))}"{rng.choice(["", " ", " hidden"])}>')  # noqa: B023
                parts.append(escape(rng.choice(values), quote=False) + rng.choice([" ", "<br>", "<br/>", "<!-- it's > -->"]))  # noqa: B023
                if depth < 4:
                    grow(depth + 1)
                parts.append(f"</{tag}>")  # noqa: B023

        grow(0)
        source = "".join(parts)
        reader = Reader()
        reader.feed(source)
        reader.close()
        assert "".join(words(source).split()) == "".join("".join(reader.out).split())


def test_sections_of_nested_lists(spark):
    html = """<div class="optionalItemsContainer"><span><b>Sem lista</b></span>
    <span><b>Lazer</b><ul><li>x<ul><li>n</li></ul></li><li>y</li></ul></span><div><span><b>Fora</b><ul><li>no</li></ul></span></div></div>"""
    df = spark.createDataFrame([("u", html, 1), ("v", None, 2), ("w", "", 3)], "url string, html string, parts int")
    got = {r.url_anuncio: r for r in markup.listing_fields(df).collect()}
    assert got["u"].attrs == {"comodidades_lazer": "xn, n, y"}
    assert got["v"].attrs == {} and got["v"].titulo is None and got["w"].attrs == {}
    old = {r.url: r for r in markup.legacy_fields(df).collect()}
    assert old["u"].secoes == {"lazer": "xn, n, y"} and old["v"].imagem == "Imagem não encontrada"
    assert markup.listing_fields(df.limit(0)).count() == 0


def test_a_small_file_of_one_row_group_is_dealt_out(spark, tmp_path):
    session = spark.newSession()
    rows = 400_000  # one row group, which splits of 64 KB cannot share
    pq.write_table(pa.table({"x": np.random.default_rng(1).random(rows)}), tmp_path / "one.parquet", row_group_size=rows)
    session.conf.set("spark.sql.files.maxPartitionBytes", 64 << 10)
    scan = session.read.parquet(str(tmp_path / "one.parquet"))

    def largest(df):
        return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

    assert scan.rdd.getNumPartitions() >= 4 and largest(scan) == rows
    assert largest(spread_small_scan(scan)) <= rows / 3


def test_tags_without_attributes_skip_their_states(monkeypatch):
    read = []
    monkeypatch.setattr(elements, "attributes", lambda source, at, whole=elements.attributes: read.append(at) or whole(source, at))
    assert words("<p><b>one</b ><i class=x>two</i><br/></p>three") == "one two three"
    assert len(read) == 3  # </b >, <i class=x> and <br/>

"""Column expressions on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import hashing, lexicons, price, text, url
from larkspur.functions.url_type import classify_url, split_url
from larkspur.operators import normalize


def values(spark, inputs, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_price_amount(spark):
    cases = {"12 995 kr": 12995.0, "12.995 kr": 12995.0, "12,995.50": 12995.5, "12.995,50": 12995.5, "12 999 - 15 999 kr": 12999.0,
             "1.234.567": 1234567.0, "99,9": 99.9, "12 995 kr": 12995.0, "0": None, "-5": None, "ask": None, "1,2.3,4": None}
    assert values(spark, cases, price.price_amount) == list(cases.values())


def test_money_sv(spark):
    rows = values(spark, ["12 995 kr", "12 995:-", "12.50 kr", "1.234 kr", "12 995,00 kr", "Pris på förfrågan", "", "50 EUR"], price.money_sv)
    assert [r.amount for r in rows] == [12995.0, 12995.0, 12.5, 1234.0, 12995.0, None, None, 50.0]
    assert [r.currency for r in rows] == ["SEK", None, "SEK", "SEK", "SEK", None, None, "EUR"]
    assert rows[5].warnings == ["unparseable"] and rows[6].warnings == ["missing"] and rows[2].warnings == ["suspiciously_low"]


def test_size_class_from_title(spark):
    titles = ["Bertha Soffa 2-sits", "3-sits Bäddsoffa Masin", "4-sits Hörnbäddsoffa", "U-Bäddsoffa Höger", "Schäslong Lilly", "Okänd"]
    assert values(spark, titles, normalize.size_class_title) == ["small", "medium", "large", "large", "small", None]


def test_lexicon_inference(spark):
    titles = ["Bolero 3-sits soffa svart", "Red Edition Fifties Sofa 210", "STOCKHOLM 2025 3-seat sofa", "inredningsstilar och kollektionen", "Sofa off-white"]
    got = values(spark, titles, lambda c: text.infer_canon(c, F.lit(""), lexicons.COLORS))
    assert got == ["black", "red", None, None, "white"]
    assert values(spark, ["leather", "okänt", "  ", None], lambda c: text.canon(c, lexicons.MATERIALS, "mixed")) == ["leather", "mixed", None, None]


def test_clean_text(spark):
    titles = ["&#xC5;re 2-sits", "&amp;#xC5;re   Soffa", "  <b>&Aring;re</b> \n Soffa ", "   ", None]
    assert values(spark, titles, text.clean_title) == ["Åre 2-sits", "Åre Soffa", "Åre Soffa", None, None]
    assert values(spark, ["<p>One</p><br>Two  words<br/>&lt;b&gt;three&lt;/b&gt;"], text.clean_description) == ["One\n\nTwo words\n\nthree"]


def test_canonical_url(spark):
    urls = ["https://Example.COM/p?utm_source=x", "https://a.com/p#frag", "https://a.com/x?b=2&a=1&b=3&fbclid=9&e=", "ftp://a.com/p"]
    assert values(spark, urls, url.canonical_url) == ["https://example.com/p", "https://a.com/p", "https://a.com/x?b=2&b=3&a=1", "ftp://a.com/p"]


def test_url_signature_and_domain(spark):
    assert values(spark, ["https://a.com/p/?size=1&x=2&color=3", "https://A.com/p"], url.url_signature) == ["https://a.com/p?color&size", "https://a.com/p"]
    assert values(spark, ["www.mio.example", "https://sub.example.com/x"], url.canonical_domain) == ["mio.example", "sub.example.com"]


@pytest.mark.parametrize("address,hint", [
    ("https://www.x.se/soffor", "category"), ("https://www.x.se/soffor-och-fatoljer/soffor", "category"), ("https://e.com/soffor?page=2", "category"),
    ("https://www.x.se/p/rossi-3-sits-soffa-beige", "product"), ("https://e.com/produkt/my-sofa-grey", "product"),
    ("https://www.x.se/soffa-grey-p12345-v2", "product"), ("https://e.com/a.pdf", "non_product"), ("https://e.com/", "homepage")])
def test_url_type(spark, address, hint):
    df = split_url(spark.createDataFrame([(address,)], "url string"))
    assert df.select(classify_url(F.col("url")).alias("t")).first().t.hint == hint


def test_hash_matches_signed_32_bit_rule(spark):
    def rule(s):
        h = 0
        for ch in s:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        return h - 2**32 if h >= 2**31 else h
    names = ["", "a", "session-123", "zzzzzzzzzzzz", "åäö"]
    assert values(spark, names, hashing.string_hash32) == [rule(n) for n in names]


def test_image_urls(spark):
    got = values(spark, ["https://x.se/a.jpg", "https://cdn.x.se/a", "https://x.se/produkt/a", "https://x.se/a?w=800", "short"], url.is_image_url)
    assert got == [True, True, False, True, False]
    df = spark.createDataFrame([(["/p/only-page-one", "/p/only-page-two"],), (["//c.x/i.jpg", "//c.x/i.jpg", "/p/page-long"],)], "a array<string>")
    out = [r.o for r in df.select(url.normalize_images(F.col("a"), F.lit("https://x.se/")).alias("o")).collect()]
    assert out == [["https://x.se/p/only-page-one", "https://x.se/p/only-page-two"], ["https://c.x/i.jpg"]]

"""Page state is walked to its end, however deep it nests."""

import json

import pytest

from larkspur.operators import extract as X


def page(value, depth):
    for i in range(depth):
        value = [value] if i % 2 else {"k": value}
    return f'<script id="__NEXT_DATA__" type="application/json">{json.dumps({"a": value})}</script>'


@pytest.mark.parametrize("depth", [2, 12, 60])
def test_product_at_depth(spark, depth):
    html = page({"name": "Deep stol", "price": 700, "sku": "1"}, depth)
    df = spark.createDataFrame([(1, "https://x.se/1", html), (2, "https://x.se/2", "<p>none</p>")], "page_id int, url string, html string")
    assert [(r.page_id, r.node is not None) for r in X.embedded_product(df).orderBy("page_id").collect()] == [(1, True), (2, False)]
    assert [(r.method, r.title, r.price_amount) for r in X.extract_products(df).collect()] == [("embedded_json", "Deep stol", 700.0)]


@pytest.mark.parametrize("depth", [2, 12, 60])
def test_product_array_at_depth(spark, depth):
    html = page([{"name": f"Item {i}", "price": 10 + i, "url": f"/p/{i}"} for i in range(3)], depth)
    df = spark.createDataFrame([(1, "https://x.se/1", html)], "page_id int, url string, html string")
    assert [r.title for r in X.state_products(df).orderBy("position").collect()] == ["Item 0", "Item 1", "Item 2"]

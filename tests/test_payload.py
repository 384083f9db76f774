import json
import re
import time

import pytest
from pyspark.sql import functions as F

from pantryplan.functions import payload
from pantryplan.operators import jsonwalk


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [
        ('<script>self.__next_f.push([1,"a\\"b"])</script><p><script>self.__next_f.push([1,"c"]);</script>', 'a"bc'),
        ('<script>self.__next_f.push([0])</script><script>self.__next_f.push([1,null])</script><script>self.__next_f.push([1,{"a":"b"}])</script>', ""),
        ('<script>self.__next_f.push([1,"cut</script><script>other("x")</script><script>self.__next_f.push(["k","é)\\n"])</script>', "é)\n"),
        ('self.__next_f.push([1,"outside"])', ""),
        ("", ""),
    ],
)
def test_flight(spark, text, want):
    assert one(spark, payload.flight, text) == want


@pytest.mark.parametrize("text, want", [("a" + chr(92) + "u0026b", "a&b"), (r"5\" x", '5" x'), (r"https:\/\/x", "https://x"), (r"a\nb", "a b"), (r"\\n", " "), (None, "")])
def test_unescape_in_order(spark, text, want):
    assert one(spark, payload.unescape, text) == want


@pytest.mark.parametrize(
    "text, want", [("20+ in stock", "In stock (20+)"), ("3 in stock", "In stock (3)"), ("0 in stock", "Out of stock"), ("007  in stock today", "In stock (7)"), ("Only 3 in stock", "Only 3 in stock"), ("", ""), (None, "")]
)
def test_stock_status(spark, text, want):
    assert one(spark, payload.stock_status, text) == want


@pytest.mark.parametrize("text, want", [("4", "4"), ("0.5", "0.5"), ("12.75", "12.75"), ("1234.5678", "1234.57"), ("0.000123456789", "0.000123457"), ("100", "100"), ("999999", "999999")])
def test_six_digits(spark, text, want):
    assert one(spark, payload.six_digits, float(text), "double") == want == f"{float(text):g}".replace("e-", "e-")


@pytest.mark.parametrize(
    "name, sold, price, want",
    [
        ("Oats", "12 oz • $0.30/oz", "3", ("12 oz", "$0.30/oz")), ("Oats", "12 oz •", "3", ("12 oz", "")), ("Oats (16 OZ)", "", "4", ("16 OZ", "$0.25/oz")), ("Oats (a (b)", None, "4", ("a (b", "")), ("Oats (4 oz) x", "", "4", ("", "")),
        ("Oats", "0 oz", "4", ("0 oz", "")), ("Oats", "1.2.3 oz", "4", ("1.2.3 oz", "")), ("Oats", "2 oz", "", ("2 oz", "")),
    ],
)
def test_unit_fields(spark, name, sold, price, want):
    row = spark.createDataFrame([(name, sold, price)], "n string, s string, p string").select(payload.unit_fields(F.col("n"), F.col("s"), F.col("p")).alias("x")).first().x
    assert tuple(row) == want


def brute_cards(page):
    """item_id, name, image, badges and price of each window, with Python's own search."""
    out, inside = [], r'((?:[^"\\]|\\.)*)'
    for m in re.finditer('"item_data":{', page):
        ahead, window = page[max(0, m.start() - 900) : m.start()], page[m.start() : m.start() + 4000]
        get = lambda p, text: (re.search(p, text) or ["", ""])[1]
        if get(r'"item_id":"(\d+)"', window):
            badges = [b for b in re.findall(rf'"badgeText":"{inside}"', window) if b]
            badges += [v for k, v in re.findall(rf'"label":"([^"]+)","priority_level":"[^"]+","value":"{inside}"', ahead) if k == "badge" and v]
            out.append((get(r'"item_id":"(\d+)"', window), get(rf'"item_name":"{inside}"', window), get(rf'"uri":"{inside}"\}}\}}', ahead), badges, get(r'"unit_amount":(\d+)', window)))
    return out


def test_windows_reach_into_neighbours(spark):
    """Short cards: a window holds later cards' fields and what stands ahead of it earlier ones', as in the original."""
    cards = [
        '{"image":{"c":{"uri":"i%d"}},%s"item_data":{%s"item_name":"n\\"%d é",%s%s}' % (i, '{"label":"badge","priority_level":"x","value":"b%d"},' % i if i % 2 else "", '"item_id":"%d",' % i if i % 5 else "", i, '"unit_amount":%d,' % i if i % 7 == 0 else "", '{"badgeText":""},{"badgeText":"t%d"},' % i if i % 3 else "")
        for i in range(60)
    ]
    page = "".join(cards)
    df = spark.createDataFrame([(1, page), (2, ""), (3, None)], "page_id long, text string")
    got = payload.raw_cards(payload.item_windows(df, "text")).orderBy("item_no").collect()
    assert [(r.item_id, r.item_name, r.image, r.badge_texts, r.unit_amount) for r in got] == brute_cards(page)


def test_window_time_is_linear(spark):
    def seconds(n):
        page = "".join('"item_data":{"item_id":"%d","x":"%s"}' % (i, "y" * 300) for i in range(n))
        df = spark.createDataFrame([(page,)], "text string")
        started = time.time()
        assert payload.raw_cards(payload.item_windows(df, "text").drop("text")).count() == n
        return time.time() - started

    seconds(100)
    # ten times the marks in one page; a page split anew for each would take a hundred times
    assert seconds(10_000) < 25 * max(seconds(1_000), 0.4)


def test_products_without_ids_and_odd_lists(spark):
    lists = ['[{"id":null,"name":"x"},{"name":"y"},{"id":"None"},{"id":7,"name":"z","badges":null,"itemLimit":0,"metadata":{"soldAsInfo":null},"extra":[1]}]', "[]", "no list", None, '[{"id":8,"soldAsInfoLongText":"long","price":{"unitAmount":0}}]']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "k int, products string")
    got = {r.item_id: r for r in payload.normalised(payload.raw_products(df, "products")).collect()}
    assert set(got) == {"7", "8"} and got["7"].stock_status == "Out of stock" and got["8"].unit_size == "long" and got["8"].price_usd == "0.00" and got["7"].price_usd == ""


def walk_leaves(obj, names):
    if isinstance(obj, dict):
        for k, v in obj.items():
            if k in names and isinstance(v, str) and v:
                yield k, v
            else:
                yield from walk_leaves(v, names)
    elif isinstance(obj, list):
        for v in obj:
            yield from walk_leaves(v, names)


def test_named_leaves_in_document_order(spark):
    doc = {"z": [{"b": 'say "a":"no"'}, {"a": "1"}], "a": {"a": "2", "b": ["a", {"a": ""}]}, "é": {"q": {"a": "\\", "b": "•\n"}}, "a ": "x", "c": "a"}
    for text in (json.dumps(doc), json.dumps(doc, ensure_ascii=False, indent=1), json.dumps(doc, separators=(",", ":"))):
        got = one(spark, lambda c: payload.named_leaves(c, ("a", "b")), text)
        assert [tuple(r) for r in got] == list(walk_leaves(doc, {"a", "b"}))
    assert one(spark, lambda c: payload.named_leaves(c, ("a",)), None) is None


def test_item_details_fold(spark):
    leaf = lambda *pairs: json.dumps([{k: v} for k, v in pairs], ensure_ascii=False)
    s, a, u = payload.STRIKE_LEAF, payload.SPOKEN_LEAF, payload.UNIT_LEAF
    cases = {
        leaf((a, "$1, was $2"), (a, "$1, was $3")): ("", "", "$2", "2.00"),
        leaf((a, "$1, was $2"), (s, "$5"), (s, "6"), (a, "$1, was $9")): ("", "", "$5", "5.00"),
        leaf((a, "$1, was $2"), (s, "$x")): ("", "", "$x", "2.00"),
        leaf((u, "1 oz • $1"), (u, "2 oz"), (u, "3 oz•$3/oz • y")): ("3 oz", "$3/oz • y", "", ""),
        "[]": ("", "", "", ""),
    }
    for text, want in cases.items():
        assert tuple(one(spark, payload.item_details, text)) == want


def test_walk(spark):
    doc = {"b": {"x y": [1, [], {"q": None, "r": [True, "s"]}]}, "a": 0.5, "e": {}}
    rows = [(1, json.dumps(doc)), (2, "3"), (3, "not json"), (4, None), (5, "[" * 30 + '"deep"' + "]" * 30)]
    got = jsonwalk.walk(spark.createDataFrame(rows, "k int, t string"), "t", ["k"]).orderBy("k", "place").collect()
    assert [(r.path, r.value, r.depth) for r in got if r.k == 1] == [("$.a", "0.5", 1), ('$.b."x y"[0]', "1", 3), ('$.b."x y"[2].q', "null", 4), ('$.b."x y"[2].r[0]', "true", 5), ('$.b."x y"[2].r[1]', '"s"', 5)]
    assert [(r.k, r.path[:5], r.value) for r in got if r.k != 1] == [(2, "$", "3"), (5, "$[0][", '"deep"')]
    assert jsonwalk.walk(spark.createDataFrame([], "k int, t string"), "t", ["k"]).count() == 0


def test_page_badges(spark):
    got = one(spark, payload.page_badges, 'Best by 1/2 data-testid="best_by:Best by 3/4" 5k+ Recently Sold 1.5 oz · $2/oz >SNAP<')
    assert tuple(got) == ("3/4", "5k+ Recently Sold", "1.5 oz", "$2/oz", "yes")
    assert tuple(one(spark, payload.page_badges, "")) == ("", "", "", "", "")


def test_amounts_have_six_digits_at_any_size(spark):
    values = [0.0, 1.0, 12.75, 0.5, 999999.0, 999999.4, 999999.5, 1e6, 1000001.0, 1000005.0, 1000015.0, 1234565.0, 1234567.0, 7199995.0, 9999995.0, 1.5e12, 0.0001, 0.00012345678, 0.00005]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(payload.six_digits(F.col("x"))).collect()] == [f"{v:g}" for v in values]


def test_pages_reach_workers_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in (("10000", "32"), ("0", "32"), ("5", "5")):
            spark.conf.set(key, given)
            payload.item_windows(spark.createDataFrame([("x",)], "text string"), "text")
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)

import pytest
from pyspark.sql import functions as F

from larder.functions import jsonfix, scores, text, vectors


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind(v)}" for k, v in values.items()))
    return row.select(column.alias("x")).first()[0]


def kind(v):
    return {str: "string", float: "double", int: "long", bool: "boolean"}.get(type(v), "string") if not isinstance(v, list) else f"array<{kind(v[0]) if v else 'string'}>"


@pytest.mark.parametrize(
    "raw, want",
    [("2 Glasses of milk", (2.0, "glasse", "milk")), ("1/2 a banana", (0.5, None, "banana")), ("a cup of oatmeal", (1.0, "cup", "oatmeal")), ("half one apple", (0.5, None, "apple")), ("126 grams of maize flour", (126.0, "g", "maize flour")), ("I had rice for lunch", (None, None, "rice")),
     ("boneless thigh one", (1.0, None, "boneless thigh")), ("tender steak ten", (10.0, None, "tender steak")), ("12 glasz 2 g rice", (2.0, "g", "12 glasz rice")), ("soup\n3 cups x", (3.0, "cup", "soup x"))],
)
def test_meal_item(spark, raw, want):
    got = one(spark, text.parse_meal(F.col("t")), t=raw)
    assert [(x["qty"], x["unit"], x["term"]) for x in got] == [want]


def test_meal_split(spark):
    assert one(spark, text.split_meal(F.col("t")), t="rice, beans; and milk with sand") == ["rice", "beans", "milk", "sand"]
    assert one(spark, text.parse_meal(F.col("t")), t="") == []


def test_food_terms(spark):
    assert one(spark, text.food_terms(F.col("t")), t="126 grams of maize flour, a plain bun weighing 30 grams and a boiled large onion (1g). 5 g of MAIZE flour.") == ["maize flour", "bun", "onion"]
    assert one(spark, text.food_terms(F.col("t")), t="nothing here") == []


def test_synonyms(spark):
    assert one(spark, text.rewrite_synonyms(F.col("t")), t=" Groundnuts and groundnut ") == "peanuts and groundnut"
    assert one(spark, text.rewrite_synonyms(F.col("t")), t="rice") == "rice"


@pytest.mark.parametrize(
    "nutrient, reply, want",
    [("carb", 'Output: {"total_carbohydrates": 12.5}', 12.5), ("carb", '{"total_carbohydrates": "10-20"}', 15.0), ("carb", '{"total_carbohydrates": [1, 4]}', 2.5), ("fat", '{"total_fat": 3-5}', 4.0), ("protein", " 7 ", 7.0), ("energy", "none", -1.0)],
)
def test_answer(spark, nutrient, reply, want):
    assert one(spark, text.answer(F.col("t"), nutrient), t=reply) == want


def test_tags(spark):
    assert one(spark, text.strip_thoughts(F.col("t")), t="a<think>x\ny</think>b") == "ab"
    assert one(spark, text.tool_calls(F.col("t")), t='<tool_call>{"a": 1}</tool_call><tool_call>{bad}</tool_call>') == ['{"a": 1}']
    box = one(spark, text.boxes(F.col("t"), 200, 100), t="<ref>cup</ref><box>(100,200,300,400)</box>" * 2)
    assert [tuple(b) for b in box] == [("cup", 20.0, 20.0, 60.0, 40.0)]
    assert one(spark, text.frame_label(F.col("t")), t="detected_coffee_cup_0") == "coffee cup"
    assert one(spark, text.token_estimate(F.col("t")), t="abc") == 1
    assert sorted(one(spark, text.word_set(F.col("t")), t="Été à la été plage")) == ["plage", "été"]
    refs = one(spark, text.item_references(F.col("t")), t='x\n- sugar: USDA match → "Sugars, granulated" — Carb: 99.6g\n- onion: no reliable USDA match — own')
    assert [(r["food_term"], r["matched"]) for r in refs] == [("sugar", True), ("onion", False)]
    assert [tuple(r) for r in one(spark, text.coordinates(F.col("t")), t="a:1,2\nbad\nb:x,3")] == [("a", 1.0, 2.0)]


@pytest.mark.parametrize("reply, want", [('{"a": 1}', True), ('x ```json\n{"a": 1}\n``` y', True), ('so {"a": {"b": 1}} end', True), ('cut {"a": {"b": 1', True), ("none", False)])
def test_repair(spark, reply, want):
    got = one(spark, jsonfix.repair_json(F.col("t")), t=reply)
    assert (got is not None) == want


def test_lenient(spark):
    assert one(spark, jsonfix.lenient_double(F.col("t")), t='["3.5", "4"]') == 3.5
    assert one(spark, jsonfix.lenient_double(F.col("t")), t="7") == 7.0
    assert one(spark, jsonfix.lenient_double(F.col("t")), t="x") is None
    assert one(spark, jsonfix.repair_list(F.col("t")), t='1. "a" 2. "b"') == ["a", "b"]
    got = one(spark, jsonfix.targets(F.col("t")), t='{"targets": {"protein_g": 3, "fat_g": "x"}}')
    assert (got["protein_g"], got["fat_g"], got["energy_kcal"]) == (3.0, 20.0, 500.0)


def test_vectors(spark):
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[3.0, 4.0], b=[3.0, 4.0]) == pytest.approx(1)
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[3.0, 4.0]) is None
    assert one(spark, vectors.unit(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]


def test_scores(spark):
    l = F.lit  # noqa: E741
    assert one(spark, scores.macro_match((l(50.0), l(30.0), l(20.0)), (l(0.0), l(-1.0), l(0.0))), x="") == 0.0
    assert one(spark, scores.macro_match((l(1.0), l(1.0), l(0.0)), (l(1.0), l(1.0), l(0.0))), x="") == 1.0
    assert one(spark, scores.within(l(None).cast("double"), l(10.0), 0.5), x="") is False
    assert one(spark, scores.within(l(16.0), l(10.0), 0.5), x="") is False
    assert one(spark, scores.dominant(["P", "F"], [l(1.0), l(1.0)], "Other"), x="") == "P"
    assert one(spark, scores.bin_right_closed(l(100.0), [0.0, 100.0, 200.0], ["a", "b"]), x="") == "a"
    assert [one(spark, scores.sector_index(l(x), l(y)), x="") for x, y in ((1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (-1.0, 0.0), (1.0, -0.001))] == [0, 1, 2, 4, 0]
    assert one(spark, scores.patch_median(F.array(l(0.0), l(4.0), l(2.0))), x="") == 3.0
    assert one(spark, scores.yaw(l(0.0), l(0.0), l(0.5**0.5), l(0.5**0.5)), x="") == pytest.approx(1.5707963)

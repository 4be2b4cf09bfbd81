"""Texts for model calls, whole, with what is missing left out."""

import pytest
from pyspark.sql import functions as F

from larder.operators import prompts

REFS = "doc_id long, pos int, term string, matched boolean, candidates array<struct<rank:int,id:long,description:string,score:double>>"
HEAD = "\n".join(prompts.HEADER)


def test_numbers_are_written_exactly(spark):
    values = [0.25, 0.75, 0.15, 0.35, 2.5, 3.5, 1234567.05, -0.04, 0.0, 1e12]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", prompts.fixed(F.col("v")), prompts.fixed(F.col("v"), 0), prompts.fixed(F.col("v"), 2)).collect()
    for v, *said in got:
        assert said == [f"{v:.1f}", f"{v:.0f}", f"{v:.2f}"]


@pytest.fixture
def refs(spark):
    rows = [
        (1, 0, "rice", True, [(1, 10, "Rice, white", 0.9), (2, 11, "Rice, brown", 0.7), (3, 12, "Rye", 0.5)]),
        (1, 1, "zzz", False, [(1, 11, "Rice, brown", 0.2)]), (1, 2, "egg", True, [(1, 12, "Rye", 0.8), (2, 10, "Rice, white", 0.61)]),
        (2, 0, "air", False, None), (3, 0, "rye", True, [(1, 12, "Rye", 1.0)]),
    ]
    profiles = [(10, {"Carbohydrate, by difference": 28.25, "Protein": 2.0, "Energy (Atwater General Factors)": 130.0}), (11, {"Carbohydrate, by difference": 23.0}), (12, {"Protein": 1.0})]
    return spark.createDataFrame(rows, REFS), spark.createDataFrame(profiles, "fdc_id long, nutrients map<string,double>")


@pytest.mark.parametrize("style, body", [
    ("legacy", '[1] "Rice, white" (USDA #10)\n    Carbohydrate: 28.2g | Protein: 2.0g | Energy: 130.0kcal\n'),
    ("items", '- rice: USDA match → "Rice, white" — Carbohydrate: 28.2g | Protein: 2.0g | Energy: 130.0kcal\n- zzz: no reliable USDA match — use your own knowledge\n- egg: no reliable USDA match — use your own knowledge'),
    ("candidates", '- rice:\n  1. "Rice, white" — Carbohydrate: 28.2g | Protein: 2.0g | Energy: 130.0kcal\n  2. "Rice, brown" — Carbohydrate: 23.0g\n\n- egg:\n  1. "Rice, white" — Carbohydrate: 28.2g | Protein: 2.0g | Energy: 130.0kcal\n'),
])
def test_reference_blocks(refs, style, body):
    got = dict(prompts.reference_blocks(*refs, style).collect())
    assert got == {1: f"{HEAD}\n{body}\n===", 2: "", 3: ""}  # the third has no carbohydrate


def test_reference_blocks_by_nutrient(refs):
    assert {k for k, v in prompts.reference_blocks(*refs, "items", "protein").collect() if v} == {1, 3}
    assert {k for k, v in prompts.reference_blocks(*refs, "items", "energy").collect() if v} == {1}
    assert prompts.reference_blocks(refs[0].limit(0), refs[1], "legacy").collect() == []
    with pytest.raises(ValueError):
        prompts.reference_blocks(*refs, "other")


def test_recipe_prompts(spark):
    recipes = spark.createDataFrame([(1, 2, "Stew", ["a", "b", "c"], 100.0, None, 5.25, None), (1, 1, None, None, None, None, None, None)], "qid long, place int, recipe_name string, ingredients array<string>, calories double, protein double, carbohydrates double, saturated_fat double")
    asked = spark.createDataFrame([
        (1, "a stew", ["a"], ["x", "y"], [("protein", "high", 5.0, 30.0), ("fat", "low", None, None), ("salt", None, 1.0, None)], [("fiber", 1.0, 2.5, "g")]), (2, None, None, [], None, None),
    ], "qid long, query_text string, positive array<string>, negative array<string>, limits array<struct<nutrient:string,level:string,low:double,high:double>>, guidelines array<struct<nutrient:string,lower:double,upper:double,unit:string>>")
    got = dict(prompts.recipe_prompts(recipes, asked, 2).collect())
    assert got[1] == (
        '=== Candidate Recipes ===\n1. "Unknown"\n   Ingredients: ingredients: N/A\n   Nutrients (per serving): nutrients: N/A\n2. "Stew"\n   Ingredients: a, b (+1 more)\n   Nutrients (per serving): cal: 100.0, carbs: 5.2\n===\n\n'
        f"Query: a stew\nMust include: a\nMust NOT include: x, y\nNutrient: high protein (5.0-30.0)\nNutrient: low fat\nGuideline: fiber 1.0-2.5 g per meal\n\n{prompts.ASKED}"
    )
    assert got[2] == f"=== Candidate Recipes ===\n\n===\n\nQuery: \n\n{prompts.ASKED}"


def test_offer_context(spark):
    goals = spark.createDataFrame([(1, "u", "Low protein.", 30.5, 10.0, 50.0, None), (2, "v", None, None, None, None, None)], "qid long, user_id string, reasoning string, protein_g double, fat_g double, carb_g double, energy_kcal double")
    options = spark.createDataFrame([
        (1, 2, True, "Tofu", {"Protein": 12.0, "Energy": 80.5}, 0.7, None), (1, 1, True, "Egg", None, 0.5, None), (1, 3, False, "Tempeh", {"Protein": 19.0}, 0.5, 0.875),
    ], "qid long, place int, is_seed boolean, description string, nutrients map<string,double>, preference double, similarity double")
    likes = spark.createDataFrame([("u", "favourite", 2, "Rice"), ("u", "favourite", 1, "Tofu"), ("w", "disliked", 1, "Egg")], "user_id string, kind string, place int, food_desc string")
    got = dict(prompts.offer_context(goals, options, likes, "dinner").collect())
    assert got[1].split("\n") == [
        "=== Nutritional Gap Analysis ===", "Low protein.", "Target for dinner: ~30g protein, ~10g fat, ~50g carb, ~0 kcal", "", "=== Recommended Foods (from USDA database) ===",
        '[1] "Egg" — 0.0g protein | 0.0g fat | 0.0g carb | 0 kcal per 100g', '[2] "Tofu" — 12.0g protein | 0.0g fat | 0.0g carb | 80 kcal per 100g (user favorite)', "",
        "Similar alternatives (via GAT embedding neighbors):", '  - "Tempeh" — 19.0g protein | 0.0g fat | 0.0g carb (similarity: 0.88)', "", "=== User Preference History ===", "User tends to choose: Tofu, Rice", "",
    ]
    assert got[2].split("\n")[2:] == ["Target for dinner: ~0g protein, ~0g fat, ~0g carb, ~0 kcal", "", "=== Recommended Foods (from USDA database) ===", ""]

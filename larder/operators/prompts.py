"""Texts for model calls: reference blocks of a benchmark, candidate recipes with requirements, what to offer next.

All is put together by column functions; what is grouped is one request's lines, never a table.  Numbers are written as C
and Python write them (exact value, ties to even).  The system message of a call is the caller's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording of the blocks, and the names and units of nutrients in them.
HEADER = [
    "=== USDA Reference (per 100g) ===",
    "Below are possible USDA matches for some ingredients.",
    "Ignore wrong matches and use your own knowledge.",
    "The reference may only cover some of the items — estimate the rest yourself",
    "Keep reasoning brief",
    "",
]
SHOWN = {"Carbohydrate, by difference": "Carbohydrate", "Protein": "Protein", "Total lipid (fat)": "Fat"}
ENERGY = ["Energy", "Energy (Atwater General Factors)", "Energy (Atwater Specific Factors)"]
TARGETS = {"carb": ["Carbohydrate, by difference"], "protein": ["Protein"], "fat": ["Total lipid (fat)"], "energy": ENERGY}
RECIPE_FACTS = {"calories": "cal", "protein": "protein", "carbohydrates": "carbs", "saturated_fat": "sat_fat"}
ASKED = "Which recipes from the list above satisfy ALL requirements? Return a JSON list of recipe names."


def fixed(x: Column, digits: int = 1) -> Column:
    """A number with so many digits after the point."""
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * digits if digits else "0"))


def _said(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _lines(*parts: Column) -> Column:
    """Arrays of lines, or single ones, as one text; nulls are left out."""
    return F.array_join(F.array_compact(F.concat(*parts)), "\n")


def _amount(nutrients: Column, name: str) -> Column:
    return F.try_element_at(nutrients, F.lit(name))


def food_facts(nutrients: Column) -> Column:
    """The key nutrients of a food that are known, and the first energy there is."""
    energy = F.coalesce(*(_amount(nutrients, n) for n in ENERGY))
    parts = [F.when(_amount(nutrients, n).isNotNull(), _said(f"{s}: ", fixed(_amount(nutrients, n)), "g")) for n, s in SHOWN.items()]
    return F.array_join(F.array_compact(F.array(*parts, F.when(energy.isNotNull(), _said("Energy: ", fixed(energy), "kcal")))), " | ")


def reference_blocks(refs: DataFrame, profiles: DataFrame, style: str, nutrient: str = "carb", least: float = 0.6) -> DataFrame:
    """The whole reference text of each sample: doc_id, block; empty where nothing in it would be a reference.

    refs: as `assistant.references` gives them.  profiles: fdc_id, nutrients (map).  A food counts if the target nutrient
    is known.  `legacy`: matched foods, numbered; `items`: every term, those below `least` as unknown; `candidates`: all
    foods of a term from `least` on, terms without any left out.
    """
    if style not in ("legacy", "items", "candidates"):
        raise ValueError(f"unknown style {style!r}")
    each = refs.select("doc_id", "pos", "term", "matched", F.explode_outer("candidates").alias("c")).select("doc_id", "pos", "term", "matched", F.col("c.id").alias("fdc_id"), "c.rank", "c.description", "c.score")
    each = each.join(profiles.select("fdc_id", "nutrients"), "fdc_id", "left")
    known = F.coalesce(*(_amount(F.col("nutrients"), n) for n in TARGETS[nutrient])).isNotNull()
    food = F.when(known, F.struct("rank", "fdc_id", "description", "score", food_facts(F.col("nutrients")).alias("facts")))
    # one shuffle by sample serves both groupings
    terms = each.repartition("doc_id").groupBy("doc_id", "pos").agg(F.first("term").alias("term"), F.first("matched").alias("matched"), F.sort_array(F.collect_list(food)).alias("foods"))
    docs = terms.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "term", "matched", "foods"))).alias("terms"))
    best = lambda t: F.get(F.filter(t["foods"], lambda f: f["rank"] == 1), F.lit(0))
    if style == "legacy":
        found = F.filter("terms", lambda t: t["matched"] & best(t).isNotNull())
        entry = lambda t, i: F.array(_said("[", (i + 1).cast("string"), '] "', best(t)["description"], '" (USDA #', best(t)["fdc_id"].cast("string"), ")"), _said("    ", best(t)["facts"]), F.lit(""))
        body = F.flatten(F.transform(found, entry))
    elif style == "items":
        good = lambda t: t["matched"] & F.coalesce(best(t)["score"] >= least, F.lit(False))
        found = F.filter("terms", good)
        entry = lambda t: F.when(good(t), _said("- ", t["term"], ': USDA match → "', best(t)["description"], '" — ', best(t)["facts"])).otherwise(_said("- ", t["term"], ": no reliable USDA match — use your own knowledge"))
        body = F.transform("terms", entry)
    else:
        valid = lambda t: F.filter(t["foods"], lambda f: f["score"] >= least)
        found = F.filter("terms", lambda t: F.size(valid(t)) > 0)
        line = lambda f, i: _said("  ", (i + 1).cast("string"), '. "', f["description"], '" — ', f["facts"])
        body = F.flatten(F.transform(found, lambda t: F.concat(F.array(_said("- ", t["term"], ":")), F.transform(valid(t), line), F.array(F.lit("")))))
    text = _lines(F.array(*map(F.lit, HEADER)), body, F.array(F.lit("===")))
    return docs.select("doc_id", F.when(F.size(found) > 0, text).otherwise("").alias("block"))


def _first_of(names: Column, n: int, more: str) -> Column:
    """Names in a row, those past the n-th as a number."""
    rest = F.size(names) - n
    return _said(F.array_join(F.slice(names, 1, n), ", "), F.when(rest > 0, _said(more, rest.cast("string"), " more)")).otherwise(""))


def recipe_prompts(candidates: DataFrame, requests: DataFrame, max_items: int = 10) -> DataFrame:
    """The user's message of each request: qid, prompt.

    candidates: qid, place, recipe_name, ingredients (array), calories, protein, carbohydrates, saturated_fat.
    requests: qid, query_text, positive, negative (arrays), limits (array of nutrient, level, low, high), guidelines (array
    of nutrient, lower, upper, unit).  Nulls are left out; a request without candidates has an empty list.
    """
    facts = F.array_join(F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), _said(f"{s}: ", fixed(F.col(c)))) for c, s in RECIPE_FACTS.items()))), ", ")
    facts = F.when(facts == "", "nutrients: N/A").otherwise(facts)
    uses = F.when(F.coalesce(F.size("ingredients"), F.lit(0)) > 0, _first_of(F.col("ingredients"), max_items, " (+")).otherwise("ingredients: N/A")
    entry = _said('"', F.coalesce("recipe_name", F.lit("Unknown")), '"\n   Ingredients: ', uses, "\n   Nutrients (per serving): ", facts)
    listed = candidates.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", entry.alias("entry")))).alias("listed"))
    numbered = F.transform("listed", lambda r, i: _said((i + 1).cast("string"), ". ", r["entry"]))
    some = lambda names, says: F.when(F.size(names) > 0, _said(says, F.array_join(names, ", ")))
    level = lambda x: _said("Nutrient: ", F.coalesce(x["level"], F.lit("")), " ", F.coalesce(x["nutrient"], F.lit("")))
    limit = lambda x: F.when(x["low"].isNotNull() & x["high"].isNotNull(), _said(level(x), " (", x["low"].cast("string"), "-", x["high"].cast("string"), ")")).when(x["level"] != "", level(x))
    guide = lambda x: _said("Guideline: ", x["nutrient"], " ", x["lower"].cast("string"), "-", x["upper"].cast("string"), " ", F.coalesce(x["unit"], F.lit("")), " per meal")
    none = F.array().cast("array<string>")
    wanted = _lines(
        F.array(_said("Query: ", F.coalesce("query_text", F.lit(""))), some("positive", "Must include: "), some("negative", "Must NOT include: ")),
        F.coalesce(F.transform("limits", limit), none), F.coalesce(F.transform("guidelines", guide), none),
    )
    block = F.coalesce(F.array_join(numbered, "\n"), F.lit(""))
    return requests.join(listed, "qid", "left").select("qid", _said("=== Candidate Recipes ===\n", block, "\n===\n\n", wanted, f"\n\n{ASKED}").alias("prompt"))


def offer_context(goals: DataFrame, options: DataFrame, likes: DataFrame, next_meal: str = "lunch", seeds: int = 5, neighbours: int = 8, names: int = 5) -> DataFrame:
    """What a call for a recommendation is told, for each request: qid, context.

    goals: qid, user_id, reasoning, protein_g, fat_g, carb_g, energy_kcal.  options: qid, place, is_seed, description,
    nutrients (map), preference, similarity.  likes: user_id, kind (favourite or disliked), place, food_desc.  Amounts that
    are unknown are 0; of options and names the first are told.
    """
    amount = lambda o, n: F.coalesce(_amount(o["nutrients"], n), F.lit(0.0))
    macro = lambda o: _said(fixed(amount(o, "Protein")), "g protein | ", fixed(amount(o, "Total lipid (fat)")), "g fat | ", fixed(amount(o, "Carbohydrate, by difference")), "g carb")
    # The order of structs decides; maps cannot be ordered, so they are looked up before.
    told = options.withColumn("o", F.struct("description", "nutrients")).select(
        "qid", "place", "is_seed",
        F.when(F.col("is_seed"), _said('"', F.col("description"), '" — ', macro(F.col("o")), " | ", fixed(amount(F.col("o"), "Energy"), 0), " kcal per 100g", F.when(F.col("preference") >= 0.7, " (user favorite)").otherwise("")))
        .otherwise(_said('  - "', F.col("description"), '" — ', macro(F.col("o")), " (similarity: ", fixed(F.coalesce("similarity", F.lit(0.0)), 2), ")")).alias("line"),
    )
    kept = F.struct("place", "line")
    told = told.groupBy("qid").agg(F.sort_array(F.collect_list(F.when(F.col("is_seed"), kept))).alias("s"), F.sort_array(F.collect_list(F.when(~F.col("is_seed"), kept))).alias("n"))
    liked = [F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("place", "food_desc")))).alias(k) for k in ("favourite", "disliked")]
    rows = goals.join(told, "qid", "left").join(likes.groupBy("user_id").agg(*liked), "user_id", "left")
    none = F.array().cast("array<string>")
    first = lambda c, n, field: F.coalesce(F.transform(F.slice(c, 1, n), lambda x: x[field]), none)
    goal = [fixed(F.coalesce(c, F.lit(0.0)), 0) for c in ("protein_g", "fat_g", "carb_g", "energy_kcal")]
    target = _said(f"Target for {next_meal}: ~", goal[0], "g protein, ~", goal[1], "g fat, ~", goal[2], "g carb, ~", goal[3], " kcal")
    near, fav, bad = first("n", neighbours, "line"), first("favourite", names, "food_desc"), first("disliked", names, "food_desc")
    choice = lambda c, says: F.when(F.size(c) > 0, _said(says, F.array_join(c, ", ")))
    known = (F.size(fav) > 0) | (F.size(bad) > 0)
    context = _lines(
        F.array(F.lit("=== Nutritional Gap Analysis ==="), F.coalesce("reasoning", F.lit("")), target, F.lit(""), F.lit("=== Recommended Foods (from USDA database) ===")),
        F.transform(first("s", seeds, "line"), lambda x, i: _said("[", (i + 1).cast("string"), "] ", x)),
        F.when(F.size(near) > 0, F.concat(F.array(F.lit(""), F.lit("Similar alternatives (via GAT embedding neighbors):")), near)).otherwise(none), F.array(F.lit("")),
        F.when(known, F.array(F.lit("=== User Preference History ==="), choice(fav, "User tends to choose: "), choice(bad, "User tends to skip: "), F.lit(""))).otherwise(none),
    )
    return rows.select("qid", context.alias("context"))

"""Foods and recipes under constraints: filters, relaxation, preferences, pipelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import scores
from larder.operators import retrieval

# Nutrient names of questions and the recipe columns that add up to them.
NUTRIENT_COLUMNS = {"calories": ["calories"], "energy": ["calories"], "protein": ["protein"], "carbohydrates": ["carbohydrates"], "carbohydrate": ["carbohydrates"], "saturated fat": ["saturated_fat"], "monounsaturated fat": ["monounsaturated_fat"], "polyunsaturated fat": ["polyunsaturated_fat"], "fat": ["saturated_fat", "monounsaturated_fat", "polyunsaturated_fat"]}
# Meals and the tag their recipes carry; an unknown meal is its own tag, none is lunch.
MEAL_TAGS = {"breakfast": "breakfast", "lunch": "lunch", "dinner": "dinner-party", "snack": "snacks", "snacks": "snacks"}
# Diets by illness.
DIETS = {"Diabetes": "Low-Carb", "Hypertension": "Low-Sodium", "Obesity": "Balanced", "None": "Balanced"}
# Ingredients that an allergy rules out; a meal with one of them is not safe.
ALLERGENS = {"Peanuts": ["peanut", "peanuts"], "Gluten": ["wheat", "flour", "bread", "barley", "rye", "gluten"]}
# Ingredients that a dietary restriction rules out when meals are chosen; they say nothing about safety.
RESTRICTIONS = {"Low_Sugar": ["sugar", "syrup", "honey", "candy", "dessert"], "Low_Sodium": ["salt", "soy sauce", "bacon", "sausage", "bouillon"]}
# Words in the names of desserts.
DESSERT_WORDS = [
    "sherbet", "sorbet", "ice cream", "ice-cream", "cake", "cupcake", "cookie", "brownie", "pudding", "frosting", "popsicle", "mousse", "parfait", "milkshake", "custard", "gelato", "donut", "doughnut", "candy",
]


def meal_tag(meal: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(meal, F.lit(""))))
    chain = F.when(name == "", F.lit("lunch"))
    for k, v in MEAL_TAGS.items():
        chain = chain.when(name == k, F.lit(v))
    return chain.otherwise(name)


def nutrient_sum(name: str) -> Column | None:
    """The recipe's amount of a nutrient, unknown parts as 0; None for a name that is not known."""
    columns = NUTRIENT_COLUMNS.get(name.strip().lower())
    return None if columns is None else reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0.0)) for c in columns))


def _holds(values: dict[str, Column]):
    """A test of one range (nutrition, range of two); unknown nutrients and malformed ranges hold."""

    def holds(r: Column) -> Column:
        chain = F.when(F.size(r["range"]) != 2, F.lit(True))
        for name, v in values.items():
            inside = v.between(F.get(r["range"], F.lit(0)), F.get(r["range"], F.lit(1)))
            chain = chain.when(F.lower(F.trim(r["nutrition"])) == name, inside)
        return chain.otherwise(True)

    return holds


def in_range(values: dict[str, Column], ranges: Column) -> Column:
    """Whether every range holds."""
    return F.forall(ranges, _holds(values))


def ranges_missed(values: dict[str, Column], ranges: Column) -> Column:
    """How many ranges do not hold."""
    holds = _holds(values)
    return F.size(F.filter(ranges, lambda r: ~holds(r)))


def lower_set(values: Column) -> Column:
    return F.array_distinct(F.transform(values, lambda x: F.lower(F.trim(x))))


def excludes(ingredients: Column, negative: Column) -> Column:
    return ~F.arrays_overlap(lower_set(ingredients), lower_set(negative))


def contains_all(ingredients: Column, positive: Column) -> Column:
    return F.size(F.array_except(lower_set(positive), lower_set(ingredients))) == 0


def wanted_missing(ingredients: Column, positive: Column) -> Column:
    """How many of the wanted ingredients are missing."""
    own = lower_set(ingredients)
    return F.size(F.filter(positive, lambda p: ~F.array_contains(own, F.lower(F.trim(p)))))


def unwanted_present(ingredients: Column, negative: Column) -> Column:
    """How many of the unwanted ingredients are there."""
    own = lower_set(ingredients)
    return F.size(F.filter(negative, lambda p: F.array_contains(own, F.lower(F.trim(p)))))


def free_of_terms(ingredients: Column, terms: Column) -> Column:
    """No ingredient contains the head (before a comma) of a term; heads under three letters do not count."""
    heads = F.filter(F.transform(terms, lambda t: F.lower(F.trim(F.substring_index(t, ",", 1)))), lambda t: F.length(t) >= 3)
    return ~F.exists(ingredients, lambda i: F.exists(heads, lambda t: F.contains(F.lower(i), t)))


def recipe_context(recipes: DataFrame, uses: DataFrame, tags: DataFrame | None = None, place: str | None = None) -> DataFrame:
    """Recipes with their distinct ingredient names and tags, sorted; ingredients as first seen if `place` says where each stands."""
    if place is None:
        ing = uses.groupBy("recipe_id").agg(F.sort_array(F.collect_set("ingredient_name")).alias("ingredients"))
    else:
        first = uses.groupBy("recipe_id", "ingredient_name").agg(F.min(place).alias("at"))
        ing = first.groupBy("recipe_id").agg(F.sort_array(F.collect_list(F.struct("at", "ingredient_name")))["ingredient_name"].alias("ingredients"))
    out = recipes.join(ing, "recipe_id", "left")
    if tags is not None:
        out = out.join(tags.groupBy("recipe_id").agg(F.sort_array(F.collect_set("tag_name")).alias("tags")), "recipe_id", "left")
    return out.withColumn("ingredients", F.coalesce("ingredients", F.array().cast("array<string>")))


def tag_pool(requests: DataFrame, recipe_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Recipes with each request's tag, whatever its case: qid, recipe_id."""
    named = recipe_tags.join(tags, "tag_id").select("recipe_id", F.lower("tag_name").alias("tag")).distinct()
    return requests.select("qid", F.lower("tag").alias("tag")).join(named, "tag").select("qid", "recipe_id")


def relaxation_tier(safe: Column, macros: Column, overlap: Column, min_overlap: int) -> Column:
    """The first tier in which a row stands.

    0: safe, enough overlap, macros in range; 1: without the macros; 2: with one ingredient in common (if more are
    asked for); 3: all safe rows; 4: all rows, those with disliked ingredients as well.  Tiers are nested, so the rows
    of tier t are those with a number up to t.
    """
    return (
        F.when(~safe, 4)
        .when(macros & (overlap >= min_overlap), 0)
        .when(overlap >= min_overlap, 1)
        .when(F.lit(min_overlap > 1) & (overlap >= 1), 2)
        .otherwise(3)
    )


def relax(rows: DataFrame, tier: str = "tier", by: str = "qid") -> DataFrame:
    """The rows of each request's first tier that has any."""
    least = rows.groupBy(by).agg(F.min(tier).alias("least"))  # a row per request
    return rows.join(least, by).where(F.col(tier) <= F.col("least")).drop("least")


def rerank_meals(rows: DataFrame, gamma: float = 0.5, beta: float = 0.3, weight: float = 0.0, k: int = 5) -> DataFrame:
    """final = score + gamma * overlap ratio - beta * missing / most missing + weight * macro fit; best k per request.

    Most missing (at least 1) is over all rows of the request, before relaxation.
    """
    first = F.min("tier").alias("least")
    most = F.greatest(F.max("missing"), F.lit(1)).alias("most")
    extremes = rows.groupBy("qid").agg(first, most)  # both in one pass, a row per request
    kept = rows.join(extremes, "qid").where(F.col("tier") <= F.col("least"))
    final = F.col("score") + gamma * F.col("overlap_ratio") - beta * F.col("missing") / F.col("most") + weight * F.col("macro_fit")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("final"), "recipe_id"))
    return kept.withColumn("final", F.round(final, 9)).withColumn("rank", rank).where(F.col("rank") <= k)


def recommend_meals(
    requests: DataFrame, recipes: DataFrame, pool: DataFrame, alpha: float = 0.5, min_overlap: int = 1, tolerance: float = 0.5,
    gamma: float = 0.5, beta: float = 0.3, weight: float = 0.0, candidates: int = 200, k: int = 5,
) -> DataFrame:
    """Meals for many requests in one plan: hybrid scores in the tag's pool, signals, relaxation, re-ranking.

    requests: qid, q_text, q_graph, wanted (ids of recommended foods), available (ids at hand, or null), terms
    (disliked), protein_g, carb_g, fat_g, energy_kcal.  recipes: recipe_id, ingredients (names), ingredient_ids,
    text_vec, graph_vec, calories, protein, carbohydrates, fat_total.  pool: qid, recipe_id, the recipes with the
    request's tag; a request without any gets the best `candidates` of all recipes.
    """
    items = recipes.withColumnRenamed("recipe_id", "id")
    vectors = items.select("id", "text_vec", "graph_vec")
    asked = requests.select("qid", "q_text", "q_graph")
    tagged = pool.select("qid", F.col("recipe_id").alias("id"))
    scored = retrieval.hybrid_scores(vectors, asked, alpha, tagged).select("qid", "id", F.col("total").alias("score"))
    unknown = asked.join(tagged.select("qid").distinct(), "qid", "left_anti")
    others = retrieval.hybrid_rank(vectors, unknown, alpha, candidates).select("qid", "id", F.col("total").alias("score"))
    context = items.drop("text_vec", "graph_vec")
    rows = scored.unionByName(others).join(context, "id").join(requests.drop("q_text", "q_graph"), "qid")
    overlap = F.size(F.array_intersect("ingredient_ids", "wanted"))
    missing = F.when(F.col("available").isNull(), F.lit(0)).otherwise(F.size(F.array_except("ingredient_ids", "available")))
    near = [
        scores.within(F.col(v), F.col(t), tolerance)
        for v, t in (("protein", "protein_g"), ("carbohydrates", "carb_g"), ("calories", "energy_kcal"))
    ]
    fit = scores.closeness({
        "carb": (F.col("carbohydrates"), F.col("carb_g")), "protein": (F.col("protein"), F.col("protein_g")), "fat": (F.col("fat_total"), F.col("fat_g")),
    })
    wanted = F.size(F.array_distinct("wanted"))
    rows = rows.withColumns({
        "overlap": overlap, "missing": missing, "macros": near[0] & near[1] & near[2], "macro_fit": fit,
        "safe": free_of_terms(F.col("ingredients"), F.col("terms")),
        "overlap_ratio": F.when(wanted > 0, overlap / wanted).otherwise(0.0),
    })
    rows = rows.withColumn("tier", relaxation_tier(F.col("safe"), F.col("macros"), F.col("overlap"), min_overlap))
    return rerank_meals(rows.withColumnRenamed("id", "recipe_id"), gamma, beta, weight, k)


def preference_scores(log: DataFrame, foods: DataFrame | None = None) -> DataFrame:
    """Chosen over offered per user and food; 0.5 where a food was never offered."""
    ratio = log.groupBy("user_id", "food_fdc_id").agg(F.sum(F.col("offered").cast("int")).alias("offered"), F.sum(F.col("chosen").cast("int")).alias("chosen"))
    ratio = ratio.withColumn("score", F.coalesce(F.try_divide("chosen", "offered"), F.lit(0.5)))
    if foods is None:
        return ratio
    return foods.join(ratio, ["user_id", "food_fdc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.5)))


def preference_summary(log: DataFrame) -> DataFrame:
    """Favourites (ratio from 0.5) and disliked foods (never chosen) among those offered twice or more."""
    names = log.groupBy("user_id", "food_fdc_id").agg(F.max("food_desc").alias("food_desc"))
    rated = preference_scores(log).where("offered >= 2").join(names, ["user_id", "food_fdc_id"])
    return rated.withColumn("kind", F.when(F.col("score") >= 0.5, "favourite").when(F.col("chosen") == 0, "disliked")).where("kind IS NOT NULL")


def recent(log: DataFrame, n: int, by: str = "user_id") -> DataFrame:
    """The last n entries of each user."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("timestamp"), F.desc("id")))
    return log.withColumn("rank", rank).where(F.col("rank") <= n)


def recommend_foods(
    requests: DataFrame, edges_by_name: DataFrame, vectors: DataFrame, least: float = 5.0, seeds: int = 5, neighbours: int = 5,
    available: DataFrame | None = None, eaten: DataFrame | None = None
) -> DataFrame:
    """Seeds rich in each request's largest macro, then their graph neighbours; first come, no repeats.

    requests: qid, protein_g, fat_g, carb_g.  edges_by_name: fdc_id, macro (protein, fat or carb), amount.
    What is eaten or not available goes before seeds are counted; an empty availability is no filter.
    """
    macro = scores.dominant(["protein", "fat", "carb"], [F.coalesce(F.col(c), F.lit(0.0)) for c in ("protein_g", "fat_g", "carb_g")])
    rows = requests.select("qid", macro.alias("macro")).join(edges_by_name.where(F.col("amount") >= least), "macro")
    if eaten is not None:
        rows = rows.join(eaten.select("qid", "fdc_id"), ["qid", "fdc_id"], "left_anti")
    if available is not None and available.limit(1).count():
        rows = rows.join(available.select("fdc_id").distinct(), "fdc_id", "left_semi")
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("amount"), "fdc_id"))
    chosen = rows.withColumn("seed", order).where(F.col("seed") <= seeds).select("qid", "seed", "fdc_id")
    some = chosen.select(F.col("fdc_id").alias("p")).distinct().join(vectors.select(F.col("id").alias("p"), F.col("vec").alias("v")), "p")
    near = retrieval.vector_topk(
        vectors, some, neighbours, query_id="p", query_vec="v", include_self=False
    ).select(F.col("qid").alias("fdc_id"), F.col("id").alias("other"), "rank", "score")
    found = chosen.join(near, "fdc_id").select("qid", "seed", "rank", F.col("other").alias("fdc_id"), "score")
    both = chosen.select("qid", "seed", F.lit(0).alias("rank"), "fdc_id", F.lit(1.0).alias("score")).unionByName(found)
    first = F.row_number().over(Window.partitionBy("qid", "fdc_id").orderBy("seed", "rank"))
    return both.withColumn("n", first).where("n = 1").drop("n")


def recommend_foods_hybrid(
    requests: DataFrame, foods: DataFrame, q_text: DataFrame, q_graph: DataFrame, allowed: list[int], k: int = 10, weight: float = 0.5,
    alpha: float = 0.5
) -> DataFrame:
    """Hybrid search from target vectors among foods of the allowed categories (or of none), with the macro fit as a score.

    foods: id, text_vec, graph_vec, food_category_id, protein, fat, carb.  requests: qid, protein_g, fat_g, carb_g.
    The fit depends on request and food: it is one more term inside the blocks of queries, so foods do not move.
    """
    foods = foods.where(F.col("food_category_id").isNull() | F.col("food_category_id").isin(allowed))
    macros = lambda *names: F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names))
    items = foods.select("id", "text_vec", "graph_vec", macros("protein", "fat", "carb").alias("macros"))
    queries = q_text.join(q_graph, "qid").join(requests, "qid")
    queries = queries.select("qid", "q_text", "q_graph", macros("protein_g", "fat_g", "carb_g").alias("q_macros"))
    return retrieval.hybrid_macro_rank(items, queries, alpha, weight, k)


def rank_by_preference(options: DataFrame, preferences: DataFrame) -> DataFrame:
    """Seeds first, by preference; then neighbours by similarity; the order they came in breaks ties."""
    rows = options.join(
        preferences.select("user_id", F.col("food_fdc_id").alias("fdc_id"), F.col("score").alias("preference")), ["user_id", "fdc_id"], "left"
    ).withColumn("preference", F.coalesce("preference", F.lit(0.5)))
    seed = F.col("rank") == 0
    order = [F.desc(seed), F.desc(F.when(seed, F.col("preference")).otherwise(F.col("score"))), "seed", "rank"]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))


def retrieve_recipes(questions: DataFrame, recipes: DataFrame, pool: DataFrame, hard: bool = True) -> DataFrame:
    """Each question's pool under its constraints: violators go, or pay 0.5 for every violation.

    A violation is a wanted ingredient that is missing, an unwanted one that is there, or a range that does not hold.
    questions: qid, positive, negative, ranges.  recipes: recipe_id, ingredients and nutrient columns.
    """
    rows = pool.select("qid", "recipe_id").join(questions, "qid").join(recipes, "recipe_id")
    values = {n: v for n in NUTRIENT_COLUMNS if (v := nutrient_sum(n)) is not None}
    if hard:
        tests = [
            excludes(F.col("ingredients"), F.col("negative")),
            contains_all(F.col("ingredients"), F.col("positive")),
            in_range(values, F.col("ranges")),
        ]
        passed = reduce(lambda a, b: a & b, (F.coalesce(t, F.lit(True)) for t in tests))
        return rows.where(passed).withColumn("penalty", F.lit(0.0))
    violations = [
        wanted_missing(F.col("ingredients"), F.col("positive")),
        unwanted_present(F.col("ingredients"), F.col("negative")),
        ranges_missed(values, F.col("ranges")),
    ]
    return rows.withColumn("penalty", scores.penalty(violations))


def rank_recipes(questions: DataFrame, recipes: DataFrame, pool: DataFrame, mode: str = "hybrid", lam: float = 0.3, k: int = 20) -> DataFrame:
    """Tag pool, then constraints, then the best k by text and graph: qid, id, total, text_sim, graph_sim, rank.

    questions: qid, q_text (and q_graph for mode `external`), positive, negative, ranges.
    recipes: recipe_id, text_vec, graph_vec, ingredients and nutrient columns.
    """
    constraints = questions.select("qid", "positive", "negative", "ranges")
    left = retrieve_recipes(constraints, recipes.drop("text_vec", "graph_vec"), pool).select("qid", F.col("recipe_id").alias("id"))
    items = recipes.select(F.col("recipe_id").alias("id"), "text_vec", "graph_vec")
    asked = questions.select("qid", "q_text", *(["q_graph"] if mode == "external" else []))
    return retrieval.search_pool(items, asked, left, mode, lam, k)


def rank_embedding_first(questions: DataFrame, recipes: DataFrame, pool: DataFrame | None = None, hard: bool = True, lam: float = 0.3, k: int = 20) -> DataFrame:
    """Hybrid ranks first (the whole pool, or without one the best max(50 k, 1000) of all), then the constraints.

    Violators go (`hard`) or lose their penalty in score; the best k by score: qid, id, score, rank.
    """
    items = recipes.select(F.col("recipe_id").alias("id"), "text_vec", "graph_vec")
    asked = questions.select("qid", "q_text")
    if pool is None:
        ranked = retrieval.hybrid_rank(items, retrieval.pseudo_anchor(items, asked), lam, max(50 * k, 1000))
    else:
        own = pool.select("qid", F.col("recipe_id").alias("id"))
        ranked = retrieval.hybrid_scores(items, retrieval.pool_anchor(items, asked, own), lam, own)
    ranked = ranked.select("qid", F.col("id").alias("recipe_id"), "total")
    constraints = questions.select("qid", "positive", "negative", "ranges")
    kept = retrieve_recipes(constraints, recipes.drop("text_vec", "graph_vec"), ranked, hard).select("qid", "recipe_id", "penalty")
    rows = ranked.join(kept, ["qid", "recipe_id"]).withColumn("score", F.round(F.col("total") - F.col("penalty"), 12))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "recipe_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", F.col("recipe_id").alias("id"), "score", "rank")


def _terms(table: dict[str, list[str]], key: str) -> Column:
    none = F.array().cast("array<string>")
    return reduce(lambda rest, x: F.when(F.col(key) == x[0], F.array(*map(F.lit, x[1]))).otherwise(rest), table.items(), none)


def patient_terms(patients: DataFrame) -> DataFrame:
    """Adds the diet, the allergens (for safety) and all terms to avoid (allergens and restrictions, for choosing meals)."""
    diet = F.coalesce(*(F.when(F.col("disease") == k, F.lit(v)) for k, v in DIETS.items()), F.lit("Balanced"))
    rows = patients.withColumns({"diet": diet, "allergens": _terms(ALLERGENS, "allergies")})
    return rows.withColumn("avoided", F.concat("allergens", _terms(RESTRICTIONS, "restrictions")))


def patient_meals(patients: DataFrame, meals: DataFrame) -> DataFrame:
    """Whether each recommended meal is free of the patient's allergens, and adheres: also within half of the target carbohydrate.

    patients: patient, disease, allergies, restrictions, carb_target.  meals: patient, meal, ingredients, carb.
    Dietary restrictions do not make a meal unsafe; without a target every amount is right.
    """
    rows = patient_terms(patients).join(meals, "patient")
    rows = rows.withColumn("safe", free_of_terms(F.col("ingredients"), F.col("allergens")))
    target, carb = F.coalesce("carb_target", F.lit(0.0)), F.coalesce("carb", F.lit(0.0))
    near = (target == 0) | carb.between(0.5 * target, 1.5 * target)
    return rows.withColumn("adheres", F.col("safe") & near)


def without_desserts(options: DataFrame, by: str = "qid", words: list[str] = DESSERT_WORDS) -> DataFrame:
    """The best option whose name has none of the words, else the best option."""
    sweet = reduce(lambda a, b: a | b, (F.contains(F.lower("name"), F.lit(w)) for w in words))
    return options.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(sweet, "rank"))).where("n = 1").drop("n")

"""Constraints, relaxation, scores and preferences over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import scores
from larder.operators import recommend as rec
from larder.plans.registry import Tables, query

# Recipes: an order with its parts' names and amounts.
_RECIPES = """SELECT o_orderkey AS recipe_id, o_orderpriority AS tag, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS calories, q AS protein, n * 10.0 AS carbohydrates, mx AS saturated_fat, mn AS monounsaturated_fat,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 1.0 END AS polyunsaturated_fat, names, part_ids FROM orders JOIN (
  SELECT l_orderkey, sum(l_quantity) AS q, CAST(count(*) AS DOUBLE) AS n, max(l_quantity) AS mx, min(l_quantity) AS mn, {names} AS names, list_sort(list(DISTINCT l_partkey)) AS part_ids FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON l_orderkey = o_orderkey"""
_SQL_RECIPES = _RECIPES.format(names="list_sort(list(DISTINCT p_name))")
# Questions: a tag, wanted and unwanted parts, and a range of one nutrient.
_QUESTIONS = [("1-URGENT", ["red ring"], ["blue bolt", "hot gear"], "protein", 20.0, 200.0), ("2-HIGH", [], ["old anvil"], "fat", 10.0, 80.0), ("3-MEDIUM", [], [], "calories", 100000.0, 300000.0), ("4-NOT SPECIFIED", [], ["new rod"], "sodium", 1.0, 2.0), ("5-LOW", ["cold plate", "red ring", "hot gear"], ["blue bolt", "old rod", "new anvil"], "carbohydrates", 20.0, 60.0)]
_SQL_QUESTIONS = "(VALUES " + ", ".join(f"('{t}', {p!r}::VARCHAR[], {n!r}::VARCHAR[], '{k}', {lo}, {hi})" for t, p, n, k, lo, hi in _QUESTIONS) + ") AS q(qid, positive, negative, nutrition, lo, hi)"
_TESTS = """NOT list_has_any(names, negative) AS negative_ok, list_has_all(names, positive) AS positive_ok,
  CASE nutrition WHEN 'protein' THEN coalesce(protein, 0) BETWEEN lo AND hi WHEN 'fat' THEN coalesce(saturated_fat, 0) + coalesce(monounsaturated_fat, 0) + coalesce(polyunsaturated_fat, 0) BETWEEN lo AND hi
  WHEN 'calories' THEN coalesce(calories, 0) BETWEEN lo AND hi WHEN 'carbohydrates' THEN coalesce(carbohydrates, 0) BETWEEN lo AND hi ELSE true END AS range_ok"""


def recipes(t: Tables) -> DataFrame:
    uses = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("recipe_id"), F.col("p_name").alias("ingredient_name"))
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("recipe_id")).agg(F.sum("l_quantity").alias("protein"), (F.count("*").cast("double") * 10).alias("carbohydrates"), F.max("l_quantity").alias("saturated_fat"), F.min("l_quantity").alias("monounsaturated_fat"))
    o = t.orders.select(F.col("o_orderkey").alias("recipe_id"), F.col("o_orderpriority").alias("tag"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("calories"), F.when(F.col("o_orderstatus") != "P", 1.0).alias("polyunsaturated_fat"))
    return rec.recipe_context(o.join(sums, "recipe_id"), uses)


def questions(t: Tables) -> DataFrame:
    rows = [(q, p, n, [(k, [lo, hi])]) for q, p, n, k, lo, hi in _QUESTIONS]
    return t.spark.createDataFrame(rows, "qid string, positive array<string>, negative array<string>, ranges array<struct<nutrition:string,range:array<double>>>")


def _pool(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("recipe_id"), F.col("o_orderpriority").alias("tag_id"))
    tags = o.select("tag_id", F.lower("tag_id").alias("tag_name")).distinct()
    return rec.tag_pool(questions(t).select("qid", F.col("qid").alias("tag")), o, tags)


@query("SELECT o_orderpriority AS qid, o_orderkey AS recipe_id FROM orders")
def tag_candidates(t):
    return _pool(t)


@query(f"SELECT recipe_id, array_to_string(names, ';') AS ingredients, calories, protein FROM ({_SQL_RECIPES})")
def recipe_context(t):
    return recipes(t).select("recipe_id", F.array_join("ingredients", ";").alias("ingredients"), "calories", "protein")


@query(f"SELECT qid, recipe_id FROM (SELECT qid, recipe_id, {_TESTS} FROM ({_SQL_RECIPES}) r JOIN {_SQL_QUESTIONS} ON tag = qid) WHERE negative_ok AND positive_ok AND range_ok")
def constraint_filter_hard(t):
    return rec.retrieve_recipes(questions(t), recipes(t), _pool(t)).select("qid", "recipe_id")


_VIOLATIONS = """len(list_filter(positive, lambda x: NOT list_contains(names, x))) + len(list_filter(negative, lambda x: list_contains(names, x))) + CASE WHEN range_ok THEN 0 ELSE 1 END"""


@query(f"SELECT qid, recipe_id, 0.5::DOUBLE * ({_VIOLATIONS}) AS penalty FROM (SELECT *, {_TESTS} FROM ({_SQL_RECIPES}) r JOIN {_SQL_QUESTIONS} ON tag = qid)")
def constraint_penalty_soft(t):
    return rec.retrieve_recipes(questions(t), recipes(t), _pool(t), hard=False).select("qid", "recipe_id", F.col("penalty").cast("double").alias("penalty"))


# Requests: targets, wanted parts and disliked ones per tag; every recipe of the fourth has something disliked.
_ALL_PARTS = ["ring", "widget", "plate", "rod", "gear", "anvil", "gizmo", "bolt"]
_REQUESTS = [("1-URGENT", 100.0, 40.0, 200000.0, ["red ring", "blue rod"], ["anvil"]), ("2-HIGH", 2000.0, 40.0, 200000.0, ["red ring", "old gear"], []), ("3-MEDIUM", 5000.0, 1.0, 1.0, ["no such part"], ["bolt"]), ("4-NOT SPECIFIED", 100.0, 40.0, 200000.0, ["red ring", "hot rod"], _ALL_PARTS), ("5-LOW", 0.0, 0.0, 0.0, ["hot plate"], ["ring, any", "ox"])]
_SQL_REQUESTS = "(VALUES " + ", ".join(f"('{q}', {p}, {c}, {k}, {w!r}::VARCHAR[], {x!r}::VARCHAR[])" for q, p, c, k, w, x in _REQUESTS) + ") AS s(qid, protein_g, carb_g, energy_kcal, wanted, terms)"
# An unknown amount counts as 0.
_NEAR = "({t} <= 0 OR coalesce({v}, 0) BETWEEN {t} * 0.5 AND {t} * 1.5)"
_SAFE = """NOT list_bool_or(list_concat([false], list_transform(terms, lambda x: len(trim(split_part(x, ',', 1))) >= 3
  AND list_bool_or(list_concat([false], list_transform(names, lambda i: contains(i, trim(split_part(x, ',', 1)))))))))"""
# Tiers: enough overlap (two) and macros; enough overlap; some overlap; all safe rows; all rows.
_TIER = "CASE WHEN NOT safe THEN 4 WHEN macros AND overlap >= 2 THEN 0 WHEN overlap >= 2 THEN 1 WHEN overlap >= 1 THEN 2 ELSE 3 END"
_MACROS = " AND ".join(_NEAR.format(t=t, v=v) for t, v in (("protein_g", "protein"), ("carb_g", "carbohydrates"), ("energy_kcal", "calories")))
_TIERS = f"""SELECT qid, recipe_id, protein, carbohydrates, overlap, wanted_n - overlap AS missing, wanted_n, {_TIER} AS tier, protein_g, carb_g FROM (
  SELECT *, len(wanted) AS wanted_n, len(list_intersect(names, wanted)) AS overlap, {_SAFE} AS safe, {_MACROS} AS macros
  FROM ({_SQL_RECIPES}) r JOIN {_SQL_REQUESTS} ON tag = qid)"""


def _tiers(t: Tables) -> DataFrame:
    q = t.spark.createDataFrame(_REQUESTS, "qid string, protein_g double, carb_g double, energy_kcal double, wanted array<string>, terms array<string>")
    rows = recipes(t).join(F.broadcast(q), F.col("tag") == F.col("qid"))  # five requests
    near = [scores.within(F.col(v), F.col(g), 0.5) for v, g in (("protein", "protein_g"), ("carbohydrates", "carb_g"), ("calories", "energy_kcal"))]
    overlap = F.size(F.array_intersect("ingredients", "wanted"))
    rows = rows.withColumns({"overlap": overlap, "missing": F.size("wanted") - overlap, "safe": rec.free_of_terms(F.col("ingredients"), F.col("terms")), "macros": near[0] & near[1] & near[2]})
    return rows.withColumn("tier", rec.relaxation_tier(F.col("safe"), F.col("macros"), F.col("overlap"), 2))


@query(f"WITH r AS ({_TIERS}) SELECT r.qid, recipe_id, tier FROM r JOIN (SELECT qid, min(tier) AS least FROM r GROUP BY 1) m ON r.qid = m.qid WHERE tier <= least")
def relaxation_cascade(t):
    return rec.relax(_tiers(t)).select("qid", "recipe_id", "tier")


@query(f"""WITH r AS ({_TIERS}), f AS (SELECT r.qid, recipe_id, round(0.01 * protein + 0.5 * overlap / wanted_n - 0.3 * missing / greatest(most, 1)
  + (CASE WHEN protein_g > 0 THEN (1 - least(abs(protein - protein_g) / protein_g, 1) + 1 - least(abs(carbohydrates - carb_g) / carb_g, 1)) / 2 ELSE 0 END), 9) AS final, tier, least
  FROM r JOIN (SELECT qid, min(tier) AS least, max(missing) AS most FROM r GROUP BY 1) m ON r.qid = m.qid)
SELECT qid, recipe_id, final, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY final DESC, recipe_id) AS INTEGER) AS rank FROM f WHERE tier <= least) WHERE rank <= 5""")
def meal_rerank(t):
    rows = _tiers(t).withColumns({"score": 0.01 * F.col("protein"), "overlap_ratio": F.col("overlap") / F.size("wanted"), "macro_fit": scores.closeness({"p": (F.col("protein"), F.col("protein_g")), "c": (F.col("carbohydrates"), F.col("carb_g"))})})
    return rec.rerank_meals(rows, weight=1.0).select("qid", "recipe_id", "final", "rank")


# Recipes with vectors: those whose number is an embedding's; text and graph vectors are its halves.
_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_TEXT, _GRAPH = _COS.format(a="et.embedding[1:32]", b="e.embedding[1:32]"), _COS.format(a="eg.embedding[33:64]", b="e.embedding[33:64]")
_EMBEDDED = f"(SELECT r.*, embedding, coalesce(saturated_fat, 0) + coalesce(monounsaturated_fat, 0) + coalesce(polyunsaturated_fat, 0) AS fat_total FROM ({_SQL_RECIPES}) r JOIN embeddings ON vec_id = recipe_id)"
# Meal requests: tag, numbers of their text and graph vectors, recommended parts, parts at hand (none: unknown), disliked names, targets.
_MEALS = [
    ("m1", "1-URGENT", 3, 40, [3, 30, 66, 90, 120, 151, 180], [3, 7, 11, 30], [], 100.0, 40.0, 60.0, 200000.0),
    ("m2", "2-HIGH", 8, 77, [1, 2], None, ["anvil", "rod, any"], 90.0, 30.0, 50.0, 0.0),
    ("m3", "no such tag", 21, 5, list(range(0, 200, 3)), [5], ["widget"], 60.0, 20.0, 40.0, 150000.0),
    ("m4", "4-NOT SPECIFIED", 13, 99, [4, 8], [4], _ALL_PARTS, 100.0, 40.0, 60.0, 200000.0),
]
_SQL_MEALS = "(VALUES " + ", ".join(
    f"('{q}', '{tag}', {a}, {b}, {w!r}::BIGINT[], {'NULL' if h is None else h}::BIGINT[], {x!r}::VARCHAR[], {', '.join(map(str, n))})" for q, tag, a, b, w, h, x, *n in _MEALS
) + ") AS q(qid, wanted_tag, text_id, graph_id, wanted, available, terms, protein_g, carb_g, fat_g, energy_kcal)"
_FIT = " + ".join(f"(1 - least(abs({v} - {g}) / {g}, 1))" for v, g in (("carbohydrates", "carb_g"), ("protein", "protein_g"), ("fat_total", "fat_g")))


def embedded(t: Tables) -> DataFrame:
    """The recipes that have an embedding, with its halves, their parts' numbers and their fat."""
    parts = t.lineitem.groupBy(F.col("l_orderkey").alias("recipe_id")).agg(F.collect_set("l_partkey").alias("ingredient_ids"))
    vectors = t.embeddings.select(F.col("vec_id").alias("recipe_id"), F.slice("embedding", 1, 32).alias("text_vec"), F.slice("embedding", 33, 32).alias("graph_vec"))
    fat = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ("saturated_fat", "monounsaturated_fat", "polyunsaturated_fat")), F.lit(0.0))
    return recipes(t).join(vectors, "recipe_id").join(parts, "recipe_id").withColumn("fat_total", fat)


def _vectors_of(t: Tables, asked: DataFrame) -> DataFrame:
    text = t.embeddings.select(F.col("vec_id").alias("text_id"), F.slice("embedding", 1, 32).alias("q_text"))
    graph = t.embeddings.select(F.col("vec_id").alias("graph_id"), F.slice("embedding", 33, 32).alias("q_graph"))
    return asked.join(text, "text_id").join(graph, "graph_id").drop("text_id", "graph_id")


@query(f"""WITH s AS (SELECT q.*, e.* EXCLUDE embedding, round(0.5 * {_GRAPH} + 0.5 * {_TEXT}, 12) AS score FROM {_SQL_MEALS}
  JOIN embeddings et ON et.vec_id = text_id JOIN embeddings eg ON eg.vec_id = graph_id JOIN {_EMBEDDED} e ON e.tag = wanted_tag OR wanted_tag = 'no such tag'),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, recipe_id) AS place FROM s),
r AS (SELECT *, len(list_intersect(part_ids, wanted)) AS overlap, CASE WHEN available IS NULL THEN 0 ELSE len(list_filter(part_ids, lambda i: NOT list_contains(available, i))) END AS missing,
  {_SAFE} AS safe, {_MACROS} AS macros FROM p WHERE wanted_tag <> 'no such tag' OR place <= 200),
g AS (SELECT *, {_TIER} AS tier FROM r), m AS (SELECT qid, min(tier) AS least, greatest(max(missing), 1) AS most FROM g GROUP BY 1),
f AS (SELECT g.qid, recipe_id, tier, round(score + 0.5 * overlap / len(wanted) - 0.3 * missing / most + ({_FIT}) / 3, 9) AS final FROM g JOIN m ON g.qid = m.qid WHERE tier <= least)
SELECT qid, recipe_id, tier, round(final, 6) AS final, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY final DESC, recipe_id) AS INTEGER) AS rank FROM f) WHERE rank <= 5""")
def recommend_meal(t):
    rows = [(q, tag, a, b, w, h, x, *n) for q, tag, a, b, w, h, x, *n in _MEALS]
    asked = t.spark.createDataFrame(rows, "qid string, tag string, text_id long, graph_id long, wanted array<long>, available array<long>, terms array<string>, protein_g double, carb_g double, fat_g double, energy_kcal double")
    own = embedded(t)
    pool = asked.select("qid", "tag").join(own.select("tag", "recipe_id"), "tag").select("qid", "recipe_id")
    out = rec.recommend_meals(_vectors_of(t, asked).drop("tag"), own.drop("tag"), pool, min_overlap=2, weight=1.0)
    return out.select("qid", "recipe_id", "tier", F.round("final", 6).alias("final"), "rank")


def _recipe_questions(t: Tables) -> DataFrame:
    number = F.element_at(F.create_map(*(F.lit(v) for i, q in enumerate(_QUESTIONS) for v in (q[0], 7 * i + 2))), F.col("qid")).cast("long")
    return _vectors_of(t, questions(t).withColumns({"text_id": number, "graph_id": number + 100}))


def _tag_pool(t: Tables) -> DataFrame:
    return embedded(t).select(F.col("tag").alias("qid"), "recipe_id")


_NUMBERED = "(VALUES " + ", ".join(f"('{q[0]}', {7 * i + 2})" for i, q in enumerate(_QUESTIONS)) + ") AS n(nq, text_id)"
_ASKED = f"FROM {_SQL_QUESTIONS} JOIN {_NUMBERED} ON nq = qid JOIN embeddings et ON et.vec_id = text_id"
_BEST = "SELECT qid, id, round(total, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(total, 12) DESC, id) AS INTEGER) AS rank FROM ({rows})) WHERE rank <= {k}"
_ANCHORED = f"""(SELECT c.qid, c.id, 0.7 * text + 0.3 * {_COS.format(a="a.embedding[33:64]", b="e.embedding[33:64]")} AS total, c.penalty FROM c
  JOIN (SELECT qid, arg_max(id, (round(text, 12), -id)) AS anchor FROM c GROUP BY 1) b ON b.qid = c.qid JOIN embeddings a ON a.vec_id = anchor JOIN embeddings e ON e.vec_id = c.id)"""


def _candidates(join: str, where: str = "true") -> str:
    return f"""WITH c AS (SELECT qid, recipe_id AS id, {_COS.format(a="asked[1:32]", b="embedding[1:32]")} AS text, 0.5 * ({_VIOLATIONS}) AS penalty, positive_ok AND negative_ok AND range_ok AS ok
  FROM (SELECT qid, e.*, positive, negative, et.embedding AS asked, {_TESTS} {_ASKED} JOIN {_EMBEDDED} e ON {join}) WHERE {where}) """


@query(_candidates("e.tag = qid", "positive_ok AND negative_ok AND range_ok") + _BEST.format(rows=f"SELECT qid, id, total FROM {_ANCHORED}", k=20))
def recipe_retrieve(t):
    out = rec.rank_recipes(_recipe_questions(t).drop("q_graph"), embedded(t), _tag_pool(t))
    return out.select("qid", "id", F.round("total", 6).alias("score"), "rank")


@query(_candidates("e.tag = qid") + _BEST.format(rows=f"SELECT qid, id, total - penalty AS total FROM {_ANCHORED}", k=20))
def recipe_embedding_first_soft(t):
    out = rec.rank_embedding_first(_recipe_questions(t).drop("q_graph"), embedded(t), _tag_pool(t), hard=False)
    return out.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(_candidates("true") + f""", x AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(total, 12) DESC, id) AS place FROM {_ANCHORED})
""" + _BEST.format(rows="SELECT x.qid, x.id, total FROM x JOIN c ON c.qid = x.qid AND c.id = x.id WHERE place <= 1000 AND ok", k=20))
def recipe_embedding_first_hard(t):
    """Without a tag: the best 1,000 of all recipes, then the constraints."""
    out = rec.rank_embedding_first(_recipe_questions(t).drop("q_graph"), embedded(t))
    return out.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH f AS (SELECT vec_id AS id, embedding, (vec_id % 13)::DOUBLE AS protein, (vec_id % 7)::DOUBLE AS fat, (vec_id % 5)::DOUBLE AS carb FROM embeddings WHERE vec_id % 11 = 0 OR label < 5),
q AS (SELECT vec_id AS qid, embedding, (vec_id // 100 + 1)::DOUBLE AS p, 2.0::DOUBLE AS f, (vec_id // 100)::DOUBLE AS c FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT qid, id, 0.5 * {_COS.format(a="q.embedding[33:64]", b="f.embedding[33:64]")} + 0.5 * {_COS.format(a="q.embedding[1:32]", b="f.embedding[1:32]")} + 0.5 * (CASE WHEN protein + fat + carb <= 0 THEN 0
  ELSE greatest(0, least(1, 1 - (abs(p / (p + q.f + c) - protein / (protein + fat + carb)) + abs(q.f / (p + q.f + c) - fat / (protein + fat + carb)) + abs(c / (p + q.f + c) - carb / (protein + fat + carb))) / 2)) END) AS total FROM q, f)
""" + _BEST.format(rows="s", k=10).replace("FROM (s)", "FROM s"))
def recommend_foods_hybrid(t):
    e = t.embeddings
    halves = (F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    kind = F.when(F.col("vec_id") % 11 != 0, F.col("label"))
    foods = e.select(F.col("vec_id").alias("id"), halves[0].alias("text_vec"), halves[1].alias("graph_vec"), kind.alias("food_category_id"), *((F.col("vec_id") % n).alias(c) for c, n in (("protein", 13), ("fat", 7), ("carb", 5))))
    asked = e.where("vec_id % 100 = 0").withColumn("qid", F.col("vec_id"))
    step = F.floor(F.col("vec_id") / 100)
    targets = asked.select("qid", (step + 1).alias("protein_g"), F.lit(2).alias("fat_g"), step.alias("carb_g"))
    out = rec.recommend_foods_hybrid(targets, foods, asked.select("qid", halves[0].alias("q_text")), asked.select("qid", halves[1].alias("q_graph")), [0, 1, 2, 3, 4])
    return out.select("qid", "id", F.round("total", 6).alias("score"), "rank")


# Patients: customers.  Their meals: orders, best first by price, with an ingredient and a name from each line.
_INGREDIENTS = ["peanut butter", "rye bread", "brown sugar", "sea salt", "rice", "egg", "milk", "soy sauce"]
_NAMES = ["Rice bowl", "Carrot cake", "Omelette", "Ice cream sundae", "Soup"]
_PATIENTS = """SELECT c_custkey AS patient, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Diabetes' WHEN 'BUILDING' THEN 'Hypertension' WHEN 'MACHINERY' THEN 'Obesity' ELSE 'None' END AS disease,
  CASE c_nationkey % 3 WHEN 0 THEN 'Peanuts' WHEN 1 THEN 'Gluten' ELSE 'None' END AS allergies, CASE c_nationkey % 4 WHEN 0 THEN 'Low_Sugar' WHEN 1 THEN 'Low_Sodium' ELSE 'None' END AS restrictions,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 50)::DOUBLE END AS carb_target FROM customer"""
_CHOSEN = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY regexp_matches(lower(name), 'cake|ice cream'), rank) AS n FROM (
  SELECT o_custkey AS patient, o_orderkey AS meal, ({_NAMES!r})[o_orderkey % 5 + 1] AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)) WHERE n = 1"""
_EATEN = f"SELECT l_orderkey AS meal, list(DISTINCT ({_INGREDIENTS!r})[l_partkey % 8 + 1]) AS names, sum(l_quantity) AS carb FROM lineitem GROUP BY 1"


@query(f"""SELECT patient, meal, diet, safe, avoids, safe AND (coalesce(carb_target, 0) = 0 OR coalesce(carb, 0) BETWEEN 0.5 * carb_target AND 1.5 * carb_target) AS adheres FROM (
  SELECT p.patient, m.meal, carb, carb_target, CASE disease WHEN 'Diabetes' THEN 'Low-Carb' WHEN 'Hypertension' THEN 'Low-Sodium' ELSE 'Balanced' END AS diet,
    NOT (allergies = 'Peanuts' AND list_contains(names, 'peanut butter')) AND NOT (allergies = 'Gluten' AND list_contains(names, 'rye bread')) AS safe,
    safe AND NOT (restrictions = 'Low_Sugar' AND list_contains(names, 'brown sugar')) AND NOT (restrictions = 'Low_Sodium' AND (list_contains(names, 'sea salt') OR list_contains(names, 'soy sauce'))) AS avoids
  FROM ({_PATIENTS}) p JOIN ({_CHOSEN}) m ON m.patient = p.patient JOIN ({_EATEN}) x ON x.meal = m.meal)""")
def patient_adherence(t):
    from pyspark.sql import Window

    pick = lambda c, pairs, rest: F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in pairs), rest)
    patients = t.customer.select(
        F.col("c_custkey").alias("patient"), pick(F.col("c_mktsegment"), [("AUTOMOBILE", "Diabetes"), ("BUILDING", "Hypertension"), ("MACHINERY", "Obesity")], F.lit("None")).alias("disease"),
        pick(F.col("c_nationkey") % 3, [(0, "Peanuts"), (1, "Gluten")], F.lit("None")).alias("allergies"), pick(F.col("c_nationkey") % 4, [(0, "Low_Sugar"), (1, "Low_Sodium")], F.lit("None")).alias("restrictions"),
        F.when(F.col("c_custkey") % 5 != 0, (F.col("c_custkey") % 50).cast("double")).alias("carb_target"),
    )
    of = lambda names, c: F.get(F.array(*map(F.lit, names)), (F.col(c) % len(names)).cast("int"))
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    offered = t.orders.select(F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("meal"), of(_NAMES, "o_orderkey").alias("name"), rank.alias("rank"))
    eaten = t.lineitem.groupBy(F.col("l_orderkey").alias("meal")).agg(F.collect_set(of(_INGREDIENTS, "l_partkey")).alias("ingredients"), F.sum("l_quantity").alias("carb"))
    chosen = rec.without_desserts(offered, by="patient").join(eaten, "meal")
    out = rec.patient_meals(patients, chosen)
    return out.select("patient", "meal", "diet", "safe", rec.free_of_terms(F.col("ingredients"), F.col("avoided")).alias("avoids"), "adheres")


@query("SELECT c_custkey AS patient, round(c_acctbal * 0.2 / 4, 6) AS protein_g, round(c_acctbal * 0.3 / 9, 6) AS fat_g, round(c_acctbal * 0.5 / 4, 6) AS carb_g FROM customer")
def macros_of_intake(t):
    grams = scores.macros_from_energy(F.col("c_acctbal"))
    return t.customer.select(F.col("c_custkey").alias("patient"), *(F.round(grams[c], 6).alias(c) for c in ("protein_g", "fat_g", "carb_g")))


@query(f"""SELECT recipe_id, round(CASE WHEN f <= 0 THEN 0 ELSE greatest(0, least(1, 1 - (abs(0.5 - protein / f) + abs(0.3 - saturated_fat / f) + abs(0.2 - carbohydrates / f)) / 2)) END, 6) AS fit
FROM (SELECT *, protein + saturated_fat + carbohydrates AS f FROM ({_SQL_RECIPES}))""")
def macro_match(t):
    target = (F.lit(50.0), F.lit(30.0), F.lit(20.0))
    return recipes(t).select("recipe_id", F.round(scores.macro_match(target, (F.col("protein"), F.col("saturated_fat"), F.col("carbohydrates"))), 6).alias("fit"))


@query(f"SELECT recipe_id, round((1 - least(abs(protein - 100) / 100, 1) + 1 - least(abs(carbohydrates - 50) / 50, 1)) / 2, 6) AS score FROM ({_SQL_RECIPES})")
def macro_match_score(t):
    return recipes(t).select("recipe_id", F.round(scores.closeness({"p": (F.col("protein"), F.lit(100.0)), "c": (F.col("carbohydrates"), F.lit(50.0)), "f": (F.col("saturated_fat"), F.lit(0.0))}), 6).alias("score"))


@query(f"""SELECT macro, bin, count(*) AS n FROM (SELECT CASE WHEN greatest(protein, saturated_fat, carbohydrates) <= 1e-6 THEN 'Other' WHEN protein >= saturated_fat AND protein >= carbohydrates THEN 'Protein'
  WHEN saturated_fat >= carbohydrates THEN 'Fat' ELSE 'Carb' END AS macro, CASE WHEN calories > 0 AND calories <= 100000 THEN 'low' WHEN calories > 100000 AND calories <= 250000 THEN 'mid' WHEN calories > 250000 THEN 'high' END AS bin FROM ({_SQL_RECIPES})) GROUP BY 1, 2""")
def macro_dominant_bins(t):
    macro = scores.dominant(["Protein", "Fat", "Carb"], [F.col("protein"), F.col("saturated_fat"), F.col("carbohydrates")], "Other")
    rows = recipes(t).select(macro.alias("macro"), scores.bin_right_closed(F.col("calories"), [0.0, 100000.0, 250000.0, float("inf")], ["low", "mid", "high"]).alias("bin"))
    return rows.groupBy("macro", "bin").agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS fdc_id, " + ", ".join(f"coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = '{f}'), 0) AS {f.lower()}_total" for f in "ARN") + " FROM lineitem GROUP BY 1")
def macro_pivot(t):
    wide = t.lineitem.groupBy(F.col("l_partkey").alias("fdc_id")).pivot("l_returnflag", ["A", "R", "N"]).agg(F.sum("l_quantity")).fillna(0.0)
    return wide.select("fdc_id", *(F.col(f).alias(f"{f.lower()}_total") for f in "ARN"))


_LOG = "SELECT event_id AS id, ts AS timestamp, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS food_fdc_id, event_type <> 'error' AS offered, event_type = 'purchase' AS chosen FROM events"


def log_of(events: DataFrame) -> DataFrame:
    """The preference log that a table or stream of events stands for."""
    return events.select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("food_fdc_id"), F.concat(F.lit("food "), F.get_json_object("props", "$.k")).alias("food_desc"), (F.col("event_type") != "error").alias("offered"), (F.col("event_type") == "purchase").alias("chosen"))


def log(t: Tables) -> DataFrame:
    return log_of(t.events)


@query(f"SELECT user_id, food_fdc_id, CAST(sum(CAST(offered AS INT)) AS BIGINT) AS offered, CAST(sum(CAST(chosen AS INT)) AS BIGINT) AS chosen, round(coalesce(sum(CAST(chosen AS INT))::DOUBLE / nullif(sum(CAST(offered AS INT)), 0), 0.5), 6) AS score FROM ({_LOG}) GROUP BY 1, 2")
def preference_scores(t):
    return rec.preference_scores(log(t)).withColumn("score", F.round("score", 6))


@query(f"""SELECT user_id, food_fdc_id, 'food ' || food_fdc_id AS food_desc, CASE WHEN c >= 0.5 * o THEN 'favourite' ELSE 'disliked' END AS kind
FROM (SELECT user_id, food_fdc_id, sum(CAST(offered AS INT)) AS o, sum(CAST(chosen AS INT)) AS c FROM ({_LOG}) GROUP BY 1, 2) WHERE o >= 2 AND (c >= 0.5 * o OR c = 0)""")
def preference_summary(t):
    return rec.preference_summary(log(t)).select("user_id", "food_fdc_id", "food_desc", "kind")


@query("SELECT user_id, event_id AS id, rank FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events) WHERE rank <= 5")
def recent_history(t):
    return rec.recent(log(t), 5).select("user_id", "id", "rank")


@query("""SELECT user_id, event_id AS id, meal, meal IS DISTINCT FROM before AS new_meal FROM (SELECT user_id, event_id, event_type AS meal, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)""")
def meal_changes(t):
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("user_id", F.col("event_id").alias("id"), F.col("event_type").alias("meal"), (~F.col("event_type").eqNullSafe(before)).alias("new_meal"))

"""The pipelines that put operators together: a benchmark's references and prompts, and the recommendation assistant.

All of it is one plan over many requests; the model calls are the only barriers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.jsonfix import repair_json, targets
from larder.functions.text import food_terms, nutrient_line, parse_meal, rewrite_synonyms
from larder.operators import evaluate, kb, models, recommend, retrieval
from larder.session import dealt, written

# The nutrients of a prompt and what they are called there.
KEY_NUTRIENTS = {"Carbohydrate, by difference": "Carb", "Protein": "Protein", "Total lipid (fat)": "Fat", "Energy": "Energy"}


def references(samples: DataFrame, foods: DataFrame, embed: Callable[[Column], Column], k: int = 1, least: float = 0.6) -> DataFrame:
    """Food references of each sample (doc_id, meal): doc_id, pos, term, matched, candidates (id, description, score).

    Terms are searched once however many samples have them.  A term whose best food an earlier term of the sample had is
    left out; a term without a food from `least` on stays, unmatched.
    """
    # written, for both sides of the join to come from one pass over the texts
    # an outer explode: for a plain one Spark asks first whether the array is empty, which reads each text again
    asked = dealt(samples).select("doc_id", F.posexplode_outer(food_terms(F.col("meal"))).alias("pos", "term")).where("pos IS NOT NULL").withColumn("text", rewrite_synonyms(F.col("term")))
    asked = written(asked.withColumn("qid", F.xxhash64("text")), "terms")
    terms = asked.select("text", "qid").distinct()
    found = retrieval.vector_topk(foods, terms.withColumn("v", embed(F.col("text"))), k, query_vec="v").join(foods.select("id", "description"), "id")
    packed = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "description", "score"))).alias("candidates"))
    rows = asked.join(packed, "qid", "left")
    top = F.get("candidates", F.lit(0))
    rows = rows.withColumns({"matched": F.coalesce(top["score"] >= least, F.lit(False)), "best": top["id"]})
    first = F.row_number().over(Window.partitionBy("doc_id", F.when(F.col("matched"), F.col("best")), F.when(~F.col("matched"), F.col("pos"))).orderBy("pos"))
    return rows.withColumn("n", first).where("n = 1").select("doc_id", "pos", "term", "matched", "candidates")


def prompt_blocks(refs: DataFrame, profiles: DataFrame, style: str, nutrient: str = "Carbohydrate, by difference") -> DataFrame:
    """A text per sample: `legacy` (matched foods with all key nutrients), `items` (a line per term) or `candidates`.

    profiles: fdc_id, nutrients (map).  Samples with nothing to say have an empty text.
    """
    each = refs.select("doc_id", "pos", "term", "matched", F.explode_outer("candidates").alias("c")).select("doc_id", "pos", "term", "matched", "c.rank", F.col("c.id").alias("fdc_id"), "c.description", "c.score")
    each = each.join(profiles, "fdc_id", "left")
    amount = lambda n: F.try_element_at(F.col("nutrients"), F.lit(n))
    own = F.when(amount(nutrient).isNotNull(), nutrient_line(F.lit(KEY_NUTRIENTS.get(nutrient, nutrient)), amount(nutrient), F.lit("g"))).otherwise("unknown")
    best = (F.col("rank") == 1) | F.col("rank").isNull()
    if style == "legacy":
        facts = F.array_join(F.array_compact(F.array(*(F.when(amount(n).isNotNull(), nutrient_line(F.lit(s), amount(n), F.lit("kcal" if s == "Energy" else "g"))) for n, s in KEY_NUTRIENTS.items()))), ", ")
        line, rows = F.concat(F.lit("- "), "description", F.lit(" (per 100 g): "), facts), each.where(best & F.col("matched"))
    elif style == "items":
        hit = F.concat(F.lit("- "), "term", F.lit(': USDA match → "'), "description", F.lit('" — '), own)
        line, rows = F.when(F.col("matched"), hit).otherwise(F.concat(F.lit("- "), "term", F.lit(": no reliable USDA match — use your own knowledge"))), each.where(best)
    elif style == "candidates":
        line, rows = F.concat(F.lit("- "), "term", F.format_string(" #%d ", "rank"), F.lit('"'), "description", F.lit('" '), F.format_string("(similarity %.2f) ", "score"), own), each.where("matched")
    else:
        raise ValueError(f"unknown style {style!r}")
    lines = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "rank", line.alias("line")))).alias("l"))
    return refs.select("doc_id").distinct().join(lines, "doc_id", "left").select("doc_id", F.coalesce(F.array_join("l.line", "\n"), F.lit("")).alias("block"))


def similarity_summary(refs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Per sample the largest, mean, first and number of best scores; and over all samples mean, median and share from `least` on."""
    best = refs.select("doc_id", "pos", F.get("candidates", F.lit(0))["score"].alias("score"))
    per = best.groupBy("doc_id").agg(F.max("score").alias("max"), F.avg("score").alias("mean"), F.count("score").alias("n"), F.min_by("score", "pos").alias("first"))
    return per, per.agg(F.avg("max").alias("mean"), F.median("max").alias("median"), F.min("max").alias("min"), F.max("max").alias("max"), (100 * F.avg((F.col("max") >= least).cast("double"))).alias("percent"))


def substitution_eval(items: DataFrame, pairs: DataFrame, wide: int = 20, near: int = 5) -> tuple[DataFrame, DataFrame]:
    """Ranks of true substitutes in a pool of `wide` text matches of their category and `near` graph neighbours of each; and their metrics.

    items: id, category, text_vec, graph_vec.  pairs: qid, id.  A substitute outside the pool ranks behind its category.
    """
    wanted = pairs.join(items.select("id", "category"), "id").select("qid", "category").distinct()
    asked = wanted.join(items.select(F.col("id").alias("qid"), F.col("text_vec").alias("q_text")), "qid")
    # a query and a category are one question; its pool is never written out as pairs
    keyed = asked.withColumn("k", F.xxhash64("qid", "category"))
    found = retrieval.vector_topk(items, keyed, wide, item_vec="text_vec", query_id="k", query_vec="q_text", alike=("category", "category"))
    top = written(found.select(F.col("qid").alias("k"), "id").join(keyed.select("k", "qid", "category"), "k").select("qid", "category", "id"), "wide")
    some = top.select(F.col("id").alias("p")).distinct().join(items.select(F.col("id").alias("p"), F.col("graph_vec").alias("v")), "p")
    around = retrieval.vector_topk(items, some, near, item_vec="graph_vec", query_id="p", query_vec="v", include_self=False).select(F.col("qid").alias("parent"), F.col("id").alias("other"))
    more = top.join(around, top["id"] == around["parent"]).select("qid", "category", F.col("other").alias("id"))
    score = F.round(retrieval.dot(retrieval.unit(F.col("text_vec")), retrieval.unit(F.col("q_text"))), 12)
    pool = top.unionByName(more).distinct().join(items.select("id", "category", "text_vec"), ["id", "category"]).join(asked, ["qid", "category"]).withColumn("score", score)
    size = asked.join(items.groupBy("category").agg(F.count("*").alias("n")), "category").groupBy("qid").agg(F.sum("n").alias("n"))
    ranks = evaluate.target_ranks(pool.select("qid", "id", "score"), pairs, size)
    return ranks, evaluate.rank_metrics(ranks)


def assistant(requests: DataFrame, foods: DataFrame, edges: DataFrame, nutrients: DataFrame, vectors: DataFrame, log: DataFrame, embed: Callable[[Column], Column], chat: Callable[[], models.Chat], available: DataFrame | None = None, seeds: int = 5, neighbours: int = 5, shown: int = 10) -> dict[str, DataFrame]:
    """From what was eaten to a recommendation, for many requests at once.

    requests: qid, user_id, meal (text).  foods: id, description, text_vec.  vectors: id, vec.  log: the preference log.
    Gives the tables eaten, targets, options, prompts, replies and offers (rows to append to the log).
    """
    parsed = dealt(requests).select("qid", "user_id", F.posexplode_outer(parse_meal(F.col("meal"))).alias("pos", "item")).where("pos IS NOT NULL").select("qid", "user_id", "pos", "item.term", "item.qty", "item.unit")
    parsed = parsed.withColumn("text", rewrite_synonyms(F.col("term")))
    parsed = written(parsed.withColumn("k", F.xxhash64("text")), "meals")  # meals are parsed once
    terms = parsed.select("text", "k").distinct().withColumn("v", embed(F.col("text")))
    top = retrieval.vector_topk(foods, terms, 1, item_vec="text_vec", query_id="k", query_vec="v").select(F.col("qid").alias("k"), F.col("id").alias("fdc_id"), "score")
    eaten = parsed.drop("text").join(top, "k", "left").drop("k")
    profiles = kb.nutrient_profiles(edges, nutrients, list(KEY_NUTRIENTS))
    known = eaten.join(profiles, "fdc_id", "left").join(foods.select(F.col("id").alias("fdc_id"), "description"), "fdc_id", "left")
    facts = F.array_join(F.transform(F.map_entries(F.coalesce("nutrients", F.create_map().cast("map<string,double>"))), lambda e: F.concat(e["key"], F.format_string(" %.1f", e["value"]))), ", ")
    said = known.groupBy("qid").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(": ", F.coalesce("description", "term"), facts))), "\n").alias("eaten"))
    asked = requests.join(said, "qid", "left").select("qid", "user_id", F.concat(F.lit("Eaten:\n"), F.coalesce("eaten", F.lit("nothing")), F.lit("\nGive targets for the next meal as JSON.")).alias("prompt"))
    goal = models.chat_with(asked, "prompt", "reply", chat).select("qid", "user_id", targets(F.coalesce(repair_json("reply"), F.lit("{}"))).alias("t")).select("qid", "user_id", "t.*")
    macros = {"Protein": "protein", "Total lipid (fat)": "fat", "Carbohydrate, by difference": "carb"}
    kind = F.coalesce(*(F.when(F.col("nutrient_name") == n, F.lit(m)) for n, m in macros.items()))
    rich = edges.join(nutrients.where(F.col("nutrient_name").isin(list(macros))), "nutrient_id").select("fdc_id", kind.alias("macro"), "amount")
    options = recommend.recommend_foods(goal, rich, vectors, seeds=seeds, neighbours=neighbours, available=available, eaten=eaten.where("fdc_id IS NOT NULL").select("qid", "fdc_id").distinct())
    options = options.join(requests.select("qid", "user_id"), "qid")
    ranked = recommend.rank_by_preference(options, recommend.preference_scores(log)).where(F.col("place") <= shown)
    ranked = ranked.join(foods.select(F.col("id").alias("fdc_id"), "description"), "fdc_id", "left")
    listed = ranked.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", F.concat(F.coalesce("description", F.lit("?")), F.when(F.col("preference") >= 0.7, " (favourite)").otherwise("")).alias("d")))).alias("l"))
    prompts = goal.join(listed, "qid", "left").select("qid", F.concat(F.format_string("Targets: protein %.0f g, fat %.0f g, carbohydrate %.0f g, %.0f kcal\nFoods:\n", "protein_g", "fat_g", "carb_g", "energy_kcal"), F.coalesce(F.array_join("l.d", "\n"), F.lit("none"))).alias("prompt"))
    replies = models.chat_with(prompts, "prompt", "answer", chat)
    offers = ranked.select("qid", "user_id", F.col("fdc_id").alias("food_fdc_id"), F.coalesce("description", F.lit("")).alias("food_desc"), F.lit(True).alias("offered"), F.lit(False).alias("chosen"))
    return {"eaten": eaten, "targets": goal, "options": ranked, "prompts": prompts, "replies": replies, "offers": offers}

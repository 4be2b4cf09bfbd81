"""Metrics of rankings, regressions, runs, failures and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import word_set
from larder.operators.kb import dense_ids


def set_metrics(truth: Column, predicted: Column) -> Column:
    """Struct precision, recall and f1 of two arrays of names as sets; with an empty truth only an empty prediction is right."""
    t, p = F.array_distinct(truth), F.array_distinct(predicted)
    hits = F.size(F.array_intersect(t, p)).cast("double")
    precision, recall = F.coalesce(F.try_divide(hits, F.size(p)), F.lit(0.0)), F.coalesce(F.try_divide(hits, F.size(t)), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    right = F.when(F.size(p) == 0, 1.0).otherwise(0.0)
    none = F.size(t) == 0
    return F.struct(F.when(none, right).otherwise(precision).alias("precision"), F.when(none, 1.0).otherwise(recall).alias("recall"), F.when(none, right).otherwise(f1).alias("f1"))


def ranking_metrics(ranked: DataFrame, truth: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Average precision and recall per query: ranked (qid, item, rank), truth (qid, item).  Repeated predictions count again.

    `queries` (qid) lists all of them: one with neither truth nor predictions scores 1, which no other table can show.
    """
    relevant = truth.select("qid", "item").distinct()
    size = relevant.groupBy("qid").agg(F.count("*").alias("n_truth"))
    rows = ranked.join(relevant.withColumn("rel", F.lit(1)), ["qid", "item"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    so_far = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hits", F.sum("rel").over(so_far)).withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    sums = rows.groupBy("qid").agg(
        F.sum(F.col("rel") * F.col("hits") / F.col("k")).alias("p"), F.sum(F.col("rel") * F.col("hits")).cast("double").alias("r"),
        F.count("*").alias("n_pred")
    )
    both = size.join(sums, "qid", "full_outer")
    if queries is not None:
        both = queries.select("qid").distinct().join(both, "qid", "left")
    n = F.col("n_truth")
    right = F.when(F.col("n_pred").isNull(), 1.0).otherwise(0.0)  # with nothing to find, only an empty prediction is right
    ap = F.when(n.isNull(), right).otherwise(F.coalesce(F.col("p") / n, F.lit(0.0)))
    ar = F.when(n.isNull(), right).otherwise(F.coalesce(F.try_divide(F.col("r") / n, F.least(n, F.col("n_pred"))), F.lit(0.0)))
    return both.select("qid", ap.alias("ap"), ar.alias("ar"), F.coalesce(n, F.lit(0)).alias("n_truth"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"))


def macro_average(per_query: DataFrame, columns: list[str]) -> DataFrame:
    return per_query.agg(*(F.round(100 * F.avg(c), 6).alias(c) for c in columns), F.count("*").alias("n"))


def target_ranks(scored: DataFrame, targets: DataFrame, pool_size: DataFrame | None = None) -> DataFrame:
    """Rank of each target among its query's scored items (ties by id); absent: the pool's size plus 1.

    scored: qid, id, score.  targets: qid, id.
    """
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    rows = targets.join(scored.withColumn("rank", rank), ["qid", "id"], "left")
    size = scored.groupBy("qid").agg(F.count("*").alias("n")) if pool_size is None else pool_size
    return rows.join(size, "qid", "left").select("qid", "id", F.coalesce("rank", F.coalesce("n", F.lit(0)) + 1).cast("long").alias("rank"))


def rank_metrics(ranks: DataFrame) -> DataFrame:
    """MAP ((i + 1) / rank over each query's sorted ranks), MRR and shares of queries with a rank up to 5 and 10."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id"))
    per = ranks.withColumn("i", place).groupBy("qid").agg(F.avg(F.col("i") / F.col("rank")).alias("ap"), F.min("rank").alias("best"))
    share = lambda k: F.avg((F.col("best") <= k).cast("double"))
    return per.agg(F.avg("ap").alias("map"), F.avg(1 / F.col("best")).alias("mrr"), share(5).alias("rr_at_5"), share(10).alias("rr_at_10"), F.count("*").alias("n"))


def regression(rows: DataFrame, predicted: str, truth: str, threshold: float) -> DataFrame:
    """Mean accuracy (error strictly below the threshold) and mean error over rows with both values."""
    e = F.abs(F.col(predicted) - F.col(truth))
    return rows.where(e.isNotNull()).agg(F.avg((e < threshold).cast("double")).alias("acc"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").alias("n"))


def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of two runs side by side by their place in the order of a distinct key (columns of b get `_b`); none if the runs differ in length."""
    if a.count() != b.count():
        return a.join(b.select(*(F.col(c).alias(f"{c}_b") for c in b.columns)), F.lit(False))
    place = lambda df: df.join(dense_ids(df, key, "place"), key)
    other = place(b).select("place", *(F.col(c).alias(f"{c}_b") for c in b.columns))
    return place(a).join(other, "place").drop("place")


def sweep(runs: DataFrame, row: str, column: str, score: str, columns: list) -> DataFrame:
    """A table of the best score by row and column of a sweep, with the best of each row."""
    wide = runs.groupBy(row).pivot(column, columns).agg(F.max(score))
    return wide.join(runs.groupBy(row).agg(F.max(score).alias("best")), row)


def compare_errors(a: DataFrame, b: DataFrame, band: float = 0.5) -> DataFrame:
    """Samples of two runs (doc_id, mae) side by side: delta and better, same or worse."""
    both = a.select("doc_id", F.col("mae").alias("mae_a")).join(b.select("doc_id", F.col("mae").alias("mae_b")), "doc_id")
    delta = F.col("mae_b") - F.col("mae_a")
    return both.withColumn("delta", delta).withColumn("outcome", F.when(delta < -band, "better").when(delta > band, "worse").otherwise("same"))


def matched_rollup(samples: DataFrame, band: float = 0.5) -> DataFrame:
    """By the number of matched references: samples, mean difference of error, helped, hurt and mean number of references.

    samples: matched, unmatched, mae_a, mae_b.  Samples without a reference are left out.
    """
    delta = F.col("mae_b") - F.col("mae_a")
    rows = samples.withColumns({"delta": delta, "items": F.col("matched") + F.col("unmatched")}).where("items > 0")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.groupBy("matched").agg(
        F.count("*").alias("n"), F.avg("delta").alias("delta"), count(F.col("delta") < -band).alias("helped"), count(F.col("delta") > band).alias("hurt"), F.avg("items").alias("items"),
    )


def extremes(rows: DataFrame, by: str, key: str, n: int, largest: bool = True) -> DataFrame:
    """The n rows with the largest (or smallest) value; ties by key."""
    return rows.orderBy(F.desc_nulls_last(by) if largest else F.asc_nulls_last(by), key).limit(n)


def failure_tags(refs: Column, rag: Column, base: Column) -> Column:
    """Reasons of a failure from reference structs (food_term, matched, description) and two predictions; later rules only where none applied."""
    none = F.array().cast("array<string>")
    broken = F.transform(F.filter(refs, lambda r: r["food_term"].rlike(r"\d")), lambda r: F.concat(F.lit("BROKEN_TERM:"), r["food_term"]))
    long = F.transform(F.filter(refs, lambda r: F.size(F.split(F.trim(r["food_term"]), r"\s+")) > 6), lambda r: F.concat(F.lit("LONG_TERM:"), r["food_term"]))
    wrong = F.transform(
        F.filter(refs, lambda r: r["matched"] & (F.size(word_set(r["food_term"])) > 0) & (F.size(F.array_intersect(word_set(r["food_term"]), word_set(r["description"]))) == 0)),
        lambda r: F.concat(F.lit("WRONG_MATCH:"), r["food_term"], F.lit("->"), r["description"]),
    )
    minus = lambda p, tag: F.when(p == -1, F.array(F.lit(tag))).otherwise(none)
    found = F.concat(broken, long, wrong, minus(rag, "RAG_RETURNED_MINUS1"), minus(base, "BASELINE_RETURNED_MINUS1"))
    n, hit = F.size(refs), F.size(F.filter(refs, lambda r: r["matched"]))
    last = F.when(hit == n, F.lit("ALL_MATCHED_STILL_WORSE")).when(hit > 0, F.format_string("PARTIAL_COVERAGE:%d/%d", hit, n)).otherwise("ALL_UNMATCHED")
    return F.when(n == 0, F.array(F.lit("NO_TERMS_EXTRACTED"))).when(F.size(found) == 0, F.array(last)).otherwise(found)


def tag_counts(rows: DataFrame, tags: str, key: str, shown: int = 3) -> DataFrame:
    """Count and the first few keys of each kind of tag, most common first."""
    each = rows.select(key, F.explode(tags).alias("t")).select(key, F.split_part("t", F.lit(":"), F.lit(1)).alias("tag"))
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(key))
    few = each.withColumn("n", rank).where(F.col("n") <= shown).groupBy("tag").agg(F.sort_array(F.collect_list(key)).alias("examples"))
    return each.groupBy("tag").agg(F.count("*").alias("count")).join(few, "tag").orderBy(F.desc("count"), "tag")


def finite(c: Column) -> Column:
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def subset_stats(episodes: DataFrame, metrics: list[str], by: str = "subset") -> DataFrame:
    """Mean, median, min, max, deviation (0 for one), sum and count of finite values per subset, and over all as OVERALL."""
    long = episodes.select(by, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), finite(F.col(m)).alias("v")) for m in metrics)))).where("v IS NOT NULL")
    grouped = long.rollup("metric", by).agg(
        F.avg("v").alias("mean"), F.median("v").alias("median"), F.min("v").alias("min"), F.max("v").alias("max"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), F.sum("v").alias("sum"), F.count("v").alias("count"), F.grouping(by).alias("all"), F.grouping("metric").alias("total")
    )
    return grouped.where("total = 0").withColumn(by, F.when(F.col("all") == 1, "OVERALL").otherwise(F.col(by))).drop("all", "total")


def failure_buckets(episodes: DataFrame, by: str = "subset") -> DataFrame:
    """Episodes with many planner errors, at the step limit, slow, or with an empty plan; one may be in several."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return episodes.groupBy(by).agg(
        count(F.col("planner_output_error") > 3)("many_errors"), count(F.col("num_steps") == 30)("step_limit"), count(F.col("episode_elapsed_seconds") > 200)("slow"), count((F.col("empty_plan") > 0) & (F.col("task_success") == 0))("empty_plan")
    )


def compare_runs(a: DataFrame, b: DataFrame, metric: str, by: str = "subset") -> DataFrame:
    """Means of two runs per subset; a subset that one run lacks has a null there."""
    x = a.groupBy(by).agg(F.avg(metric).alias("a"))
    y = b.groupBy(by).agg(F.avg(metric).alias("b"))
    return x.join(y, by, "full_outer").withColumn("delta", F.col("b") - F.col("a"))


def query_costs(results: DataFrame) -> DataFrame:
    """Tokens, times and calls per query from nested turns (llm_turns of tool_calls); no rows are exploded."""
    turns = F.coalesce("llm_turns", F.array().cast(results.schema["llm_turns"].dataType))
    add = lambda f, kind="long": F.aggregate(turns, F.lit(0).cast(kind), lambda s, t: s + F.coalesce(f(t).cast(kind), F.lit(0).cast(kind)))
    tools = lambda t, f: F.aggregate(F.coalesce(t["tool_calls"], F.array().cast("array<struct<tool_name:string,args_tokens:bigint,result_tokens:bigint,execution_time_s:double>>")), F.lit(0.0), lambda s, c: s + F.coalesce(f(c).cast("double"), F.lit(0.0)))
    return results.select(
        "query_id", add(lambda t: t["input_tokens"]).alias("input_tokens"), add(lambda t: t["output_tokens"]).alias("output_tokens"),
        add(lambda t: t["inference_time_s"], "double").alias("llm_s"),
        add(lambda t: tools(t, lambda c: c["execution_time_s"]), "double").alias("tool_s"), add(lambda t: F.size(t["tool_calls"])).alias("calls")
    )


def overall_costs(per_query: DataFrame) -> DataFrame:
    """Mean of every measure over the queries that have it."""
    return per_query.agg(*(F.avg(c).alias(c) for c in per_query.columns if c != "query_id"), F.count("*").alias("queries"))


def tool_costs(results: DataFrame) -> DataFrame:
    calls = results.select(F.explode("llm_turns").alias("t")).select(F.inline("t.tool_calls"))
    return calls.groupBy("tool_name").agg(
        F.count("*").alias("calls"), F.avg("args_tokens").alias("args_tokens"), F.avg("result_tokens").alias("result_tokens"),
        F.avg("execution_time_s").alias("seconds")
    )


def mean_of_ratios(rows: DataFrame, over: str, under: str) -> DataFrame:
    return rows.agg(F.avg(F.try_divide(F.col(over).cast("double"), F.col(under))).alias("ratio"))


def leaderboard(runs: DataFrame, score: str, order: str) -> DataFrame:
    """Runs in their order with the best score so far, and their place."""
    so_far = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # a row per run
    return runs.withColumn("best_so_far", F.max(score).over(so_far)).withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), order)))

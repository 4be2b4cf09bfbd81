"""Metrics of rankings, regressions, runs and costs over orders, events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.jsonfix import repair_json, repair_list, targets
from larder.functions.text import answer, food_terms, parse_meal, strip_thoughts, token_estimate, tool_calls
from larder.operators import evaluate as ev
from larder.operators import clusters, graph, layout, models
from larder.plans.registry import query
from larder.session import dealt


def _ranked(t):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t.orders.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("item"), rank.alias("rank"))


# Queries: customers, those without an order included.  Ranked: their orders by price; relevant: finished orders.  A query
# with nothing to find is right (1) only if it found nothing.
_AP = """WITH r AS (SELECT o_custkey AS qid, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS rel, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders WHERE o_custkey % 3 <> 0),
h AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY k) AS hits FROM r),
a AS (SELECT qid, sum(rel) AS n, count(*) AS p, sum(rel * hits / k::DOUBLE) AS sp, sum(rel * hits)::DOUBLE AS sr FROM h GROUP BY 1),
m AS (SELECT c_custkey AS qid, CASE WHEN p IS NULL THEN 1.0::DOUBLE WHEN n = 0 THEN 0 ELSE sp / n END AS ap, CASE WHEN p IS NULL THEN 1.0::DOUBLE WHEN n = 0 THEN 0 ELSE sr / n / least(n, p) END AS ar, CAST(coalesce(n, 0) AS BIGINT) AS n_truth, coalesce(p, 0) AS n_pred
  FROM customer LEFT JOIN a ON qid = c_custkey)"""


def _ranking(t):
    own = t.orders.where("o_custkey % 3 <> 0")
    truth = own.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("item"))
    return ev.ranking_metrics(_ranked(t).where("qid % 3 <> 0"), truth, t.customer.select(F.col("c_custkey").alias("qid")))


@query(_AP + " SELECT qid, round(ap, 6) AS ap, round(ar, 6) AS ar, n_truth, n_pred FROM m")
def ap_ar_per_query(t):
    return _ranking(t).withColumns({"ap": F.round("ap", 6), "ar": F.round("ar", 6)})


@query(_AP + " SELECT round(100 * avg(ap), 6) AS ap, round(100 * avg(ar), 6) AS ar, count(*) AS n FROM m")
def mean_ap_ar(t):
    return ev.macro_average(_ranking(t), ["ap", "ar"])


@query("""SELECT qid, round(CASE WHEN len(p) = 0 THEN 0 ELSE h / len(p)::DOUBLE END, 6) AS precision, round(CASE WHEN len(x) = 0 THEN 1 ELSE h / len(x)::DOUBLE END, 6) AS recall FROM (
  SELECT o_custkey AS qid, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS x0, list(DISTINCT o_orderpriority) FILTER (WHERE o_totalprice > 250000) AS p0, coalesce(x0, []) AS x, coalesce(p0, []) AS p, len(list_intersect(coalesce(x0, []), coalesce(p0, []))) AS h FROM orders GROUP BY 1) WHERE len(x) > 0""")
def set_precision_recall(t):
    pick = lambda c: F.collect_set(F.when(c, F.col("o_orderpriority")))
    rows = t.orders.groupBy(F.col("o_custkey").alias("qid")).agg(pick(F.col("o_orderstatus") == "F").alias("x"), pick(F.col("o_totalprice") > 250000).alias("p"))
    m = ev.set_metrics(F.col("x"), F.col("p"))
    return rows.where(F.size("x") > 0).select("qid", F.round(m["precision"], 6).alias("precision"), F.round(m["recall"], 6).alias("recall"))


_RANKS = """SELECT o_custkey AS qid, o_orderkey AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE o_orderstatus = 'P'"""


def _ranks(t):
    scored = t.orders.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return ev.target_ranks(scored, t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id")))


@query(_RANKS)
def substitution_ranks(t):
    return _ranks(t)


@query(f"""SELECT round(avg(ap), 6) AS map, round(avg(1.0 / best), 6) AS mrr, round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0 END), 6) AS rr_at_5, round(avg(CASE WHEN best <= 10 THEN 1.0 ELSE 0 END), 6) AS rr_at_10, count(*) AS n
FROM (SELECT qid, avg(i / rank::DOUBLE) AS ap, min(rank) AS best FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, id) AS i FROM ({_RANKS})) GROUP BY 1)""")
def substitution_metrics(t):
    return ev.rank_metrics(_ranks(t)).select(*(F.round(c, 6).alias(c) for c in ("map", "mrr", "rr_at_5", "rr_at_10")), "n")


@query("SELECT round(avg(CASE WHEN e < 7.5 THEN 1.0 ELSE 0 END), 6) AS acc, round(avg(e), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, count(*) AS n FROM (SELECT abs(l_quantity - l_tax * 500) AS e FROM lineitem)")
def acc_mae(t):
    out = ev.regression(t.lineitem.withColumn("g", F.col("l_tax") * 500), "l_quantity", "g", 7.5)
    return out.select(*(F.round(c, 6).alias(c) for c in ("acc", "mae", "rmse")), "n")


@query("""SELECT outcome, count(*) AS n, round(avg(delta), 6) AS delta FROM (SELECT CASE WHEN delta < -0.5 THEN 'better' WHEN delta > 0.5 THEN 'worse' ELSE 'same' END AS outcome, delta FROM (
  SELECT a.q - b.m AS delta FROM (SELECT l_orderkey, round(sum(l_quantity) / count(*), 3) AS q FROM lineitem GROUP BY 1) a JOIN (SELECT o_orderkey, round(o_totalprice / 10000, 3) AS m FROM orders) b ON l_orderkey = o_orderkey)) GROUP BY 1""")
def ab_delta(t):
    a = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.round(F.col("o_totalprice") / 10000, 3).alias("mae"))
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.round(F.sum("l_quantity") / F.count("*"), 3).alias("mae"))
    return ev.compare_errors(a, b).groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("delta"))


_SAMPLES = """SELECT l_orderkey AS id, count(*) FILTER (WHERE l_returnflag = 'R') AS matched, count(*) FILTER (WHERE l_returnflag = 'A') AS unmatched, round(sum(l_tax) * 100, 3) AS mae_a, round(sum(l_discount) * 100, 3) AS mae_b FROM lineitem GROUP BY 1"""


def _samples(t):
    count = lambda f: F.count(F.when(F.col("l_returnflag") == f, 1))
    error = lambda c: F.round(F.sum(c) * 100, 3)
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(count("R").alias("matched"), count("A").alias("unmatched"), error("l_tax").alias("mae_a"), error("l_discount").alias("mae_b"))


@query(f"""SELECT matched, count(*) AS n, round(avg(mae_b - mae_a), 6) AS delta, count(*) FILTER (WHERE mae_b - mae_a < -0.5) AS helped, count(*) FILTER (WHERE mae_b - mae_a > 0.5) AS hurt, round(avg(matched + unmatched), 6) AS items
FROM ({_SAMPLES}) WHERE matched + unmatched > 0 GROUP BY 1""")
def matched_rollup(t):
    return ev.matched_rollup(_samples(t)).withColumns({"delta": F.round("delta", 6), "items": F.round("items", 6)})


@query(f"SELECT id, mae_b FROM ({_SAMPLES}) ORDER BY mae_b DESC, id LIMIT 15")
def worst_samples(t):
    """The report of the largest errors: a list of 15."""
    return ev.extremes(_samples(t), "mae_b", "id", 15).select("id", "mae_b")


@query("""SELECT seed, score, max(score) OVER (ORDER BY seed) AS best_so_far, CAST(row_number() OVER (ORDER BY score DESC, seed) AS INTEGER) AS place FROM (SELECT l_suppkey AS seed, round(avg(l_quantity), 6) AS score FROM lineitem GROUP BY 1)""")
def seed_leaderboard(t):
    runs = t.lineitem.groupBy(F.col("l_suppkey").alias("seed")).agg(F.round(F.avg("l_quantity"), 6).alias("score"))
    return ev.leaderboard(runs, "score", "seed").select("seed", "score", "best_so_far", "place")


@query("""SELECT l_shipmode, a, n, r, best FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, max(l_quantity) FILTER (WHERE l_linenumber = 1) AS a, max(l_quantity) FILTER (WHERE l_linenumber = 2) AS n, max(l_quantity) FILTER (WHERE l_linenumber = 3) AS r, max(l_quantity) AS best FROM lineitem GROUP BY 1)""")
def model_sweep(t):
    runs = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode"), "l_linenumber", "l_quantity")
    return ev.sweep(runs, "l_shipmode", "l_linenumber", "l_quantity", [1, 2, 3]).select("l_shipmode", F.col("1").alias("a"), F.col("2").alias("n"), F.col("3").alias("r"), "best")


@query("""SELECT s_suppkey AS key, c_custkey AS key_b, s_acctbal AS value, c_acctbal AS value_b FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier) JOIN (SELECT *, row_number() OVER (ORDER BY c_custkey) AS m FROM customer WHERE c_custkey < (SELECT count(*) FROM supplier)) ON n = m""")
def paired_by_place(t):
    a = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value"))
    b = t.customer.where(F.col("c_custkey") < a.count()).select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return ev.paired(a, b, "key")


@query("SELECT round(avg(l_discount / nullif(l_tax, 0)), 6) AS ratio FROM lineitem")
def mean_ratio(t):
    return ev.mean_of_ratios(t.lineitem, "l_discount", "l_tax").select(F.round("ratio", 6).alias("ratio"))


@query("""SELECT split_part(tag, ':', 1) AS tag, count(*) AS count, list_sort(list(p_partkey))[1:3]::VARCHAR AS examples FROM (SELECT p_partkey, unnest([p_type || ':' || p_name, p_brand]) AS tag FROM part) GROUP BY 1""")
def tag_examples(t):
    rows = t.part.select("p_partkey", F.array(F.concat("p_type", F.lit(":"), "p_name"), "p_brand").alias("tags"))
    out = ev.tag_counts(rows, "tags", "p_partkey")
    return out.withColumn("examples", F.concat(F.lit("["), F.array_join(F.col("examples").cast("array<string>"), ", "), F.lit("]")))


@query("""SELECT round(lo - 0.06 * (hi - lo + 1e-9), 6) AS lo, round(hi + 0.06 * (hi - lo + 1e-9), 6) AS hi
FROM (SELECT quantile_cont(l_extendedprice, 0.005) AS lo, quantile_cont(l_extendedprice, 0.995) AS hi FROM lineitem)""")
def padded_quantiles(t):
    return models.padded_range(t.lineitem, "l_extendedprice").select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def _episodes(t):
    return t.orders.select(F.col("o_orderpriority").alias("subset"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("task_success"), (F.col("o_totalprice") / 1000).alias("episode_elapsed_seconds"), (F.col("o_orderkey") % 31).cast("double").alias("num_steps"), (F.col("o_custkey") % 6).cast("double").alias("planner_output_error"), (F.col("o_custkey") % 2).cast("double").alias("empty_plan"))


_EPISODES = "(SELECT o_orderpriority AS subset, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS task_success, o_totalprice / 1000 AS episode_elapsed_seconds, (o_orderkey % 31)::DOUBLE AS num_steps, (o_custkey % 6)::DOUBLE AS planner_output_error, (o_custkey % 2)::DOUBLE AS empty_plan FROM orders)"
_LONG = f"(SELECT subset, 'task_success' AS metric, task_success::DOUBLE AS v FROM {_EPISODES} UNION ALL SELECT subset, 'episode_elapsed_seconds', episode_elapsed_seconds FROM {_EPISODES})"


@query(f"""SELECT metric, coalesce(subset, 'OVERALL') AS subset, round(avg(v), 6) AS mean, round(median(v), 6) AS median, min(v) AS min, max(v) AS max, round(coalesce(stddev_samp(v), 0), 6) AS std, round(sum(v), 4) AS sum, count(v) AS count
FROM {_LONG} GROUP BY GROUPING SETS ((metric, subset), (metric))""")
def episode_stats_rollup(t):
    out = ev.subset_stats(_episodes(t), ["task_success", "episode_elapsed_seconds"])
    return out.select("metric", "subset", *(F.round(c, 6).alias(c) for c in ("mean", "median")), "min", "max", F.round("std", 6).alias("std"), F.round("sum", 4).alias("sum"), "count")


@query(f"""SELECT subset, count(*) FILTER (WHERE planner_output_error > 3) AS many_errors, count(*) FILTER (WHERE num_steps = 30) AS step_limit, count(*) FILTER (WHERE episode_elapsed_seconds > 200) AS slow,
  count(*) FILTER (WHERE empty_plan > 0 AND task_success = 0) AS empty_plan FROM {_EPISODES} GROUP BY 1""")
def failure_buckets(t):
    return ev.failure_buckets(_episodes(t))


@query("""SELECT coalesce(x.s, y.s) AS subset, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta FROM (SELECT l_returnflag || l_linestatus AS s, avg(l_quantity) AS a FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) x
FULL JOIN (SELECT l_returnflag || l_linestatus AS s, avg(l_quantity) AS b FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) y ON x.s = y.s""")
def run_compare(t):
    rows = t.lineitem.withColumn("subset", F.concat("l_returnflag", "l_linestatus"))
    out = ev.compare_runs(rows.where("l_returnflag <> 'N'"), rows.where("l_linestatus = 'O'"), "l_quantity")
    return out.select("subset", *(F.round(c, 6).alias(c) for c in ("a", "b", "delta")))


def _turns(t):
    call = F.struct(F.col("role").alias("tool_name"), F.lit(2).cast("long").alias("args_tokens"), F.length("text").cast("long").alias("result_tokens"), (F.col("turn") * 0.5).alias("execution_time_s"))
    turn = F.struct(token_estimate(F.col("text")).alias("input_tokens"), F.lit(3).cast("long").alias("output_tokens"), F.lit(0.25).alias("inference_time_s"), F.array(call).alias("tool_calls"))
    return t.conversations.groupBy(F.col("conv_id").alias("query_id")).agg(F.collect_list(turn).alias("llm_turns"))


@query("""SELECT conv_id AS query_id, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS input_tokens, 3 * count(*) AS output_tokens, 0.25::DOUBLE * count(*) AS llm_s, sum(turn * 0.5::DOUBLE) AS tool_s, count(*) AS calls FROM conversations GROUP BY 1""")
def token_cost_rollup(t):
    return ev.query_costs(_turns(t))


@query("""SELECT round(avg(i), 6) AS input_tokens, round(avg(3 * n), 6) AS output_tokens, round(avg(n), 6) AS calls, count(*) AS queries FROM (SELECT sum(greatest(1, length(text) // 4)) AS i, count(*) AS n FROM conversations GROUP BY conv_id)""")
def overall_costs(t):
    out = ev.overall_costs(ev.query_costs(_turns(t)))
    return out.select(*(F.round(c, 6).alias(c) for c in ("input_tokens", "output_tokens", "calls")), "queries")


@query("SELECT role AS tool_name, count(*) AS calls, 2.0::DOUBLE AS args_tokens, round(avg(length(text)), 6) AS result_tokens, round(avg(turn * 0.5::DOUBLE), 6) AS seconds FROM conversations GROUP BY 1")
def per_tool_avg(t):
    return ev.tool_costs(_turns(t)).select("tool_name", "calls", "args_tokens", F.round("result_tokens", 6).alias("result_tokens"), F.round("seconds", 6).alias("seconds"))


@query("""SELECT p_partkey AS key FROM (SELECT p_partkey, md5(p_partkey::VARCHAR) AS h, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY md5(p_partkey::VARCHAR), p_partkey) AS turn FROM part) ORDER BY turn, h, p_partkey LIMIT 100""")
def greedy_diverse_pick(t):
    return graph.diverse_pick(t.part, ["p_type", "p_brand"], "p_partkey", 100).select(F.col("p_partkey").alias("key"))


@query("""WITH p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), s AS (SELECT a FROM p GROUP BY 1 HAVING count(*) >= 2 ORDER BY md5(a::VARCHAR), a LIMIT 50)
SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY md5(concat_ws('-', a, b)), b) AS n FROM p WHERE a IN (SELECT a FROM s)) WHERE n = 1""")
def holdout_split(t):
    pairs = t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return graph.hold_out(pairs, 50).where("held_out").select("a", "b")


@query("""WITH p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), s AS (SELECT a FROM p GROUP BY 1 HAVING count(*) >= 2 ORDER BY md5(a::VARCHAR), a LIMIT 50),
h AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY md5(concat_ws('-', a, b)), b) AS n FROM p WHERE a IN (SELECT a FROM s)) WHERE n = 1)
SELECT a, b FROM p EXCEPT SELECT a, b FROM h""")
def training_split(t):
    """All pairs but those held out."""
    pairs = t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return graph.hold_out(pairs, 50).where("NOT held_out").select("a", "b")


@query("""SELECT part, count(*) AS n FROM (SELECT CASE WHEN h <= 'd9999999' THEN 'train' WHEN h <= 'eb851eb8' THEN 'valid' ELSE 'test' END AS part FROM (SELECT substr(md5(concat_ws('-', 82, a, b)), 1, 8) AS h FROM (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem))) GROUP BY 1""")
def edge_split(t):
    pairs = t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return graph.split_edges(pairs, ["a", "b"]).groupBy("part").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part), n AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 + (SELECT count(*) FROM part) AS i FROM supplier),
e AS (SELECT f.i AS src, n.i AS dst, round(ln(1 + l_quantity), 9) AS attr FROM lineitem JOIN f ON l_partkey = f.id JOIN n ON l_suppkey = n.id)
SELECT src, dst, attr, 'contains' AS etype FROM e UNION ALL SELECT dst, src, attr, 'contains' FROM e""")
def graph_index_edges(t):
    nodes = graph.number_nodes([("food", t.part, "p_partkey"), ("nutrient", t.supplier, "s_suppkey")])
    rows = t.lineitem.withColumnRenamed("l_quantity", "amount")
    return graph.edge_table(nodes, rows, ("food", "nutrient"), ("l_partkey", "l_suppkey"), "contains", graph.log_weight()).withColumn("attr", F.round("attr", 9))


@query("SELECT l_partkey AS food, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS neighbours FROM lineitem GROUP BY 1")
def adjacency_sets(t):
    return graph.adjacency(t.lineitem.select(F.col("l_partkey").alias("food"), F.col("l_suppkey").cast("string").alias("n")), "food", "n").withColumn("neighbours", F.array_join("neighbours", ","))


_DRAW = "CAST('0x' || substr(md5('{side}-82-' || k), 1, 8) AS BIGINT) % (SELECT count(*) FROM {table})"


@query(f"""WITH k AS (SELECT unnest(range(766)) AS k), d AS (SELECT DISTINCT {_DRAW.format(side="a", table="part")} AS a, {_DRAW.format(side="b", table="supplier")} AS b FROM k)
SELECT a, b FROM d WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = a AND l_suppkey = b) ORDER BY md5(concat_ws('-', a, b)), a, b LIMIT 500""")
def negative_edges(t):
    pairs = t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    left = t.part.select(F.col("p_partkey").alias("i"), F.col("p_partkey").alias("id"))
    return graph.negative_edges(pairs, left, t.supplier.select(F.col("s_suppkey").alias("i"), F.col("s_suppkey").alias("id")), 500)


_FREE = """WITH f AS (SELECT p_partkey AS a, s_suppkey AS b, row_number() OVER (ORDER BY p_partkey, s_suppkey) - 1 AS place FROM part, supplier
  WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey)), t AS (SELECT count(*) AS t FROM f)"""


def _numbered(t):
    pairs = t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return pairs, t.part.select(F.col("p_partkey").alias("i"), F.col("p_partkey").alias("id")), t.supplier.select(F.col("s_suppkey").alias("i"), F.col("s_suppkey").alias("id"))


@query(f"""{_FREE}, k AS (SELECT k, t, least(5000, t) AS n, t // least(5000, t) AS q, t % least(5000, t) AS r FROM t, (SELECT unnest(range(5000)) AS k) WHERE k < t),
s AS (SELECT k, k * q + k * r // n AS lo, (k + 1) * q + (k + 1) * r // n AS hi FROM k)
SELECT a, b FROM s JOIN f ON place = lo + CAST('0x' || substr(md5('n-82-' || k), 1, 8) AS BIGINT) % (hi - lo)""")
def negative_edges_exact(t):
    return graph.exact_negative_edges(*_numbered(t), 5000)


@query("""SELECT p_partkey AS a, n_nationkey::BIGINT AS b FROM part, nation WHERE (p_partkey, n_nationkey) NOT IN (SELECT (l_partkey, s_nationkey) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)""")
def negative_edges_all(t):
    """Of a dense graph, parts and the nations they come from, every pair that is no edge."""
    edges = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("a"), F.col("s_nationkey").cast("long").alias("b"))
    parts, nations = (x.select(F.col(c).cast("long").alias("i"), F.col(c).cast("long").alias("id")) for x, c in ((t.part, "p_partkey"), (t.nation, "n_nationkey")))
    return graph.exact_negative_edges(edges, parts, nations, 1 << 40)


@query("""SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
  SELECT l_quantity AS s, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS neg FROM lineitem GROUP BY 1))""")
def link_auc(t):
    rows = t.lineitem.withColumn("y", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    return graph.area_under_curve(rows, "l_quantity", "y").select(F.round("auc", 6).alias("auc"))


@query("SELECT conv_id, turn, trim(replace(text, '{', '')) AS text, 1::INTEGER AS calls, text IS NOT NULL AS ok FROM conversations")
def thoughts_and_tools(t):
    plain = F.trim(F.replace("text", F.lit("{")))
    reply = F.concat(F.lit("<think>a\nb</think>"), plain, F.lit('<tool_call>{"name": "look", "arguments": {}}</tool_call><tool_call>{bad}</tool_call>'))
    return t.conversations.select("conv_id", "turn", F.regexp_replace(strip_thoughts(reply), r"(?s)<tool_call>.*$", "").alias("text"), F.size(tool_calls(reply)).alias("calls"), repair_json(F.lit('x {"a": {"b": 1}')).isNotNull().alias("ok"))


_ANSWER = "SELECT l_orderkey AS id, l_linenumber AS line, {name} CASE l_linenumber % 4 WHEN 0 THEN l_quantity WHEN 1 THEN (l_quantity + l_quantity + 2) / 2 WHEN 2 THEN l_quantity ELSE -1 END AS pred FROM lineitem"
# The keys under which replies name each nutrient.
_KEYS = {"fat": "total_fat", "protein": "total_protein", "energy": "total_energy"}


@query(" UNION ALL ".join(_ANSWER.format(name=f"'{n}' AS nutrient,") for n in _KEYS))
def answers_by_nutrient(t):
    q = F.col("l_quantity").cast("string")
    several = F.concat(q, F.lit("-"), (F.col("l_quantity") + 2).cast("string"))
    kind, out = F.col("l_linenumber") % 4, None
    for nutrient, key in _KEYS.items():
        keyed = lambda v, key=key: F.concat(F.lit(f'Reasoning. Output: {{"{key}": '), v, F.lit("}"))
        reply = F.when(kind == 0, keyed(q)).when(kind == 1, keyed(several)).when(kind == 2, q).otherwise(F.lit("no idea"))
        rows = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.lit(nutrient).alias("nutrient"), answer(reply, nutrient).alias("pred"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(_ANSWER.format(name=""))
def answer_extract(t):
    q = F.col("l_quantity").cast("string")
    keyed = lambda v: F.concat(F.lit('Reasoning. Output: {"total_carbohydrates": '), v, F.lit("}"))
    reply = F.when(F.col("l_linenumber") % 4 == 0, keyed(q)).when(F.col("l_linenumber") % 4 == 1, keyed(F.concat(F.lit("["), q, F.lit(", "), (F.col("l_quantity") + 2).cast("string"), F.lit("]")))).when(F.col("l_linenumber") % 4 == 2, q).otherwise(F.lit("no idea"))
    return t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), answer(reply, "carb").alias("pred"))


@query("SELECT p_partkey AS id, p_size::DOUBLE AS protein_g, 20.0::DOUBLE AS fat_g, 2::INTEGER AS listed FROM part")
def json_targets(t):
    reply = F.concat(F.lit('Sure: ```json\n{"targets": {"protein_g": '), F.col("p_size").cast("string"), F.lit(', "fat_g": "much"}}\n```'))
    fixed = targets(repair_json(reply))
    return t.part.select(F.col("p_partkey").alias("id"), fixed["protein_g"].alias("protein_g"), fixed["fat_g"].alias("fat_g"), F.size(repair_list(F.concat(F.lit('1. "'), "p_name", F.lit('" and "b"')))).alias("listed"))


# number words and digits inside other words come before the quantity itself; units that are none ("glasz") come before it too
_HARD = ["'tender boneless ' || p_name || ' ten'", "'often ' || p_name || ' one'", "'1' || p_size::VARCHAR || ' glasz 2 g ' || p_name"]
_HARD_SQL = f"""SELECT p_partkey AS id, k, CASE k WHEN 0 THEN 10.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS qty, CASE k WHEN 2 THEN 'g' END AS unit,
  CASE k WHEN 0 THEN 'tender boneless ' || p_name WHEN 1 THEN 'often ' || p_name ELSE '1' || p_size::VARCHAR || ' glasz ' || p_name END AS term FROM part, (SELECT unnest([0, 1, 2]) AS k)"""


@query(_HARD_SQL)
def meal_quantity_places(t):
    """Quantities are cut out where they are found, not where the same letters come first."""
    texts = F.array(*(F.expr(h.replace("p_size::VARCHAR", "CAST(p_size AS STRING)")) for h in _HARD))
    rows = dealt(t.part).select(F.col("p_partkey").alias("id"), F.posexplode(texts).alias("k", "meal")).select("id", "k", F.explode_outer(parse_meal(F.col("meal"))).alias("x")).where("x IS NOT NULL")  # outer: parsed once
    return rows.select("id", "k", "x.qty", "x.unit", "x.term")


_MEAL = "p_size::VARCHAR || ' grams of boiled ' || p_name || ', a cup of milk and half a ' || p_type"


@query(f"""SELECT p_partkey AS id, n AS n, CASE n WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN 1.0 ELSE 0.5 END AS qty, CASE n WHEN 1 THEN 'g' WHEN 2 THEN 'cup' END AS unit,
  CASE n WHEN 1 THEN 'boiled ' || p_name WHEN 2 THEN 'milk' ELSE p_type END AS term FROM part, (SELECT unnest([1, 2, 3]) AS n)""")
def meal_parse(t):
    text = F.expr(_MEAL.replace("p_size::VARCHAR", "CAST(p_size AS STRING)"))
    rows = dealt(t.part).select(F.col("p_partkey").alias("id"), F.posexplode_outer(parse_meal(text)).alias("pos", "x")).where("pos IS NOT NULL")
    return rows.select("id", (F.col("pos") + 1).alias("n"), "x.qty", "x.unit", "x.term")


@query("SELECT p_partkey AS id, trim(regexp_replace(p_name, '\\b(large|small)\\b', '')) || ';white bun' AS terms FROM part")
def food_term_extract(t):
    text = F.concat(F.lit("I ate "), F.col("p_size").cast("string"), F.lit(" g of fresh "), "p_name", F.lit(", and a plain white bun (30g) with 5 grams of FRESH "), F.upper("p_name"), F.lit("."))
    return dealt(t.part).select(F.col("p_partkey").alias("id"), F.array_join(food_terms(text), ";").alias("terms"))


@query()
def kmeans_clusters(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return clusters.assign(rows, clusters.fit(rows)).groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def vector_map(t):
    """Every vector's place in a plane that keeps neighbourhoods."""
    return layout.layout(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))


@query()
def pca_projection(t):
    return models.project(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))).select("id", F.get("xy", F.lit(0)).alias("x"), F.get("xy", F.lit(1)).alias("y"))


@query()
def embed_texts(t):
    embed = models.embed_with(lambda: models.hashing_embedder(64))
    return t.benchmark.select("item_id", embed(F.col("text")).alias("vec"))


@query("SELECT item_id, 25.0::DOUBLE AS protein_g, 500.0::DOUBLE AS energy_kcal FROM benchmark")
def gap_analysis_stub(t):
    replies = models.chat_with(t.benchmark.select("item_id", "text"), "text", "reply", models.default_chat)
    fixed = targets(repair_json(F.coalesce("reply", F.lit("{}"))))
    return replies.select("item_id", fixed["protein_g"].alias("protein_g"), fixed["energy_kcal"].alias("energy_kcal"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem WHERE l_returnflag = 'A')) / (SELECT stddev_samp(l_quantity) FROM lineitem WHERE l_returnflag = 'A'), 6) AS z FROM lineitem")
def standardised(t):
    out = models.standardise(t.lineitem, "l_quantity", F.col("l_returnflag") == "A")
    return out.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.round("l_quantity_z", 6).alias("z"))


def _foods(t):
    embed = models.embed_with(lambda: models.hashing_embedder(1024))
    rows = t.part.groupBy(F.col("p_name").alias("description")).agg(F.min("p_partkey").alias("id"))
    return rows.withColumn("vec", embed(F.col("description"))).withColumn("text_vec", F.col("vec")), embed


@query("""WITH f AS (SELECT p_name AS d, min(p_partkey) AS id FROM part GROUP BY 1), q AS (SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^(large|small) ') THEN split_part(p_name, ' ', 2) ELSE p_name END AS term FROM part),
m AS (SELECT term, min(id) AS id FROM (SELECT DISTINCT term FROM q) JOIN f ON d = term OR (NOT contains(term, ' ') AND split_part(d, ' ', 2) = term) GROUP BY 1), a AS (SELECT l_partkey, min(l_quantity) AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_name = 'Supplier#000000001' GROUP BY 1)
SELECT p_partkey AS doc_id, '- ' || q.term || ': USDA match → "' || d || '" — ' || coalesce('Carb: ' || CAST(a.m AS DECIMAL(10, 1))::VARCHAR || 'g', 'unknown') || chr(10) || '- bun: no reliable USDA match — use your own knowledge' AS block
FROM q JOIN m ON q.term = m.term JOIN f ON f.id = m.id LEFT JOIN a ON l_partkey = m.id""")
def bench_prompts(t):
    from larder.operators import kb
    from larder.plans import assistant

    foods, embed = _foods(t)
    meal = F.concat(F.col("p_size").cast("string"), F.lit(" grams of "), "p_name", F.lit(", a plain bun (5g)"))
    refs = assistant.references(t.part.select(F.col("p_partkey").alias("doc_id"), meal.alias("meal")), foods, embed)
    edges = t.lineitem.select(F.col("l_partkey").alias("fdc_id"), F.col("l_suppkey").alias("nutrient_id"), F.col("l_quantity").alias("amount"))
    edges = edges.join(foods.select(F.col("id").alias("fdc_id")), "fdc_id", "left_semi")  # of foods that can be found
    carb = t.supplier.where("s_name = 'Supplier#000000001'").select(F.col("s_suppkey").alias("nutrient_id"), F.lit("Carbohydrate, by difference").alias("nutrient_name"))
    return assistant.prompt_blocks(refs, kb.nutrient_profiles(edges, carb), "items")


# Names of foods are two words, so the stand-in's cosine is half the number of words they share.
_OFFERS = """WITH f AS (SELECT p_name AS d, min(p_partkey) AS id FROM part GROUP BY 1), q AS (SELECT c_custkey AS qid, CASE c_nationkey % 2 WHEN 0 THEN 'blue bolt' ELSE 'hot gear' END AS other FROM customer),
eaten AS (SELECT qid, id FROM q JOIN f ON d = 'red ring' OR d = other),
rich AS (SELECT l_partkey AS id, l_quantity AS amount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_name = 'Supplier#000000002' AND l_quantity >= 5 AND l_partkey IN (SELECT id FROM f)),
seeds AS (SELECT * FROM (SELECT q.qid, r.id, row_number() OVER (PARTITION BY q.qid ORDER BY amount DESC, r.id) AS seed FROM q, rich r WHERE NOT EXISTS (SELECT 1 FROM eaten e WHERE e.qid = q.qid AND e.id = r.id)) WHERE seed <= 5),
pairs AS (SELECT a.id AS p, b.id, (CAST(split_part(a.d, ' ', 1) = split_part(b.d, ' ', 1) AS INT) + CAST(split_part(a.d, ' ', 2) = split_part(b.d, ' ', 2) AS INT)) / 2.0 AS score FROM f a, f b WHERE a.id <> b.id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY score DESC, id) AS rank FROM pairs) WHERE rank <= 5),
every AS (SELECT qid, id, seed, 0 AS rank, 1.0 AS score FROM seeds UNION ALL SELECT qid, near.id, seed, near.rank, near.score FROM seeds JOIN near ON p = seeds.id),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY seed, rank) AS n FROM every) WHERE n = 1),
liked AS (SELECT user_id, food_fdc_id, coalesce(sum(CAST(chosen AS INT)) / nullif(sum(CAST(offered AS INT)), 0), 0.5) AS liking FROM (LOG) GROUP BY 1, 2),
placed AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rank = 0 THEN 0 ELSE 1 END, CASE WHEN rank = 0 THEN coalesce(liking, 0.5) ELSE score END DESC, seed, rank) AS place FROM once LEFT JOIN liked ON user_id = qid AND food_fdc_id = id)
SELECT qid, id AS food_fdc_id, d AS food_desc FROM placed JOIN f USING (id) WHERE place <= 10"""


@query(_OFFERS.replace("LOG", "SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS food_fdc_id, event_type <> 'error' AS offered, event_type = 'purchase' AS chosen FROM events"))
def assistant_offers(t):
    from larder.plans import assistant, recommend_queries

    foods, embed = _foods(t)
    names = {"Supplier#000000000": "Protein", "Supplier#000000001": "Total lipid (fat)", "Supplier#000000002": "Carbohydrate, by difference"}
    called = F.coalesce(*(F.when(F.col("s_name") == k, F.lit(v)) for k, v in names.items()))
    nutrients = t.supplier.select(F.col("s_suppkey").alias("nutrient_id"), called.alias("nutrient_name")).where("nutrient_name IS NOT NULL")
    edges = t.lineitem.join(foods.select(F.col("id").alias("l_partkey")), "l_partkey", "left_semi").select(F.col("l_partkey").alias("fdc_id"), F.col("l_suppkey").alias("nutrient_id"), F.col("l_quantity").alias("amount"))
    requests = t.customer.select(F.col("c_custkey").alias("qid"), F.col("c_custkey").alias("user_id"), F.concat(F.lit("a cup of red ring and 20 g of "), F.element_at(F.array(F.lit("blue bolt"), F.lit("hot gear")), (F.col("c_nationkey") % 2 + 1).cast("int"))).alias("meal"))
    out = assistant.assistant(requests, foods, edges, nutrients, foods.select("id", "vec"), recommend_queries.log(t), embed, models.default_chat)
    return out["offers"].select("qid", "food_fdc_id", "food_desc")


_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query(f"""WITH p AS (SELECT q.vec_id AS qid, min(i.vec_id) AS id, any_value(q.label) AS category FROM embeddings q JOIN embeddings i ON q.label = i.label AND q.vec_id <> i.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1),
s AS (SELECT qid, i.vec_id AS id, round({_COS.format(a="q.embedding[1:32]", b="i.embedding[1:32]")}, 12) AS score FROM p JOIN embeddings q ON q.vec_id = qid JOIN embeddings i ON i.label = p.category),
t AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS n FROM s) WHERE n <= 20),
g AS (SELECT DISTINCT qid, id FROM (SELECT t.qid, i.vec_id AS id, row_number() OVER (PARTITION BY t.qid, t.id ORDER BY round({_COS.format(a="a.embedding[33:64]", b="i.embedding[33:64]")}, 12) DESC, i.vec_id) AS n
  FROM t JOIN embeddings a ON a.vec_id = t.id, embeddings i WHERE i.vec_id <> t.id) WHERE n <= 5),
o AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s SEMI JOIN (SELECT * FROM t UNION SELECT * FROM g) x USING (qid, id))
SELECT p.qid, p.id, CAST(coalesce(rank, n + 1) AS BIGINT) AS rank FROM p JOIN (SELECT qid, count(*) AS n FROM s GROUP BY 1) c ON c.qid = p.qid LEFT JOIN o ON o.qid = p.qid AND o.id = p.id""")
def substitution_pool_ranks(t):
    from larder.plans import assistant

    items = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("category"), F.slice("embedding", 1, 32).alias("text_vec"), F.slice("embedding", 33, 32).alias("graph_vec"))
    least = items.groupBy("category").agg(F.min("id").alias("a"))  # a row per category: its smallest id, and the next for that one itself
    least = least.join(items.join(least, "category").where("id <> a").groupBy("category").agg(F.min("id").alias("b")), "category", "left")
    pairs = items.where("id % 100 = 0").select(F.col("id").alias("qid"), "category").distinct().join(least, "category")
    pairs = pairs.select("qid", F.when(F.col("qid") != F.col("a"), F.col("a")).otherwise(F.col("b")).alias("id")).where("id IS NOT NULL").groupBy("qid").agg(F.min("id").alias("id"))
    return assistant.substitution_eval(items, pairs)[0]

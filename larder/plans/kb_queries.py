"""Knowledge-base operators over the star schema: parts are foods, suppliers nutrients, line items edges, orders recipes, priorities tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.text import frame_label, id_after_hash, normalise_name, rewrite_synonyms
from larder.operators import kb
from larder.plans.registry import Tables, query
from larder.sources.sinks import export_nested

MACROS = ["Supplier#000000001", "Supplier#000000003", "Supplier#000000005"]


def foods(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("fdc_id"), F.col("p_name").alias("description"))


def edges(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_partkey").alias("fdc_id"), F.col("l_suppkey").alias("nutrient_id"), F.col("l_quantity").alias("amount"))


def nutrients(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("nutrient_id"), F.col("s_name").alias("nutrient_name"), F.lit("g").alias("unit_name"))


@query("""SELECT l_partkey AS fdc_id, p_name AS description, s_name AS nutrient_name, l_quantity AS amount
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
WHERE s_name = 'Supplier#000000007' AND l_quantity >= 20 ORDER BY amount DESC, fdc_id LIMIT 20""")
def nutrient_target_topk(t):
    return kb.nutrient_target(foods(t), edges(t), nutrients(t), "supplier#000000007", 20.0, 20)


@query("""SELECT fdc_id, string_agg(s_name || '=' || CAST(CAST(m AS BIGINT) AS VARCHAR), ',' ORDER BY s_name) AS profile
FROM (SELECT l_partkey AS fdc_id, s_name, min(l_quantity) AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) GROUP BY fdc_id""")
def food_profile_map(t):
    entries = F.transform(F.map_entries("nutrients"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("long").cast("string")))
    return kb.nutrient_profiles(edges(t), nutrients(t)).select("fdc_id", F.array_join(F.array_sort(entries), ",").alias("profile"))


@query("""SELECT p_partkey AS fdc_id, coalesce(c, 0) AS macro_count FROM part LEFT JOIN (
  SELECT l_partkey, count(*) AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE s_name IN ('Supplier#000000001', 'Supplier#000000003', 'Supplier#000000005') GROUP BY 1) ON p_partkey = l_partkey
ORDER BY macro_count DESC, fdc_id LIMIT 50""")
def macro_count_rank(t):
    counts = kb.macro_counts(edges(t), nutrients(t), MACROS)
    rows = foods(t).select("fdc_id").join(counts, "fdc_id", "left").withColumn("macro_count", F.coalesce("macro_count", F.lit(0)).cast("long"))
    return rows.orderBy(F.desc("macro_count"), "fdc_id").limit(50)


_REPR = """SELECT fdc_id, description, edges FROM (SELECT p_partkey AS fdc_id, p_name AS description, coalesce(c, 0) AS edges,
  row_number() OVER (PARTITION BY p_name ORDER BY coalesce(c, 0) DESC, p_partkey) AS n
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS c FROM lineitem GROUP BY 1) ON p_partkey = l_partkey) WHERE n = 1"""


@query(_REPR)
def kb_dedup_representative(t):
    return kb.representatives(foods(t), edges(t))


@query(f"""WITH r AS ({_REPR}) SELECT r.fdc_id, l_suppkey AS nutrient_id, round(avg(l_quantity), 6) AS amount
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN r ON p_name = r.description GROUP BY 1, 2""")
def kb_dedup_avg_edges(t):
    out = kb.merge_edges(foods(t), edges(t), kb.representatives(foods(t), edges(t)))
    return out.withColumn("amount", F.round("amount", 6))


_NAMED = "CASE WHEN p_size % 7 = 0 THEN 'Vitamin ' || p_name WHEN p_size % 11 = 0 THEN p_name || ' - NFY' ELSE p_name END"


def _named(t):
    return t.part.select(F.col("p_partkey").alias("fdc_id"), F.expr(_NAMED).alias("description"))


@query(f"""SELECT * FROM (SELECT p_partkey AS fdc_id, {_NAMED} AS description FROM part)
WHERE NOT regexp_matches(description, '^(Amino Acids|Minerals|Vitamin|Starch)') AND description NOT LIKE '%- NFY%' AND description NOT LIKE '%- CY%'""")
def kb_junk_filter(t):
    return _named(t).where(~kb.is_junk(F.col("description")))


@query(f"""SELECT * FROM (SELECT p_partkey AS fdc_id, {_NAMED} AS description FROM part)
WHERE NOT regexp_matches(description, '^Vitamin') AND description NOT LIKE '%- NFY%' AND fdc_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)""")
def kb_clean_foods(t):
    some = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("fdc_id"))
    return kb.clean_foods(_named(t), some)


@query("SELECT o_orderkey AS recipe_id, o_orderpriority AS tag FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def kb_orphan_recipes(t):
    recipes = t.orders.select(F.col("o_orderkey").alias("recipe_id"), F.col("o_orderpriority").alias("tag"))
    return kb.orphans(recipes, t.lineitem.select(F.col("l_orderkey").alias("recipe_id")), "recipe_id")


@query("SELECT l_suppkey AS nutrient_id, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1")
def kb_dangling_edges(t):
    nodes = t.part.where("p_size > 25").select(F.col("p_partkey").alias("fdc_id"))
    return kb.dangling(edges(t), nodes, "fdc_id").groupBy("nutrient_id").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.55 THEN 'medium' ELSE 'low' END AS quality, count(*) AS n
FROM (SELECT round(1 - l_discount * 5, 4) AS s FROM lineitem) GROUP BY 1""")
def kb_quality_buckets(t):
    return kb.match_quality(t.lineitem.select(F.round(1 - F.col("l_discount") * 5, 4).alias("s")), "s")


@query("SELECT round(avg(n), 6) AS average FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def kb_avg_ingredients(t):
    return kb.average_degree(t.lineitem, "l_orderkey").select(F.round("average", 6).alias("average"))


@query("SELECT round(1 - sum(CASE WHEN p_partkey IS NULL THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS coverage FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 25) ON l_partkey = p_partkey")
def link_coverage(t):
    return kb.coverage(t.lineitem, t.part.where("p_size > 25"), "l_partkey", "p_partkey").select(F.round("coverage", 6).alias("coverage"))


@query("""SELECT p_partkey AS fdc_id, p_name AS description, p_type AS data_type, CAST(p_size AS BIGINT) AS food_category_id FROM part
UNION ALL SELECT s_suppkey + 1000000, s_name, NULL, NULL FROM supplier""")
def kb_append_nullpad(t):
    base = t.part.select(F.col("p_partkey").alias("fdc_id"), F.col("p_name").alias("description"), F.col("p_type").alias("data_type"), F.col("p_size").cast("long").alias("food_category_id"))
    return kb.append_padded(base, t.supplier.select((F.col("s_suppkey") + 1_000_000).alias("fdc_id"), F.col("s_name").alias("description")))


@query("""SELECT p_partkey AS fdc_id, '{"fdc_id":' || p_partkey || ',"description":"' || p_name || '","nutrients":{' ||
  coalesce(string_agg('"' || s_name || '":{"amount":' || CAST(m AS VARCHAR) || ',"unit":"g"}', ',' ORDER BY s_name), '') || '}}' AS json
FROM part LEFT JOIN (SELECT l_partkey, s_name, min(l_quantity) AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) ON p_partkey = l_partkey
GROUP BY p_partkey, p_name""")
def kb_export_json(t):
    return export_nested(foods(t), edges(t), nutrients(t))


@query("SELECT p_partkey AS fdc_id, p_name AS description FROM part WHERE lower(p_name) LIKE '%ring%' ORDER BY description, fdc_id LIMIT 50")
def substring_search(t):
    return kb.substring_search(foods(t), "Ring", 50)


@query("SELECT p_partkey AS id, lower(trim(replace(' ' || upper(p_name) || '\\''s ', '\\''', ''''))) AS name FROM part")
def name_normalise(t):
    return t.part.select(F.col("p_partkey").alias("id"), normalise_name(F.concat(F.lit(" "), F.upper("p_name"), F.lit("\\'s "))).alias("name"))


@query("SELECT p_name AS name, row_number() OVER (ORDER BY p_name) - 1 AS tag_id FROM (SELECT DISTINCT p_name FROM part)")
def dense_tag_ids(t):
    return kb.dense_ids(t.part.select(F.col("p_name").alias("name")), "name", "tag_id")


@query("""SELECT p_partkey AS id, CASE WHEN contains(s, 'spring onion') THEN regexp_replace(s, 'spring onion', 'green onion') WHEN contains(s, 'groundnuts') THEN regexp_replace(s, 'groundnuts', 'peanuts')
  WHEN contains(s, 'maize') THEN regexp_replace(s, 'maize', 'corn') ELSE s END AS term FROM (
  SELECT p_partkey, lower(trim(CASE p_size % 4 WHEN 0 THEN p_name || ' Maize maize' WHEN 1 THEN 'Spring Onion ' || p_name || ' maize' WHEN 2 THEN 'groundnuts ' || p_name ELSE p_name END)) AS s FROM part)""")
def synonym_rewrite(t):
    raw = F.expr("CASE p_size % 4 WHEN 0 THEN p_name || ' Maize maize' WHEN 1 THEN 'Spring Onion ' || p_name || ' maize' WHEN 2 THEN 'groundnuts ' || p_name ELSE p_name END")
    return t.part.select(F.col("p_partkey").alias("id"), rewrite_synonyms(raw).alias("term"))


@query("SELECT p_partkey AS id, p_name AS label, p_partkey + 5 AS number FROM part")
def frame_labels(t):
    frame = F.concat(F.lit("detected_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string"))
    return t.part.select(F.col("p_partkey").alias("id"), frame_label(frame).alias("label"), id_after_hash(F.concat(F.lit("http://x/y#"), (F.col("p_partkey") + 5).cast("string"))).alias("number"))

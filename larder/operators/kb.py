"""The knowledge base: choosing source tables, cleaning, merging, deduplication, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.session import checkpointed

# Descriptions that start so are laboratory records, not foods.
JUNK_PREFIXES = [
    "Amino Acids", "Minerals", "Fatty Acids", "Proximates", "Starch", "Sugars,", "TDF", "Thiamin", "Vitamin", "Riboflavin", "Selenium", "Pantothenic",
    "Choline", "Niacin", "Fat,", "Carotenoids", "Folate", "Cholesterol"
]
JUNK_PARTS = ["- NFY", "- CY"]
# Words that tell a table of nutrients, and points for its columns.
NUTRIENT_WORDS = ["protein", "fat", "carbo", "fiber", "energy", "calcium", "iron", "vitamin"]
NUTRIENT_COLUMNS = {"unit_name": 4, "nutrient_nbr": 3, "rank": 2, "nutrient_id": 1}
FOOD_COLUMNS = {"data_type": 3, "publication_date": 2, "food_category_id": 1}


def optional(df: DataFrame, name: str, kind: str) -> Column:
    """The column as `kind`, or nulls where the source lacks it."""
    return (F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)).alias(name)


def choose_food_table(tables: dict[str, DataFrame]) -> str:
    def score(df: DataFrame) -> float:
        return sum(v for c, v in FOOD_COLUMNS.items() if c in df.columns) + 0.001 * df.count()

    fits = {n: score(d) for n, d in tables.items() if {"fdc_id", "description"} <= set(d.columns)}
    if not fits:
        raise ValueError("no table has fdc_id and description")
    return max(sorted(fits), key=fits.get)


def choose_nutrient_table(tables: dict[str, DataFrame]) -> str:
    def score(df: DataFrame) -> float:
        hit = F.lit(False)
        for w in NUTRIENT_WORDS:
            hit = hit | F.lower("name").contains(w)
        r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(hit, 1).otherwise(0)), F.lit(0)).alias("hits")).first()
        return 100 * r["hits"] + sum(v for c, v in NUTRIENT_COLUMNS.items() if c in df.columns) + (2 if 200 <= r["n"] <= 1000 else 1 if r["n"] > 1000 else 0)

    fits = {n: score(d) for n, d in tables.items() if {"id", "name"} <= set(d.columns) and "fdc_id" not in d.columns}
    if not fits:
        raise ValueError("no table has id and name")
    return max(sorted(fits), key=fits.get)


def coverage(links: DataFrame, dims: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Share of the links whose key is known; 0 for no links."""
    known = dims.select(F.col(dim_key).alias("known")).distinct()
    joined = links.join(known, F.col(key) == F.col("known"), "left")
    missing = F.sum(F.when(F.col("known").isNull(), 1).otherwise(0))
    return joined.agg(F.coalesce(1 - F.try_divide(missing, F.count("*")), F.lit(0.0)).alias("coverage"))


def choose_link_table(tables: dict[str, DataFrame], foods: DataFrame, nutrients: DataFrame) -> str:
    def score(df: DataFrame) -> float:
        ids = df.select(F.col("fdc_id").try_cast("long").alias("f"), F.col("nutrient_id").try_cast("long").alias("n"))
        return coverage(ids, foods, "f", "fdc_id").first()[0] + coverage(ids, nutrients, "n", "nutrient_id").first()[0]

    fits = {n: score(d) for n, d in tables.items() if {"fdc_id", "nutrient_id"} <= set(d.columns)}
    if not fits:
        raise ValueError("no table links foods and nutrients")
    return max(sorted(fits), key=fits.get)


def is_junk(description: Column) -> Column:
    """Null descriptions are not junk."""
    prefix = "^(" + "|".join(p.replace("(", r"\(") for p in JUNK_PREFIXES) + ")"
    test = description.rlike(prefix)
    for part in JUNK_PARTS:
        test = test | description.contains(part)
    return F.coalesce(test, F.lit(False))


def clean_foods(foods: DataFrame, edges: DataFrame) -> DataFrame:
    """Foods that have an edge and are no laboratory record."""
    return foods.join(edges.select("fdc_id").distinct(), "fdc_id", "left_semi").where(~is_junk(F.col("description")))


def append_padded(base: DataFrame, more: DataFrame) -> DataFrame:
    return base.unionByName(more, allowMissingColumns=True)


def append_new(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    return base.unionByName(more.join(base.select(key), key, "left_anti"), allowMissingColumns=True)


def representatives(foods: DataFrame, edges: DataFrame, key: str = "fdc_id", name: str = "description") -> DataFrame:
    """Of each description the food with most edges, then the smallest id.  Minimum of a struct, so partial aggregation does the work."""
    counts = edges.groupBy(key).agg(F.count("*").alias("edges"))
    ranked = foods.join(counts, key, "left").withColumn("o", F.struct((-F.coalesce("edges", F.lit(0))).alias("e"), F.col(key).alias("k")))
    return ranked.groupBy(name).agg(F.min("o").alias("o")).select(F.col("o.k").alias(key), name, (-F.col("o.e")).cast("long").alias("edges"))


def merge_edges(
    foods: DataFrame, edges: DataFrame, repr_: DataFrame, key: str = "fdc_id", name: str = "description", nutrient: str = "nutrient_id",
    amount: str = "amount"
) -> DataFrame:
    """Edges of all foods of one description, averaged on their representative; null amounts do not count."""
    named = edges.join(foods.select(key, name), key)
    by_name = named.groupBy(name, nutrient).agg(F.sum(amount).alias("s"), F.count(amount).alias("c"))  # summed before the join back
    return by_name.join(repr_.select(F.col(key).alias("r"), name), name).select(F.col("r").alias(key), nutrient, F.try_divide("s", "c").alias(amount))


def orphans(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    return nodes.join(edges.select(key).distinct(), key, "left_anti")


def dangling(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges whose node is missing."""
    return edges.join(nodes.select(key).distinct(), key, "left_anti")


def quality_bucket(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.55, "medium").otherwise("low")


def match_quality(edges: DataFrame, score: str) -> DataFrame:
    return edges.groupBy(quality_bucket(F.col(score)).alias("quality")).agg(F.count("*").alias("n"))


def average_degree(edges: DataFrame, key: str) -> DataFrame:
    return edges.groupBy(key).agg(F.count("*").alias("n")).agg(F.avg("n").alias("average"))


def food_index(foods: DataFrame) -> DataFrame:
    return foods.select("fdc_id", "description", F.lower("description").alias("description_lc"), optional(foods, "data_type", "string"))


def dense_ids(df: DataFrame, key: str, out: str) -> DataFrame:
    """Ids from 0 in the order of a distinct key: range partitions are numbered apart and their sizes added up."""
    one = df.select(key).distinct()
    parts = checkpointed(one.repartitionByRange(key).select(key, F.spark_partition_id().alias("p")))  # partition numbers hold from here on
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("p").agg(F.count("*").alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row per partition
    inner = F.row_number().over(Window.partitionBy("p").orderBy(key))
    return parts.withColumn("i", inner).join(F.broadcast(sizes), "p").select(key, (F.col("base") + F.col("i") - 1).cast("long").alias(out))


def build_kb(tables: dict[str, DataFrame], legacy: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Node, edge and index tables from a catalogue of CSV tables, with the legacy release appended after cleaning."""
    raw = tables[choose_nutrient_table(tables)]
    nutrients = raw.select(
        F.col("id").try_cast("long").alias("nutrient_id"), F.trim("name").alias("nutrient_name"),
        F.trim(optional(raw, "unit_name", "string")).alias("unit_name")
    ).where("nutrient_id IS NOT NULL")
    raw = tables[choose_food_table(tables)]
    foods = raw.select(
        F.col("fdc_id").try_cast("long").alias("fdc_id"), "description", optional(raw, "data_type", "string"),
        optional(raw, "food_category_id", "long"), optional(raw, "publication_date", "string")
    ).where("fdc_id IS NOT NULL")
    raw = tables[choose_link_table(tables, foods, nutrients)]
    amount = "amount" if "amount" in raw.columns else "value"
    edges = raw.select(
        F.col("fdc_id").try_cast("long").alias("fdc_id"), F.col("nutrient_id").try_cast("long").alias("nutrient_id"),
        F.col(amount).try_cast("double").alias("amount")
    ).where("fdc_id IS NOT NULL AND nutrient_id IS NOT NULL")
    foods = clean_foods(foods, edges)
    if legacy:
        foods, edges, nutrients = append_padded(foods, legacy["food"]), append_padded(edges, legacy["edges"]), append_new(nutrients, legacy["nutrients"], "nutrient_id")
    chosen = representatives(foods, edges)
    kept = foods.join(chosen.select("fdc_id"), "fdc_id", "left_semi")
    return {"nodes_food": kept, "nodes_nutrient": nutrients, "edges_food_contains_nutrient": merge_edges(foods, edges, chosen), "food_index": food_index(kept)}


def quality_report(tables: dict[str, DataFrame], links: DataFrame, recipes: DataFrame) -> DataFrame:
    """Row counts, match quality, orphans and ingredients per recipe, as measure and value."""
    rows = [df.agg(F.lit(f"rows:{n}").alias("measure"), F.count("*").cast("double").alias("value")) for n, df in tables.items()]
    rows.append(match_quality(links, "similarity_score").select(F.concat(F.lit("match:"), "quality").alias("measure"), F.col("n").cast("double").alias("value")))
    rows.append(orphans(recipes, links, "recipe_id").agg(F.lit("recipes without foods").alias("measure"), F.count("*").cast("double").alias("value")))
    rows.append(average_degree(links, "recipe_id").select(F.lit("ingredients per recipe").alias("measure"), F.col("average").alias("value")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def substring_search(foods: DataFrame, text: str, limit: int, key: str = "fdc_id", name: str = "description") -> DataFrame:
    return foods.where(F.lower(name).contains(text.lower())).select(key, name).orderBy(name, key).limit(limit)


def nutrient_target(foods: DataFrame, edges: DataFrame, nutrients: DataFrame, nutrient: str, least: float, limit: int) -> DataFrame:
    """Foods with at least `least` of a nutrient, most first.  The nutrient's few rows are picked before any join."""
    wanted = nutrients.where(F.lower(F.trim("nutrient_name")) == nutrient.strip().lower()).select("nutrient_id", "nutrient_name", "unit_name")
    found = edges.where(F.col("amount") >= least).join(wanted, "nutrient_id")
    return found.join(foods, "fdc_id").select("fdc_id", "description", "nutrient_name", "amount").orderBy(F.desc("amount"), "fdc_id").limit(limit)


def nutrient_profiles(edges: DataFrame, nutrients: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A map from nutrient name to amount per food; of nutrients that share a name the smallest amount."""
    named = edges.join(nutrients.select("nutrient_id", "nutrient_name"), "nutrient_id")
    if names is not None:
        named = named.where(F.col("nutrient_name").isin(names))
    one = named.groupBy("fdc_id", "nutrient_name").agg(F.min("amount").alias("amount"))
    return one.groupBy("fdc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("nutrient_name", "amount")))).alias("nutrients"))


def macro_counts(edges: DataFrame, nutrients: DataFrame, names: list[str]) -> DataFrame:
    few = nutrients.where(F.col("nutrient_name").isin(names)).select("nutrient_id")
    return edges.join(few, "nutrient_id").groupBy("fdc_id").agg(F.count("*").alias("macro_count"))

"""Readers of the raw inputs.  All are lazy; nothing is sampled to guess types."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions.jsonfix import first_name, lenient_double
from larder.sources.files import Matrix
from larder.sources.tensors import TensorFile

SR_OFFSET = 1_000_000  # legacy food numbers are moved by this, so they cannot meet others


def csv_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV file with a header, all columns as strings."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False, escape='"')


def substitution_pairs(spark: SparkSession, path: str, food: str = "Food id", substitute: str = "Substitution id") -> DataFrame:
    """Pairs of food URIs (food, substitute) from a file separated by semicolons; rows without both are left out."""
    return csv_table(spark, path, ";").select(F.col(f"`{food}`").alias("food"), F.col(f"`{substitute}`").alias("substitute")).dropna()


def patients(spark: SparkSession, path: str) -> DataFrame:
    """Patients: id, illness, allergies, restrictions, severity, age, gender, body mass index and energy eaten a day (0 if unknown)."""
    rows = csv_table(spark, path)
    number = lambda c: F.col(c).try_cast("double")
    return rows.select(
        F.col("Patient_ID").alias("patient"), F.col("Disease_Type").alias("disease"), F.col("Allergies").alias("allergies"), F.col("Dietary_Restrictions").alias("restrictions"), F.col("Severity").alias("severity"),
        F.col("Gender").alias("gender"), number("Age").alias("age"), number("BMI").alias("bmi"), F.coalesce(number("Daily_Caloric_Intake"), F.lit(0.0)).alias("energy_kcal"),
    )


def csv_catalog(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every CSV file below a folder as a frame of strings, by file name without its ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select("path")
    paths = sorted(r["path"] for r in files.collect())  # names only; a catalogue of files is small
    if not paths:
        raise FileNotFoundError(f"no CSV files below {root}")
    return {p.rsplit("/", 1)[1].rsplit(".", 1)[0]: csv_table(spark, p) for p in paths}


def column_sets(tables: dict[str, DataFrame]) -> dict[str, set[str]]:
    return {name: {c.lower() for c in df.columns} for name, df in tables.items()}


def sr_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A caret-separated, tilde-quoted Latin-1 file without header; columns by place."""
    rows = spark.read.csv(path, sep="^", quote="~", encoding="ISO-8859-1", header=False, inferSchema=False)
    return rows.select(*(F.col(f"_c{i}").alias(n) if f"_c{i}" in rows.columns else F.lit(None).cast("string").alias(n) for i, n in enumerate(names)))


def sr_legacy(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Foods, nutrients and amounts of the legacy release; amounts that are no numbers are left out."""
    food = sr_table(spark, f"{folder}/FOOD_DES.txt", ["ndb", "group", "description"])
    data = sr_table(spark, f"{folder}/NUT_DATA.txt", ["ndb", "nutrient", "amount"])
    names = sr_table(spark, f"{folder}/NUTR_DEF.txt", ["nutrient", "unit", "tag", "name"])
    return {
        "food": food.select((F.col("ndb").try_cast("long") + SR_OFFSET).alias("fdc_id"), "description").where("fdc_id IS NOT NULL"),
        "edges": data.select(
            (F.col("ndb").try_cast("long") + SR_OFFSET).alias("fdc_id"), F.col("nutrient").try_cast("long").alias("nutrient_id"),
            F.col("amount").try_cast("double").alias("amount")
        ).where("fdc_id IS NOT NULL AND nutrient_id IS NOT NULL AND amount IS NOT NULL"),
        "nutrients": names.select(
            F.col("nutrient").try_cast("long").alias("nutrient_id"), F.trim("name").alias("nutrient_name"), F.trim("unit").alias("unit_name")
        ).where("nutrient_id IS NOT NULL"),
    }


_DISH = "struct<name:string,neighbors:string>"


def recipe_graph(lines: DataFrame) -> dict[str, DataFrame]:
    """Tables of a recipe graph from JSON lines (column `value`): tags that hold dishes that hold ingredients.

    Keys are data, so each level is a map.  Of a recipe under several tags the first in the file gives the values.
    """
    at = F.struct(F.monotonically_increasing_id().alias("line"), F.lit(0).alias("pos"))
    tags = lines.where(F.trim("value") != "").select(
        at.alias("at"),
        F.explode(
            F.from_json("value", "map<string,struct<name:string,neighbors:struct<tagged_dishes:array<map<string,struct<name:string,neighbors:string>>>>>>")
        ).alias("tag_uri", "tag")
    )
    dishes = tags.select(
        "at", "tag_uri", F.posexplode("tag.neighbors.tagged_dishes").alias("dish_pos", "dish")
    ).select("at", "tag_uri", "dish_pos", F.explode("dish").alias("recipe_uri", "recipe"))
    one = Window.partitionBy("recipe_uri").orderBy("at", "dish_pos", "tag_uri")
    body = F.from_json(F.col("recipe.neighbors"), "map<string,string>")
    amount = lambda k: lenient_double(F.try_element_at(body, F.lit(k)))
    first = dishes.withColumn("n", F.row_number().over(one)).where("n = 1")
    recipes = first.select(
        "recipe_uri", first_name(F.col("recipe.name")).alias("recipe_name"), amount("calories").alias("calories"), amount("protein").alias("protein"), amount("carbohydrates").alias("carbohydrates"),
        amount("saturated fat").alias("saturated_fat"), amount("monounsaturated fat").alias("monounsaturated_fat"), amount("polyunsaturated fat").alias("polyunsaturated_fat"),
    )
    parts = F.from_json(F.try_element_at(body, F.lit("contains_ingredients")), "array<map<string,struct<name:string>>>")
    ingredients = first.select("recipe_uri", F.posexplode(parts).alias("pos", "part")).select("recipe_uri", "pos", F.explode("part").alias("ingredient_uri", "x")).select(
        "recipe_uri", "pos", first_name(F.col("x.name")).alias("ingredient_name")
    )
    uses = ingredients.groupBy("recipe_uri", "ingredient_name").agg(F.min("pos").alias("pos"))
    return {
        "tags": tags.groupBy("tag_uri").agg(F.min_by(first_name(F.col("tag.name")), "at").alias("tag_name")),
        "recipes": recipes, "recipe_tags": dishes.select("recipe_uri", "tag_uri").distinct(), "recipe_ingredients": uses,
    }


EXAMPLE = "qId string, qText string, qOriginText string, topicKey array<string>, entities array<array<string>>, persona struct<ingredient_likes:array<string>,ingredient_dislikes:array<string>,constrained_entities:map<string,array<string>>>, explicit_nutrition array<struct<nutrition:string,level:string,range:array<double>>>, guideline map<string,struct<meal:struct<lower:double,upper:double>,unit:string>>, answers array<string>, origin_answers array<string>"


def examples(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark questions as flat constraints; avoided ingredients are entities of kind 2, else the persona's dislikes."""
    e = spark.read.schema(EXAMPLE).json(path)
    none = F.array().cast("array<string>")
    return e.select(
        F.col("qId").alias("qid"), F.coalesce("qText", F.lit("")).alias("question"), F.get(F.coalesce("topicKey", none), F.lit(0)).alias("tag"),
        F.coalesce(F.try_element_at(F.col("persona.constrained_entities"), F.lit("1")), F.col("persona.ingredient_likes"), none).alias("positive"),
        F.coalesce(F.try_element_at(F.col("persona.constrained_entities"), F.lit("2")), F.col("persona.ingredient_dislikes"), none).alias("negative"),
        F.filter(
            F.coalesce("explicit_nutrition", F.array().cast("array<struct<nutrition:string,level:string,range:array<double>>>")),
            lambda x: F.size(x["range"]) == 2
        ).alias("ranges"),
        F.coalesce("answers", none).alias("answers"),
    )


def eval_samples(spark: SparkSession, path: str) -> DataFrame:
    """Logged samples: doc_id, prompt (the user's message inside a JSON string), reply, acc, mae."""
    s = spark.read.schema("doc_id long, doc map<string,string>, arguments array<array<array<string>>>, filtered_resps array<string>, acc boolean, mae double").json(path)
    chat = F.from_json(F.get(F.get(F.get("arguments", F.lit(0)), F.lit(0)), F.lit(0)), "array<struct<role:string,content:string>>")
    user = F.get(F.filter(chat, lambda m: m["role"] == "user"), F.lit(0))["content"]
    reply = F.get("filtered_resps", F.lit(0))
    return s.select(
        "doc_id", F.try_element_at("doc", F.lit("meal_description")).alias("meal"), F.coalesce(user, F.lit("")).alias("prompt"),
        first_name(reply).alias("reply"), "acc", "mae"
    )


METRICS = [
    "task_success", "task_progress", "reward", "num_steps", "planner_steps", "planner_output_error", "num_invalid_actions",
    "num_invalid_action_ratio", "empty_plan", "episode_elapsed_seconds"
]


def _episode_files(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "episode_*_final_res.json").text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return raw.withColumns({"subset": F.regexp_extract("path", r"([^/]+)/(?:results/)?episode_[^/]*$", 1), "file": F.regexp_extract("path", r"([^/]+)$", 1)})


def unreadable_episodes(spark: SparkSession, root: str) -> DataFrame:
    """The episode files that `episodes` leaves out, so that they can be reported: subset, file."""
    return _episode_files(spark, root).where(F.try_parse_json("value").isNull()).select("subset", "file")


def episodes(spark: SparkSession, root: str) -> DataFrame:
    """One row per readable episode file below root/<subset>/; files that are no JSON objects are left out."""
    raw = _episode_files(spark, root)
    v = F.try_parse_json("value")
    rows = raw.where(v.isNotNull()).select(
        "subset", "file", *(F.try_variant_get(v, f"$.{m}", "double").alias(m) for m in METRICS),
        F.try_variant_get(v, "$.instruction", "string").alias("instruction")
    )
    return rows


def latest_file(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """The path that sorts last among the files that match."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).agg(F.max("path").alias("path"))


def object_map(text: Column) -> Column:
    """Objects of a JSON map name -> {px, py}; empty on any failure."""
    kind = "map<string,struct<px:double,py:double,label:string,conf:double>>"
    return F.map_entries(F.coalesce(F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, kind)), F.create_map().cast(kind)))


def tool_log(lines: DataFrame) -> DataFrame:
    """Log lines `n. Tool(args)` to step, tool and args."""
    shape = r"^\s*(\d+)\.\s*(\w+)\((.*)\)\s*$"
    return lines.where(F.col("value").rlike(shape)).select(
        F.regexp_extract("value", shape, 1).cast("int").alias("step"), F.regexp_extract("value", shape, 2).alias("tool"),
        F.regexp_extract("value", shape, 3).alias("args")
    )


def settings(spark: SparkSession, text: str, schema: str, level: str | None = None) -> DataFrame:
    """A small YAML or JSON list or map of records (with the key as `name`), those of one `level` if given; YAML where the parser is installed."""
    try:
        data = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("this text is no JSON, and no YAML parser is installed") from e
        data = yaml.safe_load(text)
    rows = [{"name": k} | v for k, v in data.items()] if isinstance(data, dict) else data
    rows = [r for r in rows if level is None or r.get("level") == level]
    lines = spark.createDataFrame([(json.dumps(r, default=str),) for r in rows], "value string")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def hosted_samples(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A copy of a hosted question set: doc_id, meal_description, carb, protein, fat and energy (numbers, null if they are none)."""
    rows = spark.read.format(kind).load(path)
    have = {c.lower(): c for c in rows.columns}
    number = lambda c: (F.col(f"`{have[c]}`").try_cast("double") if c in have else F.lit(None).cast("double")).alias(c)
    key = F.col(f"`{have['doc_id']}`").cast("long") if "doc_id" in have else F.xxhash64(f"`{have['meal_description']}`")
    return rows.select(key.alias("doc_id"), F.col(f"`{have['meal_description']}`").alias("meal_description"), *map(number, ("carb", "protein", "fat", "energy")))


def _matrix(path: str, key: str | None = None) -> Matrix | TensorFile:
    return TensorFile(path, key) if path.endswith((".pt", ".pth")) else Matrix(path)


def vector_file(spark: SparkSession, path: str, ids: str | None = None, rows: int = 4096, key: str | None = None) -> DataFrame:
    """A .npy or .pt matrix as id and vec, by row number or by the ids of a second file.  Tasks read their own rows, from any file system.

    `key` names the matrix in a .pt file of several.
    """
    import numpy as np
    import pyarrow as pa

    x = _matrix(path, key)
    n = len(x)
    x.close()

    def run(batches):
        x, keys = _matrix(path, key), _matrix(ids) if ids else None
        for b in batches:
            for start in b.column(0).to_pylist():
                stop = min(start + rows, n)
                own = keys.rows(start, stop) if keys else np.arange(start, stop)
                part = x.rows(start, stop).astype(np.float32)
                cuts = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.ListArray.from_arrays(cuts, pa.array(part.ravel()))], names=["id", "vec"])

    return spark.range(0, n, rows).mapInArrow(run, "id long, vec array<float>")

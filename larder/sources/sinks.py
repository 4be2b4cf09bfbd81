"""Writers.  Each writes in parallel; only those named `single` make one file, for small results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def export_nested(foods: DataFrame, edges: DataFrame, nutrients: DataFrame) -> DataFrame:
    """A JSON text per food: nutrients as a map from name to amount (4 places) and unit; an empty map if there are none."""
    rows = edges.join(nutrients, "nutrient_id").select("fdc_id", "nutrient_name", F.struct(F.round("amount", 4).alias("amount"), F.col("unit_name").alias("unit")).alias("v"))
    one = rows.groupBy("fdc_id", "nutrient_name").agg(F.min("v").alias("v"))
    packed = one.groupBy("fdc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("nutrient_name", "v")))).alias("nutrients"))
    empty = F.create_map().cast("map<string,struct<amount:double,unit:string>>")
    out = foods.join(packed, "fdc_id", "left").select("fdc_id", "description", F.coalesce("nutrients", empty).alias("nutrients"))
    return out.select("fdc_id", F.to_json(F.struct("fdc_id", "description", "nutrients"), {"ignoreNullFields": "false"}).alias("json"))


def write_json_lines(exported: DataFrame, path: str) -> None:
    exported.orderBy("fdc_id").select("json").write.mode("overwrite").text(path)


def write_single_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, sep=sep)


def write_summary(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    df.select(*(columns or df.columns)).write.mode("overwrite").json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    df.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").parquet(path)


def log_offers(offers: DataFrame, chosen: DataFrame, path: str) -> None:
    """Appends a row per offered food; `chosen` says whether it was taken."""
    taken = chosen.select("user_id", "food_fdc_id").distinct().withColumn("taken", F.lit(True))
    rows = offers.join(taken, ["user_id", "food_fdc_id"], "left").select(
        F.expr("uuid()").alias("id"), F.current_timestamp().alias("timestamp"), "user_id", "meal_type", "food_fdc_id", "food_desc",
        F.lit(True).alias("offered"), F.coalesce("taken", F.lit(False)).alias("chosen")
    )
    rows.write.mode("append").parquet(path)


def merge_objects(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Objects by name after changes (op: put, forget or clear; by seq): the last one counts."""
    cleared = changes.where("op = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("cleared"))
    old = stored.select("name", "px", "py", "label", F.lit("put").alias("op"), F.lit(-1).cast("long").alias("seq"))
    new = changes.where("op <> 'clear'").select("name", "px", "py", "label", "op", F.col("seq").cast("long").alias("seq"))
    last = old.unionByName(new).crossJoin(F.broadcast(cleared)).where("seq > cleared OR (cleared = -1 AND seq = -1)").groupBy("name").agg(
        F.max_by(F.struct("px", "py", "label", "op"), "seq").alias("x")
    )
    return last.where("x.op = 'put'").select("name", "x.px", "x.py", "x.label")


def fixed_width(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Lines of a report: each column padded to its width."""
    return df.select(F.concat_ws(" ", *(F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), w, " ") for c, w in widths.items())).alias("line"))


def latex_rows(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.concat_ws(" & ", *(F.coalesce(F.col(c).cast("string"), F.lit("--")) for c in df.columns)), F.lit(" \\\\")).alias("line"))

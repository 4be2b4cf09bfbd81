import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.functions import scores
from larder.functions.jsonfix import json_objects
from larder.operators import evaluate, graph, kb, models, recommend, retrieval, spatial
from larder.sources import readers, remote, sinks
from larder.streaming import stateful, windows


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def frame(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_build_kb(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/food.csv").write_text("fdc_id,data_type,description,publication_date\n1,a,Milk,x\n2,a,Milk,x\n3,a,Vitamin C sample,x\n4,a,Rice,x\n5,a,,x\n")
    (tmp_path / "d/nutrient.csv").write_text("id,name,unit_name\n10, Protein ,G\n11,Total lipid (fat),G\n,none,G\n")
    (tmp_path / "d/measure_unit.csv").write_text("id,name\n1,cup\n")
    (tmp_path / "d/food_nutrient.csv").write_text("id,fdc_id,nutrient_id,amount\n1,1,10,3\n2,2,10,5\n3,2,11,x\n4,3,10,1\n5,5,10,2\n")
    tables = readers.csv_catalog(spark, str(tmp_path))
    assert readers.column_sets(tables)["measure_unit"] == {"id", "name"}
    (tmp_path / "FOOD_DES.txt").write_bytes("~01~^~1~^~Caf\xe9~\n".encode("latin-1"))
    (tmp_path / "NUT_DATA.txt").write_text("~01~^~10~^4.5\n~01~^~11~^\n")
    (tmp_path / "NUTR_DEF.txt").write_text("~10~^~g~^~P~^~Protein~\n~99~^~g~^~Z~^~Zinc~\n")
    out = kb.build_kb(tables, readers.sr_legacy(spark, str(tmp_path)))
    assert rows(out["nodes_food"].select("fdc_id", "description"), "fdc_id") == [(2, "Milk"), (5, None), (1000001, "Café")]
    assert rows(out["edges_food_contains_nutrient"], "fdc_id", "nutrient_id") == [(2, 10, 4.0), (2, 11, None), (1000001, 10, 4.5)]
    assert rows(out["nodes_nutrient"].select("nutrient_id"), "nutrient_id") == [(10,), (11,), (99,)]
    with pytest.raises(FileNotFoundError):
        (tmp_path / "no").mkdir()
        readers.csv_catalog(spark, str(tmp_path / "no"))


def test_recipe_graph(spark):
    dish = lambda name, cal, ings: {"name": [name], "neighbors": {"calories": cal, "contains_ingredients": [{f"i/{i}": {"name": [i]}} for i in ings]}}
    lines = [json.dumps({"t/1": {"name": ["lunch"], "neighbors": {"tagged_dishes": [{"r/1": dish("A", ["10"], ["egg", "egg", "oil"])}, {"r/2": {"name": ["B"]}}]}}}), "", json.dumps({"t/2": {"name": ["dinner"], "neighbors": {"tagged_dishes": [{"r/1": dish("other", 99, ["x"])}]}}})]
    out = readers.recipe_graph(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1))
    assert rows(out["recipes"].select("recipe_uri", "recipe_name", "calories"), "recipe_uri") == [("r/1", "A", 10.0), ("r/2", "B", None)]
    assert rows(out["recipe_ingredients"].select("ingredient_name"), "pos") == [("egg",), ("oil",)]
    assert out["recipe_tags"].count() == 3 and rows(out["tags"], "tag_uri") == [("t/1", "lunch"), ("t/2", "dinner")]


def test_examples_and_samples(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"qId": "1", "topicKey": ["t"], "persona": {"ingredient_dislikes": ["egg"], "constrained_entities": {"2": ["nut"]}}, "explicit_nutrition": [{"nutrition": "fat", "range": [1, 2]}, {"nutrition": "fat", "range": [1]}]}) + "\n" + json.dumps({"qId": "2", "persona": {"ingredient_dislikes": ["egg"]}}) + "\n")
    got = readers.examples(spark, str(tmp_path / "q.json")).orderBy("qid").collect()
    assert got[0]["negative"] == ["nut"] and len(got[0]["ranges"]) == 1 and got[1]["negative"] == ["egg"] and got[1]["answers"] == []
    chat = json.dumps([{"role": "system", "content": "s"}, {"role": "user", "content": "hi"}])
    (tmp_path / "s.jsonl").write_text(json.dumps({"doc_id": 3, "doc": {"meal_description": "m"}, "arguments": [[[chat]]], "filtered_resps": ["5"], "acc": True, "mae": 1.0}))
    assert rows(readers.eval_samples(spark, str(tmp_path / "s.jsonl")))[0][:4] == (3, "m", "hi", "5")


def test_episodes_and_files(spark, tmp_path):
    d = tmp_path / "base" / "results"
    d.mkdir(parents=True)
    (d / "episode_1_final_res.json").write_text('{"task_success": 1, "reward": 0.5}')
    (d / "episode_2_final_res.json").write_text("broken")
    assert rows(readers.episodes(spark, str(tmp_path)).select("subset", "file", "task_success")) == [("base", "episode_1_final_res.json", 1.0)]
    assert readers.latest_file(spark, str(tmp_path), "*.json").first()[0].endswith("episode_2_final_res.json")
    assert rows(readers.unreadable_episodes(spark, str(tmp_path))) == [("base", "episode_2_final_res.json")]
    np.save(tmp_path / "many.npy", np.arange(30_000, dtype=np.float64).reshape(10_000, 3))
    np.save(tmp_path / "ids.npy", np.arange(10_000, dtype=np.int32) * 7)
    many = readers.vector_file(spark, f"file://{tmp_path}/many.npy", str(tmp_path / "ids.npy"), rows=300)
    assert many.count() == 10_000 and all(r["vec"][0] * 7 == 3 * r["id"] for r in many.collect())
    np.save(tmp_path / "odd.npy", np.array(["a", {}], dtype=object))
    with pytest.raises(ValueError):
        readers.vector_file(spark, str(tmp_path / "odd.npy"))
    tasks = '[{"id": "a", "level": "easy"}, {"id": "b", "level": "hard"}]'
    assert rows(readers.settings(spark, tasks, "id string, level string", level="hard")) == [("b", "hard")]
    np.save(tmp_path / "v.npy", np.eye(3, dtype=np.float32))
    assert rows(readers.vector_file(spark, str(tmp_path / "v.npy")), "id")[2] == (2, [0.0, 0.0, 1.0])
    assert rows(readers.settings(spark, '{"Door": {"x": 1, "y": 2}}', "name string, x double, y double")) == [("Door", 1.0, 2.0)]
    log = readers.tool_log(frame(spark, "value string", ("1. Go(kitchen)",), ("noise",)))
    assert rows(log) == [(1, "Go", "kitchen")]


def test_small_files(spark, tmp_path):
    (tmp_path / "subs.csv").write_text("Food id;Substitution id;x\nu#1;u#2;a,b\nu#3;;\n")
    assert rows(readers.substitution_pairs(spark, str(tmp_path / "subs.csv"))) == [("u#1", "u#2")]
    (tmp_path / "patients.csv").write_text("Patient_ID,Age,Gender,Disease_Type,Severity,BMI,Daily_Caloric_Intake,Dietary_Restrictions,Allergies\nP1,50,Male,Diabetes,Mild,x,2000,Low_Sugar,Peanuts\nP2,,,,,,,,\n")
    got = rows(readers.patients(spark, str(tmp_path / "patients.csv")).select("patient", "disease", "allergies", "restrictions", "bmi", "energy_kcal"), "patient")
    assert got == [("P1", "Diabetes", "Peanuts", "Low_Sugar", None, 2000.0), ("P2", None, None, None, None, 0.0)]
    (tmp_path / "h.json").write_text('{"meal_description": "egg", "carb": "1.5", "Protein": 3, "doc_id": 4}\n')
    assert rows(readers.hosted_samples(spark, str(tmp_path / "h.json"), "json")) == [(4, "egg", 1.5, 3.0, None, None)]


def test_first_seen_pairs_and_objects(spark):
    uses = frame(spark, "recipe_id long, ingredient_name string, pos int", (1, "rice", 0), (1, "egg", 1), (1, "rice", 2))
    assert rows(recommend.recipe_context(frame(spark, "recipe_id long", (1,), (2,)), uses, place="pos"), "recipe_id") == [(1, ["rice", "egg"]), (2, [])]
    a, b = frame(spark, "k long, v double", (5, 1.0), (3, 2.0)), frame(spark, "k long, v double", (9, 3.0), (8, 4.0))
    assert rows(evaluate.paired(a, b, "k").select("k", "k_b"), "k") == [(3, 8), (5, 9)]
    assert evaluate.paired(a, b.limit(1), "k").count() == 0
    texts = frame(spark, "x string", ('```json\n[{"a": 1}, {"a": 2}]\n```',), ('note\n{"a": 3},\n{bad}\n {"a": 4}',), ("none",), (None,))
    got = [r[0] and [x["a"] for x in r[0]] for r in texts.select(json_objects(F.col("x"), "struct<a:bigint>")).collect()]
    assert got[:3] == [[1, 2], [3, 4], []] and not got[3]


def test_watchdog_timer(spark, tmp_path):
    """A drive that falls silent fails by the clock."""
    import time

    src = tmp_path / "t"
    frame(spark, "goal_id string, t double, distance double", ("a", 0.0, 3.0), ("b", 0.0, 0.1)).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("goal_id string, t double, distance double").parquet(str(src))
    q = stateful.watchdog(stream, patience_s=1.0, timer=True).writeStream.format("memory").queryName("silence").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    end = time.time() + 60
    while time.time() < end and spark.table("silence").count() < 2:
        time.sleep(0.5)
    q.stop()
    assert dict(rows(spark.table("silence").select("goal_id", "state"))) == {"a": "failed", "b": "success"}


def test_remote(spark, tmp_path):
    remote.register(spark)
    (tmp_path / "o.json").write_text('{"cup": {"px": 1, "py": "x"}, "bad": 3}')
    load = lambda p: rows(spark.read.format("larder_objects").option("address", f"file:{p}").load())
    assert load(tmp_path / "o.json") == [("cup", 1.0, None, "cup")] and load(tmp_path / "none.json") == []
    (tmp_path / "f.jsonl").write_text('{"topic": "c", "frame_seq": 1, "ts": 0.5}\nbad\n{"topic": "c", "frame_seq": 2, "ts": 1.5}\n')
    s = spark.readStream.format("larder_frames").option("path", str(tmp_path / "f.jsonl")).load()
    q = s.writeStream.format("memory").queryName("frames_t").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("frames_t").select("frame_seq"), "frame_seq") == [(1,), (2,)]


def test_sinks(spark, tmp_path):
    stored = frame(spark, "name string, px double, py double, label string", ("a", 1.0, 1.0, "a"), ("b", 2.0, 2.0, "b"))
    changes = frame(spark, "name string, px double, py double, label string, op string, seq long", ("a", None, None, None, "forget", 1), ("c", 3.0, 3.0, "c", "put", 2))
    assert [r[0] for r in rows(sinks.merge_objects(stored, changes), "name")] == ["b", "c"]
    wiped = changes.unionByName(frame(spark, changes.schema, ("x", None, None, None, "clear", 3)))
    assert rows(sinks.merge_objects(stored, wiped)) == []
    offers = frame(spark, "user_id string, meal_type string, food_fdc_id long, food_desc string", ("u", "lunch", 1, "x"), ("u", "lunch", 2, "y"))
    sinks.log_offers(offers, frame(spark, "user_id string, food_fdc_id long", ("u", 2)), str(tmp_path / "log"))
    assert rows(spark.read.parquet(str(tmp_path / "log")).select("food_fdc_id", "chosen"), "food_fdc_id") == [(1, False), (2, True)]
    sinks.write_single_csv(offers, str(tmp_path / "csv"), ";")
    assert len(list((tmp_path / "csv").glob("*.csv"))) == 1
    assert rows(sinks.fixed_width(offers, {"user_id": 3, "food_desc": 2}))[0] == ("u   x ",)


def test_vector_topk_ties_and_modes(spark):
    items = frame(spark, "id long, vec array<double>, text_vec array<double>, graph_vec array<double>, description string", (1, [1.0, 0.0], [1.0, 0.0], [0.0, 1.0], "a"), (2, [1.0, 0.0], [1.0, 1.0], None, "b"), (3, [0.0, 0.0], None, [1.0, 0.0], "c"), (4, None, [0.0, 1.0], [1.0, 1.0], "d"))
    q = frame(spark, "qid long, v array<double>", (9, [2.0, 0.0]))
    assert [r[1:] for r in rows(retrieval.vector_topk(items, q, 2, query_vec="v").select("qid", "id", "score"), "id")] == [(1, 1.0), (2, 1.0)]
    assert rows(retrieval.vector_topk(items, frame(spark, "qid long, v array<double>", (1, [1.0, 0.0])), 5, query_vec="v", include_self=False).select("id"), "rank") == [(2,), (3,)]
    empty = spark.createDataFrame([], "qid long, v array<double>")
    assert retrieval.vector_topk(items, empty, 3, query_vec="v").count() == 0
    qs = frame(spark, "qid long, q_text array<double>, q_graph array<double>", (1, [1.0, 0.0], [0.0, 1.0]), (2, None, [1.0, 0.0]), (3, [0.0, 1.0], None))
    want = {}
    unit = lambda v: None if v is None else np.array(v) / np.linalg.norm(v)
    for qid, qt, qg in ((1, [1, 0], [0, 1]), (2, None, [1, 0]), (3, [0, 1], None)):
        s = []
        for i, tv, gv in ((1, [1, 0], [0, 1]), (2, [1, 1], None), (3, None, [1, 0]), (4, [0, 1], [1, 1])):
            a = None if qt is None or tv is None else unit(qt) @ unit(tv)
            b = None if qg is None or gv is None else unit(qg) @ unit(gv)
            total = a if b is None else b if a is None else 0.3 * b + 0.7 * a
            if total is not None:
                s.append((-round(float(total), 12), i))
        want[qid] = [i for _, i in sorted(s)]
    got = retrieval.hybrid_rank(items, qs, 0.3, 10).orderBy("qid", "rank").collect()
    assert {k: [r["id"] for r in got if r["qid"] == k] for k in want} == want
    for alpha, col in ((0.0, "text_vec"), (1.0, "graph_vec")):
        full = items.where("text_vec IS NOT NULL AND graph_vec IS NOT NULL")
        pure = retrieval.vector_topk(full, qs.where("qid = 1"), 5, item_vec=col, query_vec="q_text" if alpha == 0 else "q_graph")
        mixed = retrieval.hybrid_rank(full, qs.where("qid = 1"), alpha, 5)
        assert rows(pure.select("id"), "rank") == rows(mixed.select("id"), "rank")
    with pytest.raises(ValueError):
        retrieval.search(items, qs, "other")


def test_relaxation(spark):
    """Two safe rows without overlap both come, in range or not; where every row has something disliked, all come."""
    data = frame(spark, "qid string, recipe_id long, tier int", ("a", 1, 1), ("a", 2, 3), ("a", 3, 4), ("b", 4, 4), ("b", 5, 4), ("c", 6, 3), ("c", 7, 3), ("c", 8, 4))
    assert rows(recommend.relax(data).select("qid", "recipe_id"), "qid", "recipe_id") == [("a", 1), ("b", 4), ("b", 5), ("c", 6), ("c", 7)]
    t = lambda safe, macros, overlap, least: recommend.relaxation_tier(F.lit(safe), F.lit(macros), F.lit(overlap), least)
    cases = [((True, True, 2, 2), 0), ((True, False, 2, 2), 1), ((True, True, 1, 2), 2), ((True, True, 0, 2), 3), ((True, False, 0, 2), 3), ((False, True, 2, 2), 4), ((True, False, 0, 0), 1), ((True, True, 0, 1), 3)]
    assert tuple(spark.range(1).select(*(t(*x) for x, _ in cases)).first()) == tuple(n for _, n in cases)


def test_macro_window(spark):
    values = frame(spark, "v double, t double", (None, 10.0), (None, 0.0), (float("nan"), 10.0), (5.0, 10.0), (4.9, 10.0), (15.0, 10.0), (15.1, 10.0), (3.0, None))
    got = [r[0] for r in values.select(scores.within(F.col("v"), F.col("t"), 0.5)).collect()]
    assert got == [False, True, True, True, False, True, False, True]


def test_soft_penalty_counts_every_violation(spark):
    """Three wanted ingredients are missing, two unwanted ones are there and one of two ranges does not hold."""
    questions = spark.createDataFrame([("q", ["A", "b", "c", "Egg"], ["salt", "OIL", "tea"], [("fat", [1.0, 2.0]), ("protein", [0.0, 5.0]), ("zinc", [1.0, 2.0]), ("fat", [1.0])])], "qid string, positive array<string>, negative array<string>, ranges array<struct<nutrition:string,range:array<double>>>")
    recipes = frame(spark, "recipe_id long, ingredients array<string>, calories double, protein double, carbohydrates double, saturated_fat double, monounsaturated_fat double, polyunsaturated_fat double", (1, ["egg", "Salt", "oil"], 1.0, 3.0, None, 2.0, None, 1.0), (2, ["a", "b", "c", "egg"], 1.0, 3.0, None, 2.0, None, None))
    pool = frame(spark, "qid string, recipe_id long", ("q", 1), ("q", 2))
    assert rows(recommend.retrieve_recipes(questions, recipes, pool, hard=False).select("recipe_id", "penalty"), "recipe_id") == [(1, 3.0), (2, 0.0)]
    assert rows(recommend.retrieve_recipes(questions, recipes, pool).select("recipe_id")) == [(2,)]


def test_patients(spark):
    """Sugar is to be avoided, but only allergens make a meal unsafe; without a target any amount is right."""
    patients = frame(spark, "patient long, disease string, allergies string, restrictions string, carb_target double", (1, "Diabetes", "None", "Low_Sugar", 40.0), (2, "Other", "Gluten", "None", 40.0), (3, "None", "Peanuts", "Low_Sodium", None), (4, "Obesity", "None", "None", 40.0))
    meals = frame(spark, "patient long, meal string, ingredients array<string>, carb double", (1, "m", ["Brown Sugar"], 20.0), (2, "m", ["rye bread"], 40.0), (3, "m", ["sea salt"], 999.0), (4, "m", ["rice"], None))
    got = recommend.patient_meals(patients, meals)
    assert rows(got.select("patient", "diet", "safe", "adheres"), "patient") == [(1, "Low-Carb", True, True), (2, "Balanced", False, False), (3, "Balanced", True, True), (4, "Balanced", True, False)]
    assert got.where("patient = 3").first()["avoided"] == ["peanut", "peanuts", "salt", "soy sauce", "bacon", "sausage", "bouillon"]
    options = frame(spark, "qid long, name string, rank int", (1, "Carrot Cake", 1), (1, "Soup", 2), (2, "Sorbet", 1), (2, "Candy", 2))
    assert rows(recommend.without_desserts(options).select("qid", "name"), "qid") == [(1, "Soup"), (2, "Sorbet")]


def test_recommend_meals_by_hand(spark):
    """Of one request's two recipes the one with more overlap wins; a request with an unknown tag sees all of them."""
    recipes = frame(
        spark, "recipe_id long, ingredients array<string>, ingredient_ids array<long>, text_vec array<double>, graph_vec array<double>, calories double, protein double, carbohydrates double, fat_total double",
        (1, ["rice"], [1, 2], [1.0, 0.0], [1.0, 0.0], 500.0, 20.0, 50.0, 10.0), (2, ["egg"], [3], [1.0, 0.0], [0.0, 1.0], 500.0, 20.0, 50.0, 10.0), (3, ["nut"], [1, 2], [0.0, 1.0], [0.0, 1.0], None, None, None, None),
    )
    requests = frame(
        spark, "qid string, q_text array<double>, q_graph array<double>, wanted array<long>, available array<long>, terms array<string>, protein_g double, carb_g double, fat_g double, energy_kcal double",
        ("a", [1.0, 0.0], [0.0, 1.0], [1, 2], [1], [], 20.0, 50.0, 10.0, 500.0), ("b", [0.0, 1.0], None, [9], None, ["nut"], 0.0, 0.0, 0.0, 0.0), ("c", [0.0, 1.0], None, [9], None, ["rice", "nut", "egg"], 0.0, 0.0, 0.0, 0.0),
    )
    got = recommend.recommend_meals(requests, recipes, frame(spark, "qid string, recipe_id long", ("a", 1), ("a", 2)), weight=1.0)
    have = {}
    for r in got.collect():
        have.setdefault(r["qid"], {})[r["recipe_id"]] = (r["tier"], r["final"], r["rank"])
    assert have["a"] == {1: (0, pytest.approx(0.5 + 0.5 - 0.3 + 1.0), 1)}
    assert set(have["b"]) == {1, 2} and have["b"][1][0] == 3 and set(have["c"]) == {1, 2, 3} and have["c"][3][0] == 4


def test_ranking_of_empty_sides(spark):
    """Nothing to find and nothing found is right; nothing to find but something found is wrong."""
    ranked = frame(spark, "qid long, item long, rank int", (1, 5, 1), (1, 6, 2), (3, 5, 1))
    truth = frame(spark, "qid long, item long", (1, 6), (2, 7))
    got = evaluate.ranking_metrics(ranked, truth, frame(spark, "qid long", (1,), (2,), (3,), (4,)))
    assert rows(got.select("qid", "ap", "ar"), "qid") == [(1, 0.5, 1.0), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, 1.0, 1.0)]


def test_writers(spark, tmp_path):
    foods = frame(spark, "fdc_id long, description string", (2, "b"), (1, "a"))
    sinks.write_tables({"foods": foods}, str(tmp_path / "t"))
    sinks.write_tables({"foods": foods.where("fdc_id = 1")}, str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "t/foods"))) == [(1, "a")]
    sinks.write_summary(foods, str(tmp_path / "s"), ["description"])
    assert rows(spark.read.json(str(tmp_path / "s")), "description") == [("a",), ("b",)]
    vectors = frame(spark, "id int, vec array<double>, more string", (1, [0.5, 1.0], "x"))
    sinks.write_vectors(vectors, str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    assert rows(back) == [(1, [0.5, 1.0])] and back.dtypes == [("id", "bigint"), ("vec", "array<float>")]
    none = frame(spark, "fdc_id long, nutrient_id long, amount double")
    exported = sinks.export_nested(foods, none, frame(spark, "nutrient_id long, nutrient_name string, unit_name string"))
    sinks.write_json_lines(exported, str(tmp_path / "j"))
    lines = [json.loads(r[0]) for r in rows(spark.read.text(str(tmp_path / "j")))]
    assert lines == [{"fdc_id": 1, "description": "a", "nutrients": {}}, {"fdc_id": 2, "description": "b", "nutrients": {}}]
    assert rows(sinks.latex_rows(foods), "line") == [("1 & a \\\\",), ("2 & b \\\\",)]


def test_quality_report_and_geometry(spark):
    links = frame(spark, "recipe_id long, similarity_score double", (1, 0.8), (1, 0.6), (2, 0.1))
    report = kb.quality_report({"links": links}, links, frame(spark, "recipe_id long", (1,), (2,), (3,)))
    assert dict(rows(report)) == {"rows:links": 3.0, "match:high": 1.0, "match:medium": 1.0, "match:low": 1.0, "recipes without foods": 1.0, "ingredients per recipe": 1.5}
    p = spark.range(1).select(scores.back_project(F.lit(420.0), F.lit(140.0), F.lit(2000.0), 500.0, 400.0, 320.0, 240.0).alias("p")).first()["p"]
    assert tuple(p) == (0.4, -0.5, 2.0)
    stored = frame(spark, "name string, label string", ("detected_coffee_cup_0", "coffee cup"), ("detected_coffee_cup_1", "coffee_cup"), ("Door", "door"))
    assert spatial.objects_named(stored, "coffee cup").count() == 2
    assert [rows(spatial.object_named(stored, n).select("name")) for n in ("Door", "coffee cup", "none")] == [[("Door",)], [("detected_coffee_cup_0",)], []]
    z = frame(spark, "x double", (1.5,))
    assert rows(models.destandardise(z, "x", F.lit(10.0), F.lit(2.0))) == [(13.0,)]


def test_attention_encoder_equals_numpy(spark):
    rng = np.random.default_rng(5)
    x = {i: rng.normal(size=3) for i in range(6)}
    edges = [(0, 1, 0.5), (2, 1, 1.5), (3, 4, 0.0), (0, 4, 1.0), (1, 0, 2.0), (4, 0, 0.1)]
    m = lambda *shape: rng.normal(size=shape)

    def block(width, out, heads):
        return {"heads": [{"w_src": m(out, width), "w_dst": m(out, width), "a": m(out), "w_edge": m(out)} for _ in range(heads)], "bias": m(out * heads), "residual": m(out * heads, width), "scale": m(out * heads), "shift": m(out * heads)}

    blocks = [block(3, 2, 4), block(8, 3, 1)]

    def plain(x, b):
        out = {}
        for i in x:
            parts = []
            for h in b["heads"]:
                own = [(s, t) for s, d, t in edges if d == i]
                e = [h["a"] @ (lambda v: np.where(v > 0, v, 0.2 * v))(h["w_src"] @ x[s] + h["w_dst"] @ x[i] + h["w_edge"] * t) for s, t in own]
                w = np.exp(e) / np.exp(e).sum() if own else []
                parts.append(sum((k * (h["w_src"] @ x[s]) for k, (s, _) in zip(w, own, strict=True)), np.zeros(len(h["a"]))))
            v = np.concatenate(parts) + b["bias"]
            v = np.where(v > 0, v, np.exp(np.minimum(v, 0)) - 1) + b["residual"] @ x[i]
            out[i] = (v - v.mean()) / np.sqrt(v.var() + 1e-5) * b["scale"] + b["shift"]
        return out

    lists = [{k: [{a: c.tolist() for a, c in h.items()} for h in v] if k == "heads" else v.tolist() for k, v in b.items()} for b in blocks]
    nodes = frame(spark, "id long, vec array<double>", *[(i, v.tolist()) for i, v in x.items()])
    got = dict(rows(graph.attention_encoder(nodes, frame(spark, "src long, dst long, attr double", *edges), lists)))
    want = plain(plain(x, blocks[0]), blocks[1])
    assert all(got[i] == pytest.approx(want[i].tolist()) for i in x)


def test_many_query_blocks(spark, monkeypatch):
    """Queries of several blocks, passes written one by one, give what one block gives; and ids may be names."""
    rng = np.random.default_rng(6)
    items = frame(spark, "id long, vec array<double>, g string", *[(i, rng.normal(size=4).tolist(), "ab"[i % 2]) for i in range(60)])
    asked = items.select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("qid"), F.col("vec").alias("v"), F.col("g").alias("h"))
    want = sorted(rows(retrieval.vector_topk(items, asked, 3, query_vec="v", unlike=("g", "h"))))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK_BYTES", 500)
    assert sorted(rows(retrieval.vector_topk(items, asked, 3, query_vec="v", unlike=("g", "h")))) == want and len(want) == 180
    assert all((int(q[1:]) + i) % 2 for q, i, *_ in want)


def test_preferences(spark):
    log = frame(spark, "id long, timestamp timestamp, user_id string, food_fdc_id long, food_desc string, offered boolean, chosen boolean", *[(i, None, "u", f, d, o, c) for i, (f, d, o, c) in enumerate([(1, "x", True, True), (1, "", True, False), (2, "y", True, False), (2, "y", True, False), (3, "z", True, True)])])
    assert rows(recommend.preference_summary(log).select("food_fdc_id", "food_desc", "kind"), "food_fdc_id") == [(1, "x", "favourite"), (2, "y", "disliked")]
    foods = frame(spark, "user_id string, food_fdc_id long", ("u", 9))
    assert rows(recommend.preference_scores(log, foods).select("score")) == [(0.5,)]


def test_recommend_foods(spark):
    requests = frame(spark, "qid string, protein_g double, fat_g double, carb_g double", ("q", 5.0, 5.0, 1.0))
    amounts = frame(spark, "fdc_id long, macro string, amount double", (1, "protein", 9.0), (2, "protein", 8.0), (3, "fat", 9.0), (4, "protein", 1.0))
    vecs = frame(spark, "id long, vec array<double>", (1, [1.0, 0.0]), (2, [0.0, 1.0]), (5, [1.0, 0.1]))
    got = recommend.recommend_foods(requests, amounts, vecs, seeds=2, neighbours=1)
    assert rows(got.select("fdc_id", "seed", "rank"), "seed", "rank") == [(1, 1, 0), (5, 1, 1), (2, 2, 0)]
    eaten = frame(spark, "qid string, fdc_id long", ("q", 1))
    assert rows(recommend.recommend_foods(requests, amounts, vecs, seeds=1, neighbours=1, eaten=eaten).select("fdc_id"), "rank") == [(2,), (5,)]


def test_failure_tags(spark):
    refs = "array<struct<food_term:string,matched:boolean,description:string,nutrients:string>>"
    data = frame(spark, f"refs {refs}", ([],), ([("sugar", True, "Sugars, raw", None)],), ([("milk", True, "Rice", None), ("2 eggs", False, None, None)],), ([("a b", True, "a b", None), ("c", False, None, None)],))
    got = [r[0] for r in data.select(evaluate.failure_tags(F.col("refs"), F.lit(1.0), F.lit(1.0))).collect()]
    assert got == [["NO_TERMS_EXTRACTED"], ["WRONG_MATCH:sugar->Sugars, raw"], ["BROKEN_TERM:2 eggs", "WRONG_MATCH:milk->Rice"], ["PARTIAL_COVERAGE:1/2"]]
    tagged = frame(spark, "k long, t array<string>", (1, ["A:x"]), (2, ["A:y", "B"]))
    assert rows(evaluate.tag_counts(tagged, "t", "k")) == [("A", 2, [1, 2]), ("B", 1, [2])]


def test_stats_of_one_and_nan(spark):
    e = frame(spark, "subset string, reward double", ("a", 1.0), ("b", float("nan")), ("b", 3.0))
    got = {(r["subset"]): (r["mean"], r["std"], r["count"]) for r in evaluate.subset_stats(e, ["reward"]).collect()}
    assert got["a"] == (1.0, 0.0, 1) and got["b"] == (3.0, 0.0, 1) and got["OVERALL"][0] == 2.0


def test_attention_and_scores(spark):
    nodes = frame(spark, "id long, vec array<double>", (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]))
    e = frame(spark, "src long, dst long", (1, 3), (2, 3))
    eye = [[1.0, 0.0], [0.0, 1.0]]
    got = dict(rows(graph.attention_layer(nodes, e, eye, eye, [1.0, 0.0])))
    w = np.exp([2.0, 1.0])
    assert got[3] == pytest.approx(list(w / w.sum()))
    pairs = graph.link_scores(frame(spark, "a long, b long", (1, 3)), nodes)
    assert rows(pairs.select("p"))[0][0] == pytest.approx(1 / (1 + np.exp(-1)))
    neg = graph.negative_edges(frame(spark, "a long, b long", (0, 0)), frame(spark, "i long, id long", (0, 0), (1, 1)), frame(spark, "i long, id long", (0, 0)), 5)
    assert rows(neg) == [(1, 0)]
    sub = graph.substitution_edges(frame(spark, "food string, substitute string", ("u#1", "u#2"), ("u#1", "u#9")), frame(spark, "fdc_id long", (1000001,), (1000002,)))
    assert rows(sub) == [(1000001, 1000002)]


def test_models(spark):
    df = frame(spark, "id long, x double", (1, 1.0), (2, 3.0))
    assert rows(models.standardise(df, "x", F.col("id") > 5).select("x_z")) == [(None,), (None,)]

    def broken():
        def chat(p):
            raise RuntimeError

        return chat

    assert rows(models.chat_with(df, "x", "reply", broken).select("reply")) == [(None,), (None,)]
    assert [models._stem(w) for w in ("foods", "running", "berries", "glass", "cooked", "sized")] == ["food", "run", "berri", "glass", "cook", "size"]


def test_stems_of_the_published_vocabulary():
    """Pairs of the sample vocabulary that is published with the Snowball English stemmer, and its exceptions."""
    pairs = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
    consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid
    consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu
    conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc
    constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel
    kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive
    knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
    nutrition nutrit nutritional nutrit quickly quick generate generat generously generous communication communic arsenal arsenal hopping hop hoping hope hoped hope ties tie cries cri gas gas this this
    gaps gap kiwis kiwi skies sky dying die news news only onli herring herring proceed proceed succeeding succeed sayings say youth youth boyish boyish happy happi by by say say relational relat
    conditional condit usefulness use apology apolog feed feed agreed agre luxuriated luxuri roll roll controll control dog's dog""".split()
    wrong = {w: (models._stem(w), s) for w, s in zip(pairs[::2], pairs[1::2], strict=True) if models._stem(w) != s}
    assert not wrong


def test_stemmed_search_finds_derived_forms(spark):
    docs = frame(spark, "id long, text string", (1, "nutritional value of quick oats"), (2, "plain rice"), (3, "boiled beans"))
    found = retrieval.bm25(docs, frame(spark, "qid long, text string", (7, "nutrition"), (8, "quickly")), stem=models.stem_words)
    assert rows(found.select("qid", "id")) == [(7, 1), (8, 1)]


def test_registry_and_names(spark):
    stored = frame(spark, "name string, label string, px double, py double", ("detected_coffee_cup_4", "coffee cup", 0.0, 0.0))
    found = frame(spark, "i long, label string, px double, py double", (1, "coffee_cup", 0.3, 0.3), (2, "coffee cup", 0.5, 0.0), (3, "coffee cup", 0.6, 0.1))
    assert [r[0] for r in rows(spatial.register(found, stored, "i"), "name")] == ["detected_coffee_cup_0", "detected_coffee_cup_1", "detected_coffee_cup_4"]


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    frames = []
    for seq in range(60):
        det = [(l, float(c), float(seq), 0.0, 1.0) for l in ("cup", "pan") for c in rng.random(rng.integers(0, 3))]
        frames.append(("s", seq, det))
    schema = "stream_id string, frame_seq long, detections array<struct<label:string,confidence:double,cam_x:double,cam_y:double,cam_z:double>>"
    src = str(tmp_path / "in")
    for a in range(0, 60, 20):
        part = frames[a : a + 20]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = windows.run_to_end(stateful.stable(stream, n=4), "stable_t", str(tmp_path / "c"))
    full = spark.createDataFrame(frames, schema)
    det = full.select("stream_id", "frame_seq", F.inline("detections")).where(spatial.qualifies(None, 0.5))
    want = spatial.stable_labels(det, full.select("stream_id", "frame_seq"), 4)
    key = lambda df: sorted((r["label"], r["frame_seq"], r["streak"], round(r["cam_x"], 9)) for r in df.collect())
    assert key(got) == key(want) and key(want)


def test_stream_registry_and_windows(spark, tmp_path):
    schema = "map_id string, request_id long, label string, px double, py double, op string"
    frame(spark, schema, ("m", 1, "cup", 0.0, 0.0, "put"), ("m", 1, "cup", 0.1, 0.0, "put"), ("m", 2, "cup", 0.2, 0.0, "put"), ("m", 3, "cup", 5.0, 0.0, "put")).coalesce(1).write.parquet(str(tmp_path / "r"))
    got = windows.run_to_end(stateful.registry(spark.readStream.schema(schema).parquet(str(tmp_path / "r"))), "registry_t", str(tmp_path / "c1"))
    assert [r[0] for r in rows(got.select("name"), "name")] == ["detected_cup_0", "detected_cup_1", "detected_cup_2"]
    track = frame(spark, "goal_id string, t double, distance double", ("a", 0.0, 3.0), ("a", 5.0, 0.4), ("b", 0.0, 3.0), ("b", 16.0, 2.99), ("c", 0.0, 3.0))
    assert dict(rows(spatial.stalls(track))) == {"a": "success", "b": "failed", "c": "running"}
    track.coalesce(1).write.parquet(str(tmp_path / "t"))
    dog = windows.run_to_end(stateful.watchdog(spark.readStream.schema(track.schema).parquet(str(tmp_path / "t"))), "dog_t", str(tmp_path / "c2"))
    assert dict(rows(dog.select("goal_id", "state"))) == {"a": "success", "b": "failed"}
    ev = spark.createDataFrame([("2024-01-01 00:00:01", "u", 1.0), ("2024-01-01 00:09:00", "u", 2.0), ("2024-01-01 00:11:00", "u", 4.0)], "ts string, user string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    ev.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = windows.event_time(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "e")), late="10 minutes")
    out = windows.run_to_end(windows.tumbling(stream, "10 minutes", ["user"], "value"), "tumble_t", str(tmp_path / "c3"), "complete")
    assert [r[0] for r in rows(out.select("total"), "start")] == [3.0, 4.0]


def test_references_and_prompts(spark):
    from larder.plans import assistant

    embed = models.embed_with(lambda: models.hashing_embedder(64))
    foods = frame(spark, "id long, description string", (1, "maize flour"), (2, "corn flour"), (3, "milk")).withColumn("vec", embed(F.col("description")))
    samples = frame(spark, "doc_id long, meal string", (7, "10 g of maize flour, 5 g of corn flour, 3 g of zzz."), (8, "nothing"))
    refs = assistant.references(samples, foods, embed, k=2)
    got = [(r["pos"], r["term"], r["matched"]) for r in refs.orderBy("pos").collect()]
    assert got == [(0, "maize flour", True), (2, "zzz", False)]  # both names mean the second food; the later term goes
    profiles = spark.createDataFrame([(2, {"Protein": 3.25, "Carbohydrate, by difference": 70.0})], "fdc_id long, nutrients map<string,double>")
    block = lambda style: [r["block"] for r in assistant.prompt_blocks(refs, profiles, style).collect()]
    assert block("items") == ['- maize flour: USDA match → "corn flour" — Carb: 70.0g\n- zzz: no reliable USDA match — use your own knowledge']
    assert block("legacy") == ["- corn flour (per 100 g): Carb: 70.0g, Protein: 3.2g"] or block("legacy") == ["- corn flour (per 100 g): Carb: 70.0g, Protein: 3.3g"]
    assert block("candidates")[0].startswith('- maize flour #1 "corn flour" (similarity 1.00) Carb: 70.0g\n- maize flour #2 "maize flour"')
    with pytest.raises(ValueError):
        assistant.prompt_blocks(refs, profiles, "other")
    per, total = assistant.similarity_summary(refs, 0.6)
    assert per.first()["n"] == 2 and total.first()["percent"] == 100.0


def test_substitution_eval(spark):
    from larder.plans import assistant

    items = frame(spark, "id long, category string, text_vec array<double>, graph_vec array<double>", (1, "a", [1.0, 0.0], [1.0, 0.0]), (2, "a", [1.0, 0.1], [0.0, 1.0]), (3, "a", [0.0, 1.0], [0.1, 1.0]), (4, "b", [1.0, 0.0], [1.0, 0.0]))
    ranks, metrics = assistant.substitution_eval(items, frame(spark, "qid long, id long", (1, 2), (1, 3)), wide=2, near=1)
    assert rows(ranks, "id") == [(1, 2, 2), (1, 3, 3)]
    assert metrics.first()["mrr"] == pytest.approx(0.5)


def test_assistant(spark):
    from larder.plans import assistant

    embed = models.embed_with(lambda: models.hashing_embedder(64))
    foods = frame(spark, "id long, description string", (1, "egg"), (2, "rice"), (3, "tofu")).withColumn("text_vec", embed(F.col("description")))
    edges = frame(spark, "fdc_id long, nutrient_id long, amount double", (1, 10, 12.0), (2, 11, 70.0), (3, 11, 20.0))
    nutrients = frame(spark, "nutrient_id long, nutrient_name string", (10, "Protein"), (11, "Carbohydrate, by difference"))
    vecs = frame(spark, "id long, vec array<double>", (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.1, 1.0]))
    log = frame(spark, "user_id string, food_fdc_id long, food_desc string, offered boolean, chosen boolean", ("u", 3, "tofu", True, True))
    requests = frame(spark, "qid string, user_id string, meal string", ("q", "u", "two egg and 100 g of rice"))
    out = assistant.assistant(requests, foods, edges, nutrients, vecs, log, embed, models.default_chat)
    assert sorted(r["fdc_id"] for r in out["eaten"].collect()) == [1, 2]
    assert out["targets"].first()["carb_g"] == 50.0
    assert [(r["fdc_id"], r["preference"]) for r in out["options"].where("place = 1").collect()] == [(3, 1.0)]
    assert "tofu (favourite)" in out["prompts"].first()["prompt"] and out["replies"].first()["answer"] and out["offers"].count() >= 1

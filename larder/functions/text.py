"""Text functions as Column builders: meals, food terms, model answers, tags and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of foods in other varieties of English, and what the index calls them.
SYNONYMS = {
    "groundnut": "peanut", "groundnuts": "peanuts", "maize": "corn", "capsicum": "pepper", "aubergine": "eggplant", "courgette": "zucchini", "coriander": "cilantro", "spring onion": "green onion",
    "rocket": "arugula", "prawns": "shrimp", "nshima": "cornmeal", "ugali": "cornmeal", "fufu": "cassava", "dhal": "lentils", "dal": "lentils", "porridge": "oatmeal",
}

# Units of quantities, what plural-stripped ones are called, number words in the order they are tried.
UNIT = r"(g|grams?|gram|oz|ounces?|cup|cups|tbsp|tablespoons?|tsp|teaspoons?|slice|slices|ml|milliliters?|l|liters?|litres?|lb|pounds?|kg|kilograms?|piece|pieces|serving|servings|bowl|bowls|glass|glasses|can|cans)"
UNIT_NAMES = {"gram": "g", "ounce": "oz", "milliliter": "ml", "liter": "l", "litre": "l", "kilogram": "kg", "pound": "lb", "tablespoon": "tbsp", "teaspoon": "tsp"}
NUMBER_WORDS = {"half": 0.5, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}

# Words that carry no food.
CONTEXT = r"(?i)\b(for\s+)?(breakfast|lunch|dinner|snack|brunch|dessert|supper|this\s+morning|today|yesterday|i\s+ate|i\s+had|i\s+drank|i\s+eat|i\s+have|we\s+had|we\s+ate|ate|eat|eaten|had|have|drank|drinking|then|also|some|with)\b"
ARTICLES = r"(?i)\b(a|an|one|two|three|four|five|half\s+a|half)\b"
PREPARATION = r"(?i)\b(?:raw|boiled|fried|baked|cooked|roasted|steamed|grilled|dried|fresh|ripe|unripe|large|small|medium|plain|whole|chopped|sliced|diced|peeled|unpeeled|skinless|boneless|without\s+skin|in\s+their\s+shells?|weighing|along|the|a|an|ate|had|consumed|got|sprinkled)\b"

# Shapes of foods with weights, in the order in which they are collected.
TERM_SHAPES = [
    r"(?i)\d+(?:\.\d+)?\s*(?:g(?:rams?)?)\s+(?:of\s+)([\w\s,'-]+?)(?=\s*(?:,|\band\b|\balong\b|\.|$))",
    r"(?i)((?:\w+\s+){0,3}\w+)\s+weighing\s+\d+",
    r"(?i)((?:\w+\s+){0,3}\w+)\s*\(\d+(?:\.\d+)?\s*g\)",
]


def replace_first(text: Column, what: str, by: str) -> Column:
    at = F.instr(text, what)
    return F.concat(F.substring(text, F.lit(1), at - 1), F.lit(by), F.substring(text, at + len(what), F.length(text)))


def rewrite_synonyms(term: Column) -> Column:
    """Lower-cased and trimmed; the longest alias that occurs is replaced, once."""
    text = F.lower(F.trim(term))
    chain = None
    for alias in sorted(SYNONYMS, key=len, reverse=True):
        test, value = F.contains(text, F.lit(alias)), replace_first(text, alias, SYNONYMS[alias])
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain.otherwise(text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def split_meal(text: Column) -> Column:
    """Items of a meal: cut at commas, semicolons, 'and' and 'with'; trimmed, none empty."""
    return F.filter(F.transform(F.split(text, r",|;|\band\b|\bwith\b"), lambda p: F.trim(p, F.lit(" \t\n\r"))), lambda p: p != "")


def _unit(raw: Column) -> Column:
    plain = F.regexp_replace(F.lower(raw), "s+$", "")
    chain = plain
    for name, short in UNIT_NAMES.items():
        chain = F.when(plain == name, F.lit(short)).otherwise(chain)
    return chain


def _without(text: Column, pattern: str) -> Column:
    """The text without the first match: what comes before it is the shortest prefix that a match follows."""
    return F.regexp_replace(text, rf"(?s)\A(.*?){pattern}", "$1")


def quantity(text: Column) -> Column:
    """Struct qty, unit, rest: a number and unit, else a fraction, else an article and unit, else a number word."""
    amount = rf"(?i)(\d+\.?\d*)\s*{UNIT}\b"
    fraction = rf"(?i)(\d+)\s*/\s*(\d+)\s*(?:of\s+a\s+)?{UNIT}?\b"
    article = rf"(?i)\b(?:a|an|one)\s+{UNIT}\b"
    got = lambda p, i: F.regexp_extract(text, p, i)

    def row(qty: Column, unit: Column, rest: Column) -> Column:
        return F.struct(qty.cast("double").alias("qty"), unit.cast("string").alias("unit"), rest.alias("rest"))

    third = got(fraction, 3)
    out = (
        F.when(text.rlike(amount), row(got(amount, 1), _unit(got(amount, 2)), _without(text, amount)))
        .when(
            text.rlike(fraction),
            row(
                F.try_divide(got(fraction, 1).try_cast("double"), got(fraction, 2).try_cast("double")),
                F.when(third != "", F.regexp_replace(F.lower(third), "s+$", "")), _without(text, fraction)
            )
        )
        .when(text.rlike(article), row(F.lit(1.0), _unit(got(article, 1)), _without(text, article)))
    )
    for word, number in NUMBER_WORDS.items():
        pattern = rf"(?i)\b{word}\b"
        out = out.when(text.rlike(pattern), row(F.lit(number), F.lit(None), _without(text, pattern)))
    return out.otherwise(row(F.lit(None), F.lit(None), text))


def food_term(text: Column) -> Column:
    """Without context words, articles and a leading 'of'."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, CONTEXT, " "), ARTICLES, " "), r"(?i)^\s*of\s+", ""))


def parse_meal(text: Column) -> Column:
    """Array of raw, term, qty and unit; items without a term are left out."""

    def item(x: Column) -> Column:
        q = x["q"]
        return F.struct(x["raw"].alias("raw"), food_term(q["rest"]).alias("term"), q["qty"].alias("qty"), q["unit"].alias("unit"))

    # in two steps, so that an item's quantity is looked for once and not for each field
    found = F.transform(split_meal(text), lambda part: F.struct(part.alias("raw"), quantity(part).alias("q")))
    return F.filter(F.transform(found, item), lambda x: x["term"] != "")


def distinct_first(values: Column, key) -> Column:
    """Values whose key has not come before, in order."""
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        values, F.struct(empty.alias("keys"), empty.alias("out")), lambda acc,
        v: F.when(F.array_contains(acc["keys"], key(v)), acc).otherwise(F.struct(F.array_append(acc["keys"], key(v)).alias("keys"), F.array_append(acc["out"], v).alias("out")))
    )
    return kept["out"]


def food_terms(text: Column) -> Column:
    """Foods with weights in a description, cleaned, without repeats (whatever their case)."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), 1) for p in TERM_SHAPES))
    clean = F.transform(found, lambda t: F.rtrim(squeeze(F.regexp_replace(t, PREPARATION, " ")), F.lit(".")))
    return distinct_first(F.filter(clean, lambda t: F.length(t) >= 2), F.lower)


def frame_label(name: Column) -> Column:
    """detected_coffee_cup_0 -> coffee cup; other names as they are, lower-cased."""
    inner = F.regexp_extract(name, r"^detected_(.+?)(?:_\d+)?$", 1)
    return F.lower(F.replace(F.when(inner != "", inner).otherwise(name), F.lit("_"), F.lit(" ")))


def normalise_name(name: Column) -> Column:
    """Unescaped quotes, trimmed, lower case."""
    return F.lower(F.trim(F.replace(F.replace(name, F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"'))))


def id_after_hash(uri: Column) -> Column:
    return F.split_part(uri, F.lit("#"), F.lit(2)).try_cast("long")


NUMBER = r"-?[0-9]+(?:\.[0-9]*)?"
ANSWER_KEYS = {"fat": "total_fat", "protein": "total_protein", "energy": "total_energy", "carb": "total_carbohydrates"}


def answer(reply: Column, nutrient: str, chain_of_thought: bool = True) -> Column:
    """The number a model answered: keyed, a range a-b or list [a, b] averaged (lists for carb only), a bare number, else -1."""
    text = F.trim(F.when(F.contains(reply, F.lit("Output:")), F.split_part(reply, F.lit("Output:"), F.lit(2))).otherwise(reply) if chain_of_thought else reply)
    quote = "[\"']"
    gap = r"\s*" if nutrient == "carb" else " "
    before = rf"{quote}\s*{ANSWER_KEYS[nutrient]}{quote}:{gap}"
    single = before + (rf"{quote}?" if nutrient == "carb" else "") + rf"({NUMBER}(?:-{NUMBER.removeprefix('-?')})?)"
    value = F.regexp_extract(text, single, 1)
    low, high = F.regexp_extract(value, rf"^({NUMBER})-({NUMBER.removeprefix('-?')})$", 1), F.regexp_extract(value, rf"^({NUMBER})-({NUMBER.removeprefix('-?')})$", 2)
    keyed = F.coalesce(value.try_cast("double"), F.when(~value.startswith("-"), (low.try_cast("double") + high.try_cast("double")) / 2), F.lit(-1.0))
    bare = F.coalesce(text.try_cast("double"), F.lit(-1.0))
    out = F.when(text.rlike(single), keyed)
    if nutrient == "carb":
        several = F.regexp_extract(text, before + rf"\[({NUMBER}(?:,\s*{NUMBER})*)\]", 1)
        parts = F.split(several, r",\s*")
        out = out.when(several != "", F.coalesce((F.get(parts, F.lit(0)).try_cast("double") + F.get(parts, F.lit(1)).try_cast("double")) / 2, F.lit(-1.0)))
    return out.otherwise(bare)


def strip_thoughts(reply: Column) -> Column:
    return F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")


def tool_calls(reply: Column) -> Column:
    """Bodies of <tool_call> blocks that are valid JSON objects, as text."""
    found = F.regexp_extract_all(reply, F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), 1)
    return F.filter(found, lambda x: F.try_parse_json(x).isNotNull())


def boxes(reply: Column, width: float, height: float) -> Column:
    """Labels and boxes of <ref>..</ref><box>(x1,y1,x2,y2)</box>, distinct, from thousandths to pixels."""
    pattern = r"<ref>(.*?)</ref><box>\((\d+),(\d+),(\d+),(\d+)\)</box>"
    found = F.array_distinct(F.regexp_extract_all(reply, F.lit(pattern), 0))
    n = lambda m, i: F.regexp_extract(m, pattern, i).cast("double") / 1000.0
    return F.transform(
        found,
        lambda m: F.struct(
            F.trim(F.regexp_extract(m, pattern, 1)).alias("label"), (n(m, 2) * width).alias("x1"), (n(m, 3) * height).alias("y1"),
            (n(m, 4) * width).alias("x2"), (n(m, 5) * height).alias("y2")
        )
    )


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def word_set(text: Column) -> Column:
    """Distinct lower-case words of three characters or more, in any script."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w{3,}"), 0))


def item_references(prompt: Column) -> Column:
    """Reference lines of a prompt: food_term, matched, description, nutrients."""
    lines = F.transform(F.split(prompt, "\n"), F.trim)
    hit, miss = '^- (.+?): USDA match → "(.+?)" — (.+)$', "^- (.+?): no reliable USDA match"
    kept = F.filter(lines, lambda x: x.rlike(hit) | x.rlike(miss))
    return F.transform(
        kept,
        lambda x: F.when(x.rlike(hit), F.struct(F.regexp_extract(x, hit, 1).alias("food_term"), F.lit(True).alias("matched"), F.regexp_extract(x, hit, 2).alias("description"), F.regexp_extract(x, hit, 3).alias("nutrients"))).otherwise(
            F.struct(
                F.regexp_extract(x, miss, 1).alias("food_term"), F.lit(False).alias("matched"), F.lit(None).cast("string").alias("description"),
                F.lit(None).cast("string").alias("nutrients")
            )
        ),
    )


def coordinates(text: Column) -> Column:
    """Lines key:px,py to an array of name, px, py; bad lines are left out."""
    shape = r"^([^:]+):([^,]+),([^,]+)$"
    rows = F.transform(
        F.split(text, "\n"),
        lambda x: F.struct(
            F.trim(F.regexp_extract(x, shape, 1)).alias("name"), F.trim(F.regexp_extract(x, shape, 2)).try_cast("double").alias("px"),
            F.trim(F.regexp_extract(x, shape, 3)).try_cast("double").alias("py")
        )
    )
    return F.filter(rows, lambda r: (r["name"] != "") & r["px"].isNotNull() & r["py"].isNotNull())


def listed(values: Column, shown: int) -> Column:
    """The first few values and how many more there are."""
    more = F.size(values) - shown
    return F.concat(F.array_join(F.slice(values, 1, shown), ", "), F.when(more > 0, F.format_string(" (+%d more)", more)).otherwise(""))


def nutrient_line(name: Column, amount: Column, unit: Column) -> Column:
    return F.format_string("%s: %.1f%s", name, amount, unit)

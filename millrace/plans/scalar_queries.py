"""Column functions over whole tables: food text, ingredient lines, dates, units, scores, arrays, JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import dates, parsing, scores, text
from millrace.plans.tables import AMOUNTS, NOTES, UNIT_WORDS, foods, raw_lines, recipe_lines, table

LINE = ["recipe_id", "line", "food_id", "source_id"]
TERMS = ("gear", "hot gear", "large steel plate", "hot", "cold bolt")
PHYSICAL, COOKING = ("chopped", "diced", "sliced", "whole"), ("raw", "cooked", "grilled", "hot", "cold")


def _words(words):
    return F.array(*[F.lit(w) for w in words])


def st2_names_volume(spark, sf_dir):
    return raw_lines(spark, sf_dir).select(*LINE, text.has_volume(F.col("raw")).alias("volume"))


def st3_modifier_kinds(spark, sf_dir):
    return raw_lines(spark, sf_dir).groupBy(text.modifier_kind(F.col("raw")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def st5_tokens(spark, sf_dir):
    lines = raw_lines(spark, sf_dir)
    return lines.select(*LINE, F.array_join(text.tokens(F.col("raw")), " ").alias("tokens"), F.array_join(text.tokens(F.col("raw"), drop_containers=False), " ").alias("signal"))


def st7_modifier_classes(spark, sf_dir):
    found = lambda words: F.array_join(F.array_sort(F.array_intersect("tokens", _words(words))), " ")
    lines = raw_lines(spark, sf_dir).select(*LINE, text.tokens(F.col("raw")).alias("tokens"))  # both classes read them
    return lines.select(*LINE, found(PHYSICAL).alias("physical_form"), found(COOKING).alias("cooking_state"))


def st8_clean_ingredients(spark, sf_dir):
    return raw_lines(spark, sf_dir).select(*LINE, text.clean_ingredient(F.col("raw")).alias("cleaned"))


def st9_semantic_text(spark, sf_dir):
    """Title, bar, sorted ingredient texts; and what stands behind the bar."""
    recipes = raw_lines(spark, sf_dir).groupBy("recipe_id").agg(F.collect_list(text.clean_ingredient(F.col("raw"))).alias("items"))
    made = text.semantic_text(F.concat(F.lit("recipe "), F.col("recipe_id").cast("string")), F.col("items"))
    return recipes.select("recipe_id", made.alias("semantic_text"), text.after_bar(made).alias("ingredients"))


def st11_slugs(spark, sf_dir):
    """Column names of foods: slugs, later ones of equal slugs with a number."""
    place = F.row_number().over(Window.partitionBy("slug").orderBy("food_id"))
    slugs = foods(spark, sf_dir).select("food_id", text.slug(F.concat_ws(" - ", "brand", "description")).alias("slug"))
    return slugs.select("food_id", F.when(place == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("_"), place.cast("string"))).alias("name"))


def st12_display_labels(spark, sf_dir):
    return raw_lines(spark, sf_dir).select(*LINE, text.display_label(F.col("raw")).alias("label"))


def st13_units_in_text(spark, sf_dir):
    return raw_lines(spark, sf_dir).select(*LINE, parsing.units_in_text(F.col("raw")).alias("normalized"))


def st15_parsed_lines(spark, sf_dir):
    return parsing.parsed_lines(raw_lines(spark, sf_dir).select(*LINE, "raw")).drop("raw")


def st17_bracketed_grams(spark, sf_dir):
    return raw_lines(spark, sf_dir).select(*LINE, F.round(parsing.bracketed_grams(F.col("raw")), 6).alias("grams"))


def st18_line_flags(spark, sf_dir):
    flag = lambda pattern, name: F.col("raw").rlike(pattern).alias(name)
    return raw_lines(spark, sf_dir).select(
        *LINE, flag(parsing.VAGUE_AMOUNT, "vague"), flag(parsing.COMPOUND_NAME, "compound"), flag(parsing.SIZED_CONTAINER, "container")
    )


def st20_term_scores(spark, sf_dir):
    """Every food against a stated list of terms: overlap by F-beta, Jaccard with bonus, label match."""
    pairs = foods(spark, sf_dir).select("food_id", "description", F.explode(_words(TERMS)).alias("term"))
    t, d = text.tokens(F.col("term")), text.tokens(F.col("description"))
    return pairs.select(
        "food_id", "term", F.round(scores.f_beta(t, d), 6).alias("f_beta"), F.round(scores.containment_bonus(t, d), 6).alias("jaccard"),
        F.round(scores.label_match(F.col("term"), F.col("description")), 6).alias("label_match"),
    )


def st26_link_domains(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.link_domain(F.col("url")).alias("domain"))


def st28_ordered_distinct(spark, sf_dir):
    """Distinct words of a line in order of first use, and those of them that the food's name lacks."""
    words, own = F.array_distinct(F.split("raw", " ")), F.split("description", " ")
    return raw_lines(spark, sf_dir).select(*LINE, F.array_join(words, " ").alias("words"), F.array_join(F.array_except(words, own), " ").alias("focus"))


def st31_joined_labels(spark, sf_dir):
    parts = F.when(F.col("size") > 10, F.col("description")), F.when(F.col("size") % 2 == 0, F.lit(" ")).otherwise(F.col("brand")), F.when(F.col("size") < 40, F.col("data_type"))
    return foods(spark, sf_dir).select("food_id", text.joined_label(*parts).alias("label"))


def st32_portion_ids(spark, sf_dir):
    """A structured id if there is one, else the number that a method names."""
    method = F.concat(F.lit("portion "), F.col("source_id").cast("string"), F.lit(" by volume"))
    named = F.regexp_extract(F.when(F.col("source_id") % 3 > 0, method), r"portion (\d+)", 1).try_cast("long")
    return recipe_lines(spark, sf_dir).select(*LINE, F.coalesce(F.when(F.col("food_id") % 5 == 0, F.col("food_id")), named).alias("portion_id"))


def d1_split_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("d"), F.date_format("ts", "HH:mm:ss").alias("clock"),
        F.floor(dates.epoch_micros(F.col("ts")) / 1000).alias("epoch_ms"),
    )


def d2_spend_of_last_day(spark, sf_dir):
    last = table(spark, sf_dir, "events").where(dates.within(F.col("ts"), "2024-01-15 12:00:00", 24))
    return last.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("spend"), F.round(dates.minutes_between(F.min("ts"), F.max("ts")), 4).alias("minutes"))


def d5_latest_text_date(spark, sf_dir):
    """The order with the greatest date as text, missing dates last."""
    dated = table(spark, sf_dir, "orders").withColumn("date", F.when(F.col("o_orderpriority") != "5-LOW", F.date_format("o_orderdate", "yyyy-MM-dd")))
    order = Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("date"), "o_orderkey")
    return dated.withColumn("r", F.row_number().over(order)).where("r = 1").select("o_custkey", "o_orderkey", "date")


def m1_converted_amounts(spark, sf_dir):
    """Parsed amounts in milliliters or grams, and their kind."""
    p = parsing.parsed_lines(raw_lines(spark, sf_dir).select(*LINE, "raw"))
    kind = parsing.amount_kind(F.col("quantity"), F.col("unit"), F.col("name"))
    base = F.when(parsing.unit_kind(F.col("unit")) == "volume", "milliliter").otherwise("gram")
    return p.select(*LINE, kind.alias("kind"), F.round(scores.convert(F.col("quantity"), F.col("unit"), base), 6).alias("amount"))


def m8_gram_ladder(spark, sf_dir):
    """Grams by the first path that gives any: mass in brackets, mass, volume by the food's grams a cup, count by its grams a piece."""
    p = parsing.with_bracketed_grams(parsing.parsed_lines(raw_lines(spark, sf_dir).select(*LINE, "raw"))).drop("size")
    p = p.join(foods(spark, sf_dir).select("food_id", "size"), "food_id")
    quantity, unit = F.col("quantity"), F.col("unit")
    paths = {
        "bracketed": F.col("bracketed"),
        "mass": scores.convert(quantity, unit, F.lit("gram")),
        "volume": scores.convert(quantity, unit, F.lit("cup")) * F.col("size"),
        "count": F.when(parsing.unit_kind(unit) == "count", quantity * F.col("size") / 2),
    }
    method = F.coalesce(*[F.when(g.isNotNull(), n) for n, g in paths.items()], F.lit("unresolved"))
    return p.select(*LINE, method.alias("method"), F.round(F.coalesce(*paths.values()), 6).alias("grams"))


def m11_portion_flags(spark, sf_dir):
    """Per food which kinds of portions its lines show: volume, count, a container with its mass."""
    p = parsing.parsed_lines(raw_lines(spark, sf_dir).select("food_id", "raw")).select("food_id", parsing.unit_kind(F.col("unit")).alias("kind"), "raw")
    container = F.col("raw").rlike(r"\bcans?\b") & F.col("raw").rlike(parsing.BRACKETED_MASS)
    shown = p.groupBy("food_id").agg(F.bool_or(F.col("kind").eqNullSafe("volume")).alias("v"), F.bool_or(F.col("kind").eqNullSafe("count")).alias("c"), F.bool_or(container).alias("cm"))
    flag = F.when(F.col("food_id") <= 2, "-").when(F.col("v") & F.col("cm"), "VC").when(F.col("v"), "V").when(F.col("cm"), "Cm").when(F.col("c"), "C").otherwise("-")
    return shown.select("food_id", flag.alias("flag"))


BOX = {"low": [0.10, 0.20, 0.20], "high": [0.60, 0.35, 0.55]}


def _macros(spark, sf_dir):
    grams = lambda c: F.round(F.sum(c), 6)
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("recipe_id")).agg(
        grams("l_quantity").alias("protein"), grams(F.col("l_tax") * 100).alias("fat"), grams(F.col("l_discount") * 100).alias("carb")
    )


def m12_range_fit(spark, sf_dir):
    """Energy shares of recipes: fit to a box, its score, L1 distance to the box."""
    shares = scores.energy_shares(F.col("protein"), F.col("fat"), F.col("carb"))
    fit = scores.range_fit(shares, BOX["low"], BOX["high"])
    return _macros(spark, sf_dir).select(
        "recipe_id", F.round(scores.kcal(F.col("protein"), F.col("fat"), F.col("carb")), 4).alias("kcal"),
        F.round(fit, 6).alias("fit"), F.round(scores.fit_score(fit), 6).alias("score"), F.round(scores.box_distance(shares, BOX["low"], BOX["high"]), 6).alias("distance"),
    )


def m15_zones(spark, sf_dir):
    """Accounts against quartiles and against the 15th and 85th percentile of their nation."""
    c = table(spark, sf_dir, "customer")
    q = c.groupBy("c_nationkey").agg(F.percentile("c_acctbal", F.array(*[F.lit(x) for x in (0.15, 0.25, 0.5, 0.75, 0.85)])).alias("q"), F.count(F.lit(1)).alias("n"))
    at = lambda k: F.col("q")[k]
    v = F.col("c_acctbal")
    return c.join(q, "c_nationkey").select(
        "c_custkey", scores.iqr_zone(v, at(1), at(2), at(3), whisker=0.25).alias("zone"), scores.share_band(v, at(0), at(4), F.col("n"), whisker=0.1).alias("band")
    )


def m16_fidelity(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        (F.max("l_discount") * 20).alias("worst"), F.count_if(F.col("l_tax") >= 0.08).alias("n_red"), F.bool_or(F.col("l_returnflag") == "A").alias("hit"), F.sum("l_quantity").alias("q")
    )
    return r.select("l_orderkey", scores.fidelity_band(F.col("worst"), F.col("n_red"), F.col("q") < 250, F.col("hit"), F.lit(False), accept=1.3, most=1.9).alias("band"))


def m18_typicality(spark, sf_dir):
    """A band of accounts against the accounts of each nation."""
    low, high, eps = F.col("c_nationkey") * 400.0, F.col("c_nationkey") * 400.0 + 100.0, 1e-12
    x = F.col("c_acctbal")
    s = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count_if(x.between(low - eps, high + eps)).alias("inside"), F.count_if(x < low - eps).alias("below"), F.count_if(x > high + eps).alias("above"),
        F.count(F.lit(1)).alias("n"), F.percentile("c_acctbal", 0.5).alias("mid"),
    )
    rare = F.col("inside") <= 2
    status = (
        F.when(rare & ((F.col("mid") < low - eps) | ((F.col("below") > F.col("above")) & (F.col("mid") <= high + eps))), "very_high")
        .when(rare & ((F.col("mid") > high + eps) | (F.col("above") > F.col("below"))), "very_low")
        .when(rare, F.when((low + high) / 2 >= F.col("mid"), "very_high").otherwise("very_low"))
        .when(F.col("below") / F.col("n") >= 0.8, "slightly_high")
        .when(F.col("above") / F.col("n") >= 0.8, "slightly_low")
        .otherwise("typical")
    )
    return s.select("c_nationkey", status.alias("status"))


def m19_badness(spark, sf_dir):
    """Badness by median and MAD of the nation, on a logistic curve; groups of one by their value."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") / 1000).alias("v"))
    middle = c.groupBy("c_nationkey").agg(F.percentile("v", 0.5).alias("mid"), F.count(F.lit(1)).alias("n"))
    c = c.join(middle, "c_nationkey")
    spread = c.groupBy("c_nationkey").agg(F.percentile(F.abs(F.col("v") - F.col("mid")), 0.5).alias("mad"))
    z = F.when(F.col("n") == 1, F.col("v")).otherwise((F.col("v") - F.col("mid")) / (1.4826 * F.col("mad") + 1e-9))
    return c.join(spread, "c_nationkey").select("c_custkey", F.round(scores.logistic_badness(z, middle=0.5), 6).alias("badness"))


def m20_churn(spark, sf_dir):
    """Half the Jaccard distance of foods, half the L1 distance of grams, between the A and the R lines of a recipe."""
    of = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("grams"))), F.lit(0.0))
    pairs = recipe_lines(spark, sf_dir).where("status in ('A', 'R')").groupBy("recipe_id", "food_id").agg(of("A").alias("a"), of("R").alias("r"))
    r = pairs.groupBy("recipe_id").agg(F.count_if((F.col("a") > 0) & (F.col("r") > 0)).alias("both"), F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("a") - F.col("r"))).alias("l1"), F.sum("r").alias("ref"))
    return r.where("ref > 0").select("recipe_id", F.round(0.5 * (1 - F.col("both") / F.col("n")) + 0.5 * F.col("l1") / F.col("ref"), 6).alias("churn"))


def m21_least_hits(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).select("o_custkey", scores.clamp_count(F.col("n")).cast("long").alias("least"))


def m24_portion_changes(spark, sf_dir):
    """Scale factors of the lines against a uniformly scaled recipe."""
    lines = recipe_lines(spark, sf_dir, ("l_discount",)).withColumn("now", F.col("grams") * (1 - F.col("l_discount")))
    whole = Window.partitionBy("recipe_id")
    base = F.col("grams") * F.sum("now").over(whole) / F.sum("grams").over(whole)
    r = F.col("now") / F.greatest(base, F.lit(1e-3))
    f = lines.select("recipe_id", r.alias("r"), F.pow(F.log(F.greatest(r, F.lit(1e-12))), F.lit(2.0)).alias("sq"))
    return f.groupBy("recipe_id").agg(
        F.round(F.sum("sq"), 6).alias("portion_score"), F.round(F.avg(F.abs(F.col("r") - 1)) * 100, 4).alias("avg_pct_change"), F.round(F.max(F.abs(F.col("r") - 1)) * 100, 4).alias("max_pct_change"),
        F.round(F.min("r"), 6).alias("least"), F.round(F.max("r"), 6).alias("most"), F.round(F.sqrt(F.avg("sq")), 6).alias("rms_log_deviation"),
    )


def m25_bound_violations(spark, sf_dir):
    """Grams of a recipe against bounds from energy shares at a target of 600 kcal."""
    out = []
    for k, name in enumerate(("protein", "fat", "carb")):
        per = scores.KCAL_PER_GRAM[name]
        low, high = 600 * BOX["low"][k] / per, 600 * BOX["high"][k] / per
        out.append(((F.col(name) < low - 1e-6) | (F.col(name) > high + 1e-6)).alias(f"{name}_out"))
    energy = scores.kcal(F.col("protein"), F.col("fat"), F.col("carb"))
    return _macros(spark, sf_dir).select("recipe_id", *out, (F.abs(energy - 600) > 100).alias("kcal_out"))


def m26_token_cost(spark, sf_dir):
    cost = F.sum("n_chars") / 4 / 1e6 * 2.5 + F.count(F.lit(1)) * 100 / 1e6 * 10.0
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(cost, 6).alias("cost"))


CUISINES = {"italian": ("mediterranean", "european"), "mediterranean": ("italian", "greek", "european"), "mexican": ("latin",), "chinese": ("asian",), "japanese": ("asian",)}


def m27_cuisine_similarity(spark, sf_dir):
    """1 for the same cuisine, a half for one family, 0 else."""
    names = list(CUISINES)
    family = F.create_map(*[x for n, f in CUISINES.items() for x in (F.lit(n), _words((n, *f)))])
    a, b = (_words(names)[F.pmod(F.col(c), F.lit(len(names))).cast("int")] for c in ("o_custkey", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(a == b, 1.0).when(F.arrays_overlap(family[a], family[b]), 0.5).otherwise(0.0).alias("similarity"))


def m30_box_feasibility(spark, sf_dir):
    low = [(F.col("c_custkey") % m) / 20.0 for m in (7, 9, 11)]
    high = [x + (F.col("c_nationkey") % 5) / 10.0 for x in low]
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(sum(high, F.lit(0.0)) < 1 - 1e-9, "maxes_too_small").when(sum(low, F.lit(0.0)) > 1 + 1e-9, "mins_too_large").otherwise("feasible").alias("verdict")
    )


def aj1_exploded_lists(spark, sf_dir):
    """Lists kept as JSON text into rows; the index counts what is left after blanks are dropped."""
    stored = foods(spark, sf_dir).select("food_id", F.concat(F.lit('["'), F.replace("description", F.lit(" "), F.lit('","","')), F.lit('"]')).alias("list"))
    full = F.filter(F.from_json("list", "array<string>"), lambda x: F.trim(x) != "")
    return stored.select("food_id", F.posexplode(full).alias("idx", "item"))


def aj2_canonical_json(spark, sf_dir):
    """JSON with single quotes or double ones, read and written with sorted keys; also its hash."""
    raw = F.when(F.col("event_id") % 2 == 0, F.replace("props", F.lit('"'), F.lit("'"))).otherwise(F.col("props"))
    read = F.from_json(F.replace(raw, F.lit("'"), F.lit('"')), "struct<k: long>")
    made = F.to_json(F.struct(F.col("event_type").alias("event"), read["k"].alias("k")))
    return table(spark, sf_dir, "events").select("event_id", read["k"].alias("k"), made.alias("json"), F.sha2(made, 256).alias("sha"))


def aj4_weighted_levels(spark, sf_dir):
    """Names of a food and its successor, compared by words, last word and brand."""
    both = foods(spark, sf_dir).select("food_id", F.split("description", " ").alias("w"), F.array("brand").alias("b"))
    pairs = both.join(both.select((F.col("food_id") - 1).alias("food_id"), F.col("w").alias("w2"), F.col("b").alias("b2")), "food_id")
    last = lambda c: F.array(F.element_at(c, -1))
    levels = [(F.col("w"), F.col("w2")), (last("w"), last("w2")), (F.col("b"), F.col("b2"))]
    return pairs.select("food_id", F.round(scores.weighted_levels(levels, [0.45, 0.30, 0.15]), 6).alias("similarity"))


def aj6_least_in_box(spark, sf_dir):
    """The least loss among the points of parallel arrays that lie in a box."""
    stored = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_discount", "l_tax", "l_quantity")).alias("p"))
    inside = F.filter("p", lambda x: x["l_discount"].between(0.02, 0.07) & x["l_tax"].between(0.01, 0.06))
    return stored.select("l_orderkey", F.array_min(F.transform(inside, lambda x: x["l_quantity"])).alias("least"))


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _pick(words, key):
    return f"({_list(words)})[{key} % {len(words)} + 1]"


def _case(key, table):
    return f"CASE {key} " + " ".join(f"WHEN '{a}' THEN {b!r}" for a, b in table.items()) + " END"


_RAW = f"""
WITH raws AS (SELECT l_orderkey AS recipe_id, l_linenumber AS line, l_partkey AS food_id, l_suppkey AS source_id, p_name, p_size,
  trim(regexp_replace(concat_ws(' ', {_pick(AMOUNTS, "l_partkey")}, {_pick(UNIT_WORDS, "l_suppkey")}, p_name, {_pick(NOTES, "l_orderkey")}), ' +', ' ', 'g')) AS raw
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""
_KEY = "recipe_id, line, food_id, source_id"


def _unit(word):
    bare = f"replace({word}, '.', '')"
    return f"coalesce({_case(bare, parsing.CASED_UNITS)}, {_case(f'lower({bare})', parsing.UNIT_OF)})"


def _amount(t):
    number = lambda p, k: f"try_cast(regexp_extract({t}, '{p}', {k}) AS DOUBLE)"
    mixed, fraction = r"^(\d+)\s+(\d+)/(\d+)$", r"^(\d+)/(\d+)$"
    return f"""CASE WHEN regexp_matches({t}, '{mixed}') THEN {number(mixed, 1)} + {number(mixed, 2)} / {number(mixed, 3)}
  WHEN regexp_matches({t}, '{fraction}') THEN {number(fraction, 1)} / {number(fraction, 2)} WHEN regexp_matches({t}, '^[0-9.]+$') THEN try_cast({t} AS DOUBLE) ELSE {_case(f"lower({t})", parsing.NUMBER_WORDS)} END"""


_TOKENS = """list_sort(list_distinct([CASE WHEN x IN ('leaves', 'tomatoes', 'potatoes', 'cherries', 'berries') THEN CASE x WHEN 'leaves' THEN 'leaf' WHEN 'tomatoes' THEN 'tomato' WHEN 'potatoes' THEN 'potato' WHEN 'cherries' THEN 'cherry' ELSE 'berry' END
  WHEN length(x) > 4 AND x LIKE '%ies' THEN x[1:-4] || 'y' WHEN length(x) > 3 AND x LIKE '%es' AND x NOT LIKE '%ses' THEN x[1:-3] WHEN length(x) > 3 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN x[1:-2] ELSE x END
  FOR x IN string_split(trim(regexp_replace(regexp_replace(lower({t}), '[^a-z0-9_\\s]+', ' ', 'g'), '\\s+', ' ', 'g')), ' ') IF x <> '' AND x NOT IN ({drop}) AND (length(x) > 1 OR regexp_matches(x, '^[0-9]+$'))]))"""


def _tokens(t, containers=True):
    dropped = [*text.STOP_WORDS, *(text.CONTAINER_WORDS if containers else ())]
    return _TOKENS.replace("{t}", t).replace("{drop}", ", ".join(f"'{w}'" for w in dropped))


_PREPARED = _list(parsing.PREPARATION_WORDS)
_PARSED = _RAW + f""",
m AS (SELECT *, regexp_matches(raw, '{parsing.LINE_PATTERN}') AS found, regexp_extract(raw, '{parsing.LINE_PATTERN}', 1) AS q, regexp_extract(raw, '{parsing.LINE_PATTERN}', 2) AS w, trim(regexp_extract(raw, '{parsing.LINE_PATTERN}', 3)) AS rest FROM raws),
u AS (SELECT *, CASE WHEN found THEN {_unit("w")} END AS known, found AND ({_unit("w")}) IS NULL AND lower(w) IN ({_list(parsing.SIZE_WORDS)[1:-1]}) AS sized FROM m),
n AS (SELECT *, CASE WHEN NOT found THEN raw WHEN sized OR known IS NOT NULL THEN rest ELSE trim(w || ' ' || rest) END AS full_name FROM u),
k AS (SELECT *, list_sort(list_distinct([x FOR x IN string_split(replace(lower(full_name), ',', ''), ' ') IF list_contains({_PREPARED}, x)])) AS prep,
  trim(array_to_string([x FOR x IN string_split(full_name, ' ') IF NOT list_contains({_PREPARED}, trim(lower(x), ','))], ' '), ' ,') AS plain FROM n),
parsed AS (SELECT {_KEY}, raw, p_size, CASE WHEN found THEN {_amount("q")} END AS quantity, CASE WHEN found THEN coalesce(known, 'each') END AS unit, CASE WHEN sized THEN lower(w) END AS size,
  CASE WHEN found AND plain <> '' THEN plain ELSE full_name END AS name, CASE WHEN found AND len(prep) > 0 THEN array_to_string(prep, ', ') END AS preparation,
  CASE WHEN NOT found THEN 'no_quantity' WHEN sized THEN 'parsed_size_as_count' WHEN known IS NULL THEN 'quantity_no_known_unit' ELSE 'parsed' END AS status,
  CASE WHEN NOT found THEN 0.35 WHEN sized THEN 0.8 WHEN known IS NULL THEN 0.6 ELSE 0.9 END::DOUBLE AS confidence FROM k)"""
_CLEAN = "trim(regexp_replace(" + "regexp_replace(" * 4 + "lower(raw)" + "".join(f", '{p}', ' ', 'g')" for p in (text.BRACKETS, text.NUMBERS, text.MEASURE_WORDS, text.NOT_LETTERS)) + r", '\s+', ' ', 'g'))"
_VOLUME = rf"(?i)\b({text.VOLUME_UNITS})\b"
_MASS = rf"(?i)\b{text.MASS_UNITS}\b"
_MASS_PART = "regexp_extract(raw, '" + parsing.BRACKETED_MASS + "', {})"
_BRACKETED = f"({_amount(_MASS_PART.format(1))}) * {_case(_unit(_MASS_PART.format(2)), scores.GRAMS_PER_UNIT)}"
_COUNTS = "unit IN (" + ", ".join(f"'{u}'" for u in parsing.UNIT_SPELLINGS if u not in scores.ML_PER_UNIT and u not in scores.GRAMS_PER_UNIT) + ")"
_ML, _GRAM = _case("unit", scores.ML_PER_UNIT), _case("unit", scores.GRAMS_PER_UNIT)
_MACROS = "WITH g AS (SELECT l_orderkey AS recipe_id, round(sum(l_quantity), 6) AS p, round(sum(l_tax * 100), 6) AS f, round(sum(l_discount * 100), 6) AS c FROM lineitem GROUP BY 1)"
_FIT = [f"greatest(0.0, ln({lo}::DOUBLE / greatest({n}, 1e-6)), ln(greatest({n}, 1e-6) / {hi}::DOUBLE))" for n, lo, hi in zip("xyz", BOX["low"], BOX["high"])]
_OUTSIDE = [f"greatest({lo} - {n}, 0.0) + greatest({n} - {hi}, 0.0)" for n, lo, hi in zip("xyz", BOX["low"], BOX["high"])]

SQL = {
    "st2_names_volume": _RAW + f" SELECT {_KEY}, regexp_matches(raw, '{_VOLUME}') AS volume FROM raws",
    "st3_modifier_kinds": _RAW + rf""", k AS (SELECT regexp_matches(raw, '{_VOLUME}') AS v, regexp_matches(raw, '{_MASS}') AS m, raw FROM raws)
SELECT CASE WHEN regexp_matches(raw, '(?i)\b(fl\.?\s*oz|fluid\s+ounces?)\b') THEN 'volume' WHEN m AND NOT v THEN 'mass' WHEN v AND NOT m THEN 'volume' ELSE 'other' END AS kind, count(*) AS n FROM k GROUP BY 1""",
    "st5_tokens": _RAW + f" SELECT {_KEY}, array_to_string({_tokens('raw')}, ' ') AS tokens, array_to_string({_tokens('raw', False)}, ' ') AS signal FROM raws",
    "st7_modifier_classes": _RAW + f", t AS (SELECT {_KEY}, {_tokens('raw')} AS t FROM raws) SELECT {_KEY}, array_to_string([x FOR x IN t IF list_contains({_list(PHYSICAL)}, x)], ' ') AS physical_form, array_to_string([x FOR x IN t IF list_contains({_list(COOKING)}, x)], ' ') AS cooking_state FROM t",
    "st8_clean_ingredients": _RAW + f" SELECT {_KEY}, {_CLEAN} AS cleaned FROM raws",
    "st9_semantic_text": _RAW + f", i AS (SELECT recipe_id, array_to_string(list_sort(list({_CLEAN})), ' ') AS i FROM raws GROUP BY 1) SELECT recipe_id, 'recipe ' || recipe_id || ' | ' || i AS semantic_text, trim(i) AS ingredients FROM i",
    "st11_slugs": """
WITH s AS (SELECT p_partkey AS food_id, regexp_replace(regexp_replace(lower(p_brand || ' - ' || p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY food_id) AS r FROM s)
SELECT food_id, CASE WHEN r = 1 THEN slug ELSE slug || '_' || r END AS name FROM r""",
    "st12_display_labels": _RAW + rf" SELECT {_KEY}, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\([^)]*\)', '', 'g'), '\d+', '', 'g'), '[-–—]', ' ', 'g'), '\s+', ' ', 'g')), '') AS label FROM raws",
    "st13_units_in_text": _RAW + f" SELECT {_KEY}, array_to_string([coalesce({_unit('x')}, x) FOR x IN string_split(raw, ' ')], ' ') AS normalized FROM raws",
    "st15_parsed_lines": _PARSED + f" SELECT {_KEY}, quantity, unit, size, name, preparation, status, confidence FROM parsed",
    "st17_bracketed_grams": _RAW + f" SELECT {_KEY}, round({_BRACKETED}, 6) AS grams FROM raws",
    "st18_line_flags": _RAW + f" SELECT {_KEY}, regexp_matches(raw, '{parsing.VAGUE_AMOUNT}') AS vague, regexp_matches(raw, '{parsing.COMPOUND_NAME}') AS compound, regexp_matches(raw, '{parsing.SIZED_CONTAINER}') AS container FROM raws",
    "st20_term_scores": f"""
WITH t AS (SELECT p_partkey AS food_id, p_name AS d, unnest({_list(TERMS)}) AS term FROM part), k AS (SELECT *, {_tokens("term")} AS a, {_tokens("d")} AS b FROM t),
s AS (SELECT *, len(list_intersect(a, b)) AS n, len(a) AS na, len(b) AS nb FROM k)
SELECT food_id, term, round(CASE WHEN n = 0 THEN 0.0 ELSE 1.25 * (n / nb) * (n / na) / (0.25 * (n / nb) + n / na) END, 6) AS f_beta,
  round(CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE least(n / (na + nb - n) + CASE WHEN n = na THEN 0.25 ELSE 0 END, 1.0) END, 6) AS jaccard,
  round(CASE WHEN d = term THEN 1.0 WHEN starts_with(d, term) THEN 0.92 + 0.08 * (length(term) / length(d)) WHEN contains(d, term) THEN 0.75 + 0.2 * (length(term) / length(d)) ELSE 1 - levenshtein(term, d) / greatest(length(term), length(d)) END, 6) AS label_match FROM s""",
    "st26_link_domains": r"SELECT page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '') AS domain FROM pages",
    "st28_ordered_distinct": _RAW + f""", w AS (SELECT {_KEY}, p_name, string_split(raw, ' ') AS w FROM raws), d AS (SELECT *, [w[i] FOR i IN range(1, len(w) + 1) IF list_position(w, w[i]) = i] AS d FROM w)
SELECT {_KEY}, array_to_string(d, ' ') AS words, array_to_string([x FOR x IN d IF NOT list_contains(string_split(p_name, ' '), x)], ' ') AS focus FROM d""",
    "st31_joined_labels": "SELECT p_partkey AS food_id, nullif(concat_ws(' | ', CASE WHEN p_size > 10 THEN p_name END, CASE WHEN p_size % 2 = 1 THEN p_brand END, CASE WHEN p_size < 40 THEN p_type END), '') AS label FROM part",
    "st32_portion_ids": "SELECT l_orderkey AS recipe_id, l_linenumber AS line, l_partkey AS food_id, l_suppkey AS source_id, CASE WHEN l_partkey % 5 = 0 THEN l_partkey WHEN l_suppkey % 3 > 0 THEN l_suppkey END AS portion_id FROM lineitem",
    "d1_split_time": "SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS m, day(ts)::INT AS d, strftime(ts, '%H:%M:%S') AS clock, epoch_us(ts) // 1000 AS epoch_ms FROM events",
    "d2_spend_of_last_day": "SELECT user_id, round(sum(value), 4) AS spend, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0, 4)::DOUBLE AS minutes FROM events WHERE ts > TIMESTAMP '2024-01-14 12:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1",
    "d5_latest_text_date": """
WITH d AS (SELECT *, CASE WHEN o_orderpriority <> '5-LOW' THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders)
SELECT o_custkey, o_orderkey, date FROM d QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY date DESC NULLS LAST, o_orderkey) = 1""",
    "m1_converted_amounts": _PARSED + f""" SELECT {_KEY}, CASE WHEN quantity IS NULL THEN 'unmeasurable' WHEN unit IN ('pinch', 'dash') THEN 'volume' WHEN unit IN ('bunch', 'sprig') THEN 'unknown'
  WHEN ({_ML}) IS NOT NULL THEN 'volume' WHEN ({_GRAM}) IS NOT NULL THEN 'mass' WHEN {_COUNTS} THEN 'count' ELSE 'unknown' END AS kind, round(quantity * coalesce({_ML}, {_GRAM}), 6) AS amount FROM parsed""",
    "m8_gram_ladder": _PARSED + f""", g AS (SELECT *, {_BRACKETED} AS b, quantity * {_GRAM} AS m, quantity * ({_ML}) / 236.5882365 * p_size AS v, CASE WHEN {_COUNTS} THEN quantity * p_size / 2 END AS c FROM parsed)
SELECT {_KEY}, CASE WHEN b IS NOT NULL THEN 'bracketed' WHEN m IS NOT NULL THEN 'mass' WHEN v IS NOT NULL THEN 'volume' WHEN c IS NOT NULL THEN 'count' ELSE 'unresolved' END AS method, round(coalesce(b, m, v, c), 6) AS grams FROM g""",
    "m11_portion_flags": _PARSED + rf""", s AS (SELECT food_id, bool_or(({_ML}) IS NOT NULL) AS v, bool_or(coalesce({_COUNTS}, FALSE)) AS c, bool_or(regexp_matches(raw, '\bcans?\b') AND regexp_matches(raw, '{parsing.BRACKETED_MASS}')) AS cm FROM parsed GROUP BY 1)
SELECT food_id, CASE WHEN food_id <= 2 THEN '-' WHEN v AND cm THEN 'VC' WHEN v THEN 'V' WHEN cm THEN 'Cm' WHEN c THEN 'C' ELSE '-' END AS flag FROM s""",
    "m12_range_fit": _MACROS + f""", e AS (SELECT *, p * 4 + f * 9 + c * 4 AS kcal FROM g), s AS (SELECT recipe_id, kcal, CASE WHEN kcal <= 0 THEN 0 ELSE p * 4 / kcal END AS x, CASE WHEN kcal <= 0 THEN 0 ELSE f * 9 / kcal END AS y, CASE WHEN kcal <= 0 THEN 0 ELSE c * 4 / kcal END AS z FROM e),
d AS (SELECT *, sqrt(({_FIT[0]})^2 + ({_FIT[1]})^2 + ({_FIT[2]})^2) AS fit FROM s)
SELECT recipe_id, round(kcal, 4) AS kcal, round(fit, 6) AS fit, round(CASE WHEN fit <= 1e-6 THEN 1.0 ELSE 1 / (1 + fit) END, 6) AS score, round({" + ".join(_OUTSIDE)}, 6) AS distance FROM d""",
    "m15_zones": """
WITH q AS (SELECT c_nationkey, quantile_cont(c_acctbal, [0.15, 0.25, 0.5, 0.75, 0.85]) AS q, count(*) AS n FROM customer GROUP BY 1), c AS (SELECT c_custkey, c_acctbal AS v, n, q[1] AS a, q[2] AS b, q[3] AS m, q[4] AS d, q[5] AS e, q[4] - q[2] AS w, greatest(q[5] - q[1], 1e-9) AS u FROM customer JOIN q USING (c_nationkey))
SELECT c_custkey, CASE WHEN w <= 1e-12 OR w / greatest(abs(m), abs(b), abs(d), 1e-9) <= 1e-6 OR v BETWEEN b AND d THEN 'green' WHEN v BETWEEN b - 0.25 * w AND d + 0.25 * w THEN 'yellow' ELSE 'red' END AS zone,
  CASE WHEN n < 5 THEN 'unknown' WHEN v BETWEEN a - 0.01 AND e + 0.01 THEN 'good' WHEN v BETWEEN a - 0.1 * u AND e + 0.1 * u THEN 'warn' ELSE 'bad' END AS band FROM c""",
    "m16_fidelity": """
WITH r AS (SELECT l_orderkey, max(l_discount) * 20 AS worst, count(*) FILTER (l_tax >= 0.08) AS n, bool_or(l_returnflag = 'A') AS hit, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN q >= 250 OR NOT hit OR n >= 1 OR worst > 1.9 THEN 'must_retry' WHEN worst <= 1.3 THEN 'accept' ELSE 'moderate' END AS band FROM r""",
    "m18_typicality": """
WITH v AS (SELECT c_nationkey, c_acctbal AS x, c_nationkey * 400.0::DOUBLE AS lo, c_nationkey * 400.0::DOUBLE + 100 AS hi FROM customer),
s AS (SELECT c_nationkey, lo, hi, count(*) FILTER (x BETWEEN lo - 1e-12 AND hi + 1e-12) AS i, count(*) FILTER (x < lo - 1e-12) AS b, count(*) FILTER (x > hi + 1e-12) AS a, count(*) AS n, quantile_cont(x, 0.5) AS mid FROM v GROUP BY 1, 2, 3)
SELECT c_nationkey, CASE WHEN i <= 2 THEN CASE WHEN mid < lo - 1e-12 OR (b > a AND mid <= hi + 1e-12) THEN 'very_high' WHEN mid > hi + 1e-12 OR a > b THEN 'very_low' WHEN (lo + hi) / 2 >= mid THEN 'very_high' ELSE 'very_low' END
  WHEN b / n >= 0.8 THEN 'slightly_high' WHEN a / n >= 0.8 THEN 'slightly_low' ELSE 'typical' END AS status FROM s""",
    "m19_badness": """
WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal / 1000 AS v FROM customer), m AS (SELECT c_nationkey, quantile_cont(v, 0.5) AS mid, count(*) AS n FROM c GROUP BY 1),
d AS (SELECT c.*, mid, n, abs(v - mid) AS e FROM c JOIN m USING (c_nationkey)), s AS (SELECT c_nationkey, quantile_cont(e, 0.5) AS mad FROM d GROUP BY 1),
z AS (SELECT c_custkey, CASE WHEN n = 1 THEN v ELSE (v - mid) / (1.4826 * mad + 1e-9) END AS z FROM d JOIN s USING (c_nationkey)) SELECT c_custkey, round(1 / (1 + exp(-greatest(-60.0, least(60.0, 1.5 * (z - 0.5))))), 6) AS badness FROM z""",
    "m20_churn": """
WITH p AS (SELECT l_orderkey AS recipe_id, l_partkey, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS a, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS r FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2),
s AS (SELECT recipe_id, count(*) FILTER (a > 0 AND r > 0) AS b, count(*) AS n, sum(abs(a - r)) AS l, sum(r) AS r FROM p GROUP BY 1) SELECT recipe_id, round(0.5 * (1 - b / n) + 0.5 * l / r, 6) AS churn FROM s WHERE r > 0""",
    "m21_least_hits": "SELECT o_custkey, greatest(3, least(15, ceil(0.2 * count(*))))::BIGINT AS least FROM orders GROUP BY 1",
    "m24_portion_changes": """
WITH l AS (SELECT l_orderkey AS recipe_id, l_quantity AS g, l_quantity * (1 - l_discount) AS x FROM lineitem), b AS (SELECT *, g * sum(x) OVER w / sum(g) OVER w AS base FROM l WINDOW w AS (PARTITION BY recipe_id)), r AS (SELECT recipe_id, x / greatest(base, 1e-3) AS r FROM b)
SELECT recipe_id, round(sum(ln(greatest(r, 1e-12))^2), 6) AS portion_score, round(avg(abs(r - 1)) * 100, 4) AS avg_pct_change, round(max(abs(r - 1)) * 100, 4) AS max_pct_change, round(min(r), 6) AS least, round(max(r), 6) AS most, round(sqrt(avg(ln(greatest(r, 1e-12))^2)), 6) AS rms_log_deviation FROM r GROUP BY 1""",
    "m25_bound_violations": _MACROS + """
SELECT recipe_id, p < 15 - 1e-6 OR p > 90 + 1e-6 AS protein_out, f < 600 * 0.2::DOUBLE / 9 - 1e-6 OR f > 600 * 0.35::DOUBLE / 9 + 1e-6 AS fat_out, c < 30 - 1e-6 OR c > 82.5 + 1e-6 AS carb_out, abs(p * 4 + f * 9 + c * 4 - 600) > 100 AS kcal_out FROM g""",
    "m26_token_cost": "SELECT source, round(sum(n_chars) / 4 / 1e6 * 2.5 + count(*) * 100 / 1e6 * 10.0, 6) AS cost FROM documents GROUP BY 1",
    "m27_cuisine_similarity": f"""
WITH f AS (SELECT unnest({_list(CUISINES)}) AS n, unnest([{", ".join(_list((n, *f)) for n, f in CUISINES.items())}]) AS f), o AS (SELECT o_orderkey, {_pick(CUISINES, "o_custkey")} AS a, {_pick(CUISINES, "o_orderkey")} AS b FROM orders)
SELECT o_orderkey, CASE WHEN a = b THEN 1.0 WHEN list_has_any(x.f, y.f) THEN 0.5 ELSE 0.0 END::DOUBLE AS similarity FROM o JOIN f x ON x.n = a JOIN f y ON y.n = b""",
    "m30_box_feasibility": """
WITH b AS (SELECT c_custkey, c_custkey % 7 / 20.0::DOUBLE AS x, c_custkey % 9 / 20.0::DOUBLE AS y, c_custkey % 11 / 20.0::DOUBLE AS z, c_nationkey % 5 / 10.0::DOUBLE AS w FROM customer)
SELECT c_custkey, CASE WHEN (x + w) + (y + w) + (z + w) < 1 - 1e-9 THEN 'maxes_too_small' WHEN x + y + z > 1 + 1e-9 THEN 'mins_too_large' ELSE 'feasible' END AS verdict FROM b""",
    "aj1_exploded_lists": """
WITH l AS (SELECT p_partkey AS food_id, [x FOR x IN json_extract_string('["' || replace(p_name, ' ', '","","') || '"]', '$[*]') IF trim(x) <> ''] AS l FROM part)
SELECT food_id, (unnest(range(len(l))))::INT AS idx, unnest(l) AS item FROM l""",
    "aj2_canonical_json": """
WITH j AS (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, event_type FROM events), m AS (SELECT event_id, k, '{"event":"' || event_type || '","k":' || k || '}' AS json FROM j) SELECT *, sha256(json) AS sha FROM m""",
    "aj4_weighted_levels": """
WITH f AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS w, p_brand AS b FROM part), p AS (SELECT a.id, a.w AS w, c.w AS v, a.b = c.b AS same FROM f a JOIN f c ON c.id = a.id + 1)
SELECT id AS food_id, round((0.45 * len(list_intersect(w, v)) / len(list_distinct(w || v)) + 0.3 * (w[-1] = v[-1])::INT + 0.15 * same::INT) / 0.9, 6)::DOUBLE AS similarity FROM p""",
    "aj6_least_in_box": "SELECT l_orderkey, min(l_quantity) FILTER (l_discount BETWEEN 0.02 AND 0.07 AND l_tax BETWEEN 0.01 AND 0.06) AS least FROM lineitem GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in SQL}

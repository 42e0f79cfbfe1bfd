"""Scores: findings weighed by the thousand counted characters, per document, over all, and per corpus set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.operators.tally import added
from proselens.rulesdata import FLOOR, LAYERS, RULE_ORDER, WEIGHTS

# The bounds of the two sides of a calibration.
HUMAN_MOST, MACHINE_LEAST = 5.0, 6.0


def rule_table(spark, weights: dict[str, float] | None = None) -> DataFrame:
    """rule, layer, layer_ord, rule_ord, weight: twenty rows."""
    weights = WEIGHTS if weights is None else weights
    names = list(LAYERS)
    rows = [(r, LAYERS[r[0]], names.index(r[0]), k, float(weights.get(r, 0.0))) for r, k in RULE_ORDER.items()]
    return spark.createDataFrame(rows, "rule string, layer string, layer_ord int, rule_ord int, weight double")


def below_floor(ja: Column, floor: int = FLOOR) -> Column:
    return (ja == 0) | (ja < floor)


def points(tallied: DataFrame, key: list[str], weights: dict[str, float] | None = None, floor: int = FLOOR) -> DataFrame:
    """tallied (key, ja_chars, sentences, n_<rule>) as key, ja_chars, sentences, mode, per_1000, by_layer and by_rule.

    The sums go layer by layer and rule by rule in their order, so that doubles come out alike everywhere.
    """
    weights = WEIGHTS if weights is None else weights
    ja = F.col("ja_chars").cast("double")
    low = below_floor(F.col("ja_chars"), floor)
    by_layer = []
    for letter in LAYERS:
        total = F.lit(0.0)
        for r in RULE_ORDER:
            if r[0] == letter:
                total = total + F.when(F.col(f"n_{r}") > 0, F.col(f"n_{r}") * float(weights.get(r, 0.0)) * 1000.0 / ja).otherwise(0.0)
        by_layer.append(total)
    whole = F.lit(0.0)
    for x in by_layer:
        whole = whole + x
    some = lambda letter: F.greatest(*(F.col(f"n_{r}") for r in RULE_ORDER if r[0] == letter), F.lit(0)) > 0
    layers = F.filter(F.array(*(F.struct(F.lit(name).alias("k"), x.alias("v"), some(letter).alias("ok")) for (letter, name), x in zip(LAYERS.items(), by_layer))), lambda e: e["ok"])
    rules = F.filter(F.array(*(F.struct(F.lit(r).alias("k"), F.col(f"n_{r}").cast("long").alias("v")) for r in RULE_ORDER)), lambda e: e["v"] > 0)
    return tallied.select(
        *key,
        "ja_chars",
        "sentences",
        F.when(low, "count_only").otherwise("normalized").alias("mode"),
        F.when(~low, whole).alias("per_1000"),
        F.when(~low, F.map_from_entries(F.transform(layers, lambda e: F.struct(e["k"], e["v"])))).alias("by_layer"),
        F.map_from_entries(rules).alias("by_rule"),
    )


def exceeds(threshold: float) -> Column:
    """A normalized score over the threshold; below the floor, any finding of the first two layers."""
    named = F.exists(F.map_keys("by_rule"), lambda r: F.left(r, F.lit(1)).isin("S", "L"))
    return F.when(F.col("mode") == "normalized", F.col("per_1000") > threshold).otherwise(named)


def document_scores(tallied: DataFrame, weights=None, floor: int = FLOOR) -> DataFrame:
    return points(tallied, ["doc_id"], weights, floor)


def grand_total(tallied: DataFrame, weights=None, floor: int = FLOOR) -> DataFrame:
    """One row, scored from the sums and not from the documents' scores."""
    return points(added(tallied), [], weights, floor)


def set_scores(tallied: DataFrame, members: DataFrame, weights=None, floor: int = FLOOR) -> DataFrame:
    """members: set_name, doc_id. A row a set, scored from its sums."""
    return points(added(members.join(tallied, "doc_id", "left"), "set_name"), ["set_name"], weights, floor)


def set_rates(scores: DataFrame, rules: DataFrame) -> DataFrame:
    """set_name, rule, rate: all rules, zero where a set has no finding or no counted character."""
    every = scores.crossJoin(rules.select("rule", "rule_ord"))  # twenty rules a set
    rate = F.coalesce(F.try_divide(F.coalesce(F.try_element_at("by_rule", F.col("rule")), F.lit(0)) * 1000.0, F.col("ja_chars")), F.lit(0.0))
    return every.select("set_name", "rule", "rule_ord", rate.alias("rate"))


def verdict(floor: int = FLOOR) -> Column:
    """Of ja_chars, judge, side ('human' or 'claude') and per_1000."""
    met = F.when(F.col("side") == "human", F.col("per_1000") <= HUMAN_MOST).otherwise(F.col("per_1000") >= MACHINE_LEAST)
    return F.when(F.col("ja_chars") == 0, "empty").when(below_floor(F.col("ja_chars"), floor), "below_floor").when(~F.col("judge"), "reference").when(met, "met").otherwise("violated")


def point_table(scores: DataFrame) -> DataFrame:
    """A row a set, a column a layer."""
    return scores.select("set_name", "per_1000", *(F.coalesce(F.try_element_at("by_layer", F.lit(n)), F.lit(0.0)).alias(n) for n in LAYERS.values()))


def rate_table(rates: DataFrame) -> DataFrame:
    """A row a set, a column a rule."""
    return rates.groupBy("set_name").pivot("rule", list(RULE_ORDER)).agg(F.first("rate"))

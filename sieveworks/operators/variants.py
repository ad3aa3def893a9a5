"""Trees as rows: VARIANT values walked level by level, and rows folded bottom-up into nested JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.operators import textclean
from sieveworks.operators.textclean import TextOptions
from sieveworks.sources.shared import saved

#: Levels of one plan.
STEPS = 8
_PATH = "array<struct<pos:int,key:string>>"


def quoted(value: Column) -> Column:
    """A string as a JSON literal; null: null."""
    literal = F.to_json(F.array(value))
    return F.substr(literal, F.lit(2), F.length(literal) - 2)


def nesting(json: Column) -> Column:
    """How deep the objects and arrays of a JSON text are nested; 0 for a scalar."""
    brackets = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*+"|[^\[\]{}"]', "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, c: Column) -> Column:
        now = state["now"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.coalesce(F.aggregate(F.split(brackets, ""), start, step)["most"], F.lit(0))


def leaves(df: DataFrame, value: str, depth: int) -> DataFrame:
    """df with ``path`` and ``leaf`` in place of its VARIANT column: a row for each scalar, empty object and empty array.

    path lists the position and, in an object, the key of each step from the root. Every level is one lateral
    variant_explode over what is still a container; nothing is shuffled, and every STEPS levels are saved. depth: the levels that are opened; what is
    deeper stays whole.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c != value]
    out = df.select(*rest, F.array().cast(_PATH).alias("path"), F.col(value).alias("leaf"))
    tvf = df.sparkSession.tvf
    for step in range(1, depth + 1):
        opens = F.when(F.substr(F.to_json("leaf"), F.lit(1), F.lit(1)).isin("{", "["), F.col("leaf"))
        met = out.withColumn("_open", opens).lateralJoin(tvf.variant_explode_outer(F.col("_open").outer()))
        inside = F.col("pos").isNotNull()
        path = F.when(inside, F.array_append("path", F.struct("pos", "key"))).otherwise(F.col("path"))
        out = met.select(*rest, path.alias("path"), F.when(inside, F.col("value")).otherwise(F.col("leaf")).alias("leaf"))
        if step % STEPS == 0 and step < depth:
            out = saved(out, "leaves")
    return out


def folded(rows: DataFrame, key: Sequence[str], depth: int) -> DataFrame:
    """(key, json): the rows (key, path, json) put together to one JSON text for each key, deepest level first.

    Each level is one shuffle by (key, path of the parent): what shares a parent becomes an object where it has keys,
    else an array, in the order of its positions. rows is read once a level; every STEPS levels end in a saved table.
    """
    above = None
    for level in range(depth, -1, -1):
        here = rows.filter(F.size("path") == level).select(*key, "path", "json")
        here = here if above is None else here.unionByName(above)
        if not level:
            break
        last, up = F.element_at("path", -1), F.slice("path", 1, level - 1)
        kid = F.struct(last["pos"].alias("pos"), last["key"].alias("key"), "json")
        groups = here.groupBy(*key, up.alias("path")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        members = F.concat(F.lit("{"), F.array_join(F.transform("kids", lambda x: F.concat(quoted(x["key"]), F.lit(":"), x["json"])), ","), F.lit("}"))
        items = F.concat(F.lit("["), F.array_join("kids.json", ","), F.lit("]"))
        above = groups.select(*key, "path", F.when(F.col("kids")[0]["key"].isNotNull(), members).otherwise(items).alias("json"))
        if level % STEPS == 0:
            above = saved(above, "folded")
    return here.select(*key, "json")


def scrub(df: DataFrame, value: str, options: TextOptions = textclean.SCRUB) -> DataFrame:
    """df with every string inside its VARIANT column cleaned, at any depth; keys, numbers, booleans and nulls stay.

    Values that hold no code point that a rule may change pass by. Of the others each distinct value is walked once,
    each distinct string in them is cleaned once, and the value is folded together again level by level, so that
    repeated values and repeated strings, however many, cost one. Values are told by the SHA-256 of their JSON text.

    Null values stay null; other columns stay, whatever their names. Objects come out as VARIANT keeps them, sorted by
    key.
    """
    text, name = F.to_json(F.col(f"`{value}`")), "_scrub"
    told = df.withColumn(name, F.when(textclean.touched(text, options), F.sha2(text, 256)))
    found = told.filter(F.col(name).isNotNull()).select(name, text.alias("json")).groupBy(name).agg(F.any_value("json").alias("json"))
    found = saved(found, "scrub-values")
    depth = found.agg(F.max(nesting(F.col("json")))).first()[0]
    if depth is None:
        return df
    opened = leaves(found.select(name, F.parse_json("json").alias("value")), "value", depth)
    plain = F.when(F.substr(F.to_json("leaf"), F.lit(1), F.lit(1)) == '"', F.try_variant_get("leaf", "$", "string"))
    opened = saved(opened.select(name, "path", F.to_json("leaf").alias("json"), plain.alias("text")), "scrub-leaves")
    strings = saved(opened.filter(textclean.touched(F.col("text"), options)).select("text").distinct(), "scrub-strings")
    cleaned = saved(textclean.clean(strings.select("text", F.col("text").alias("dirty")), "text", "dirty", options).select("text", "clean"), "scrub-clean")
    met = opened.join(cleaned, "text", "left").select(name, "path", F.coalesce(F.when(F.col("clean").isNotNull(), quoted(F.col("clean"))), F.col("json"), F.lit("null")).alias("json"))
    whole = folded(met, [name], depth).select(name, F.parse_json("json").alias("_clean"))
    return told.join(whole, name, "left").select(*(F.coalesce(F.col("_clean"), F.col(f"`{c}`")).alias(c) if c == value else F.col(f"`{c}`") for c in df.columns))

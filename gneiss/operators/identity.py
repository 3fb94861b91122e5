"""Identity of named entities: canonical names, scopes, refusals, and clusters under rules of what may not be one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.text import compact
from gneiss.operators.graph import components
from gneiss.shared import dropped, written

# Words that name no one thing, number words, and what is a value and no thing.
GENERIC = ["aircraft", "app", "battery", "bolt", "camera", "controller", "device", "drone", "gear", "product", "ring", "system", "unit", "valve", "widget"]
NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
_AMOUNT = r"(?i)^[+-]?[0-9]+([.][0-9]+)?\s*(g|kg|grams?|fps|mp|gb|tb|px|%|mm|cm|km|m|hz|mhz|ghz|v|mah|min|s)?$"
_SIZE = r"(?i)^[0-9]{3,5}\s*[x×]\s*[0-9]{3,5}$"
_MONEY = r"^[$€£¥]\s*[0-9.,]+$"
_FILE = r"(?i)^[\w.-]*[.](bin|hex|apj|px4|elf)$"
_ADDRESS = r"^([0-9]{1,3}[.]){3}[0-9]{1,3}$"
_SHORT_MODEL = r"(?i)^[a-z]{1,2}-?[0-9]{1,3}( (pro|lite))?$"


def canonical(name: Column) -> Column:
    """White space collapsed, no article or pointing word in front, inches and number words before axes and generations
    written with digits."""
    c = F.trim(F.regexp_replace(name, r"\s+", " "))
    c = F.regexp_replace(c, r"(?i)^(the|a|an|this|that)\s+", "")
    c = F.regexp_replace(c, r"(?i)\b([0-9]+)\s*-?\s*(in|inch|inches)\b", "$1-inch")
    for i, word in enumerate(NUMBERS, 1):
        c = F.regexp_replace(c, rf"(?i)\b{word}\b(?=([ -]*axis\b)|$)", str(i))
    return F.regexp_replace(c, r"(?i)\b([0-9]+)[ -]*axis\b", "$1-axis")


def is_value(name: Column) -> Column:
    """Whether a name is, as a whole, a measurement, number, price, file or address. A name that only holds one is none."""
    return name.rlike(_AMOUNT) | name.rlike(_SIZE) | name.rlike(_MONEY) | name.rlike(_FILE) | name.rlike(_ADDRESS)


def is_generic(name: Column) -> Column:
    return F.lower(name).isin(GENERIC)


def identities(mentions: DataFrame, kind: str, surface: str, name: str, scope: str, source: str) -> DataFrame:
    """mentions with canonical, refusal (null if there is none), scope_key, identity and alias_scope.

    scope is "global" or "source". Values are no entities at all; generic names and short models without a maker are no
    global ones. A global entity's alias holds everywhere only if its surface is the name itself but for spelling;
    otherwise in its source alone. Equal identities are equal entities.
    """
    c, world = canonical(F.col(name)), F.col(scope) == "global"
    named = mentions.withColumn("canonical", c)
    c = F.col("canonical")
    refusal = F.when(c.isNull() | (c == ""), "nameless").when(is_value(c), "value").when(world & is_generic(c), "generic").when(world & (F.col(kind) == "product") & c.rlike(_SHORT_MODEL), "short model")
    key = F.when(world, F.lit("global")).otherwise(F.concat(F.lit("source:"), F.col(source).cast("string")))
    loose = is_generic(F.col(surface)) | (compact(canonical(F.col(surface))) != compact(c))
    out = named.withColumn("refusal", refusal).withColumn("scope_key", F.when(F.col("refusal").isNull(), key))
    identity = F.sha2(F.concat_ws("\n", "scope_key", F.col(kind), F.lower("canonical")), 256)
    alias = F.when(world & loose, F.concat(F.lit("source:"), F.col(source).cast("string"))).otherwise(F.col("scope_key"))
    return out.withColumn("identity", F.when(F.col("refusal").isNull(), identity)).withColumn("alias_scope", F.when(F.col("refusal").isNull(), alias))


def clusters(nodes: DataFrame, keys: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, cluster, code) of nodes(id, code): nodes that share a key of keys(id, key), directly or through others, are
    one, but nodes of two different codes (what tells entities apart, as a generation does; null: unknown) never are.

    Nodes with a code keep it. The others take, by rounds of joins, the code that is fewest keys away, on ties the
    least; where a chain leads from one code to another it is cut halfway. Then nodes of one code that share a key are
    joined; those that no code reaches are joined among themselves. cluster is the least id. A key is a row that its
    nodes meet at, so its nodes are never paired, and partial minima go before each shuffle.
    """
    links = written(nodes.select("id", "code").join(keys.select("id", "key").distinct(), "id"), "links")
    known = written(nodes.filter("code IS NOT NULL").select("id", "code", F.lit(0).alias("far")), "codes")
    for far in range(1, most_rounds + 1):
        front = known.filter(F.col("far") == far - 1).select("id", F.col("code").alias("_c"))
        # Keys that a code of the last round reaches hand it on; the least of several.
        reached = links.join(front, "id").groupBy("key").agg(F.min("_c").alias("_c"))
        new = links.filter("code IS NULL").join(reached, "key").groupBy("id").agg(F.min("_c").alias("code")).join(known.select("id"), "id", "left_anti").withColumn("far", F.lit(far))
        grown = written(known.unionByName(new), "codes")
        if grown.filter(F.col("far") == far).isEmpty():
            known = grown
            break
        dropped(known)
        known = grown
    else:
        raise ValueError(f"codes are still spreading after {most_rounds} rounds")
    label = nodes.select("id").join(known.select("id", "code"), "id", "left")
    # A key is one place for each code that meets at it.
    meets = links.select("id", "key").join(label, "id").select("id", F.to_json(F.struct("key", "code")).alias("place"))
    places = written(meets.groupBy("place").agg(F.min("id").alias("first")), "places")
    same = meets.join(places, "place").select("id", "first").filter("id <> first")
    found = components(same, "id", "first").select(F.col("node").alias("id"), F.col("component").alias("_c"))
    return label.join(found, "id", "left").select("id", F.coalesce("_c", "id").alias("cluster"), "code")

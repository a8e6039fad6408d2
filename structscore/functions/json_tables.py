"""Tables in JSON: categories of dimensions, groups of these, or plain pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_fence

LEVELS = {1: "map<string,string>", 2: "map<string,map<string,string>>", 3: "map<string,map<string,map<string,string>>>"}


def values(text: Column) -> Column:
    """The JSON object that holds the table: `values` if there is one."""
    t = F.regexp_extract(strip_fence(text), "(?s)(\\{.*\\})", 1)
    return F.coalesce(F.get_json_object(t, "$.values"), t)


def depth(object_: Column) -> Column:
    """How deep objects nest at the first value: 1, 2 or 3; 0 if it isn't an object."""
    key = '\\s*"(?:[^"\\\\]|\\\\.)*"\\s*:\\s*'
    out = F.lit(0)
    for n, pattern in ((1, "(?s)^\\{"), (2, "(?s)^\\{" + key + "\\{"), (3, "(?s)^\\{" + key + "\\{" + key + "\\{")):
        out = F.when(object_.rlike(pattern), n).otherwise(out)
    return out


def json_table(object_: Column) -> Column:
    """Rows of the table that `values` found (a column of its own).

    Two levels: rows are dimensions, columns categories.  Three: rows are middle
    keys, columns `outer-inner`.  One: rows are pairs.
    """
    flat = F.from_json(object_, LEVELS[1])
    two = F.from_json(object_, LEVELS[2])
    three = F.from_json(object_, LEVELS[3])
    text = lambda x: F.coalesce(x, F.lit(""))

    pairs = F.concat(F.array(F.array(F.lit("key"), F.lit("value"))), F.transform(F.map_entries(flat), lambda e: F.array(e["key"], text(e["value"]))))

    names = F.map_keys(two)
    dimensions = F.array_distinct(F.flatten(F.transform(F.map_values(two), F.map_keys)))
    grid = F.transform(dimensions, lambda d: F.concat(F.array(d), F.transform(F.map_values(two), lambda m: text(F.try_element_at(m, d)))))
    plain = F.concat(F.array(F.concat(F.array(F.lit("")), names)), grid)

    middle = F.array_distinct(F.flatten(F.transform(F.map_values(three), F.map_keys)))
    columns = F.flatten(
        F.transform(
            F.map_entries(three),
            lambda e: F.transform(F.array_distinct(F.flatten(F.transform(F.map_values(e["value"]), F.map_keys))), lambda i: F.struct(e["key"].alias("o"), i.alias("i"))),
        )
    )
    deep = F.transform(
        middle,
        lambda m: F.concat(F.array(m), F.transform(columns, lambda c: text(F.try_element_at(F.try_element_at(F.try_element_at(three, c["o"]), m), c["i"])))),
    )
    nested = F.concat(F.array(F.concat(F.array(F.lit("")), F.transform(columns, lambda c: F.concat_ws("-", c["o"], c["i"])))), deep)
    d = depth(object_)
    none = F.array().cast("array<array<string>>")
    return F.coalesce(F.when(d == 3, nested).when(d == 2, plain).when(d == 1, pairs), none)

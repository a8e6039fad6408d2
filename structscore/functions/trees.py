"""Outlines (Markdown lists) as trees, by one ordered fold per text.

A tree is array<struct<name, path>>: nodes in order, `path` the positions of a
node's ancestors and itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import csv_table
from .text import is_quantity, let, lines, strip, strip_fence, without_mark

NODES = "array<struct<name:string,path:array<int>>>"

#: Between two names of one chain.
CHAIN = "——"

# Marks that separate two names inside one node.
SEPARATOR = "(?U)(?<=\\S)\\s*(?:——|—|->|-->|--|-|:|：)\\s*(?=\\S)"


def is_outline(text: Column) -> Column:
    """At least two lines start with a dash and a space."""
    return F.size(F.filter(lines(text), lambda x: x.rlike("^\\s*- "))) >= 2


ENTRIES = "array<struct<level:int,name:string>>"


def _entry(level: Column, name: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), name.alias("name"))


def _indent(line: Column) -> Column:
    """Width of the space before a line; a tab is two."""
    return F.length(F.replace(F.regexp_extract(line, "^([ \\t]*)", 1), F.lit("\t"), F.lit("  ")))


#: Entries that one inner fold takes; appending copies what an array holds, so no array that a step appends to is long.
FOLDED = 256


def nested(entries: Column) -> Column:
    """Nodes of entries in order; a parent is the last entry of a lower level."""
    none = F.array().cast(NODES)

    def add(s: Column, e: Column, before: Column) -> Column:
        above = F.filter(s["open"], lambda o: o["level"] < e["level"])
        at = before + F.size(s["nodes"])
        path = F.array_append(F.transform(above, lambda o: o["at"]), at)
        return F.struct(
            F.array_append(s["nodes"], F.struct(e["name"].alias("name"), path.alias("path"))).alias("nodes"),
            F.array_append(above, F.struct(e["level"].alias("level"), at.alias("at"))).alias("open"),
        )

    def fold(all_: Column) -> Column:
        start = F.struct(F.array().cast(f"array<{NODES}>").alias("done"), F.array().cast("array<struct<level:int,at:int>>").alias("open"))

        def add_all(s: Column, k: Column) -> Column:
            begin = F.struct(none.alias("nodes"), s["open"].alias("open"))
            made = F.aggregate(F.slice(all_, k * FOLDED + 1, F.lit(FOLDED)), begin, lambda t, e: add(t, e, k * FOLDED))
            return let(made, lambda m: F.struct(F.array_append(s["done"], m["nodes"]).alias("done"), m["open"].alias("open")))

        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor(F.size(all_) / FOLDED).cast("int")), start, add_all)["done"])

    return let(F.coalesce(entries, F.array().cast(ENTRIES)), fold)


def list_entries(text: Column) -> Column:
    """Entries of a Markdown list: two spaces or a tab are a level."""
    listed = F.filter(lines(text), lambda x: x.rlike("^\\s*(?:- |-\\S)") & ~x.rlike("^\\s*<[^>]+>") & x.rlike("^\\s*-\\s*[^\\s]"))
    return F.transform(listed, lambda x: _entry(F.floor(_indent(x) / 2), strip(F.regexp_replace(x, "^\\s*-\\s*", ""))))


def outline(text: Column) -> Column:
    """Nodes of a Markdown list."""
    return nested(list_entries(text))


def _ranked(entries: Column) -> Column:
    """Levels by their place among the levels that occur."""

    def placed(all_: Column) -> Column:
        return let(
            F.array_sort(F.array_distinct(F.transform(all_, lambda e: e["level"]))),
            lambda steps: F.transform(all_, lambda e: _entry(F.array_position(steps, e["level"]) - 1, e["name"])),
        )

    return let(entries, placed)


# Lines of nothing else are drawn, not written.
RULING = "-=_*~#"


def text_entries(text: Column) -> Column:
    """Entries of plain or indented lines, with or without item marks; rules and tags are no items."""

    def item(line: Column) -> Column:
        told = strip(line)
        drawn = (F.length(told) > 1) & (F.translate(told, RULING, "") == "")
        tag = told.startswith("<") & (F.instr(told, ">") > 2)
        return F.when(~drawn & ~tag, _entry(_indent(line), without_mark(told)))

    return let(F.filter(F.transform(lines(text), item), lambda e: F.coalesce(e["name"] != "", F.lit(False))), _ranked)


def _once(entries: Column) -> Column:
    """The first entry of each name, whatever its case."""
    keys = lambda e: F.lower(e["name"])
    return let(entries, lambda all_: let(F.transform(all_, keys), lambda names: F.filter(all_, lambda e, i: F.array_position(names, keys(e)) == i + 1)))


def _piped(line: Column) -> Column:
    """struct<indent, cells> of a line: its names between pipes, without emphasis; numbers are blank."""
    bare = F.transform(F.split(F.replace(line, F.lit("**"), F.lit("")), "\\|"), strip)
    names = F.when(F.contains(line, F.lit("|")), F.transform(bare, lambda c: F.when(is_quantity(c), "").otherwise(c))).otherwise(F.array(strip(line)))
    return F.struct(_indent(line).cast("int").alias("indent"), names.alias("cells"))


def _said_again(names: Column) -> Column:
    """Names that a list holds more than once."""
    return let(names, lambda n: F.array_distinct(F.filter(n, lambda x, i: F.array_position(n, x) <= i)))


def pipe_rows(text: Column) -> Column:
    """struct<root, rows> of a pipe table's lines: its first line if that has no pipe, and the others as indents and cells; null if it is none."""

    def read(given: Column) -> Column:
        head = strip(F.get(given, F.lit(0)))
        told = F.filter(F.slice(given, 2, F.greatest(F.size(given), F.lit(1))), lambda x: strip(x) != "")
        piped = F.filter(given, lambda x: F.contains(x, F.lit("|")))
        fits = (F.size(given) >= 2) & (2 * F.size(piped) >= F.size(given)) & (F.size(told) > 0)
        root = F.when(F.contains(head, F.lit("|")), "").otherwise(head)
        return F.when(fits, F.struct(root.alias("root"), F.transform(told, _piped).alias("rows")))

    return let(lines(strip(F.coalesce(text, F.lit("")))), read)


def _first_cells(rows: Column) -> Column:
    """The first cell of each row that has something beside it, in lower case."""
    beside = F.filter(rows, lambda r: (F.get(r["cells"], F.lit(0)) != "") & (F.coalesce(F.get(r["cells"], F.lit(1)), F.lit("")) != ""))
    return F.transform(beside, lambda r: F.lower(F.get(r["cells"], F.lit(0))))


def pipe_parents(table: Column) -> Column:
    """First cells of `pipe_rows` that stand beside something twice or more: parents of what is beside them."""
    return _said_again(_first_cells(table["rows"]))


def pipe_levels(table: Column, parents: Column) -> Column:
    """Entries of `pipe_rows` with levels by `pipe_parents`, or by indents where there are none; the root's first."""
    any_ = F.size(parents) > 0

    def of(row: Column) -> Column:
        under = F.array_contains(parents, F.lower(F.get(row["cells"], F.lit(0)))).cast("int")
        return F.transform(row["cells"], lambda c, i: _entry(F.when(any_, F.least(i, under)).otherwise(row["indent"]), c))

    made = F.flatten(F.transform(table["rows"], of))
    return F.when(table.isNotNull(), F.when(any_, made).otherwise(_ranked(made)))


def named_once(table: Column, entries: Column) -> Column:
    """The root and the entries that have a name, each name once."""
    root = F.when(table["root"] == "", F.array().cast(ENTRIES)).otherwise(F.array(_entry(F.lit(0), table["root"])))
    named = _once(F.concat(root, F.filter(entries, lambda e: e["name"] != "")))
    return F.coalesce(F.when(table.isNotNull(), named), F.array().cast(ENTRIES))


def pipe_entries(text: Column) -> Column:
    """Entries of an outline that was answered as a pipe table; none unless half of its lines are piped.

    The first line is a header, or the root if it has no pipe.  A first cell that
    has something beside it twice or more is a parent of what is beside it;
    without such cells the indent tells the level.  Numbers are no nodes, and a
    name counts once.  Where columns can be set in between, the four steps are
    planned much faster one by one.
    """
    return let(pipe_rows(text), lambda t: let(pipe_parents(t), lambda p: named_once(t, pipe_levels(t, p))))


# Parents of roots.
NO_PARENT = ["", "0", "-1", "None", "null"]


def adjacency_entries(text: Column) -> Column:
    """Entries of a comma-separated table id, parent_id, name, children in the order of their rows.

    Columns are found by their names, else the first three count.  A row whose
    parent isn't there is a root; of equal ids the first row tells the place and
    the last the name; rows in a circle are left out.
    """
    none = F.array().cast(ENTRIES)
    names = ("id", "parent_id", "name")

    def read(rows: Column) -> Column:
        head = F.transform(F.get(rows, F.lit(0)), lambda c: F.lower(c))
        named = F.size(F.array_except(F.array(*map(F.lit, names)), head)) == 0
        headed = F.exists(head, lambda c: c.isin(*names))
        at = [F.when(named, F.array_position(head, n) - 1).otherwise(i).cast("int") for i, n in enumerate(names)]
        body = F.when(headed, F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))).otherwise(rows)
        full = F.filter(body, lambda r: F.size(r) >= 3)
        made = F.transform(full, lambda r: F.struct(*[F.coalesce(strip(F.get(r, i)), F.lit("")).alias(n) for i, n in zip(at, names, strict=True)]))
        return let(F.filter(made, lambda r: r["id"] != ""), placed)

    def placed(rows: Column) -> Column:
        ids = F.transform(rows, lambda r: r["id"])
        own = F.filter(rows, lambda r, i: F.array_position(ids, r["id"]) == i + 1)

        def climbed(kept: Column) -> Column:
            ids_ = F.transform(kept, lambda r: r["id"])
            # place of each row's parent, -1 for roots
            parents = F.transform(kept, lambda r: F.when(r["parent_id"].isin(NO_PARENT), -1).otherwise(F.array_position(ids_, r["parent_id"]) - 1).cast("int"))
            last = lambda r: F.element_at(F.filter(rows, lambda x: x["id"] == r["id"]), -1)["name"]

            def with_paths(up: Column) -> Column:
                def climb(i: Column) -> Column:
                    start = F.array(i.cast("int"))
                    step = lambda path, _: F.when(F.get(up, F.element_at(path, 1)) >= 0, F.array_prepend(path, F.get(up, F.element_at(path, 1)))).otherwise(path)
                    return F.aggregate(F.sequence(F.lit(1), F.size(kept)), start, step)

                listed = F.transform(kept, lambda r, i: F.struct(climb(i).alias("path"), last(r).alias("name")))
                rooted = F.filter(listed, lambda x: F.get(up, F.element_at(x["path"], 1)) < 0)
                return F.transform(F.array_sort(rooted), lambda x: _entry(F.size(x["path"]) - 1, x["name"]))

            return let(parents, with_paths)

        return F.when(F.size(own) > 0, let(own, climbed)).otherwise(none)

    return let(csv_table(strip_fence(text)), lambda rows: F.when(F.size(rows) > 0, read(rows)).otherwise(none))


def paths(nodes: Column) -> Column:
    """array<array<string>>: the names from the root to every node."""
    return F.transform(nodes, lambda n: F.transform(n["path"], lambda i: F.get(nodes, i)["name"]))


def child_counts(nodes: Column) -> Column:
    """How many children each node has, in node order."""

    def counted(all_: Column) -> Column:
        parents = F.transform(F.filter(all_, lambda n: F.size(n["path"]) > 1), lambda n: F.get(n["path"], F.size(n["path"]) - 2))
        # every place once and once more for each child, in order: the distance between the first of a place and of the next
        each = F.sort_array(F.concat(parents, F.sequence(F.lit(0), F.size(all_) - 1)))
        return let(each, lambda x: let(F.concat(F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1))), F.array(F.size(x))), spread))

    def spread(firsts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(firsts) - 2), lambda i: F.get(firsts, i + 1) - F.get(firsts, i) - 1)

    return let(nodes, lambda all_: F.when(F.size(all_) == 0, F.array().cast("array<int>")).when(all_.isNotNull(), counted(all_)))


def merged_paths(nodes: Column, children: Column) -> Column:
    """Paths after only children are joined to their parents by a chain mark.

    A node that has not exactly one child ends a chain; its path groups its
    ancestors by chains.  Separators inside names count as chain marks.
    """

    def read(all_: Column) -> Column:
        return F.transform(all_, lambda n: F.struct(F.regexp_replace(n["name"], SEPARATOR, CHAIN).alias("name"), n["path"].alias("path")))

    def joined(all_: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            name = F.get(all_, i)["name"]
            chained = F.concat(F.element_at(acc["names"], -1), F.lit(CHAIN), name)
            head = F.slice(acc["names"], 1, F.greatest(F.size(acc["names"]) - 1, F.lit(0)))
            return F.struct(
                F.when(acc["single"], F.array_append(head, chained)).otherwise(F.array_append(acc["names"], name)).alias("names"),
                (F.get(children, i) == 1).alias("single"),
            )

        start = F.struct(F.array().cast("array<string>").alias("names"), F.lit(False).alias("single"))
        ends = F.filter(all_, lambda n: F.get(children, F.element_at(n["path"], -1)) != 1)
        return F.transform(ends, lambda n: F.aggregate(n["path"], start, step)["names"])

    return let(let(nodes, read), joined)

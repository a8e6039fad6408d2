"""Pie charts answered in other forms than a table of names and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_quantity, let, lines, strip, strip_fence

# A cell that holds more characters, and a grid of more cells, is no pie.
LONGEST_CELL, MOST_CELLS = 200, 200

PAIRS = "array<struct<name:string,share:string>>"


def is_pie(chart_type: Column) -> Column:
    named = F.lower(chart_type)
    return F.coalesce(F.contains(named, F.lit("饼图")) | F.contains(named, F.lit("pie")), F.lit(False))


def _pair(name: Column, share: Column) -> Column:
    return F.struct(strip(name).alias("name"), strip(share).alias("share"))


def name_and_share(cell: Column) -> Column:
    """struct<name, share> of a cell that holds both; null where it is a number alone, or holds none at its end.

    A cell is read from its right end: everything behind a comma, all of a last
    pair of brackets, or a last word that is a percentage.
    """

    def after_a_comma(t: Column) -> Column:
        def cut(parts: Column) -> Column:
            joined = lambda a, n: F.array_join(F.slice(parts, a, n), ",")
            count = F.size(parts)
            ways = F.transform(F.sequence(F.lit(1), count - 1), lambda i: _pair(joined(F.lit(1), i), joined(i + 1, count)))
            return F.when(count > 1, ways).otherwise(F.array().cast(PAIRS))

        return let(F.split(t, ","), cut)

    def in_brackets(t: Column) -> Column:
        inside = F.substring_index(F.translate(t, "（）", "()"), "(", -1)
        closed = (F.length(inside) < F.length(t)) & inside.endswith(")")
        name = F.left(t, F.length(t) - F.length(inside) - 1)
        return F.when(closed, F.array(_pair(name, F.left(inside, F.length(inside) - 1)))).otherwise(F.array().cast(PAIRS))

    def last_word(t: Column) -> Column:
        word = F.substring_index(F.translate(t, "\t\n\r\u3000\u00a0", "     "), " ", -1)
        return F.when(word.endswith("%"), F.array(_pair(F.left(t, F.length(t) - F.length(word)), word))).otherwise(F.array().cast(PAIRS))

    def read(t: Column) -> Column:
        ways = F.concat(after_a_comma(t), in_brackets(t), last_word(t))
        fits = F.filter(ways, lambda w: (w["name"] != "") & ~is_quantity(w["name"]) & is_quantity(w["share"]))
        return F.when((F.length(t) <= LONGEST_CELL) & ~is_quantity(t), F.get(fits, F.lit(0)))

    return let(strip(F.coalesce(cell, F.lit(""))), read)


def _table(pairs: Column) -> Column:
    return F.concat(F.array(F.array(F.lit(""), F.lit(""))), F.transform(pairs, lambda p: F.array(p["name"], p["share"])))


def _without_first(items: Column) -> Column:
    return F.slice(items, 2, F.greatest(F.size(items), F.lit(1)))


def mermaid_pie(text: Column) -> Column:
    """Rows of a Mermaid pie, with % behind bare values up to 100; null unless it has two slices.

    By Mermaid's grammar: the word pie opens the chart, and a slice is a label in
    double quotes, a colon and a number.
    """
    told = F.filter(F.transform(lines(strip_fence(text)), strip), lambda x: x != "")
    opens = F.exists(F.slice(told, 1, 3), lambda x: F.lower(F.substring_index(F.translate(x, "\t", " "), " ", 1)) == "pie")

    def slice_(line: Column) -> Column:
        parts = F.split(line, '"')
        behind = strip(F.array_join(F.slice(parts, 3, F.size(parts)), '"'))
        said = (F.size(parts) > 2) & line.startswith('"') & behind.startswith(":")
        return F.when(said, _pair(F.get(parts, F.lit(1)), F.substring(behind, F.lit(2), F.length(behind))))

    def finished(p: Column) -> Column:
        size = F.replace(p["share"], F.lit(","), F.lit("")).try_cast("double")
        share = F.when(size.between(0, 100), F.concat(p["share"], F.lit("%"))).otherwise(p["share"])
        return _pair(F.coalesce(name_and_share(p["name"])["name"], p["name"]), share)

    slices = F.filter(F.transform(told, slice_), lambda p: F.coalesce((p["name"] != "") & is_quantity(p["share"]), F.lit(False)))
    return F.when(opens, let(slices, lambda p: F.when(F.size(p) >= 2, _table(F.transform(p, finished)))))


def _from_pairs(rows: Column, pairs: Column) -> Column:
    """What a table becomes by the pairs in its cells (null where a cell has none, no row for the header)."""
    head, body = F.get(rows, F.lit(0)), _without_first(rows)
    cells, found = F.flatten(body), F.flatten(pairs)
    full = F.filter(F.zip_with(cells, found, lambda c, p: F.struct((strip(c) != "").alias("said"), p.alias("p"))), lambda x: x["said"])
    # every cell that says anything is a name with its share: a row for each cell
    all_pairs = (F.size(full) >= 2) & (F.size(cells) <= MOST_CELLS) & F.forall(full, lambda x: x["p"].isNotNull())
    # all cells of one column are: it becomes two columns
    glued = F.filter(F.sequence(F.lit(1), F.greatest(F.size(head), F.lit(1))), lambda i: (i <= F.size(head)) & F.forall(pairs, lambda r: F.get(r, i - 1).isNotNull()))

    def parted(i: Column) -> Column:
        def around(row: Column, two: Column) -> Column:
            return F.concat(F.slice(row, 1, i - 1), two, F.slice(row, i + 1, F.greatest(F.size(row), F.lit(1))))

        named = F.zip_with(body, pairs, lambda row, p: around(row, let(F.get(p, i - 1), lambda x: F.array(x["name"], x["share"]))))
        return F.concat(F.array(around(head, F.array(F.lit(""), F.lit("")))), named)

    return F.when(all_pairs, _table(F.transform(full, lambda x: x["p"]))).otherwise(let(F.get(glued, F.lit(0)), lambda i: F.when(i.isNotNull(), parted(i)).otherwise(rows)))


def pie_rows(text: Column, rows: Column) -> Column:
    """`rows` (what `text` was read as) as a pie's table: a Mermaid pie, a grid of pairs, a column of pairs, or as they are."""
    pairs = F.transform(_without_first(rows), lambda r: F.transform(r, name_and_share))
    read = F.when(F.size(rows) >= 2, let(pairs, lambda p: _from_pairs(rows, p))).otherwise(rows)
    return F.coalesce(mermaid_pie(text), read)

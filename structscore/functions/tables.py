"""Tables as arrays of rows, alignment of two tables, and their triples.

A table is array<array<string>>, its header first.  All of it is expressions:
a prediction and its reference stay in one row, so nothing is shuffled.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import half_width, let, lines, normal_key, python_float, strip

Table = Column


def cells(line: Column) -> Column:
    """The cells of one pipe line: outer pipes go, cells are stripped."""
    inner = F.regexp_replace(strip(line), "^\\||\\|$", "")
    return F.transform(F.split(inner, "\\|"), strip)


def is_rule(row: Column) -> Column:
    """A Markdown rule row: only dashes and colons."""
    return F.forall(row, lambda c: c.rlike("^:?-+:?$"))


def markdown_table(text: Column) -> Table:
    """Pipe lines of a Markdown table, without its rule row."""
    rows = F.transform(F.filter(lines(text), lambda x: F.contains(x, F.lit("|"))), cells)
    return F.filter(rows, lambda r: ~is_rule(r))


def is_markdown_table(text: Column) -> Column:
    has = lines(text)
    return F.exists(has, lambda x: x.rlike("^\\s*\\|.*\\|\\s*$")) & F.exists(has, lambda x: x.rlike("^\\s*\\|?[\\s:|-]*-[\\s:|-]*\\|[\\s:|-]*$"))


def modal_width(rows: Table) -> Column:
    """The commonest row width; of equally common ones the first seen."""
    widths = F.transform(rows, lambda r: F.size(r))
    ranked = F.transform(F.array_distinct(widths), lambda w, i: F.struct(F.size(F.filter(widths, lambda x: x == w)).alias("n"), (-i).alias("first"), w.alias("w")))
    return F.array_max(ranked)["w"]


def is_pipe_table(text: Column) -> Column:
    """Headless pipe table: most lines piped, most of these equally wide."""
    full = F.filter(lines(text), lambda x: strip(x) != "")
    piped = F.transform(F.filter(full, lambda x: F.contains(x, F.lit("|"))), cells)

    def regular(p: Column) -> Column:
        same = let(modal_width(p), lambda w: F.size(F.filter(p, lambda r: F.size(r) == w)))
        return (F.size(p) >= 2) & (F.size(p) * 10 >= F.size(full) * 7) & (same * 10 >= F.size(p) * 7)

    return let(piped, regular)


def pipe_table(text: Column) -> Table:
    """Rows of the modal width; two rows with numbers only in the second are turned."""
    piped = F.filter(F.transform(F.filter(lines(text), lambda x: F.contains(x, F.lit("|"))), cells), lambda r: ~is_rule(r))

    def regular(p: Column) -> Column:
        rows = let(modal_width(p), lambda w: F.filter(p, lambda r: F.size(r) == w))

        def turned(r: Column) -> Column:
            second = F.element_at(r, 2)
            numeric = F.forall(F.slice(second, 2, F.size(second)), lambda c: python_float(F.regexp_replace(c, "[%,$]", "")).isNotNull())
            wide = (F.size(r) == 2) & (F.size(F.element_at(r, 1)) > 2)
            return F.when(wide & numeric, transpose(r)).otherwise(r)

        return let(rows, turned)

    return let(piped, regular)


def csv_table(text: Column) -> Table:
    """Comma-separated lines; a quoted cell may hold commas, doubled quotes and line ends."""

    def row(line: Column) -> Column:
        # the empty alternative keeps empty cells; the mark at the end keeps the last one
        parts = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit('("(?:[^"]|"")*"|[^,]*),'), F.lit(1))
        return F.transform(parts, lambda c: strip(F.when(c.rlike('(?s)^".*"$'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)))

    # a row goes on while a quote that begins a cell is open; other quotes are text
    unclosed = '(?s)^(?:"(?:[^"]++|"")*+"[^,]*+,|(?!")[^,]*+,)*+"(?:[^"]++|"")*+$'

    def gather(rows: Column, line: Column) -> Column:
        last = F.element_at(rows, -1)
        open_ = (F.size(rows) > 0) & last.rlike(unclosed)
        head = F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0)))
        return F.when(open_, F.array_append(head, F.concat(last, F.lit("\n"), line))).otherwise(F.array_append(rows, line))

    def split(x: Column) -> Column:
        joined = F.aggregate(lines(x), F.array().cast("array<string>"), gather)
        return F.when(F.contains(x, F.lit('"')), joined).otherwise(lines(x))

    return F.transform(F.filter(let(F.coalesce(text, F.lit("")), split), lambda x: strip(x) != ""), row)


def is_csv(text: Column) -> Column:
    full = F.filter(lines(text), lambda x: strip(x) != "")
    return let(full, lambda x: (F.size(x) >= 2) & (F.size(F.filter(x, lambda y: F.contains(y, F.lit(",")))) * 2 >= F.size(x)))


def _entity_names() -> dict[str, str]:
    """HTML's entity names, as Python's library has them; those that end in a semicolon."""
    return {name[:-1]: mark for name, mark in html5.items() if name.endswith(";")}


def _names_by_letter() -> list[dict[str, str]]:
    """The names from A to z by their first letter: a lookup goes through its map entry by entry."""
    shelves: list[dict[str, str]] = [{} for _ in range(ord("z") - ord("A") + 1)]
    for name, mark in _entity_names().items():
        shelves[ord(name[0]) - ord("A")][name] = mark
    return shelves


#: JSON of the names, which Spark reads into literal maps once.
_NAMES = json.dumps(_names_by_letter(), ensure_ascii=False)


def _number_marks() -> dict[int, str]:
    """Numbers from 128 to 159 stand for what Windows-1252 has there, where it has anything."""
    marks = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}
    return {n: mark for n, mark in marks.items() if mark}


def _numbered(number: Column) -> Column:
    """The character of a code point; what is none is U+FFFD."""
    bad = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    windows = F.create_map(*[F.lit(x) for n, mark in _number_marks().items() for x in (n, mark)])
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(bad, "\ufffd").when(number.between(128, 159), F.coalesce(windows[number.cast("int")], char)).otherwise(char)


def decoded_entities(text: Column) -> Column:
    """Text with entities as their characters: names with their semicolon, decimal and hexadecimal numbers; unknown ones stay."""
    names = F.from_json(F.lit(_NAMES), "array<map<string,string>>")

    def mark(part: Column) -> Column:
        body = F.substring_index(part, ";", 1)
        rest = F.substring(part, F.length(body) + 2, F.length(part))
        hexadecimal = F.lower(F.left(body, F.lit(2))) == "#x"
        digits = F.when(hexadecimal, F.substring(body, F.lit(3), F.length(body))).otherwise(F.substring(body, F.lit(2), F.length(body)))
        valid = F.when(hexadecimal, F.translate(F.lower(digits), "0123456789abcdef", "") == "").otherwise(F.translate(digits, "0123456789", "") == "")
        number = F.when(F.length(digits) > 15, F.lit(1 << 40)).otherwise(F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint"))
        char = F.when(body.startswith("#"), F.when(valid & (digits != ""), _numbered(number))).otherwise(F.get(names, F.ascii(body) - ord("A"))[body])
        known = F.when(F.length(body) < F.length(part), char)
        return F.coalesce(F.concat(known, rest), F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    decoded = let(parts, lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform(F.slice(p, 2, F.size(p)), mark), "")))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def html_text(cell: Column) -> Column:
    """Text of an HTML fragment: breaks are spaces, tags go, entities decode, space squeezes."""
    t = F.regexp_replace(cell, "(?i)<\\s*br\\s*/?\\s*>", " ")
    t = F.regexp_replace(t, "(?s)<[^>]*>", "")
    return strip(F.regexp_replace(decoded_entities(t), "(?U)\\s+", " "))


def is_html_table(text: Column) -> Column:
    return text.rlike("(?i)<table") & text.rlike("(?i)<tr") & text.rlike("(?i)<t[dh]")


def html_table(text: Column) -> Table:
    """The first table's rows; colspan repeats a cell to the right, rowspan carries it down."""
    body = F.regexp_extract(text, "(?is)<table[^>]*>(.*?)</table>", 1)
    rows = F.regexp_extract_all(body, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))

    def span(tag: Column, name: str) -> Column:
        found = F.regexp_extract(tag, f'(?is)^<t[dh][^>]*{name}\\s*=\\s*["\']?([0-9]+)', 1)
        # a cast that fails throws within: most tags have no span, so these aren't cast
        return F.greatest(F.lit(1), F.coalesce(F.when(found != "", found.try_cast("int")), F.lit(1)))

    def row(tr: Column) -> Column:
        tags = F.regexp_extract_all(tr, F.lit("(?is)(<t[dh][^>]*>.*?)(?=</t[dh]>|<t[dh]|$)"), F.lit(1))
        wide = F.transform(tags, lambda t: F.array_repeat(F.struct(html_text(t).alias("text"), span(t, "rowspan").alias("down")), span(t, "colspan")))
        return F.flatten(wide)

    grid = F.transform(F.filter(rows, lambda r: r.rlike("(?i)<t[dh]")), row)
    start = F.struct(
        F.array().cast("array<array<string>>").alias("rows"),
        F.array().cast("array<struct<text:string,down:int>>").alias("open"),
    )

    def place(state: Column, own: Column) -> Column:
        # cells still open from above keep their columns; own cells fill the rest from the left
        cell = "struct<text:string,down:int>"
        n = F.greatest(F.size(state["open"]), F.lit(0)) + F.size(own)
        empty = F.struct(F.array().cast(f"array<{cell}>").alias("out"), F.lit(1).alias("next"))

        def put(acc: Column, i: Column) -> Column:
            above = F.get(state["open"], i)
            mine = F.get(own, acc["next"] - 1)
            carried = F.struct(above["text"].alias("text"), (above["down"] - 1).cast("int").alias("down"))
            use_above = F.coalesce(above["down"] > 1, F.lit(False))
            return F.struct(
                F.when(use_above, F.array_append(acc["out"], carried))
                .when(mine.isNotNull(), F.array_append(acc["out"], F.struct(mine["text"].alias("text"), mine["down"].cast("int").alias("down"))))
                .otherwise(acc["out"])
                .alias("out"),
                (acc["next"] + F.when(use_above | mine.isNull(), 0).otherwise(1)).alias("next"),
            )

        def done(out: Column) -> Column:
            return F.struct(F.array_append(state["rows"], F.transform(out, lambda c: c["text"])).alias("rows"), out.alias("open"))

        return let(F.aggregate(F.sequence(F.lit(0), n), empty, put)["out"], done)

    plain = F.transform(grid, lambda r: F.transform(r, lambda c: c["text"]))
    placed = F.when(body.rlike("(?i)rowspan"), F.aggregate(grid, start, place)["rows"]).otherwise(plain)

    def even(t: Column) -> Column:
        widest = F.coalesce(F.array_max(F.transform(t, lambda r: F.size(r))), F.lit(0))
        padded = F.transform(t, lambda r: F.concat(r, F.array_repeat(F.lit(""), widest - F.size(r))))
        return F.filter(padded, lambda r: F.exists(r, lambda c: c != ""))

    return let(placed, even)


def transpose(rows: Table) -> Table:
    """Columns as rows, cut to the narrowest row."""
    width = F.array_min(F.transform(rows, lambda r: F.size(r)))
    return let(width, lambda w: F.when(w > 0, F.transform(F.sequence(F.lit(0), w - 1), lambda j: F.transform(rows, lambda r: F.get(r, j)))).otherwise(rows))


def any_table(text: Column) -> Table:
    """The table in a text, by the first form that fits: HTML, Markdown, pipes, comma-separated."""
    empty = F.array().cast("array<array<string>>")
    return (
        F.when(F.coalesce(text, F.lit("")) == "", empty)
        .when(is_html_table(text), html_table(text))
        .when(is_markdown_table(text), markdown_table(text))
        .when(is_pipe_table(text), pipe_table(text))
        .when(is_csv(text), csv_table(text))
        .otherwise(empty)
    )


# -- alignment ---------------------------------------------------------------


def headless(rows: Table) -> Column:
    """No header: all of it is empty, or all but its first cell."""
    h = F.get(rows, F.lit(0))
    rest = F.slice(h, 2, F.greatest(F.size(h), F.lit(1)))
    return F.coalesce((F.size(rows) > 0) & F.forall(rest, lambda c: strip(c) == "") & ((F.size(h) >= 2) | (strip(F.get(h, F.lit(0))) == "")), F.lit(False))


def blank_header(rows: Table) -> Table:
    blank = F.transform(F.get(rows, F.lit(0)), lambda c: F.lit(""))
    return F.concat(F.array(blank), F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))))


def drop_first_column(rows: Table) -> Table:
    return F.transform(rows, lambda r: F.when(F.size(r) > 1, F.slice(r, 2, F.size(r))).otherwise(r))


def counts_up(rows: Table) -> Column:
    """An unnamed first column that holds 0, 1, 2 ... or 1, 2, 3 ..., two rows at least."""
    first = F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda r: strip(F.get(r, F.lit(0))).try_cast("int"))

    def steady(x: Column) -> Column:
        start = F.get(x, F.lit(0))
        return start.isin(0, 1) & F.forall(F.transform(x, lambda v, i: F.coalesce(v == start + i, F.lit(False))), lambda ok: ok)

    return F.coalesce((strip(F.get(F.get(rows, F.lit(0)), F.lit(0))) == "") & (F.size(first) >= 2) & let(first, steady), F.lit(False))


def aligned(pred: Table, ref: Table) -> Column:
    """struct<pred, ref>: the two tables with headers and index columns made comparable.

    In this order, the first that fits: the reference has no header, so the
    prediction's is blanked; the prediction has none, so the reference's is, if
    sizes agree; the prediction has one column more, a named one before an
    unnamed first or a running number, which goes; both have two columns and
    name their values, so both headers are blanked.
    """
    np, nr = F.size(pred), F.size(ref)
    hp, hr = headless(pred), headless(ref)

    def width(t: Table) -> Column:
        return F.size(F.coalesce(F.get(t, F.lit(1)), F.get(t, F.lit(0))))

    def name(t: Table, i: int) -> Column:
        return F.coalesce(strip(F.get(F.get(t, F.lit(0)), F.lit(i))), F.lit(""))

    near = F.abs(np - nr) <= 1
    both = ~hp & ~hr & (np > 1) & (nr > 1)
    wider = both & near & (width(pred) == width(ref) + 1) & (width(ref) >= 2)
    named = (name(ref, 0) == "") & (name(pred, 0) != "")
    two = both & near & (width(pred) == 2) & (width(ref) == 2) & (name(pred, 1) != "") & (name(ref, 1) != "")
    two = two & (((name(pred, 0) == "") == (name(ref, 0) == "")) | ((name(pred, 0) != "") & (name(ref, 0) == "")))

    def pair(p: Table, r: Table) -> Column:
        return F.struct(p.alias("pred"), r.alias("ref"))

    return (
        F.when(hr & ~hp & (np > 1), pair(blank_header(pred), ref))
        .when(hp & ~hr & (nr > 1) & near & (width(pred) == width(ref)) & (width(ref) >= 2), pair(pred, blank_header(ref)))
        .when(wider & (named | counts_up(pred)), pair(drop_first_column(pred), ref))
        .when(two, pair(blank_header(pred), blank_header(ref)))
        .otherwise(pair(pred, ref))
    )


# -- triples -------------------------------------------------------------------


def _value(cell: Column) -> Column:
    return F.regexp_replace(half_width(strip(cell)), "[%$]", "")


def triple(k0: Column, k1: Column, value: Column) -> Column:
    """Keys in order and lower case, the value as a number if it is one, else as lower-case text."""

    def of(v: Column) -> Column:
        return let(
            python_float(v),
            lambda n: F.struct(
                F.lower(F.least(k0, k1)).alias("k0"),
                F.lower(F.greatest(k0, k1)).alias("k1"),
                n.alias("num"),
                F.when(n.isNull(), F.lower(v)).alias("txt"),
            ),
        )

    return let(value, of)


EMPTY_TRIPLES = "array<struct<k0:string,k1:string,num:double,txt:string>>"


def header_keys(rows: Table) -> Column:
    return F.transform(F.get(rows, F.lit(0)), normal_key)


def row_keys(rows: Table) -> Column:
    return F.transform(rows, lambda r: normal_key(F.get(r, F.lit(0))))


def triples(rows: Table, columns: Column, names: Column) -> Column:
    """array<struct<k0, k1, num, txt>>: one per cell that has a row and a column name.

    `columns` and `names` are header_keys and row_keys of the table, held in
    columns of their own so that every key is made normal once.
    """
    none = F.array().cast(EMPTY_TRIPLES)

    def headed(r: Column, i: Column) -> Column:
        wide = F.least(F.size(r), F.size(columns))
        at = F.when(wide > 1, F.sequence(F.lit(1), wide - 1)).otherwise(F.array().cast("array<int>"))
        return F.when(i == 0, none).otherwise(F.transform(at, lambda j: triple(F.get(names, i), F.get(columns, j), _value(F.get(r, j)))))

    def bare(r: Column, i: Column) -> Column:
        rest = F.slice(r, 2, F.greatest(F.size(r), F.lit(1)))
        blank = F.forall(rest, lambda c: strip(c) == "")
        cells_ = F.when(F.size(r) == 1, F.array(F.lit(""))).otherwise(rest)
        skip = F.when(F.size(r) == 1, F.get(names, i) == "").otherwise(blank)
        return F.when(skip, none).otherwise(F.transform(cells_, lambda c: triple(F.get(names, i), F.lit(""), _value(c))))

    listed = F.when(headless(rows), F.flatten(F.transform(rows, bare))).otherwise(F.flatten(F.transform(rows, headed)))
    return F.when(F.size(rows) > 0, listed).otherwise(none)


# Endings of box-plot columns in lower case, and words of triples that references may lack.
BOX_ENDINGS = ["-最小值", "-q1", "-中位数", "-q3", "-最大值"]
OPTIONAL_WORDS = [["异常值", "outlier", "离群"], ["离散点", "离散值", "discrete", "scatter"]]


def _keys(list_: Column) -> Column:
    return F.flatten(F.transform(list_, lambda t: F.array(t["k0"], t["k1"])))


def names_of(list_: Column) -> Column:
    """Distinct keys that are neither empty nor numbers."""
    return F.array_sort(F.array_distinct(F.filter(_keys(list_), lambda k: (k != "") & ~k.rlike("^[.-]*[0-9][0-9.-]*$"))))


def _renamed(list_: Column, how) -> Column:
    def one(t: Column) -> Column:
        a, b = how(t["k0"]), how(t["k1"])
        changed = (a != t["k0"]) | (b != t["k1"])
        return F.struct(
            F.when(changed, F.least(a, b)).otherwise(a).alias("k0"),
            F.when(changed, F.greatest(a, b)).otherwise(b).alias("k1"),
            t["num"].alias("num"),
            t["txt"].alias("txt"),
        )

    return F.transform(list_, one)


def _common(names: Column, of) -> Column:
    """Length of the longest head (or tail) that all names share."""
    shortest = F.array_min(F.transform(names, lambda k: F.length(k)))
    steps = F.when(shortest > 0, F.sequence(F.lit(1), shortest)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(steps, lambda i: F.forall(names, lambda k: of(k, i) == of(F.get(names, F.lit(0)), i))))


def box_subjects(ref: Column) -> Column:
    """What stands before box-plot statistics in the reference's keys."""
    endings = "|".join(BOX_ENDINGS)
    return F.array_distinct(F.transform(F.filter(_keys(ref), lambda k: k.rlike(f".(?:{endings})$")), lambda k: F.regexp_replace(k, f"(?:{endings})$", "")))


def with_subject(pred: Column, subjects: Column) -> Column:
    """Bare statistics of the prediction, with the reference's only subject before them."""
    full = _renamed(pred, lambda k: F.when(k.isin(BOX_ENDINGS), F.concat(F.get(subjects, F.lit(0)), k)).otherwise(k))
    return F.when((F.size(subjects) == 1) & F.exists(_keys(pred), lambda k: k.isin(BOX_ENDINGS)), full).otherwise(pred)


def shared_length(names: Column, tail: bool) -> Column:
    """How many characters all names end (or begin) with; 0 for fewer than two names."""
    return F.when(F.size(names) >= 2, _common(names, F.right if tail else F.left)).otherwise(0)


def with_shared(pred: Column, own: Column, names: Column, n: Column, tail: bool) -> Column:
    """The prediction's keys with the ending (or beginning) that all reference names share.

    Only where that part is set off by - or _, and every name of the prediction
    (`own`) is a reference name without it.
    """
    first = F.get(names, F.lit(0))
    shared = F.regexp_replace(F.right(first, n), "^\\s+", "") if tail else F.regexp_replace(F.left(first, n), "\\s+$", "")
    if tail:
        stems = F.transform(names, lambda k: F.regexp_replace(F.left(k, F.length(k) - n), "[-_ ]+$", ""))
    else:
        stems = F.transform(names, lambda k: F.regexp_replace(F.right(k, F.length(k) - n), "^[-_ ]+", ""))
    edge = F.left(shared, F.lit(1)) if tail else F.right(shared, F.lit(1))
    fits = (F.size(own) > 0) & (F.size(F.array_except(own, stems)) == 0) & (F.size(F.array_intersect(own, names)) == 0)

    def full(k: Column) -> Column:
        put = F.concat(k, shared) if tail else F.concat(shared, k)
        return F.when(F.array_contains(stems, k) & ~F.array_contains(names, k), put).otherwise(k)

    return F.when((n > 0) & edge.isin("-", "_") & fits, _renamed(pred, full)).otherwise(pred)


def without_optional(pred: Column, ref: Column) -> Column:
    """The prediction without outlier and scatter triples that the reference has none of."""
    out = pred
    for words_ in OPTIONAL_WORDS:
        out = F.when(F.exists(ref, _speaks_of(words_)), out).otherwise(_without(out, _speaks_of(words_)))
    return out


def _speaks_of(words_: list[str]):
    return lambda t: F.concat(t["k0"], t["k1"]).rlike("|".join(words_))


def _without(list_: Column, test) -> Column:
    return F.filter(list_, lambda t: ~test(t))

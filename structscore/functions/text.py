"""Text clean-up: stripping, fences, full-width marks, formulas, statistic names.

Java patterns carry (?U) so that classes mean what Unicode says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r?\n")


def half_width(text: Column) -> Column:
    # Full-width marks and what they become.
    return F.translate(text, "：（），；％", ":(),;%")


# Characters that have a superscript form, in pairs.
SUPERSCRIPT = ("0123456789n+-", "⁰¹²³⁴⁵⁶⁷⁸⁹ⁿ⁺⁻")


def plain_formula(text: Column) -> Column:
    """Inline formulas as plain text: `$ m^{2} $` is m²."""
    t = F.regexp_replace(text, "\\$\\s*(.*?)\\s*\\$", "$1")
    t = F.regexp_replace(t, "\\\\(?:text|mathrm|textbf)\\{([^}]*)\\}", "$1")
    for mark in ("\\^\\{([^}]*)\\}", "\\^([0-9])"):
        parts = F.split(F.regexp_replace(t, mark, "\u0001$1\u0002"), "\u0001")
        raised = F.transform(
            parts,
            lambda p, i: F.when(i == 0, p).otherwise(
                F.concat(F.translate(F.substring_index(p, "\u0002", 1), *SUPERSCRIPT), _after(p))
            ),
        )
        t = F.array_join(raised, "")
    t = strip(F.regexp_replace(t, "(?U)\\s+", " "))
    return F.when(F.contains(text, F.lit("$")) | F.contains(text, F.lit("\\")), t).otherwise(text)


def _after(part: Column) -> Column:
    """What follows the end mark of a raised piece."""
    return F.regexp_replace(part, "(?s)^[^\u0002]*\u0002", "")


# What box-plot statistics are called, by the ending that stands for them; earlier ones count first.
STATISTICS = {
    "-Q1": "下四分位数 下四分位 第一四分位数 第一四分位 Q1",
    "-中位数": "第二四分位数 第二四分位 中位数 中位 Q2 Median",
    "-Q3": "上四分位数 上四分位 第三四分位数 第三四分位 Q3",
    "-最小值": "最小值 Min",
    "-最大值": "最大值 Max",
}


def statistic_pattern(names: str) -> str:
    """Any of these names with a joining mark before it.

    English words stand alone, quartile marks end a word, and a Chinese name may
    be followed by its quartile mark in brackets.
    """
    each = sorted(names.split(), key=len, reverse=True)
    marks = [n for n in each if n[-1].isdigit()]
    in_brackets = f"(?:\\s*[(（]\\s*{marks[0]}\\s*[)）])?" if marks else ""
    forms = []
    for n in each:
        if not n.isascii():
            forms.append(n + in_brackets)
        elif n.isalpha():
            forms.append(f"\\b{n}\\b")
        else:
            forms.append(f"{n}\\b")
    return f"[_-]?(?:{'|'.join(forms)})"


def statistic_last(text: Column) -> Column:
    """Keys that name a statistic, written subject first: `Q1 of x` forms become `x-Q1`."""
    named = text
    for ending, names in reversed(STATISTICS.items()):
        pattern = statistic_pattern(names)
        whole = f"(?iUs)^(.*?)(?:{pattern})(.*)$"
        # brackets and joining marks that the statistic leaves open at its edges go
        before = F.regexp_replace(F.regexp_extract(text, whole, 1), "[-_— ]*[(（]* *$", "")
        after = F.regexp_replace(F.regexp_extract(text, whole, 2), "^[-_— ]*[)）]* *", "")
        both = (before != "") & (after != "")
        told = F.when(both, F.concat(before, F.lit(ending + "-"), after)).when(before != "", F.concat(before, F.lit(ending))).otherwise(F.concat(after, F.lit(ending)))
        named = F.when(text.rlike(f"(?iU){pattern}"), told).otherwise(named)
    # most keys name none: one look decides
    return F.when(text.rlike("(?i)四分位|中位|最小值|最大值|q[123]|median|min|max"), named).otherwise(text)


def normal_key(text: Column) -> Column:
    """A row or column name as keys compare: stripped, half-width, formulas plain, statistics last."""
    clean = F.translate(plain_formula(half_width(strip(text))), "µ", "μ")
    return let(clean, statistic_last)


def strip_fence(text: Column, languages: str = "[A-Za-z0-9_\\-]*") -> Column:
    """The inside of a text that is one fenced block; other texts stripped."""
    return let(strip(F.coalesce(text, F.lit(""))), lambda t: strip(F.regexp_replace(t, f"(?s)^```(?:{languages})\\s*\\n?(.*?)\\n?```\\s*$", "$1")))


def fenced(text: Column, languages: str) -> Column:
    """The last fenced block in one of the languages, or null."""
    found = F.regexp_extract_all(text, F.lit(f"(?is)```(?:{languages})[ \\t]*\\n(.*?)```"), F.lit(1))
    return F.when(F.size(found) > 0, strip(F.element_at(found, -1)))


def python_float(text: Column) -> Column:
    """The double that Python's float() reads, or null.

    Wide digits and single underscores between digits count; Java's suffixes
    (12d, 12f) and hexadecimal forms don't.
    """

    def read(t: Column) -> Column:
        number = t.rlike("^[+-]?(?:[0-9]+(?:_[0-9]+)*\\.?(?:[0-9]+(?:_[0-9]+)*)?|\\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?$")
        word = F.regexp_replace(F.lower(t), "^[+]", "")
        return (
            F.when(number, F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
            .when(word.isin("nan", "-nan"), F.lit(float("nan")))
            .when(word.isin("inf", "infinity"), F.lit(float("inf")))
            .when(word.isin("-inf", "-infinity"), F.lit(float("-inf")))
        )

    return let(F.translate(strip(text), "０１２３４５６７８９", "0123456789"), read)


def is_quantity(text: Column) -> Column:
    """Whether a text is nothing but a number: it names nothing.  Signs, digits grouped by threes, a point and per cent may stand in it."""

    def read(t: Column) -> Column:
        bare = F.translate(t, ", ", "")
        groups = F.split(F.translate(F.substring_index(t, ".", 1), " ", ","), ",")
        whole = F.forall(F.slice(groups, 2, F.size(groups)), lambda g: F.length(g) == 3)
        # a cast that fails throws within: names are told before it
        return F.right(bare, F.lit(1)).between("0", "9") & (F.lower(bare) == F.upper(bare)) & bare.try_cast("double").isNotNull() & whole

    return F.coalesce(let(F.rtrim(strip(text), F.lit("%")), read), F.lit(False))


# Marks before items of a list, what ends an item's number, digits that number items.
BULLETS, AFTER_NUMBER, NUMERALS = "-*+•·", ".)、", "0123456789一二三四五六七八九十"


def without_mark(line: Column) -> Column:
    """A list's line without what marks it as an item: a bullet and a space, or a number and what ends it."""

    def read(t: Column) -> Column:
        number = F.substring_index(F.translate(t, AFTER_NUMBER, "." * len(AFTER_NUMBER)), ".", 1)
        numbered = (number != "") & (F.length(number) < F.length(t)) & (F.translate(number, NUMERALS, "") == "")
        # a number needs a space behind its point, else it may be a decimal
        spaced = F.substring(t, F.length(number) + 2, F.lit(1))
        cut = F.substring(t, F.length(number) + 2, F.length(t))
        decimal = numbered & spaced.between("0", "9")
        bullet = F.translate(F.substring(t, 1, 1), BULLETS, "") == ""
        return F.when(bullet & (F.substring(t, 2, 1) == " "), strip(F.substring(t, F.lit(2), F.length(t)))).when(numbered & ~decimal, strip(cut)).otherwise(t)

    return let(F.translate(strip(line), "\t", " "), read)


# Signs that stand with amounts, and units that are left out (the number stays as it is written).
CURRENCY, UNITS = "[$￥¥€£]", "(?:[万亿]元?|元)$"


def written_number(text: Column) -> Column:
    """The number in a label: currency, thousands, per cent and units go; brackets around it mean less than zero.

    A bracketed whole number alone is a label, and a bracketed percentage keeps
    its sign.  Null if no number is left.
    """
    def read(t: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(t, CURRENCY + "|[, \u00a0]", ""), UNITS, "")
        return F.when(~t.rlike("^[（(]\\s*[-+]?[0-9]+\\s*[)）]$"), let(bare, signed))

    def signed(bare: Column) -> Column:
        plain = F.regexp_replace(bare, "[%％‰]", "")
        below = plain.rlike("^[(（].*[)）]$") & ~bare.rlike("[%％]")
        return let(python_float(F.regexp_replace(plain, "^[(（](.*)[)）]$", "$1")), lambda n: F.when(below, -n).otherwise(n))

    return let(F.regexp_replace(strip(text), "[、。，,.]+$", ""), read)


def strictly_monotonic(values: Column) -> Column:
    """Whether a list of numbers, or of texts that are numbers but for , and %, only rises or only falls; two at least."""
    numbers = F.transform(values, lambda v: python_float(F.regexp_replace(v.cast("string"), "[,%]", "")))
    steps = lambda up: F.forall(F.sequence(F.lit(1), F.size(numbers) - 1), lambda i: F.get(numbers, i) > F.get(numbers, i - 1) if up else F.get(numbers, i) < F.get(numbers, i - 1))
    whole = (F.size(values) >= 2) & F.forall(numbers, lambda n: n.isNotNull())
    return F.coalesce(F.when(whole, steps(True) | steps(False)), F.lit(False))


def python_repr(number: Column) -> Column:
    """A double as Python's str() writes it, for sizes from 1e-4 to 1e16 and zero."""
    whole = F.concat(number.try_cast("bigint").cast("string"), F.lit(".0"))
    tail = F.regexp_replace(number.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    size = F.abs(number)
    return (
        F.when((number == F.floor(number)) & (size < 1e16), whole)
        .when((size >= 1e-4) & (size < 1e16), tail)
        .otherwise(F.lower(F.replace(number.cast("string"), F.lit("E"), F.lit("e"))))
    )

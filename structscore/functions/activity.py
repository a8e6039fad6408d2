"""PlantUML activity charts and arrows, folded line by line into one graph.

Lines become events; one fold keeps what the next node hangs on (`at`), the
label of the coming edge, and a stack of open blocks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .graphs import EDGE, NODE, _edge, _first_of_each, _node, clean_label
from .text import strip, strip_fence

_ARROW = "^(\\(\\*\\)|\\[[^\\]]+\\]|\"[^\"]+\"|[^\\s:\\-<>]+)\\s*-+(?:\\w+-+)?>\\s*(\\(\\*\\)|\\[[^\\]]+\\]|\"[^\"]+\"|[^\\s:]+)\\s*(?::\\s*(.*))?$"

# Keywords of activity charts, by the event they make.
KEYWORDS = {
    "title": ["title"],
    "start": ["start"],
    "stop": ["stop", "end"],
    "if": ["if"],
    "elseif": ["elseif", "else if"],
    "else": ["else"],
    "endif": ["endif", "end if"],
    "fork": ["fork", "split"],
    "again": ["fork again", "split again"],
    "join": ["end fork", "end split", "end merge"],
    "back": ["back to"],
}

#: Events whose keyword is all of the line, but for options in braces.
ALONE = ["start", "stop", "endif", "fork", "again", "join"]


def events(text: Column) -> Column:
    """array<struct<kind, a, b, c>> of a chart's lines, comments, notes and partitions gone.

    A line begins with a keyword, or its first character tells what it is: an
    action between : and ;, words on the next arrow, a lane, or an arrow between
    two names.
    """
    t = F.regexp_replace(strip_fence(text), "(?is)/'.*?'/|\\bnote\\b[^\\n:]*\\n.*?\\bend\\s*note\\b", " ")
    t = F.regexp_replace(t, "(?im)^\\s*(?:@(?:start|end)\\w*.*|'.*|note\\b.*|partition\\b.*|[{}])\\s*$", "")
    listed = F.filter(F.transform(F.split(F.regexp_replace(t, ";\\s*-+>\\s*:", ";\n:"), "\n"), strip), lambda x: x != "")
    kinds = F.create_map(*[F.lit(x) for kind, words in KEYWORDS.items() for w in words for x in (w, kind)])
    every = sorted((w for words in KEYWORDS.values() for w in words), key=len, reverse=True)
    keyword = f"(?iU)^({'|'.join(w.replace(' ', ' *') for w in every)})(?!\\w)\\s*"

    def event(x: Column) -> Column:
        word = F.regexp_replace(F.lower(F.regexp_extract(x, keyword, 1)), " +", " ")
        word = F.when(word.isin("endfork", "endsplit", "endmerge"), F.regexp_replace(word, "^end", "end ")).otherwise(word)
        rest = F.regexp_replace(x, keyword, "")
        named = F.coalesce(kinds[word], F.lit("other"))
        known = (named != "other") & (~named.isin(ALONE) | (rest == "") | rest.startswith("{")) & ((named != "title") | (rest != ""))
        words_on = x.rlike("^-+>") & ~x.rlike(_ARROW)
        kind = (
            F.when(known, named)
            .when(x.rlike("^:.*;$"), "node")
            .when(words_on | x.rlike("^\\|[^|]+\\|$"), "label")
            .when(x.rlike(_ARROW), "arrow")
            .otherwise("other")
        )
        branch = kind.isin("if", "elseif")
        # if (a) then (b); else (a); anything else without the marks around it
        asked = "^\\(((?:[^()]|\\([^()]*\\))*)\\)"
        first = (
            F.when(kind == "title", rest)
            .when(branch | (kind == "else"), F.regexp_extract(rest, asked, 1))
            .when(kind == "arrow", F.regexp_extract(x, _ARROW, 1))
            .when(kind.isin("node", "label", "back"), F.regexp_replace(F.when(kind == "back", rest).otherwise(x), "^(?:-+>|[:|])\\s*|\\s*[;|]$", ""))
            .otherwise("")
        )
        second = F.when(branch, F.regexp_extract(F.regexp_replace(rest, asked, ""), "\\(([^()]*)\\)", 1)).when(kind == "arrow", F.regexp_extract(x, _ARROW, 2)).otherwise("")
        third = F.when(kind == "arrow", F.regexp_extract(x, _ARROW, 3)).otherwise("")
        return F.struct(kind.alias("kind"), clean_label(first).alias("a"), clean_label(second).alias("b"), clean_label(third).alias("c"))

    return F.transform(listed, event)


def plantuml(events_: Column) -> Column:
    """Graph of a chart's events (a column of their own).

    A node hangs on all that is open before it; an if's branches and a fork's
    meet at its end; start begins anew, at the title if there is one.
    """
    none = F.array().cast("array<string>")
    start = F.struct(
        none.alias("at"), F.lit("").alias("label"), F.array().cast("array<struct<kind:string,heads:array<string>,tails:array<string>>>").alias("open"),
        F.lit("").alias("title"), F.array().cast(f"array<{NODE}>").alias("nodes"), F.array().cast(f"array<{EDGE}>").alias("edges"),
    )

    def step(s: Column, e: Column) -> Column:
        k, top = e["kind"], F.element_at(s["open"], -1)
        inner = F.when(F.size(s["open"]) > 0, F.slice(s["open"], 1, F.size(s["open"]) - 1)).otherwise(s["open"])
        has = F.size(s["open"]) > 0
        hangs = k.isin("node", "if", "back", "elseif") & (e["a"] != "")
        source = F.when((k == "elseif") & has, top["heads"]).otherwise(s["at"])
        new_edges = F.transform(F.filter(source, lambda x: (x != "") & (x != e["a"])), lambda x: _edge(x, e["a"], F.when(k == "elseif", F.lit("")).otherwise(s["label"])))
        block = lambda kind, heads, tails: F.struct(kind.alias("kind"), heads.alias("heads"), tails.alias("tails"))
        tails = F.concat(top["tails"], s["at"])
        clean = lambda x: F.regexp_replace(F.when(x == "(*)", F.lit("")).otherwise(x), '^[\\["]+|[\\]"]+$', "")
        src = F.when(e["a"] == "(*)", "start").otherwise(clean(e["a"]))
        dst = F.when(e["b"] == "(*)", "end").otherwise(clean(e["b"]))
        open_ = (
            F.when(k.isin("if", "fork"), F.array_append(s["open"], block(k, F.when(k == "if", F.array(e["a"])).otherwise(s["at"]), none)))
            .when((k == "elseif") & has, F.array_append(inner, block(F.lit("if"), F.array(e["a"]), tails)))
            .when(k.isin("else", "again") & has, F.array_append(inner, block(top["kind"], top["heads"], tails)))
            .when(k.isin("endif", "join") & has, inner)
            .otherwise(s["open"])
        )
        at = (
            F.when(k.isin("node", "if", "elseif", "title") & (e["a"] != ""), F.array(e["a"]))
            .when(k == "start", F.when(s["title"] != "", F.array(s["title"])).otherwise(none))
            .when(k.isin("stop", "back"), none)
            .when(k.isin("else", "again") & has, top["heads"])
            .when(k.isin("endif", "join") & has, F.array_distinct(tails))
            .otherwise(s["at"])
        )
        label = F.when(k.isin("if", "elseif"), e["b"]).when(k.isin("else", "label"), e["a"]).when(k.isin("other", "arrow", "title"), s["label"]).otherwise("")
        return F.struct(
            at.alias("at"),
            label.alias("label"),
            open_.alias("open"),
            F.when(k == "title", e["a"]).otherwise(s["title"]).alias("title"),
            F.when(k == "arrow", F.concat(s["nodes"], F.array(_node(src, src), _node(dst, dst))))
            .when((hangs | (k == "title")) & (e["a"] != ""), F.array_append(s["nodes"], _node(e["a"], e["a"])))
            .otherwise(s["nodes"])
            .alias("nodes"),
            F.when(k == "arrow", F.array_append(s["edges"], _edge(src, dst, e["c"]))).when(hangs, F.concat(s["edges"], new_edges)).otherwise(s["edges"]).alias("edges"),
        )

    return F.aggregate(events_, start, step, lambda s: F.struct(_first_of_each(s["nodes"]).alias("nodes"), s["edges"].alias("edges")))

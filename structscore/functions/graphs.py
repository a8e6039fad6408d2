"""Flow charts in four notations as one graph: struct<nodes, edges>.

nodes: array<struct<id, label>>, first definition first; edges:
array<struct<src, dst, label>>.  Lines are cut by patterns; no parser runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import html_text
from .text import is_quantity, let, lines, strip, strip_fence, without_mark

NODE = "struct<id:string,label:string>"
EDGE = "struct<src:string,dst:string,label:string>"
_MARK, _END = "\u0001", "\u0002"


def clean_label(label: Column) -> Column:
    """Breaks of any notation become spaces, and spaces squeeze."""
    t = F.regexp_replace(label, "(?i)<\\s*br\\s*/?\\s*>|\\\\[nrl]|[\\n\\r\\t]", " ")
    return strip(F.regexp_replace(t, "(?U)\\s+", " "))


def _node(id_: Column, label: Column) -> Column:
    return F.struct(id_.alias("id"), label.alias("label"))


def _edge(src: Column, dst: Column, label: Column) -> Column:
    return F.struct(src.alias("src"), dst.alias("dst"), label.alias("label"))


def _first_of_each(nodes: Column) -> Column:
    """Nodes by first id seen, with the first label that says more than the id."""
    ids = F.array_distinct(F.transform(nodes, lambda n: n["id"]))

    def one(i: Column) -> Column:
        own = F.filter(nodes, lambda n: n["id"] == i)
        told = F.filter(own, lambda n: n["label"] != n["id"])
        return _node(i, F.coalesce(F.get(told, F.lit(0))["label"], i))

    return F.transform(F.filter(ids, lambda i: i != ""), one)


def _chain(line: Column, node_of) -> Column:
    """A line whose arrows are marked as MARK label END: its nodes and hops."""
    parts = F.split(line, _MARK)
    return F.transform(
        parts,
        lambda p, i: F.struct(
            node_of(F.when(i == 0, p).otherwise(F.regexp_replace(p, f"(?s)^[^{_END}]*{_END}", ""))).alias("node"),
            _unquoted(F.when(i == 0, F.lit("")).otherwise(F.substring_index(p, _END, 1))).alias("label"),
        ),
    )


def _graph(chains: Column, alone: Column) -> Column:
    """Graph of chains (array of arrays of node and label) and nodes defined on their own."""
    nodes = F.concat(F.flatten(F.transform(chains, lambda c: F.transform(c, lambda x: x["node"]))), alone)
    edges = F.flatten(
        F.transform(
            chains,
            lambda c: F.when(
                F.size(c) > 1,
                F.transform(
                    F.sequence(F.lit(1), F.size(c) - 1),
                    lambda i: _edge(F.get(c, i - 1)["node"]["id"], F.get(c, i)["node"]["id"], F.get(c, i)["label"]),
                ),
            ).otherwise(F.array().cast(f"array<{EDGE}>")),
        )
    )
    return F.struct(_first_of_each(nodes).alias("nodes"), F.filter(edges, lambda e: (e["src"] != "") & (e["dst"] != "")).alias("edges"))


# Mermaid's links, as (what opens one with words on it, what closes it, one without words).
LINKS = [("--", "--+>|---+", "--+>|---+"), ("==", "==+>|===+", "==+>|===+"), ("-\\.", "\\.+->|\\.+-", "-\\.+->|-\\.+-")]

#: Words on a link: in quotes anything, else neither strokes nor heads.
ON_LINK = "\"[^\"]*\"|[^-=.>|\"\\s](?:[^-=>|\"]*[^-=.>|\"\\s])?"


def _link(opened: str, closed: str, bare: str) -> str:
    """One kind of link: words between its ends, or after it between pipes, or none."""
    return f"<?{opened}\\s*({ON_LINK})\\s*(?:{closed})|<?(?:{bare})(?:\\s*\\|([^|]*)\\|)?"


MERMAID_LINK = "|".join(_link(*kind) for kind in LINKS)
_LABEL = "".join(f"${i}" for i in range(1, 2 * len(LINKS) + 1))  # one group of all holds the words


def is_mermaid(text: Column) -> Column:
    has = lines(text)
    return F.exists(has, lambda x: x.rlike("(?i)^\\s*(flowchart|graph)\\s+(TD|TB|LR|RL|BT)")) & F.exists(has, lambda x: x.rlike("-->|---|==>|-\\.->"))


def _mermaid_node(token: Column) -> Column:
    id_ = F.regexp_extract(strip(token), "(?U)^([A-Za-z_]\\w*)", 1)
    body = strip(F.regexp_replace(strip(token), "(?U)^[A-Za-z_]\\w*\\s*", ""))
    inner = F.regexp_replace(F.regexp_replace(body, "^[\\[({>/\\\\]+\\s*", ""), "\\s*[\\])}/\\\\]+$", "")
    label = clean_label(F.regexp_replace(strip(inner), '^"(.*)"$', "$1"))
    return F.when(id_ == "", _node(strip(token), clean_label(token))).otherwise(_node(id_, F.when((body == "") | (label == ""), id_).otherwise(label)))


def mermaid(text: Column) -> Column:
    skip = "(?i)^\\s*(?:$|%%|(?:flowchart|graph)\\s+(?:TD|TB|LR|RL|BT)\\b|(?:subgraph|end|style|classDef|class|click|linkStyle)\\b)"
    body = F.filter(lines(strip_fence(text)), lambda x: ~x.rlike(skip))
    has = lambda x: x.rlike(MERMAID_LINK)
    marked = F.transform(F.filter(body, has), lambda x: F.regexp_replace(x, MERMAID_LINK, f"{_MARK}{_LABEL}{_END}"))
    alone = F.transform(F.filter(body, lambda x: ~has(x)), _mermaid_node)
    return _graph(F.transform(marked, lambda x: _chain(x, _mermaid_node)), alone)


def is_dot(text: Column) -> Column:
    return text.rlike("(?is)\\b(?:di)?graph\\b[^{]*\\{") & text.rlike("->|--")


def _unquoted(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(name), '^"(.*)"$', "$1"), '\\\\"', '"')


def _attribute(attributes: Column, name: str) -> Column:
    quoted = F.regexp_extract(attributes, f'\\b{name}\\s*=\\s*"((?:[^"\\\\]|\\\\.)*)"', 1)
    bare = F.regexp_extract(attributes, f"\\b{name}\\s*=\\s*([^\\s,;\\]\"]+)", 1)
    return F.when(quoted != "", quoted).otherwise(bare)


def dot(text: Column) -> Column:
    """Graphviz: chains, labels (on a chain's last hop), subgraphs flattened, comments gone."""
    t = F.regexp_replace(strip_fence(text), "(?s)/\\*.*?\\*/|(?m)//[^\\n]*$|(?m)^\\s*#[^\\n]*$", "")
    t = F.regexp_replace(F.regexp_replace(t, "(?is)^.*?\\b(?:di)?graph\\b[^{]*\\{", ""), "(?i)\\bsubgraph\\b[^{]*\\{|[{}]", "\n")
    parts = F.transform(F.split(t, '(?:;|\\n)(?=(?:[^"]*"[^"]*")*[^"]*$)(?![^\\[]*\\])'), strip)
    body = F.filter(parts, lambda x: (x != "") & ~x.rlike("(?i)^(?:node|edge|graph)\\s*\\[|^[A-Za-z_]+\\s*=[^>]"))
    front = lambda x: F.regexp_replace(x, "(?s)\\[.*$", "")
    rest = lambda x: F.regexp_extract(x, "(?s)(\\[.*)$", 1)
    has = lambda x: front(x).rlike("->|--")
    node_of = lambda p: _node(_unquoted(p), _unquoted(p))

    def chain(x: Column) -> Column:
        hops = _chain(F.regexp_replace(front(x), "->|--", f"{_MARK}{_END}"), node_of)
        return F.transform(hops, lambda h, i: F.struct(h["node"].alias("node"), F.when(i == F.size(hops) - 1, clean_label(_attribute(rest(x), "label"))).otherwise("").alias("label")))

    def lone(x: Column) -> Column:
        label = clean_label(_attribute(rest(x), "label"))
        return _node(_unquoted(front(x)), F.when(label == "", _unquoted(front(x))).otherwise(label))

    return _graph(F.transform(F.filter(body, has), chain), F.transform(F.filter(body, lambda x: ~has(x)), lone))


def d2(text: Column) -> Column:
    """D2: `a: label`, `a -> b: label`, chains; a two-way arrow is two edges."""
    body = F.filter(F.transform(lines(strip_fence(text)), lambda x: strip(F.regexp_replace(x, "(?:^|\\s)#.*$", ""))), lambda x: (x != "") & ~x.rlike("^[{}]$|^(?:direction|shape|style)\\b"))
    arrow = "<->|->|<-|--"
    has = lambda x: F.regexp_replace(x, '"[^"]*"', "").rlike(arrow)
    key = lambda p: _unquoted(p)
    path = lambda x: F.regexp_replace(x, '^((?:"[^"]*"|[^":])*):.*$', "$1")
    told = lambda x: clean_label(_unquoted(F.regexp_replace(F.regexp_extract(x, '^(?:"[^"]*"|[^":])*:(.*)$', 1), "\\{.*$", "")))

    def chain(x: Column) -> Column:
        hops = _chain(F.regexp_replace(path(x), arrow, f"{_MARK}{_END}"), lambda p: _node(key(p), key(p)))
        return F.transform(hops, lambda h, i: F.struct(h["node"].alias("node"), F.when(i > 0, told(x)).otherwise("").alias("label")))

    forward = F.transform(F.filter(body, lambda x: has(x) & ~path(x).rlike("(?<!<)<-(?!>)")), chain)
    back = F.transform(F.filter(body, lambda x: has(x) & path(x).rlike("<-")), lambda x: _turned(chain(x)))
    lone = F.transform(F.filter(body, lambda x: ~has(x)), lambda x: _node(key(path(x)), F.when(told(x) == "", key(path(x))).otherwise(told(x))))
    # labels are given on their own lines, before or after the edges
    return _graph(F.concat(forward, back), lone)


def _turned(hops: Column) -> Column:
    """A chain read from its end: labels belong to the hop before."""
    return F.transform(
        F.reverse(hops),
        lambda h, i: F.struct(h["node"].alias("node"), F.when(i == 0, F.lit("")).otherwise(F.get(hops, F.size(hops) - i)["label"]).alias("label")),
    )


CYTOSCAPE = "array<struct<data:struct<id:string,label:string,name:string,source:string,target:string>>>"


def cytoscape(text: Column) -> Column:
    """Cytoscape JSON: elements grouped in nodes and edges, or one flat list."""
    t = strip_fence(text)
    grouped = F.from_json(t, f"struct<elements:struct<nodes:{CYTOSCAPE},edges:{CYTOSCAPE}>>")["elements"]
    plain = F.from_json(t, f"struct<nodes:{CYTOSCAPE},edges:{CYTOSCAPE}>")
    flat = F.coalesce(F.from_json(t, f"struct<elements:{CYTOSCAPE}>")["elements"], F.from_json(t, CYTOSCAPE))
    none = F.array().cast(CYTOSCAPE)
    every = F.coalesce(F.concat(grouped["nodes"], F.coalesce(grouped["edges"], none)), F.concat(plain["nodes"], F.coalesce(plain["edges"], none)), flat, none)
    data = F.transform(every, lambda x: x["data"])
    nodes = F.transform(F.filter(data, lambda d: d["source"].isNull() & d["id"].isNotNull()), lambda d: _node(d["id"], clean_label(F.coalesce(d["label"], d["name"], d["id"]))))
    edges = F.transform(F.filter(data, lambda d: d["source"].isNotNull() & d["target"].isNotNull()), lambda d: _edge(d["source"], d["target"], clean_label(F.coalesce(d["label"], F.lit("")))))
    ends = F.flatten(F.transform(edges, lambda e: F.array(_node(e["src"], e["src"]), _node(e["dst"], e["dst"]))))
    return F.struct(_first_of_each(F.concat(nodes, ends)).alias("nodes"), edges.alias("edges"))


PARSERS = {"mermaid": mermaid, "graphviz": dot, "d2": d2, "cytoscape": cytoscape}


# Names of so many characters at most say nothing, by how lines are read.
SHORT = {"cell": 2, "row": 1, "line": 1}


def listed_nodes(text: Column, by: str = "cell") -> Column:
    """Names in an answer that lists a flow chart's nodes, in order, each once whatever its case.

    Piped lines (two in five at least) after a header: a node per `cell`, or per
    `row`.  Other texts have a node per line.  Cells are read as cells of HTML
    are; a number names nothing.
    """

    def names(cells: Column, how: str) -> Column:
        plain = F.transform(cells, lambda c: without_mark(F.replace(html_text(c), F.lit("**"), F.lit(""))))
        return F.filter(plain, lambda n: ~is_quantity(n) & (F.length(n) > SHORT[how]))

    def read(given: Column) -> Column:
        piped = F.filter(given, lambda x: F.contains(x, F.lit("|")))
        body = F.slice(given, 2, F.greatest(F.size(given), F.lit(1)))
        rows = F.transform(body, lambda x: names(F.split(x, "\\|"), by))
        of_rows = F.flatten(rows) if by == "cell" else F.filter(F.transform(rows, lambda r: F.array_join(r, " ")), lambda n: n != "")
        told = F.when(5 * F.size(piped) >= 2 * F.size(given), of_rows).otherwise(names(given, "line"))
        once = let(told, lambda t: let(F.transform(t, F.lower), lambda low: F.filter(t, lambda n, i: F.array_position(low, F.lower(n)) == i + 1)))
        return F.when(F.size(given) >= 2, once).otherwise(F.array().cast("array<string>"))

    return let(lines(strip(F.coalesce(text, F.lit("")))), read)


def in_a_row(names: Column) -> Column:
    """The graph of nodes joined one after another; none of fewer than two names."""

    def joined(n: Column) -> Column:
        ends = F.when(F.size(n) > 1, F.transform(F.sequence(F.lit(1), F.size(n) - 1), lambda i: _edge((i - 1).cast("string"), i.cast("string"), F.lit("")))).otherwise(F.array().cast(f"array<{EDGE}>"))
        nodes = F.transform(n, lambda x, i: _node(i.cast("string"), clean_label(F.replace(x, F.lit('"'), F.lit("'")))))
        return F.struct(nodes.alias("nodes"), ends.alias("edges"))

    return F.when(F.size(names) >= 2, joined(names))


# The word that opens a text of a notation, and the directions behind Mermaid's older one.
OPENINGS = {"flowchart": "mermaid", "digraph": "graphviz", "strict": "graphviz", "graph": "graphviz", "@startuml": "plantuml"}
DIRECTIONS = ["TD", "TB", "LR", "RL", "BT"]
#: Marks of lines that are comments somewhere.
COMMENTS = ["%%", "//", "#", "'"]


def notation(text: Column) -> Column:
    """Which notation a text is in; null if none.

    The word that opens it tells, or the module that its code takes in, or a
    JSON value's elements; a text without any of these is what more of its lines
    are read as, PlantUML's actions or D2's edges and labels.
    """

    def opened(told: Column) -> Column:
        words = F.split(strip(F.replace(F.coalesce(F.get(told, F.lit(0)), F.lit("")), F.lit("{"), F.lit(" {"))), "\\s+")
        word, second = F.lower(F.get(words, F.lit(0))), F.upper(F.coalesce(F.get(words, F.lit(1)), F.lit("")))
        kinds = F.create_map(*[F.lit(x) for pair in OPENINGS.items() for x in pair])
        code = lambda x: F.split(x, "[\\s(.]+")
        taken = F.exists(told, lambda x: F.get(code(x), F.lit(0)).isin("from", "import") & (F.get(code(x), F.lit(1)) == "diagrams"))
        drawn = F.exists(told, lambda x: (F.get(code(x), F.lit(0)) == "with") & (F.get(code(x), F.lit(1)) == "Diagram"))
        joined = F.exists(told, lambda x: F.exists(F.split(x, "\\s+"), lambda w: w.isin(">>", "<<")))
        actions = F.size(F.filter(told, lambda x: x.startswith(":") & x.endswith(";")))
        return (
            F.when((word == "graph") & second.isin(DIRECTIONS), "mermaid")
            .when(taken | drawn | joined, "diagrams")
            .when(kinds[word].isNotNull(), kinds[word])
            .when(word.startswith("{") | word.startswith("["), F.when(_elements(text) > 0, "cytoscape"))
            .otherwise(let(F.struct(actions.alias("uml"), _read_by_d2(told).alias("d2")), lambda n: F.when((n["uml"] > 0) & (n["uml"] >= n["d2"]), "plantuml").when(n["d2"] > 0, "d2")))
        )

    told = F.filter(F.transform(lines(strip_fence(text)), strip), lambda x: (x != "") & ~F.array_contains(F.transform(F.array(*map(F.lit, COMMENTS)), lambda c: x.startswith(c)), True))
    return let(told, opened)


def _elements(text: Column) -> Column:
    held = cytoscape(text)
    return F.size(held["nodes"]) + F.size(held["edges"])


def _read_by_d2(told: Column) -> Column:
    """How many edges D2's parser finds whose ends are plain names, in texts that have an arrow at all."""
    graph = d2(F.array_join(told, "\n"))
    plain = lambda name: (F.translate(name, "[](){}<>|;=@", "") == name) & (name != "")
    return F.size(F.filter(graph["edges"], lambda e: plain(e["src"]) & plain(e["dst"])))


def told(graph: Column) -> Column:
    """A graph as a report shows it: labels of nodes, and of edges their ends' labels and their own, as JSON."""
    edges = F.transform(labelled_edges(graph), lambda e: F.array(e["src"], e["dst"], F.coalesce(e["label"], F.lit(""))))
    return F.to_json(F.struct(F.transform(graph["nodes"], lambda n: n["label"]).alias("nodes"), edges.alias("edges")))


def labelled_edges(graph: Column) -> Column:
    """Edges with the labels of their ends in place of ids."""
    label = lambda i: F.coalesce(F.get(F.filter(graph["nodes"], lambda n: n["id"] == i), F.lit(0))["label"], i)
    return F.transform(graph["edges"], lambda e: _edge(label(e["src"]), label(e["dst"]), e["label"]))

"""Values of expressions in Python code, told from its syntax tree; nothing is run.

Names, literals, arithmetic, items and slices, a few functions of numbers and
lists, and comprehensions of one loop have values; everything else has none.
Work is bounded by a number of steps and by the size of what is made.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable

STEPS, LONGEST = 20_000, 10_000


class NoValue(ValueError):
    """An expression that can't be told, or that takes too many steps."""


def _power(a: object, b: object) -> object:
    if abs(a) > 1e6 or abs(b) > 64:
        raise NoValue("a power out of bounds")
    return a**b


_BINARY: dict[type, Callable] = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv,
    ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: _power,
}
_UNARY: dict[type, Callable] = {ast.USub: operator.neg, ast.UAdd: operator.pos, ast.Not: operator.not_}
_COMPARE: dict[type, Callable] = {
    ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge,
}


def _range(*bounds: int) -> list[int]:
    numbers = range(*bounds)
    if len(numbers) > LONGEST:
        raise NoValue("a range out of bounds")
    return list(numbers)


_FUNCTIONS: dict[str, Callable] = {
    "range": _range, "list": list, "tuple": tuple, "len": len, "sum": sum, "min": min, "max": max, "round": round, "abs": abs,
    "sorted": sorted, "reversed": lambda x: list(reversed(x)), "zip": lambda *x: list(zip(*x)), "enumerate": lambda *x: list(enumerate(*x)),
    "str": str, "int": int, "float": float, "dict": dict,
}


class Fold:
    """Values in an environment of names, within a budget of steps."""

    def __init__(self, names: dict[str, object], steps: int = STEPS):
        self.names = names
        self.left = steps

    def value(self, node: ast.AST) -> object:
        self.left -= 1
        if self.left < 0:
            raise NoValue("too many steps")
        if type(node) is ast.Constant and not isinstance(node.value, str):
            return node.value
        try:
            got = getattr(self, f"_{type(node).__name__}", self._unknown)(node)
        except NoValue:
            raise
        except (TypeError, ValueError, ArithmeticError, LookupError, RecursionError, MemoryError) as e:
            raise NoValue(str(e)) from e
        if isinstance(got, (list, tuple, dict, str)) and len(got) > LONGEST:
            raise NoValue("a value out of bounds")
        return got

    def _unknown(self, node: ast.AST) -> object:
        raise NoValue(f"no value for {type(node).__name__}")

    def _Constant(self, node: ast.Constant) -> object:
        return node.value

    def _Name(self, node: ast.Name) -> object:
        return self.names[node.id]

    def _List(self, node: ast.List) -> list:
        return [self.value(x) for x in node.elts]

    def _Tuple(self, node: ast.Tuple) -> tuple:
        return tuple(self.value(x) for x in node.elts)

    def _Dict(self, node: ast.Dict) -> dict:
        return {self.value(k): self.value(v) for k, v in zip(node.keys, node.values, strict=True)}

    def _BinOp(self, node: ast.BinOp) -> object:
        a, b = self.value(node.left), self.value(node.right)
        if isinstance(node.op, ast.Mult):
            for many, times in ((a, b), (b, a)):
                if isinstance(many, (list, tuple, str)) and len(many) * max(times, 0) > LONGEST:
                    raise NoValue("a product out of bounds")
        return _BINARY[type(node.op)](a, b)

    def _UnaryOp(self, node: ast.UnaryOp) -> object:
        return _UNARY[type(node.op)](self.value(node.operand))

    def _Compare(self, node: ast.Compare) -> bool:
        sides = [self.value(x) for x in (node.left, *node.comparators)]
        return all(_COMPARE[type(op)](a, b) for op, a, b in zip(node.ops, sides, sides[1:], strict=False))

    def _IfExp(self, node: ast.IfExp) -> object:
        return self.value(node.body if self.value(node.test) else node.orelse)

    def _Subscript(self, node: ast.Subscript) -> object:
        return self.value(node.value)[self.value(node.slice)]

    def _Slice(self, node: ast.Slice) -> slice:
        return slice(*(None if x is None else self.value(x) for x in (node.lower, node.upper, node.step)))

    def _JoinedStr(self, node: ast.JoinedStr) -> str:
        return "".join(str(self.value(x)) for x in node.values)

    def _FormattedValue(self, node: ast.FormattedValue) -> str:
        return format(self.value(node.value), self.value(node.format_spec) if node.format_spec else "")

    def _Call(self, node: ast.Call) -> object:
        if not isinstance(node.func, ast.Name):
            return self._unknown(node)
        arguments = [self.value(x) for x in node.args]
        return _FUNCTIONS[node.func.id](*arguments, **{k.arg: self.value(k.value) for k in node.keywords if k.arg})

    def _comprehended(self, loops: list[ast.comprehension], made: Callable[[Fold], object]) -> list:
        if len(loops) != 1 or loops[0].is_async:
            raise NoValue("more than one loop")
        out = []
        for item in self.value(loops[0].iter):
            inner = Fold({**self.names, **_bound(loops[0].target, item)}, self.left)
            if all(inner.value(test) for test in loops[0].ifs):
                out.append(made(inner))
            self.left = inner.left
        return out

    def _ListComp(self, node: ast.ListComp) -> list:
        return self._comprehended(node.generators, lambda inner: inner.value(node.elt))

    _GeneratorExp = _ListComp

    def _DictComp(self, node: ast.DictComp) -> dict:
        return dict(self._comprehended(node.generators, lambda inner: (inner.value(node.key), inner.value(node.value))))


def _bound(target: ast.AST, value: object) -> dict[str, object]:
    """The names that an assignment gives values."""
    if isinstance(target, ast.Name):
        return {target.id: value}
    if isinstance(target, (ast.Tuple, ast.List)):
        parts = list(value)
        if len(parts) == len(target.elts):
            return {k: v for t, x in zip(target.elts, parts, strict=True) for k, v in _bound(t, x).items()}
    raise NoValue("a target without names")


def values_of(tree: ast.Module) -> dict[str, object]:
    """What the names of a module are given, in order; a name whose value can't be told is forgotten."""
    names: dict[str, object] = {}
    for node in tree.body:
        if not isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)) or node.value is None:
            continue
        targets = node.targets if isinstance(node, ast.Assign) else [node.target]
        try:
            value = Fold(names).value(ast.BinOp(node.target, node.op, node.value) if isinstance(node, ast.AugAssign) else node.value)
            for target in targets:
                names.update(_bound(target, value))
        except (NoValue, TypeError):
            for target in targets:
                for x in ast.walk(target):
                    if isinstance(x, ast.Name):
                        names.pop(x.id, None)
    return names


_CLOSES = {"(": ")", "[": "]", "{": "}"}


def _open_places(code: str) -> tuple[list[tuple[int, str]], int | None]:
    """Places where code may be cut, with what closes it there, and where a string that isn't ended begins.

    A cut stands after an element: before a comma inside brackets, or at the end.
    """
    stack: list[str] = []
    places: list[tuple[int, str]] = []
    at, quote, began = 0, "", None
    while at < len(code):
        c = code[at]
        if quote:
            if c == "\\":
                at += 1
            elif code.startswith(quote, at):
                at += len(quote) - 1
                quote, began = "", None
        elif c in "'\"":
            quote = code[at : at + 3] if code[at : at + 3] in ("'''", '"""') else c
            began = at
            at += len(quote) - 1
        elif c == "#":
            at = code.find("\n", at)
            if at < 0:
                break
        elif c in _CLOSES:
            stack.append(_CLOSES[c])
        elif c in ")]}":
            if not stack or stack.pop() != c:
                return [], None
        elif c == "," and stack:
            places.append((at, "".join(reversed(stack))))
        at += 1
    if stack and not quote:
        places.append((len(code), "".join(reversed(stack))))
    return places, began


def parsed(code: str | None, tries: int = 8) -> ast.Module | None:
    """The syntax tree of code; of code that was cut off inside brackets, that of what stands whole."""

    def tree(text: str) -> ast.Module | None:
        try:
            return ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None

    whole = tree(code or "")
    if whole is not None or not code:
        return whole
    for place, closes in reversed(_open_places(code)[0][-tries:]):
        found = tree(code[:place] + closes)
        if found is not None:
            return found
    return None

"""A compiler for a sandboxed template language: source, tokens, syntax tree, folded tree, Python closures.

    {{ expression }}                               its value as text; null as nothing
    {% for x in expression %} ... {% endfor %}     loop.index, loop.index0, loop.first and loop.last are known inside
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set x = expression %}
    {% generation %} ... {% endgeneration %}       what is inside is under the loss mask
    {# remark #}                                   a minus inside a delimiter strips white space on that side

Expressions: names, a.b and a['b'] (keys of mappings only, never attributes of objects), strings, numbers,
true, false, none, + ~ == != < > <= >= in, not, and, or, x if c else y, and filters after |. There are no calls,
no assignment to keys and no way to Python objects. Loops draw their items one at a time, so that a long
conversation is rendered as a stream.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any, NamedTuple

MARKUP = re.compile("|".join(rf"(\{{{a}-?)(.*?)(-?{b}\}})" for a, b in ((r"\{", r"\}"), ("%", "%"), ("#", "#"))), re.DOTALL)
TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>|.,()\[\]=]))", re.DOTALL)
ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
FILTERS: dict[str, Callable[[Any], Any]] = {
    "upper": lambda x: text(x).upper(), "lower": lambda x: text(x).lower(), "trim": lambda x: text(x).strip(),
    "length": lambda x: len(x), "string": lambda x: text(x), "first": lambda x: x[0], "last": lambda x: x[-1],
}


class TemplateError(ValueError):
    """The source is not a template, or a value does not allow what is asked of it."""


class Node(NamedTuple):
    kind: str
    args: tuple


def text(x: Any) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, str | int | float):
        return str(x)
    raise TemplateError(f"no text form of {type(x).__name__}")


class Parser:
    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.filters = filters
        self.parts = self.split(source)
        self.at = 0

    def split(self, source: str) -> list[tuple[str, str]]:
        parts, at, strip = [], 0, False
        for m in MARKUP.finditer(source):
            opening, body, closing = (g for g in m.groups() if g is not None)
            before = source[at : m.start()]
            before = before.lstrip() if strip else before
            parts.append(("text", before.rstrip() if opening.endswith("-") else before))
            if opening[:2] != "{#":
                parts.append(("value" if opening[:2] == "{{" else "tag", body.strip()))
            at, strip = m.end(), closing.startswith("-")
        rest = source[at:]
        parts.append(("text", rest.lstrip() if strip else rest))
        if any(k == "text" and re.search(r"\{[{%#]", p) for k, p in parts):
            raise TemplateError("a delimiter is not closed")
        return [p for p in parts if p[0] != "text" or p[1]]

    def block(self, *ends: str) -> tuple[Node, str]:
        """Nodes up to a tag that starts with one of ends; that tag."""
        out = []
        while self.at < len(self.parts):
            kind, body = self.parts[self.at]
            self.at += 1
            word = body.split(None, 1)[0] if kind == "tag" and body else ""
            if kind == "text":
                out.append(Node("const", (body,)))
            elif kind == "value":
                out.append(Node("out", (self.whole(body),)))
            elif word in ends:
                return Node("block", tuple(out)), body
            else:
                out.append(self.tag(word, body))
        if ends:
            raise TemplateError(f"{ends[0]} is missing")
        return Node("block", tuple(out)), ""

    def tag(self, word: str, body: str) -> Node:
        if word == "for" and (m := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", body, re.DOTALL)):
            return Node("for", (m[1], self.whole(m[2]), self.block("endfor")[0]))
        if word == "if":
            condition = self.whole(body[2:])
            then, end = self.block("elif", "else", "endif")
            if end.startswith("elif"):
                return Node("if", (condition, then, Node("block", (self.tag("if", end[2:]),))))
            return Node("if", (condition, then, self.block("endif")[0] if end == "else" else Node("block", ())))
        if word == "set" and (m := re.fullmatch(r"set\s+([A-Za-z_]\w*)\s*=\s*(.+)", body, re.DOTALL)):
            return Node("set", (m[1], self.whole(m[2])))
        if body == "generation":
            return Node("generation", (self.block("endgeneration")[0],))
        raise TemplateError(f"unknown tag {body!r}")

    def whole(self, source: str) -> Node:
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            if not (m := TOKEN.match(source, at)):
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        found = self.choice()
        if self.tokens[0][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return found

    def take(self, *words: str) -> str | None:
        kind, word = self.tokens[0]
        if kind in ("op", "name") and word in words:
            self.tokens.pop(0)
            return word
        return None

    def need(self, word: str) -> None:
        if not self.take(word):
            raise TemplateError(f"{word} is missing before {self.tokens[0][1]!r}")

    def choice(self) -> Node:
        value = self.either()
        if self.take("if"):
            condition = self.either()
            self.need("else")
            return Node("choice", (condition, value, self.choice()))
        return value

    def either(self) -> Node:
        left = self.both()
        while self.take("or"):
            left = Node("or", (left, self.both()))
        return left

    def both(self) -> Node:
        left = self.negated()
        while self.take("and"):
            left = Node("and", (left, self.negated()))
        return left

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        left = self.summed()
        while op := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
            left = Node("compare", (op, left, self.summed()))
        return left

    def summed(self) -> Node:
        left = self.filtered()
        while op := self.take("+", "-", "~"):
            left = Node("join" if op == "~" else "sum" if op == "+" else "less", (left, self.filtered()))
        return left

    def filtered(self) -> Node:
        value = self.item()
        while self.take("|"):
            kind, name = self.tokens.pop(0)
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"unknown filter {name!r}")
            value = Node("filter", (name, value))
        return value

    def item(self) -> Node:
        kind, word = self.tokens.pop(0)
        if kind == "string":
            value = Node("const", (re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[0]), word[1:-1], flags=re.DOTALL),))
        elif kind == "number":
            value = Node("const", (float(word) if "." in word else int(word),))
        elif kind == "name" and word in ("true", "false", "none"):
            value = Node("const", ({"true": True, "false": False, "none": None}[word],))
        elif kind == "name" and word not in ("and", "or", "not", "in", "if", "else"):
            value = Node("name", (word,))
        elif (kind, word) == ("op", "("):
            value = self.choice()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {word!r}")
        while op := self.take(".", "["):
            if op == "[":
                value = Node("key", (value, self.choice()))
                self.need("]")
            else:
                kind, word = self.tokens.pop(0)
                if kind != "name":
                    raise TemplateError(f"a key is missing after {op}")
                value = Node("key", (value, Node("const", (word,))))
        return value


def fold(node: Node, filters: Mapping[str, Callable]) -> Node:
    """The tree with constant parts computed: expressions of constants, choices of a known side, texts side by side."""
    kind, args = node.kind, tuple(fold(a, filters) if isinstance(a, Node) else a for a in node.args)
    if kind == "block":
        out: list[Node] = []
        for a in args:
            for b in a.args if a.kind == "block" else (a,):
                if b.kind == "const" and out and out[-1].kind == "const":
                    out[-1] = Node("const", (out[-1].args[0] + b.args[0],))
                elif b != Node("const", ("",)):
                    out.append(b)
        return Node("block", tuple(out))
    known = [a.args[0] for a in args if isinstance(a, Node) and a.kind == "const"]
    if kind == "out" and known:
        return Node("const", (text(known[0]),))
    if kind in ("if", "choice") and args[0].kind == "const":
        return args[1] if args[0].args[0] else args[2]
    if kind in ("or", "and", "not", "compare", "sum", "less", "join", "filter", "key") and len(known) == sum(isinstance(a, Node) for a in args):
        return Node("const", (value(Node(kind, args), filters)({}),))
    return Node(kind, args)


def key(x: Any, name: Any) -> Any:
    if isinstance(x, Mapping):
        return x.get(name)
    if isinstance(x, list | tuple) and isinstance(name, int):
        return x[name]
    raise TemplateError(f"{type(x).__name__} has no keys")


COMPARE: dict[str, Callable[[Any, Any], bool]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}


def value(node: Node, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    """A closure that computes an expression from the names' values."""
    kind, args = node.kind, node.args
    if kind == "const":
        return lambda _, x=args[0]: x
    if kind == "name":
        return lambda names, x=args[0]: names.get(x)
    if kind == "compare":
        op, a, b = COMPARE[args[0]], value(args[1], filters), value(args[2], filters)
        return lambda names: op(a(names), b(names))
    if kind == "filter":
        f, a = filters[args[0]], value(args[1], filters)
        return lambda names: f(a(names))
    own = [value(a, filters) for a in args]
    if kind == "choice":
        return lambda names: own[1](names) if own[0](names) else own[2](names)
    if kind == "not":
        return lambda names: not own[0](names)
    a, b = own
    return {
        "and": lambda names: a(names) and b(names), "or": lambda names: a(names) or b(names), "key": lambda names: key(a(names), b(names)),
        "sum": lambda names: a(names) + b(names), "less": lambda names: a(names) - b(names), "join": lambda names: text(a(names)) + text(b(names)),
    }[kind]


Piece = tuple[str, bool]


def body(node: Node, filters: Mapping[str, Callable]) -> Callable[[dict, bool], Iterator[Piece]]:
    """A closure that yields pieces (text, under the loss mask)."""
    kind, args = node.kind, node.args
    if kind == "const":
        return lambda _, mask, x=args[0]: iter(((x, mask),))
    if kind == "out":
        found = value(args[0], filters)
        return lambda names, mask: iter(((text(found(names)), mask),))
    if kind == "set":
        name, found = args[0], value(args[1], filters)

        def put(names: dict, _: bool) -> Iterator[Piece]:
            names[name] = found(names)
            return iter(())

        return put
    if kind == "generation":
        inner = body(args[0], filters)
        return lambda names, _: inner(names, True)
    if kind == "if":
        condition, yes, no = value(args[0], filters), body(args[1], filters), body(args[2], filters)
        return lambda names, mask: yes(names, mask) if condition(names) else no(names, mask)
    if kind == "for":
        name, items, inner = args[0], value(args[1], filters), body(args[2], filters)

        def loop(names: dict, mask: bool) -> Iterator[Piece]:
            source, k = iter(items(names) or ()), 0
            ahead = next(source, loop)
            while ahead is not loop:
                now, ahead = ahead, next(source, loop)
                yield from inner(names | {name: now, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": ahead is loop}}, mask)
                k += 1

        return loop
    own = [body(a, filters) for a in args]

    def block(names: dict, mask: bool) -> Iterator[Piece]:
        for f in own:
            yield from f(names, mask)

    return block


def compiled(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[[dict], Iterator[Piece]]:
    """The template as a function of its names' values that yields pieces (text, under the loss mask)."""
    filters = FILTERS | dict(filters or {})
    run = body(fold(Parser(source, filters).block()[0], filters), filters)
    return lambda names: run(dict(names), False)

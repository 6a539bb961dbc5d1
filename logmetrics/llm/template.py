"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}                         output
    {% for name in expression %} … {% endfor %}
    {% if expression %} … {% elif … %} … {% else %} … {% endif %}
    {% set name = expression %}
    {% generation %} … {% endgeneration %}   output that a loss mask marks
    {# comment #}

Expressions have names, strings, numbers, true, false, none, ``a.b`` and
``a['b']`` (keys of mappings only), ``loop.index``, ``loop.first``,
``loop.last``, the filters given to :func:`compile_template`, ``+`` on strings
and numbers, comparisons, ``in``, ``not``, ``and``, ``or`` and brackets. There
are no calls, no attributes of Python objects, and no access to anything but the
values given; a name or key that is missing is an error.

A template is parsed to a syntax tree; constant parts are folded (also through
filters, and branches whose condition is constant); then every node becomes one
closure that writes to a list of pieces.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKENS = re.compile(
    r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)"
    r"|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|<=|>=|[<>+|.\[\]()=])|(?P<bad>\S))",
    re.S,
)
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None}
_RESERVED = {"and", "or", "not", "in", "for", "if", *_WORDS}


class TemplateError(ValueError):
    """A template that does not parse, or a value it asks for that is not there."""


@dataclass(frozen=True)
class Node:
    """A tree node: its kind, its children, and whatever else the kind needs."""

    kind: str
    children: tuple[Node, ...] = ()
    value: object = None


def _const(value: object) -> Node:
    return Node("const", value=value)


class _Expression:
    """Recursive descent over one tag's tokens."""

    def __init__(self, source: str) -> None:
        self.source, self.tokens, at = source, [], 0
        while source[at:].strip():
            found = _TOKENS.match(source, at)
            if found.lastgroup == "bad":
                raise TemplateError(f"unexpected {found['bad']!r} in {source!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in wanted

    def take(self, *wanted: str) -> bool:
        if self.peek(*wanted):
            self.at += 1
            return True
        return False

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise TemplateError(f"expected {mark!r} in {self.source!r}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name" or self.tokens[self.at][1] in _RESERVED:
            raise TemplateError(f"expected a name in {self.source!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.source!r}")

    def whole(self) -> Node:
        node = self.either()
        self.end()
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", (node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", (node, self.negated()))
        return node

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.added()
        while self.peek(*_COMPARE, "in"):
            sign = self.tokens[self.at][1]
            self.at += 1
            node = Node("compare", (node, self.added()), sign)
        return node

    def added(self) -> Node:
        node = self.filtered()
        while self.take("+"):
            node = Node("add", (node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.single()
        while self.take("|"):
            node = Node("filter", (node,), self.name())
        return node

    def single(self) -> Node:
        if self.take("("):
            node = self.either()
            self.need(")")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] in ("string", "number"):
            kind, text = self.tokens[self.at]
            self.at += 1
            node = _const(int(text) if kind == "number" else re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        elif self.peek(*_WORDS):
            node = _const(_WORDS[self.tokens[self.at][1]])
            self.at += 1
        else:
            node = Node("name", value=self.name())
        while True:
            if self.take("."):
                node = Node("item", (node, _const(self.name())))
            elif self.take("["):
                node = Node("item", (node, self.either()))
                self.need("]")
            else:
                return node


@dataclass
class _Body:
    """Nested nodes of a template that is cut into text and tags."""

    parts: list[str]
    at: int = 0

    def nodes(self, *ends: str) -> tuple[Node, str, str]:
        """Nodes up to one of the tags ``ends``; which one it was, and the rest of its text."""
        out: list[Node] = []
        while self.at < len(self.parts):
            part = self.parts[self.at]
            self.at += 1
            if part.startswith("{#") and part.endswith("#}"):
                continue
            if part.startswith("{{") and part.endswith("}}"):
                out.append(Node("print", (_Expression(part[2:-2]).whole(),)))
            elif part.startswith("{%") and part.endswith("%}"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return Node("body", tuple(out)), word, rest
                out.append(self.tag(word, rest))
            elif part:
                out.append(Node("print", (_const(part),)))
        if ends:
            raise TemplateError(f"missing {{% {ends[-1]} %}}")
        return Node("body", tuple(out)), "", ""

    def tag(self, word: str, rest: str) -> Node:
        if word == "for":
            parsed = _Expression(rest)
            name = parsed.name()
            parsed.need("in")
            over = parsed.whole()
            body, _, _ = self.nodes("endfor")
            return Node("for", (over, body), name)
        if word == "if":
            return self.choice(rest)
        if word == "set":
            parsed = _Expression(rest)
            name = parsed.name()
            parsed.need("=")
            return Node("set", (parsed.whole(),), name)
        if word == "generation":
            body, _, _ = self.nodes("endgeneration")
            return Node("generation", (body,))
        raise TemplateError(f"unknown tag {word!r}")

    def choice(self, rest: str) -> Node:
        test = _Expression(rest).whole()
        body, end, more = self.nodes("elif", "else", "endif")
        other = Node("body")
        if end == "elif":
            other = self.choice(more)
        elif end == "else":
            other, _, _ = self.nodes("endif")
        return Node("if", (test, body, other))


def parse(source: str) -> Node:
    return _Body(_PARTS.split(source)).nodes()[0]


def _apply(node: Node, values: list[object], filters: Mapping[str, Callable]) -> object:
    """What an operator or filter makes of its operands."""
    if node.kind == "filter":
        return filters[node.value](values[0])
    if node.kind == "add":
        if not all(isinstance(v, str) for v in values) and not all(type(v) is int for v in values):
            raise TemplateError("'+' takes two strings or two numbers")
        return values[0] + values[1]
    if node.kind == "compare":
        return values[0] in values[1] if node.value == "in" else _COMPARE[node.value](values[0], values[1])
    if node.kind == "not":
        return not values[0]
    raise TemplateError(node.kind)


def fold(node: Node, filters: Mapping[str, Callable]) -> Node:
    """The tree with everything constant computed and neighbouring constant output joined."""
    if node.kind == "filter" and node.value not in filters:
        raise TemplateError(f"unknown filter {node.value!r}")
    children = tuple(fold(c, filters) for c in node.children)
    node = Node(node.kind, children, node.value)
    constant = bool(children) and all(c.kind == "const" for c in children)
    if node.kind in ("filter", "add", "compare", "not") and constant:
        return _const(_apply(node, [c.value for c in children], filters))
    if node.kind in ("and", "or") and children[0].kind == "const":
        return children[1] if bool(children[0].value) == (node.kind == "and") else children[0]
    if node.kind == "if" and children[0].kind == "const":
        return children[1] if children[0].value else children[2]
    if node.kind == "body":
        out: list[Node] = []
        for child in (g for c in children for g in (c.children if c.kind == "body" else (c,))):
            fixed = child.kind == "print" and child.children[0].kind == "const"
            if fixed and out and out[-1].kind == "print" and out[-1].children[0].kind == "const":
                joined = _text(out[-1].children[0].value) + _text(child.children[0].value)
                out[-1] = Node("print", (_const(joined),))
            else:
                out.append(child)
        return Node("body", tuple(out))
    return node


def _text(value: object) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def _value(node: Node, filters: Mapping[str, Callable]) -> Callable[[dict], object]:
    """A closure (names -> value) for an expression."""
    if node.kind == "const":
        return lambda names, v=node.value: v
    if node.kind == "name":

        def look(names: dict, name: str = node.value) -> object:
            try:
                return names[name]
            except KeyError:
                raise TemplateError(f"no value for {name!r}") from None

        return look
    parts = [_value(c, filters) for c in node.children]
    if node.kind == "item":

        def item(names: dict) -> object:
            held, key = parts[0](names), parts[1](names)
            if not isinstance(held, Mapping) or key not in held:
                raise TemplateError(f"no key {key!r}")
            return held[key]

        return item
    if node.kind == "and":
        return lambda names: parts[0](names) and parts[1](names)
    if node.kind == "or":
        return lambda names: parts[0](names) or parts[1](names)
    if node.kind == "filter":
        return lambda names, f=filters[node.value]: f(parts[0](names))
    return lambda names: _apply(node, [p(names) for p in parts], filters)


class Output:
    """Pieces of output and the ranges of characters that generation blocks wrote."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.length = 0
        self.marks: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def _writer(node: Node, filters: Mapping[str, Callable]) -> Callable[[dict, Output], None]:
    """A closure (names, output) for a node that writes."""
    if node.kind == "body":
        steps = [_writer(c, filters) for c in node.children]

        def body(names: dict, out: Output) -> None:
            for step in steps:
                step(names, out)

        return body
    if node.kind == "print":
        if node.children[0].kind == "const":
            return lambda names, out, text=_text(node.children[0].value): out.write(text)
        shown = _value(node.children[0], filters)
        return lambda names, out: out.write(_text(shown(names)))
    if node.kind == "set":
        given = _value(node.children[0], filters)
        return lambda names, out: names.__setitem__(node.value, given(names))
    if node.kind == "if":
        test, then, other = _value(node.children[0], filters), *(_writer(c, filters) for c in node.children[1:])
        return lambda names, out: (then if test(names) else other)(names, out)
    if node.kind == "generation":
        inner = _writer(node.children[0], filters)

        def generation(names: dict, out: Output) -> None:
            begin = out.length
            inner(names, out)
            out.marks.append((begin, out.length))

        return generation
    over, each = _value(node.children[0], filters), _writer(node.children[1], filters)

    def loop(names: dict, out: Output) -> None:
        values = list(over(names))
        for k, value in enumerate(values):
            own = {"index": k + 1, "first": k == 0, "last": k == len(values) - 1}
            each({**names, node.value: value, "loop": own}, out)

    return loop


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from values to (text, ranges of characters under the loss mask)."""
    filters = dict(filters or {})
    write = _writer(fold(parse(source), filters), filters)

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        write(dict(names), out)
        return "".join(out.pieces), out.marks

    return render

"""A compiler for chat templates: a sandboxed template language to Python closures.

The language: text, {{ expression }}, {# comment #}, and the statements

    {% for x in list %} .. {% else %} .. {% endfor %}     {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}
    {% set name = e %}     {% generation %} .. {% endgeneration %}

A hyphen inside a mark ({%- or -%}) takes away the white space beside it. Expressions
have strings, whole numbers, true, false, none, names, x.key, x['key'], x[0], not, and,
or, == != < <= > >=, in, + - ~, "a if c else b", tests (is defined, is none), and filters
(x | name). In a loop, loop.index, loop.index0, loop.first, loop.last, loop.previous and
loop.next are known.

compile_template() parses into a syntax tree, folds its constants (operators, filters and
conditions on constants, and text beside text), and turns each node into a closure. There
are no calls but the given filters, no attributes of Python objects (keys of mappings and
places of lists alone), and no loops but over given lists, so that a template can neither
reach the interpreter nor run on without end. A template that uses anything else fails
when it is compiled.

A rendering is a stream of (text, generated) parts, so that a list may be a stream as
well: of an Ahead a template may read the first places and loop over it once.
"""

from __future__ import annotations

import itertools
import operator
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, replace
from typing import Any

MOST_DEPTH = 50
#: places of a stream that a template may read before its loop
MOST_AHEAD = 16


class TemplateError(ValueError):
    """The template cannot be compiled, or does what it may not."""


# The syntax tree.


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """A strict operator or a filter: all its operands are evaluated."""

    name: str
    operands: tuple


@dataclass(frozen=True)
class Choice:
    """then if test else other; and, or are choices too."""

    test: Any
    then: Any
    other: Any


@dataclass(frozen=True)
class Keep:
    """and (found=False) or or (found=True): the first operand where its truth is found, else the second."""

    first: Any
    second: Any
    found: bool


@dataclass(frozen=True)
class Out:
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    items: Any
    body: tuple
    other: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


class Ahead:
    """An iterator whose next elements can be read before they are taken."""

    def __init__(self, items: Iterable) -> None:
        self._items, self._held = iter(items), deque()

    def peek(self, place: int) -> Any:
        """The element at a place ahead, None beyond the end."""
        if not 0 <= place < MOST_AHEAD:
            raise TemplateError(f"a stream can be read {MOST_AHEAD} places ahead")
        self._held.extend(itertools.islice(self._items, max(0, place + 1 - len(self._held))))
        return self._held[place] if place < len(self._held) else None

    def __iter__(self) -> Ahead:
        return self

    def __next__(self) -> Any:
        return self._held.popleft() if self._held else next(self._items)

    def __bool__(self) -> bool:
        return self.peek(0) is not None


def shown(value: Any) -> str:
    """A value as a template prints it: nothing for none."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str | int):
        return str(value)
    raise TemplateError(f"a {type(value).__name__} cannot be printed")


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, Mapping):
        return of.get(key)
    if isinstance(key, int) and isinstance(of, Ahead):
        return of.peek(key)
    if isinstance(key, int) and isinstance(of, str | list | tuple):
        return of[key] if -len(of) <= key < len(of) else None
    if of is None:
        return None
    raise TemplateError(f"a {type(of).__name__} has no parts")


def _plus(a: Any, b: Any) -> Any:
    if isinstance(a, str) != isinstance(b, str):
        raise TemplateError("+ of a text and something else; use ~")
    return a + b


FILTERS: dict[str, Callable] = {
    "trim": lambda x: shown(x).strip(),
    "upper": lambda x: shown(x).upper(),
    "lower": lambda x: shown(x).lower(),
    "length": lambda x: len(x) if isinstance(x, str | list | tuple | Mapping) else 0,
}
_OPERATORS: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "+": _plus, "-": operator.sub, "~": lambda a, b: shown(a) + shown(b), "in": lambda a, b: a in (b or ()),
    "not": operator.not_, "negative": operator.neg, "is none": lambda x: x is None, "is defined": lambda x: x is not None,
}

# Reading.

_MARK = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+~<>|.()\[\],=]))""", re.S)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_KEPT = {"and", "or", "not", "in", "is", "if", "else", *_WORDS}
_COMPARED = {"==", "!=", "<", "<=", ">", ">=", "in"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at : at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """One expression by recursive descent: each method reads one level of binding, from the weakest on."""

    def __init__(self, source: str, filters: Mapping[str, Callable]) -> None:
        self.tokens, self.at, self.filters, self.depth = _tokens(source), 0, filters, 0

    def ahead(self, value: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] == value

    def takes(self, value: str) -> bool:
        found = self.ahead(value)
        self.at += found
        return found

    def next(self, kind: str) -> str:
        if self.at == len(self.tokens) or self.tokens[self.at][0] != kind:
            raise TemplateError(f"a {kind} is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def needs(self, value: str) -> None:
        if not self.takes(value):
            raise TemplateError(f"{value!r} is missing")

    def whole(self) -> Any:
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is one too many")
        return node

    def choice(self) -> Any:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise TemplateError("nested too deeply")
        node = self.either()
        if self.takes("if"):
            test = self.either()
            node = Choice(test, node, self.choice() if self.takes("else") else Const(None))
        self.depth -= 1
        return node

    def either(self) -> Any:
        node = self.both()
        while self.takes("or"):
            node = Keep(node, self.both(), True)
        return node

    def both(self) -> Any:
        node = self.negated()
        while self.takes("and"):
            node = Keep(node, self.negated(), False)
        return node

    def negated(self) -> Any:
        flips = 0
        while self.takes("not"):
            flips += 1
        node = self.compared()
        return node if not flips else Apply("not", (node,)) if flips % 2 else Apply("not", (Apply("not", (node,)),))

    def compared(self) -> Any:
        node = self.joined()
        while True:
            if self.takes("is"):
                flip = self.takes("not")
                node = Apply(f"is {self.next('name')}", (node,))
                if node.name not in _OPERATORS:
                    raise TemplateError(f"no test {node.name!r}")
                node = Apply("not", (node,)) if flip else node
            elif self.ahead("not") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
                self.at += 2
                node = Apply("not", (Apply("in", (node, self.joined())),))
            elif self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in _COMPARED:
                self.at += 1
                sign = self.tokens[self.at - 1][1]
                node = Apply(sign, (node, self.joined()))
            else:
                return node

    def joined(self) -> Any:
        node = self.filtered()
        while self.ahead("+") or self.ahead("-") or self.ahead("~"):
            sign = self.next("sign")
            node = Apply(sign, (node, self.filtered()))
        return node

    def filtered(self) -> Any:
        node = Apply("negative", (self.part(),)) if self.takes("-") else self.part()
        while self.takes("|"):
            name = self.next("name")
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            node = Apply(f"|{name}", (node,))
        return node

    def part(self) -> Any:
        node = self.atom()
        while True:
            if self.takes("."):
                node = Item(node, Const(self.next("name")))
            elif self.takes("["):
                node = Item(node, self.choice())
                self.needs("]")
            else:
                return node

    def atom(self) -> Any:
        if self.takes("("):
            node = self.choice()
            self.needs(")")
            return node
        if self.at == len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(value))
        if kind == "name" and value in _WORDS:
            return Const(_WORDS[value])
        if kind == "name" and value not in _KEPT and not value.startswith("_"):
            return Name(value)
        raise TemplateError(f"{value!r} is not expected here")


class _Template:
    """The marks of a template, and the statements that they make."""

    def __init__(self, source: str, filters: Mapping[str, Callable]) -> None:
        self.filters = filters
        self.parts: list[tuple[str, str]] = []
        at, trims = 0, False
        for m in [*_MARK.finditer(source), None]:
            text = source[at : m.start() if m else len(source)]
            text = text.lstrip() if trims else text
            if m and (m[1] or m[4] or m[7]):
                text = text.rstrip()
            if re.search(r"\{[{%#]", text):
                raise TemplateError("a mark is not closed")
            if text:
                self.parts.append(("text", text))
            if m:
                at, trims = m.end(), bool(m[3] or m[6] or m[8])
                if m[2] is not None:
                    self.parts.append(("out", m[2]))
                elif m[5] is not None:
                    self.parts.append(("statement", m[5].strip()))
        self.at = 0

    def expression(self, source: str) -> Any:
        return _Expression(source, self.filters).whole()

    def whole(self) -> tuple:
        body, end = self.block((), 0)
        return body

    def block(self, ends: tuple[str, ...], depth: int) -> tuple[tuple, str]:
        """Statements up to one of the ends, and that end."""
        if depth > MOST_DEPTH:
            raise TemplateError("nested too deeply")
        out = []
        while self.at < len(self.parts):
            kind, source = self.parts[self.at]
            self.at += 1
            if kind == "text":
                out.append(Out(Const(source)))
                continue
            if kind == "out":
                out.append(Out(self.expression(source)))
                continue
            word, _, rest = source.partition(" ")
            if word in ends:
                return tuple(out), source
            out.append(self.statement(word, rest.strip(), depth + 1))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(out), ""

    def statement(self, word: str, rest: str, depth: int) -> Any:
        if word == "set":
            m = re.fullmatch(r"([A-Za-z]\w*)\s*=\s*(.*)", rest, re.S)
            if not m or m[1] in _KEPT:
                raise TemplateError("set needs a name and a value")
            return Set(m[1], self.expression(m[2]))
        if word == "for":
            m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.*)", rest, re.S)
            if not m or m[1] in _KEPT:
                raise TemplateError("for needs a name and a list")
            items = self.expression(m[2])
            body, end = self.block(("else", "endfor"), depth)
            other = self.block(("endfor",), depth)[0] if end == "else" else ()
            return For(m[1], items, body, other)
        if word == "if":
            return self.condition(rest, depth)
        if word == "generation":
            return Generation(self.block(("endgeneration",), depth)[0])
        raise TemplateError(f"no statement {word!r}")

    def condition(self, source: str, depth: int) -> If:
        test = self.expression(source)
        then, end = self.block(("elif", "else", "endif"), depth)
        if end == "else":
            return If(test, then, self.block(("endif",), depth)[0])
        return If(test, then, (self.condition(end.removeprefix("elif"), depth + 1),) if end.startswith("elif") else ())


def parse(source: str, filters: Mapping[str, Callable] = FILTERS) -> tuple:
    """The syntax tree of a template."""
    return _Template(source, filters).whole()


# Folding.


def fold_expression(node: Any, filters: Mapping[str, Callable] = FILTERS) -> Any:
    """node with its constant parts evaluated."""
    match node:
        case Item(of, key):
            of, key = fold_expression(of, filters), fold_expression(key, filters)
            return Const(_item(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Item(of, key)
        case Apply(name, operands):
            operands = tuple(fold_expression(x, filters) for x in operands)
            if all(isinstance(x, Const) for x in operands):
                try:
                    return Const(_function(name, filters)(*(x.value for x in operands)))
                except TypeError as e:
                    raise TemplateError(f"{name!r} does not suit its operands") from e
            return Apply(name, operands)
        case Choice(test, then, other):
            test = fold_expression(test, filters)
            if isinstance(test, Const):
                return fold_expression(then if test.value else other, filters)
            return Choice(test, fold_expression(then, filters), fold_expression(other, filters))
        case Keep(first, second, found):
            first, second = fold_expression(first, filters), fold_expression(second, filters)
            if isinstance(first, Const):
                return first if bool(first.value) == found else second
            return Keep(first, second, found)
    return node


def fold(body: tuple, filters: Mapping[str, Callable] = FILTERS) -> tuple:
    """Statements with constants evaluated, decided conditions replaced by what they choose, and text joined with text."""
    out: list = []
    for node in body:
        match node:
            case Out(value):
                found = [Out(fold_expression(value, filters))]
            case Set(name, value):
                found = [Set(name, fold_expression(value, filters))]
            case Generation(inner):
                found = [Generation(fold(inner, filters))]
            case For(name, items, inner, other):
                found = [For(name, fold_expression(items, filters), fold(inner, filters), fold(other, filters))]
            case If(test, then, other):
                test = fold_expression(test, filters)
                found = list(fold(then if test.value else other, filters)) if isinstance(test, Const) else [If(test, fold(then, filters), fold(other, filters))]
        for x in found:
            if isinstance(x, Out) and isinstance(x.value, Const):
                text = shown(x.value.value)
                if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                    text = out.pop().value.value + text
                x = replace(x, value=Const(text))
                if not text:
                    continue
            out.append(x)
    return tuple(out)


# Closures.

Part = tuple[str, bool]
_END = object()


def _function(name: str, filters: Mapping[str, Callable]) -> Callable:
    return filters[name[1:]] if name.startswith("|") else _OPERATORS[name]


def _evaluator(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    match node:
        case Const(value):
            return lambda env: value
        case Name(name):
            return lambda env: env.get(name)
        case Item(of, Const(key)):
            of = _evaluator(of, filters)
            return lambda env: _item(of(env), key)
        case Item(of, key):
            of, key = _evaluator(of, filters), _evaluator(key, filters)
            return lambda env: _item(of(env), key(env))
        case Apply(name, (x,)):
            f, x = _function(name, filters), _evaluator(x, filters)
            return lambda env: f(x(env))
        case Apply(name, (x, y)):
            f, x, y = _function(name, filters), _evaluator(x, filters), _evaluator(y, filters)
            return lambda env: f(x(env), y(env))
        case Choice(test, then, other):
            test, then, other = (_evaluator(x, filters) for x in (test, then, other))
            return lambda env: then(env) if test(env) else other(env)
        case Keep(first, second, found):
            first, second = _evaluator(first, filters), _evaluator(second, filters)

            def keep(env: dict) -> Any:
                value = first(env)
                return value if bool(value) == found else second(env)

            return keep
    raise TemplateError(f"no expression {node!r}")


def _loop(items: Any) -> Iterator[tuple[Any, dict]]:
    """Each element with what the template may know of its place; one element is read ahead."""
    if items is None:
        return
    if not isinstance(items, Ahead | list | tuple):
        raise TemplateError(f"no loop over a {type(items).__name__}")
    previous, at, rest = None, 0, iter(items)
    now = next(rest, _END)
    while now is not _END:
        after = next(rest, _END)
        last = after is _END
        yield now, {"index0": at, "index": at + 1, "first": not at, "last": last, "previous": previous, "next": None if last else after}
        previous, now, at = now, after, at + 1


def _runner(body: tuple, filters: Mapping[str, Callable], generated: bool = False) -> Callable[[dict], Iterator[Part]]:
    steps = [_step(node, filters, generated) for node in body]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict) -> Iterator[Part]:
        for step in steps:
            yield from step(env)

    return run


def _step(node: Any, filters: Mapping[str, Callable], generated: bool) -> Callable[[dict], Iterator[Part]]:
    match node:
        case Out(Const(text)):
            part = (text, generated)
            return lambda env: iter((part,))
        case Out(value):
            value = _evaluator(value, filters)
            return lambda env: iter(((shown(value(env)), generated),))
        case Set(name, value):
            value = _evaluator(value, filters)

            def put(env: dict) -> Iterator[Part]:
                env[name] = value(env)
                return iter(())

            return put
        case Generation(inner):
            return _runner(inner, filters, True)
        case If(test, then, other):
            test, then, other = _evaluator(test, filters), _runner(then, filters, generated), _runner(other, filters, generated)
            return lambda env: then(env) if test(env) else other(env)
        case For(name, items, inner, other):
            items, inner, other = _evaluator(items, filters), _runner(inner, filters, generated), _runner(other, filters, generated)

            def each(env: dict) -> Iterator[Part]:
                own, none = dict(env), True
                for own[name], own["loop"] in _loop(items(env)):
                    none = False
                    yield from inner(own)
                if none:
                    yield from other(env)

            return each
    raise TemplateError(f"no statement {node!r}")


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[[dict], Iterator[Part]]:
    """A function of the known names to a stream of (text, whether a generation mark holds it). filters come beside FILTERS.

    A loop is a scope of its own: what is set in it is known in its later rounds, and not after it.
    """
    known = FILTERS | dict(filters or {})
    return _runner(fold(parse(source, known), known), known)

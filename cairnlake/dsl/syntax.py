"""The filter language: scanner, grammar and tree.

    expr := term (OR term)* ;  term := factor (AND factor)* ;  factor := (NOT | !)* primary
    primary := ( expr ) | key ? | key IN ( value, ... ) | key op value
"""

from __future__ import annotations

from dataclasses import dataclass

OPERATORS = ("=", "!=", ">", ">=", "<", "<=")


class FilterError(ValueError):
    """The text is no filter."""


@dataclass(frozen=True)
class Exists:
    key: str


@dataclass(frozen=True)
class Compare:
    key: str
    op: str
    value: str


@dataclass(frozen=True)
class In:
    key: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Not:
    item: Node


@dataclass(frozen=True)
class And:
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Or:
    items: tuple[Node, ...]


Node = Exists | Compare | In | Not | And | Or

_KEYWORDS = {"AND", "OR", "NOT", "IN"}
_NUMBER_START, _NUMBER = frozenset("0123456789"), frozenset("0123456789.-:T")


def scan(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each token; kinds: op, word, value, a keyword, or the mark itself.

    A number may go on with digits and ``. - : T``, so that dates need no quotes; a word
    starts with a letter or ``_`` and goes on with letters, digits, ``_`` and ``.``; quoted
    text has no escapes.
    """
    out: list[tuple[str, str]] = []
    at = 0

    def span(first: int, ok) -> int:
        while first < len(text) and ok(text[first]):
            first += 1
        return first

    while at < len(text):
        c = text[at]
        if c.isspace():
            at += 1
        elif text[at : at + 2] in OPERATORS:
            out.append(("op", text[at : at + 2]))
            at += 2
        elif c in OPERATORS:
            out.append(("op", c))
            at += 1
        elif c in "(),?!":
            out.append(("NOT" if c == "!" else c, c))
            at += 1
        elif c.isalpha() or c == "_":
            end = span(at, lambda x: x.isalnum() or x in "_.")
            word = text[at:end]
            out.append((word.upper() if word.upper() in _KEYWORDS else "word", word))
            at = end
        elif c in _NUMBER_START or c == "-" and text[at + 1 : at + 2] in _NUMBER_START and at + 1 < len(text):
            end = span(at + 1, _NUMBER.__contains__)
            out.append(("value", text[at:end]))
            at = end
        elif c in "\"'":
            end = text.find(c, at + 1)
            if end < 0:
                raise FilterError("unterminated string")
            out.append(("value", text[at + 1 : end]))
            at = end + 1
        else:
            raise FilterError(f"unexpected character: {c}")
    return out


def parse(text: str) -> Node:
    tokens = scan(text)
    if not tokens:
        raise FilterError("empty filter expression")
    at = 0

    def kind() -> str:
        return tokens[at][0] if at < len(tokens) else "end"

    def take(*wanted: str) -> str:
        nonlocal at
        if kind() not in wanted:
            raise FilterError(f"expected {' or '.join(wanted)}, found {tokens[at][1] if at < len(tokens) else 'the end'}")
        at += 1
        return tokens[at - 1][1]

    def chain(word: str, below, make) -> Node:
        items = [below()]
        while kind() == word:
            take(word)
            items.append(below())
        return make(tuple(items)) if len(items) > 1 else items[0]

    def factor() -> Node:
        turns = 0
        while kind() == "NOT":
            take("NOT")
            turns += 1
        node = primary()
        for _ in range(turns):
            node = Not(node)
        return node

    def primary() -> Node:
        if kind() == "(":
            take("(")
            node = expression()
            take(")")
            return node
        key = take("word")
        if kind() == "?":
            take("?")
            return Exists(key)
        if kind() == "IN":
            take("IN")
            take("(")
            values = [take("value", "word")]
            while kind() == ",":
                take(",")
                values.append(take("value", "word"))
            take(")")
            return In(key, tuple(values))
        op = take("op")
        return Compare(key, op, take("value", "word"))

    def expression() -> Node:
        return chain("OR", lambda: chain("AND", factor, And), Or)

    node = expression()
    if kind() != "end":
        raise FilterError(f"unexpected token after the expression: {tokens[at][1]}")
    return node


def keys_of(node: Node) -> set[str]:
    if isinstance(node, Not):
        return keys_of(node.item)
    if isinstance(node, And | Or):
        return set().union(*map(keys_of, node.items))
    return {node.key}

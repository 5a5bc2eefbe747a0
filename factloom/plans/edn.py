"""Reader for the EDN subset that queries, rules and fact blocks are written in."""

from __future__ import annotations

import re
from dataclasses import dataclass


class EdnError(ValueError):
    """Text that is not well-formed."""


@dataclass(frozen=True)
class Keyword:
    name: str  # with the colon

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Symbol:
    name: str

    @property
    def is_var(self) -> bool:
        return self.name.startswith("?")


@dataclass(frozen=True)
class Tagged:
    """``#uuid "…"`` or ``#inst "…"``; counts as its text."""

    tag: str
    value: object


class Vector(list):
    """Square brackets."""


class Form(list):
    """Round brackets."""


_TOKEN = re.compile(
    r"""[\s,]+ | ;[^\n]* | (?P<open>\#\{|[\[({]) | (?P<close>[\])}])
      | (?P<string>"(?:\\.|[^"\\])*") | (?P<tag>\#[A-Za-z][\w./-]*) | (?P<atom>[^\s,\[\](){}";]+)""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}
_CLOSE = {"[": "]", "(": ")", "{": "}", "#{": "}"}


def _atom(text: str) -> object:
    if text in ("true", "false"):
        return text == "true"
    if text == "nil":
        return None
    if text.startswith(":"):
        return Keyword(text)
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", text):
        return float(text)
    return Symbol(text)


def unescape(quoted: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), quoted[1:-1], flags=re.S)


def quote(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'


def read_all(text: str) -> list:
    """Every top-level value of ``text``."""
    stack: list[tuple[str, list, list[str]]] = [("", [], [])]
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise EdnError(f"cannot read at {at}: {text[at : at + 20]!r}")
        at = m.end()
        kind = m.lastgroup
        if kind is None:
            continue
        if kind == "open":
            stack.append((m[kind], [], []))
            continue
        if kind == "tag":
            stack[-1][2].append(m[kind][1:])
            continue
        if kind == "close":
            bracket, items, tags = stack.pop() if len(stack) > 1 else ("", [], [])
            if _CLOSE.get(bracket) != m[kind] or tags:
                raise EdnError(f"unexpected {m[kind]} at {m.start()}")
            if bracket == "{":
                if len(items) % 2:
                    raise EdnError("a map needs pairs")
                value: object = dict(zip(items[::2], items[1::2], strict=True))
            else:
                value = {"[": Vector, "(": Form, "#{": list}[bracket](items)
        else:
            value = unescape(m[kind]) if kind == "string" else _atom(m[kind])
        while stack[-1][2]:
            value = Tagged(stack[-1][2].pop(), value)
        stack[-1][1].append(value)
    if len(stack) > 1 or stack[0][2]:
        raise EdnError("unexpected end")
    return stack[0][1]


def read(text: str) -> object:
    values = read_all(text)
    if len(values) != 1:
        raise EdnError(f"one form expected, {len(values)} found")
    return values[0]

"""Tokens of brace languages, with matched brackets."""

from __future__ import annotations

import re
from dataclasses import dataclass


class SyntaxProblem(ValueError):
    """An unterminated literal or comment, or brackets that don't match."""


@dataclass(frozen=True, slots=True)
class Token:
    kind: str  # name, number, string, sign
    text: str
    start: int
    end: int
    line: int
    broken: bool  # a line feed stands before it


OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class Source:
    """Tokens of one text, and for each bracket the index of its partner. `literals` is a pattern of string literals;
    what starts like one but doesn't match is unterminated."""

    def __init__(self, text: str, literals: str, starts: str, signs: str):
        self.text = text
        pattern = re.compile(
            rf"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>{literals})|(?P<name>[^\W\d][\w$]*|\$[\w$]*)"
            rf"|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<space>\s+)|(?P<sign>{signs}|.)",
            re.S,
        )
        self.tokens: list[Token] = []
        line, broken = 1, True
        for m in pattern.finditer(text):
            kind, body = m.lastgroup, m[0]
            if kind == "sign" and (body in starts or text.startswith("/*", m.start())):
                raise SyntaxProblem("unterminated literal or comment")
            if kind not in ("space", "comment"):
                self.tokens.append(Token(kind, body, m.start(), m.end(), line, broken))
                broken = False
            feeds = body.count("\n")
            line += feeds
            if feeds and kind != "string":
                broken = True
        self.partner: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind != "sign":
                continue
            if t.text in OPEN:
                stack.append(i)
            elif t.text in CLOSE:
                if not stack or OPEN[self.tokens[stack[-1]].text] != t.text:
                    raise SyntaxProblem("brackets don't match")
                self.partner[i] = stack.pop()
                self.partner[self.partner[i]] = i
        if stack:
            raise SyntaxProblem("brackets don't match")

    def at(self, i: int) -> str:
        """The text of token i; empty beyond the ends, and for strings."""
        if 0 <= i < len(self.tokens) and self.tokens[i].kind != "string":
            return self.tokens[i].text
        return ""

    def is_name(self, i: int, keywords: frozenset[str]) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "name" and self.tokens[i].text not in keywords

    def end_line(self, i: int) -> int:
        t = self.tokens[i]
        return t.line + t.text.count("\n")

    def between(self, i: int, j: int) -> str:
        return self.text[self.tokens[i].start : self.tokens[j].end]


@dataclass
class Symbol:
    name: str
    kind: str
    start_line: int
    end_line: int
    source: str


@dataclass
class Call:
    src: str
    target: str
    line: int
    code: str


@dataclass
class Extract:
    package: str
    symbols: list[Symbol]
    calls: list[Call]

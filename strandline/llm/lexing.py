"""Name-literal pairs of source and configuration texts, read in one pass and in time linear in the text.

Quoted strings end at their line; triple quotes, backticks and block comments at their closer, and an opener without one is
an ordinary sign. A single quote after a letter opens nothing. Comments, and strings that span lines or hold an assignment
sign, are read once more on their own, with their own constants. Assignments are `=`, `:`, `:=`, `=>`, `+=` and `?=` after a
name, a quoted name or a subscript, with or without a type; besides, `setName("x")`, `put("name", "x")`, `<name>x</name>`,
and a key or name with the value beside it. A value is literals, side by side or added up, and constants, or a bare word
that holds a digit or is all that follows NAME= on its line. A constant means its last assignment above, else its first
below.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import islice

Span = tuple[int, int]
Pair = tuple[str, list]  # a name; spans of literals and names of constants

#: Distinct literals by which a value is scored, and the longest bare word.
PARTS, LONGEST = 64, 2048

_TOKEN = r"""
      (?P<space>[^\S\n]++|\\\n)
    | (?P<line>\n)
    | (?P<fence>`{3,}+)
    | (?P<block>\"\"\"|\'\'\'|(?<![\w$])`|/\*)
    | (?P<quoted>(?:(?<![\w$])[rRbBuUfF]{1,2}+(?=["']))?(?:DOUBLESINGLE(?!)))
    | (?P<comment>(?<!\S)(?:\#|//|--(?!\S))[^\n]*+)
    | (?P<other>[!=<>]==?|<=|>=|::|&&|->)
    | (?P<assign>\+=|\?=|:=|=>|[=:])
    | (?P<plus>\+|\.\.?(?!\.)|&)
    | (?P<name>[A-Za-z_$][\w$]*+(?:[.\-][A-Za-z_$][\w$]*+)*+)
    | (?P<number>\d[\w.]*+)
    | (?P<sign>\\++(?!\n)|.)
"""
_DOUBLE, _SINGLE = r'(?<!\d)"(?P<double>(?:[^"\\\n]|\\[^\n])*+)"|', r"(?<![\w$])'(?P<single>(?:[^'\\\n]|\\[^\n])*+)'|"
#: By whether a double and a single quote may still open a string on the line.
_LEX = {
    (a, b): re.compile(_TOKEN.replace("DOUBLE", _DOUBLE * a).replace("SINGLE", _SINGLE * b), re.X | re.S)
    for a in (False, True) for b in (False, True)
}
_MARKS = re.compile(r"[#/\-\s]*+")
_BARE = re.compile(r"[^\s\"'`,;{}()\[\]<>]++")
_SPACES = re.compile(r"[ \t]*+")
_LAST = re.compile(r"[ \t\r]*+(?:\n|\#|\Z)")
_ELEMENT = re.compile(r"[^\s<>\"']++(?=</)")
_SETTERS = re.compile(r"(?:.*\.)?(?:set|with|use|put|add)(?=[_A-Z])", re.S)


def _held(before: str, quote: str) -> bool:
    """Whether the sign before a quote keeps it from opening a string."""
    return before.isdigit() if quote == '"' else before.isalnum() or before in ("_", "$")


def lex(text: str, begin: int, end: int) -> tuple[list[tuple], list[Span]]:
    """(kind, word, start, end) of tokens, for strings of what is inside; and the regions to be read on their own."""
    tokens: list[tuple] = []
    inner: list[Span] = []
    never: set[str] = set()  # openers that no closer follows
    dead = {'"': begin, "'": begin}  # up to where a quote opens no string
    at = begin

    def own(a: int, b: int) -> None:
        if text.find("=", a, b) >= 0 or text.find(":", a, b) >= 0:
            inner.append((a, b))

    while at < end:
        m = _LEX[at >= dead['"'], at >= dead["'"]].match(text, at, end)
        kind, stop = m.lastgroup, m.end()
        if kind == "quoted":
            a, b = m.span("double") if text[stop - 1] == '"' else m.span("single")
            tokens.append(("string", None, a, b))
            own(a, b)
        elif kind == "block":
            opener = m[0]
            close = "*/" if opener == "/*" else opener
            found = -1 if opener in never else text.find(close, stop, end)
            if found < 0:
                never.add(opener)
                tokens.append(("sign", opener, at, stop))
            else:
                own(stop, found)
                if opener != "/*":
                    tokens.append(("string", None, stop, found))
                stop = found + len(close)
        elif kind == "comment":
            own(_MARKS.match(text, at, stop).end(), stop)
        elif kind != "space":
            word = m[0]
            tokens.append((kind, word, at, stop))
            if word in dead and at >= dead[word] and not _held(text[at - 1 : at], word):
                line = text.find("\n", at, end)
                dead[word] = line if line >= 0 else end
        at = stop
    return tokens, inner


def _value(tokens: list[tuple], j: int) -> tuple[list, int] | None:
    """What a value that begins at token j is made of, and the token after it."""
    n, items, inside = len(tokens), [], False

    def skip(k: int) -> int:
        while k < n and tokens[k][0] == "line":
            k += 1
        return k

    if j < n and tokens[j][1] == "(":
        inside, j = True, skip(j + 1)
    while j < n:
        kind, word, a, b = tokens[j]
        if kind == "string":
            items.append((a, b))
        elif kind == "name" and not (j + 1 < n and tokens[j + 1][1] in ("(", "[")):
            items.append(word)
        else:
            return None
        j += 1
        k = skip(j) if inside else j
        if k < n and tokens[k][0] == "plus":
            j = skip(k + 1)
        elif kind == "string" and k < n and tokens[k][0] == "string":
            j = k
        else:
            return items, j
    return None


def _typed(tokens: list[tuple], j: int) -> int:
    """The `=` of `name: type = value`, where token j is the colon; else j."""
    for k in range(j + 1, min(j + 9, len(tokens))):
        kind, word, *_ = tokens[k]
        if word == "=":
            return k if k > j + 1 else j
        if not (kind == "name" or kind == "plus" or word in ("[", "]", "<", ">", "|", "?", ",", "*")):
            break
    return j


def pairs(text: str, begin: int, end: int, inner: list[Span] | None = None) -> list[Pair]:
    """The assignments of a region in order. Regions inside it are added to `inner`."""
    tokens, own = lex(text, begin, end)
    if inner is not None:
        inner += own
    n, i, out = len(tokens), 0, []
    loose: dict[int, Span] = {}  # bare words of assignments whose value names no constant
    run_end, label, label_at = -1, "", -9
    waiting: list[str] = []  # a and b in a = b = value

    def word_at(k: int):
        return tokens[k][1] if 0 <= k < n else None

    while i < n:
        kind, name, a, b = tokens[i]
        if kind == "string":
            name = text[a:b]
        elif kind != "name":
            i += 1
            continue
        j = i + 1
        while j < min(n, i + 4) and (tokens[j][1] in ("[", "]") or tokens[j][0] == "number"):
            j += 1
        if j >= n or tokens[j][0] != "assign":
            j = i + 1
            if kind == "name" and word_at(j) == "(" and word_at(j + 2) == ")" and tokens[j + 1][0] == "string" and _SETTERS.match(name):
                out.append((name, [tokens[j + 1][2:]]))
            elif kind == "string" and word_at(i - 1) == "(" and word_at(j) == "," and j + 1 < n and tokens[j + 1][0] == "string":
                out.append((name, [tokens[j + 1][2:]]))
            elif kind == "name" and word_at(i - 1) == "<" and word_at(j) == ">" and (m := _ELEMENT.match(text, tokens[j][3], end)):
                out.append((name, [m.span()]))
            i += 1
            continue
        if tokens[j][1] == ":":
            j = _typed(tokens, j)
        found = _value(tokens, j + 1)
        items, after = found or ([], j + 1)
        if not any(isinstance(x, tuple) for x in items) and kind == "name":
            a = _SPACES.match(text, tokens[j][3], end).end()
            if a >= run_end and (m := _BARE.match(text, a, end)):
                run_end = m.end()
            if a < run_end <= a + LONGEST and text[a] not in "$%":
                b = a + len(text[a:run_end].rstrip(".:"))
                before = i - (word_at(i - 1) in ("export", "set"))
                line = (before <= 0 or tokens[before - 1][0] == "line") and a == tokens[j][3] and tokens[j][1] == "="
                if any(map(str.isdigit, text[a:b])) or line and _LAST.match(text, run_end, end):
                    loose[len(out)] = (a, b)
        if not items and len(out) not in loose:
            i, waiting = j + 1, []
            continue
        if len(items) == 1 and after < n and tokens[after][0] == "assign" and tokens[after - 1][0] == "name":  # a = b = value
            loose.pop(len(out), None)
            waiting.append(name)
            i = after - 1
            continue
        also = [name, *waiting]
        if name in ("key", "name", "Key", "Name", "KEY", "NAME") and len(items) == 1:
            label, label_at = text[slice(*items[0])] if isinstance(items[0], tuple) else items[0], after
        elif name in ("value", "Value", "VALUE") and 0 <= i - label_at <= 3:
            also.append(label)
        word = loose.pop(len(out), None)
        for one in also:
            if word:
                loose[len(out)] = word
            out.append((one, items))
        i, waiting = max(j + 1, after), []
    names = {name for name, _ in out}
    return [(name, [loose[k]] if k in loose and not any(x in names for x in items) else items) for k, (name, items) in enumerate(out)]


def resolve(found: list[Pair]) -> tuple[list[tuple[Span, ...]], list[list[int]]]:
    """For each assignment the first PARTS distinct literals that it holds, and the assignments that its constants mean."""
    where: dict[str, list[int]] = {}
    for k, (name, _) in enumerate(found):
        where.setdefault(name, []).append(k)
    refs: list[list[int]] = []
    for k, (_, items) in enumerate(found):
        own = []
        for x in items:
            if isinstance(x, str) and x in where:
                at = bisect_left(where[x], k)
                other = where[x][at - 1] if at else next((y for y in where[x][:2] if y != k), None)
                if other is not None:
                    own.append(other)
        refs.append(own)
    held: list[tuple[Span, ...] | None] = [None] * len(found)
    for k, (_, items) in enumerate(found):
        if not refs[k]:
            held[k] = tuple(islice(dict.fromkeys(x for x in items if isinstance(x, tuple)), PARTS))
    for k in range(len(found)):
        if held[k] is not None:
            continue
        stack, busy = [k], set()
        while stack:
            x = stack[-1]
            if held[x] is None:
                busy.add(x)
                todo = [r for r in refs[x] if held[r] is None and r not in busy]
                if todo:
                    stack += todo
                    continue
                parts: dict[Span, None] = {}
                rest = iter(refs[x])
                for item in found[x][1]:
                    if isinstance(item, tuple):
                        parts[item] = None
                    elif item in where and len(parts) < PARTS and (r := next(rest, None)) is not None:
                        parts.update(dict.fromkeys(held[r] or ()))
                held[x] = tuple(islice(parts, PARTS))
            stack.pop()
    return held, refs


def reached(found: list[Pair], refs: list[list[int]], marked: list[int]) -> set[Span]:
    """All literals of these assignments and of the constants that they are made of."""
    seen, stack, out = set(marked), list(marked), set()
    while stack:
        k = stack.pop()
        out.update(x for x in found[k][1] if isinstance(x, tuple))
        for r in refs[k]:
            if r not in seen:
                seen.add(r)
                stack.append(r)
    return out

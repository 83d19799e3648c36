"""Go: top-level functions and methods with a body, and the calls inside of them.

A callee that is a name counts as it is; a method of a composite literal counts as Type.Method; a selector on an imported
package is left out; any other selector counts by its bare name; other callees are left out.
"""

from __future__ import annotations

from strandline.sources.syntax.lexer import Call, Extract, Source, Symbol, SyntaxProblem

KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package "
    "range return select struct switch type var".split()
)
LITERALS = r'"(?:\\.|[^"\\\n])*"|`[^`]*`|' + r"'(?:\\.[^']*|[^'\\\n])'"
TYPE_WORDS = frozenset(["map", "func", "chan", "interface", "struct"])


def extract(text: str) -> Extract:
    source = Source(text, LITERALS, "\"`'", r":=|<-|\.\.\.")
    return _File(source).extract()


class _File:
    def __init__(self, source: Source):
        self.s, self.tokens = source, source.tokens
        self.lines = source.text.split("\n")

    def extract(self) -> Extract:
        s = self.s
        package, imports, i = "unknown", set(), 0
        found: list[tuple[Symbol, int, int]] = []
        while i < len(self.tokens):
            word = s.at(i)
            if word == "package" and s.is_name(i + 1, KEYWORDS) and package == "unknown":
                package = s.at(i + 1)
                i += 2
            elif word == "import":
                i = self.imports(i + 1, imports)
            elif word == "func":
                i, made = self.function(i, package)
                found += made
            elif i in s.partner and s.partner[i] > i:
                i = s.partner[i] + 1
            else:
                i += 1
        calls = [c for symbol, a, b in found for c in self.calls(symbol.name, a, b, imports)]
        return Extract(package, [symbol for symbol, _, _ in found], calls)

    def imports(self, i: int, out: set[str]) -> int:
        """Names that import specs bring in: the alias, or the last part of the path."""
        if self.s.at(i) == "(":
            i, end = i + 1, self.s.partner[i]
        else:
            end = min(i + 2, len(self.tokens))
        alias = ""
        while i < end:
            t = self.tokens[i]
            if t.kind == "string":
                last = t.text.strip('"`').rpartition("/")[2]
                if alias and alias != "_" or last:
                    out.add(alias if alias and alias != "_" else last)
                alias = ""
                if self.s.at(end) != ")":
                    return i + 1
            elif t.kind == "name":
                alias = t.text
            i += 1
        return end + (self.s.at(end) == ")")

    def function(self, i: int, package: str):
        """The declaration at `func`: (next token, [] or [(symbol, first and last token of the body)])."""
        s, first, receiver = self.s, i, None
        i += 1
        if s.at(i) == "(":
            receiver = self.receiver(i + 1, s.partner[i])
            i = s.partner[i] + 1
        elif not s.is_name(i, KEYWORDS):
            raise SyntaxProblem("func without a name or parameters")
        if not s.is_name(i, KEYWORDS):  # a function type or literal
            return i, []
        name = s.at(i)
        i += 1
        if s.at(i) == "[":
            i = s.partner[i] + 1
        if s.at(i) != "(":
            if receiver is None:
                raise SyntaxProblem("a function without parameters")
            return i, []
        i = s.partner[i] + 1
        while i < len(self.tokens) and not self.tokens[i].broken:  # the result, then the body
            if s.at(i) == "{" and s.at(i - 1) not in ("struct", "interface"):
                end = s.partner[i]
                owner = f"{receiver}." if receiver is not None else ""
                kind = "function_declaration" if receiver is None else "method_declaration"
                symbol = Symbol(f"{package}.{owner}{name}", kind, self.tokens[first].line, self.tokens[end].line, s.between(first, end))
                return end + 1, [(symbol, i, end)]
            i = s.partner[i] + 1 if i in s.partner and s.partner[i] > i else i + 1
        return i, []

    def receiver(self, i: int, end: int) -> str:
        """The receiver's type without pointer and type parameters."""
        s = self.s
        if s.is_name(i, KEYWORDS) and s.at(i + 1) not in (".", "[", ")", ","):
            i += 1
        while i < end and not s.is_name(i, KEYWORDS):
            i += 1
        if i >= end:
            return "unknown"
        while s.at(i + 1) == "." and i + 2 < end:
            i += 2
        return s.at(i)

    def start_of(self, i: int) -> int:
        """The first token of the operand that ends with token i."""
        s = self.s
        while True:
            if i in s.partner and s.partner[i] < i:
                i = s.partner[i]
                before = s.at(i - 1)
                if before == "." and s.at(i) == "(":
                    i -= 2  # a type assertion
                elif s.is_name(i - 1, KEYWORDS) or before in (")", "]") or before == "}" and s.at(i) == "(":
                    i -= 1
                else:
                    return i
            elif s.at(i - 1) == ".":
                i -= 2
            else:
                return i

    def literal_type(self, i: int) -> str:
        """The type of the composite literal that ends with token i, alone, after & or in parentheses; empty if none."""
        s = self.s
        if s.at(i) == "}":
            k = s.partner[i] - 1
            if s.is_name(k, KEYWORDS) and s.at(k - 1) != "]":
                return s.at(k)
        elif s.at(i) == ")" and self.is_group(s.partner[i]):
            return self.literal_type(i - 1) if self.whole(s.partner[i] + 1, i - 1) else ""
        return ""

    def is_group(self, i: int) -> bool:
        before = self.s.at(i - 1)
        return not (self.s.is_name(i - 1, KEYWORDS) or before in (")", "]", "}", ".") or self.s.tokens[i - 1].kind == "string")

    def whole(self, a: int, b: int) -> bool:
        """Whether tokens a to b are one operand with prefix signs at most."""
        while self.s.at(a) in ("&", "*", "!", "-", "+", "^"):
            a += 1
        return a <= b and self.start_of(b) == a

    def callee(self, i: int, imports: set[str]) -> str:
        """The name that a call with its opening parenthesis after token i goes to; empty if it is left out."""
        s = self.s
        if s.at(i) == "]":  # explicit type arguments
            k = s.partner[i]
            if not (s.is_name(k - 1, KEYWORDS) and (s.is_name(k + 1, KEYWORDS) or s.at(k + 1) in TYPE_WORDS | {"*", "["})):
                return ""
            i = k - 1
        if not s.is_name(i, KEYWORDS) or s.at(i - 1) == "]":
            return ""
        name = s.at(i)
        if s.at(i - 1) != ".":
            return name
        operand = i - 2
        made = self.literal_type(operand)
        if made:
            return f"{made}.{name}"
        if s.is_name(operand, KEYWORDS) and s.at(operand - 1) != "." and s.at(operand) in imports:
            return ""
        return name

    def calls(self, src: str, a: int, b: int, imports: set[str]) -> list[Call]:
        s, out = self.s, []
        i = a + 1
        while i < b:
            if s.at(i) == "{" and s.at(i - 1) == "interface":
                i = s.partner[i]
            elif s.at(i) == "(" and not self.tokens[i].broken:
                target = self.callee(i - 1, imports)
                if target:
                    first = self.start_of(i - 1)
                    line = self.tokens[first].line
                    out.append((first, -s.partner[i], Call(src, target, line, self.lines[line - 1].strip())))
            i += 1
        return [c for *_, c in sorted(out, key=lambda x: x[:2])]

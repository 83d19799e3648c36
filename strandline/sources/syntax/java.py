"""Java: types, methods, constructors, lambdas and anonymous classes, and method invocations inside of them.

Members of an anonymous class are named below it, but call as members of the class around it. A lambda calls in its own
name. Receivers that are fields or in lower case are left out; receivers of other kinds (calls, literals, super) leave
the bare method, which counts for the innermost class.
"""

from __future__ import annotations

from strandline.sources.syntax.lexer import Call, Extract, Source, Symbol

MODIFIERS = frozenset(
    "public private protected static final abstract native synchronized transient volatile strictfp default sealed".split()
)
KEYWORDS = MODIFIERS | frozenset(
    "assert boolean break byte case catch char class const continue do double else enum extends finally float for goto if "
    "implements import instanceof int interface long new package return short super switch this throw throws try void "
    "while".split()
)
PRIMITIVES = frozenset("boolean byte char double float int long short void".split())
TYPES = {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "record": "record_declaration"}
LITERALS = r'"""(?:\\.|(?!""").)*"""|"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.[^'\n]*|[^'\\\n])'"


def extract(text: str) -> Extract:
    return _File(Source(text, LITERALS, "\"'", r"->|::")).extract()


class _File:
    def __init__(self, source: Source):
        self.s, self.tokens = source, source.tokens
        self.package = "default"
        self.symbols: list[tuple[int, Symbol]] = []
        self.calls: list[tuple[int, int, Call]] = []
        self.rules = self.rule_arrows()

    def extract(self) -> Extract:
        for i in range(len(self.tokens)):
            if self.s.at(i) == "package":
                k = i + 1
                while k < len(self.tokens) and self.s.at(k) != ";":
                    k += 1
                self.package = "".join(self.s.at(j) for j in range(i + 1, k)) or "default"
                break
        self.members(0, len(self.tokens), [], [], "")
        symbols = [x for _, x in sorted(self.symbols, key=lambda x: x[0])]
        return Extract(self.package, symbols, [c for *_, c in sorted(self.calls, key=lambda x: x[:2])])

    def rule_arrows(self) -> set[int]:
        """Arrows of switch rules, which are no lambdas."""
        out = set()
        for i in range(len(self.tokens)):
            if self.s.at(i) in ("case", "default"):
                k = i + 1
                while k < len(self.tokens) and self.s.at(k) not in ("->", ":", ";", "{", "}"):
                    k = self.skip(k)
                if self.s.at(k) == "->":
                    out.add(k)
        return out

    def skip(self, i: int) -> int:
        return self.s.partner[i] + 1 if self.s.partner.get(i, -1) > i else i + 1

    def angle(self, i: int) -> int:
        """The token after a pair of angle brackets that opens at i."""
        depth = 0
        while i < len(self.tokens):
            depth += (self.s.at(i) == "<") - (self.s.at(i) == ">")
            i = self.skip(i)
            if depth == 0:
                return i
        return i

    def named(self, parts: list[str]) -> str:
        return ".".join([self.package, *parts])

    def add(self, first: int, last: int, kind: str, parts: list[str]) -> None:
        t = self.tokens
        self.symbols.append((first, Symbol(self.named(parts), kind, t[first].line, self.s.end_line(last), self.s.between(first, last))))

    def modifiers(self, i: int, end: int) -> int:
        s = self.s
        while i < end:
            if s.at(i) == "@" and s.at(i + 1) != "interface":
                i += 2
                while s.at(i) == ".":
                    i += 2
                if s.at(i) == "(":
                    i = self.skip(i)
            elif s.at(i) in MODIFIERS and not (s.at(i) == "default" and s.at(i + 1) in (":", "->")):
                i += 1
            elif s.at(i) == "non" and s.at(i + 1) == "-" and s.at(i + 2) == "sealed":
                i += 3
            else:
                break
        return i

    def is_type(self, i: int) -> bool:
        word = self.s.at(i)
        if word == "record":
            return self.s.is_name(i + 1, KEYWORDS) and self.s.at(i + 2) in ("(", "<")
        return word in TYPES and self.s.is_name(i + 1, KEYWORDS) and self.s.at(i - 1) != "."

    def type_declaration(self, first: int, i: int, owners: list[str], shown: list[str], src: str) -> int:
        """The declaration whose keyword is token i and whose modifiers begin at `first`."""
        s = self.s
        word, name = s.at(i), s.at(i + 1)
        k = i + 2
        while k < len(self.tokens) and s.at(k) not in ("{", ";"):
            k = self.angle(k) if s.at(k) == "<" else self.skip(k)
        if s.at(k) != "{":
            return k + 1
        end = s.partner[k]
        self.add(first, end, TYPES[word], [*shown, name])
        body = k + 1
        if word == "enum":
            body = self.constants(body, end, [*owners, name], [*shown, name], src)
        self.members(body, end, [*owners, name], [*shown, name], src)
        return end + 1

    def constants(self, i: int, end: int, owners: list[str], shown: list[str], src: str) -> int:
        s = self.s
        while i < end:
            i = self.modifiers(i, end)
            if s.at(i) == ";":
                return i + 1
            if s.at(i) == "(":
                self.code(i + 1, s.partner[i], owners, shown, src)
                i = self.skip(i)
            elif s.at(i) == "{":
                self.members(i + 1, s.partner[i], owners, shown, src)
                i = self.skip(i)
            else:
                i += 1
        return end

    def members(self, i: int, end: int, owners: list[str], shown: list[str], src: str) -> None:
        s = self.s
        while i < end:
            first = i
            i = self.modifiers(i, end)
            if i >= end:
                return
            if s.at(i) in (";", "}"):
                i += 1
            elif s.at(i) in ("package", "import") and not owners:
                while i < end and s.at(i) != ";":
                    i += 1
            elif s.at(i) == "{":
                self.code(i + 1, s.partner[i], owners, shown, src)
                i = self.skip(i)
            elif s.at(i) == "@" and s.at(i + 1) == "interface":
                while i < end and s.at(i) != "{":
                    i = self.skip(i)
                if i < end:
                    self.members(i + 1, s.partner[i], owners, shown, src)
                    i = self.skip(i)
            elif self.is_type(i):
                i = self.type_declaration(first, i, owners, shown, src)
            else:
                i = self.member(first, i, end, owners, shown, src)

    def member(self, first: int, i: int, end: int, owners: list[str], shown: list[str], src: str) -> int:
        """A method, a constructor or fields."""
        s = self.s
        if s.at(i) == "<":
            i = self.angle(i)
        k, words = i, 0
        while k < end and s.at(k) not in ("(", "=", ";", "{"):
            if s.at(k) == "<":
                k = self.angle(k)
                continue
            words += self.tokens[k].kind == "name" and s.at(k - 1) != "." and s.at(k - 1) != "@"
            k = self.skip(k)
        if k >= end:
            return end
        if s.at(k) not in ("(", "{"):  # fields: what initialises them may hold lambdas and anonymous classes
            last = k
            while last < end and s.at(last) != ";":
                last = self.skip(last)
            self.code(k, last, owners, shown, src)
            return last + 1
        name = s.at(k - 1)
        if s.at(k) == "{":
            kind, body = "compact_constructor_declaration", k
        else:
            kind = "method_declaration" if words > 1 else "constructor_declaration"
            body = self.skip(k)
            while body < end and s.at(body) not in ("{", ";"):
                body = self.skip(body)
        last = s.partner[body] if s.at(body) == "{" else min(body, end - 1)
        called = name if kind == "method_declaration" else "<init>"
        if owners:
            self.add(first, last, kind, [*shown, called])
            src = self.named([*owners, called])
        if s.at(body) == "{":
            self.code(body + 1, last, owners, shown, src)
        return last + 1

    def code(self, i: int, end: int, owners: list[str], shown: list[str], src: str) -> None:
        """Statements and expressions between tokens i and `end`."""
        s = self.s
        while i < end:
            word = s.at(i)
            if self.is_type(i) and word != "record" or word == "record" and self.is_type(i) and s.at(i - 1) in ("{", "}", ";", "", "final", "static"):
                first = i
                while s.at(first - 1) in MODIFIERS:
                    first -= 1
                i = self.type_declaration(first, i, owners, shown, src)
            elif self.is_lambda(i):
                i = self.lambda_expression(i, end, owners, shown, src)
            elif word == "new":
                i = self.creation(i, owners, shown, src)
            else:
                if s.is_name(i, KEYWORDS) and s.at(i + 1) == "(" and s.at(i - 1) not in ("new", "@", "instanceof", "case") and src:
                    self.invocation(i, owners, src)
                i += 1

    def is_lambda(self, i: int) -> bool:
        s = self.s
        if s.at(i) == "(":
            after = s.partner[i] + 1
            return s.at(after) == "->" and after not in self.rules and not s.is_name(i - 1, KEYWORDS)
        return s.is_name(i, KEYWORDS) and s.at(i + 1) == "->" and i + 1 not in self.rules

    def lambda_expression(self, i: int, end: int, owners: list[str], shown: list[str], src: str) -> int:
        s, first = self.s, i
        i = self.skip(i) + 1  # beyond the arrow
        if s.at(i) == "{":
            last = s.partner[i]
            body, stop = i + 1, last
        else:
            last = i
            while last < end and s.at(last) not in (",", ";", ")", "]", "}"):
                last = self.skip(last)
            body, stop, last = i, last, last - 1
        if owners:
            own = f"lambda@{self.tokens[first].line}"
            self.add(first, last, "lambda_expression", [*shown, own])
            src = self.named([*owners, own])
        self.code(body, stop, owners, shown, src)
        return last + 1

    def creation(self, i: int, owners: list[str], shown: list[str], src: str) -> int:
        s, first = self.s, i
        i += 1
        while s.at(i) == "@" or s.is_name(i, frozenset()) or s.at(i) in (".", "<"):
            i = self.angle(i) if s.at(i) == "<" else i + 1
        if s.at(i) != "(":
            return i
        close = s.partner[i]
        if s.at(close + 1) != "{":
            return i  # the arguments are read on
        end = s.partner[close + 1]
        inner = shown
        if owners:
            inner = [*shown, f"anonymous@{self.tokens[first].line}"]
            self.add(first, end, "object_creation_expression", inner)
        self.code(i + 1, close, owners, inner, src)
        self.members(close + 2, end, owners, inner, src)
        return end + 1

    def receiver(self, dot: int) -> tuple[str | None, int]:
        """(receiver or None for no plain one, first token) of the expression before a dot. A field access is 'field'."""
        s, i = self.s, dot - 1
        if s.at(i) in (")", "}", "]") or s.tokens[i].kind == "string":
            first = self.start_of(i)
            if s.at(first) == "new" and s.at(i) != "]" and s.at(first - 1) != ".":
                return s.between(first, i), first
            return None, first
        if s.at(i - 1) == "." or s.at(i - 1) == "::":
            first = self.start_of(i)
            if s.at(i) == "super":
                return (s.at(i - 2) if first == i - 2 else None), first
            return "field", first
        return (None if s.at(i) == "super" else s.at(i)), i

    def start_of(self, i: int) -> int:
        """The first token of the expression that ends with token i."""
        s = self.s
        while True:
            if s.partner.get(i, i) < i:
                i = s.partner[i]
                if s.at(i) == "{":
                    i = s.partner[i - 1] if s.at(i - 1) == ")" else i
                if s.at(i - 1) == ">":  # type arguments of a creation
                    k, depth = i - 1, 0
                    while k > 0:
                        depth += (s.at(k) == ">") - (s.at(k) == "<")
                        if depth == 0:
                            break
                        k -= 1
                    i = k
                if s.at(i - 1) in (")", "]"):
                    i -= 1
                    continue
                if not (self.tokens[i - 1].kind == "name" and (s.is_name(i - 1, KEYWORDS) or s.at(i - 1) in PRIMITIVES | {"this", "super"})):
                    return i
                i -= 1
            k = i
            while s.at(k - 1) == "." and self.tokens[k - 2].kind == "name":
                k -= 2
            if s.at(k - 1) == "new":
                return k - 1
            i = k
            if s.at(i - 1) != ".":
                return i
            i -= 2

    def invocation(self, i: int, owners: list[str], src: str) -> None:
        s = self.s
        method, dot, first = s.at(i), None, i
        if s.at(i - 1) == ".":
            dot = i - 1
        elif s.at(i - 1) == ">":  # explicit type arguments
            k, depth = i - 1, 0
            while k > 0:
                depth += (s.at(k) == ">") - (s.at(k) == "<")
                if depth == 0:
                    break
                k -= 1
            dot = k - 1 if s.at(k - 1) == "." else None
        own = f"{owners[-1]}.{method}" if owners else method
        target = own
        if dot is not None:
            receiver, first = self.receiver(dot)
            if receiver == "field":
                return
            if receiver == "this":
                target = own if owners else ""
            elif receiver is not None and receiver.startswith("new "):
                target = f"{receiver.split()[1].removesuffix('()')}.{method}"
            elif receiver is not None:
                target = f"{receiver}.{method}" if receiver[:1].upper() == receiver[:1] else ""
        if target:
            end = s.partner[i + 1]
            self.calls.append((first, -end, Call(src, target, self.tokens[first].line, s.between(first, end).strip())))

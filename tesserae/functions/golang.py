"""Go source text to symbols, calls and identifiers: a lexer and a declaration scanner.

Pure Python without Spark, so that a worker reads each file once.  The scanner works on tokens
and never fails: brackets that do not close end with the file, and what is not a declaration is
passed over.

What is found:

* functions and methods at file level, with signature and, where a body stands, its extent;
* type, const and var declarations at any depth; of ``a, b = 1, 2`` the first name; aliases
  (``type A = B``) are left out; grouped declarations give one symbol per entry;
* inside bodies, calls by the last name of ``name(...)`` and ``x.name(...)``, with closures
  belonging to the function around them;
* inside bodies, all identifiers that are not field names, type names, package qualifiers of
  types or labels.

Offsets are code points from the start of the file; they identify a place, nothing else.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

NAME, WORD, LITERAL, OP, END = "name", "word", "literal", "op", "end"

#: The keywords of the language, and those a line may end with.
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
ENDING = frozenset("break continue fallthrough return".split())

#: What is most frequent comes first; no two of these start alike but for the operators.
_LEX = re.compile(
    r"""
    (?P<name>[^\W\d]\w*) | (?P<bracket>[(){}\[\],;]) | (?P<line>\n) | (?P<space>[ \t\r\f\v﻿]+)
  | (?P<comment>//[^\n]*) | (?P<block>/\*.*?(?:\*/|\Z))
  | (?P<raw>`[^`]*(?:`|\Z)) | (?P<text>"(?:[^"\\\n]|\\.)*(?:"|$|\Z)) | (?P<rune>'(?:[^'\\\n]|\\.)*(?:'|$|\Z))
  | (?P<number>(?:0[xXbBoO])?[0-9][0-9a-fA-F_.xXpP]*(?:(?<=[eEpP])[+-][0-9_]+)?i?|\.[0-9][0-9_]*(?:[eE][+-]?[0-9]+)?i?)
  | (?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|.)
    """,
    re.X | re.S | re.M,
)


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    line: int
    end: int
    end_line: int


def lex(source: str) -> list[Token]:
    """Tokens, with a ``;`` of kind END wherever the language puts one at the end of a line."""
    out: list[Token] = []
    line = 1

    def close() -> None:
        if out:
            t = out[-1]
            if t.kind in (NAME, LITERAL) or (t.kind == WORD and t.text in ENDING) or (t.kind == OP and t.text in (")", "]", "}", "++", "--")):
                out.append(Token(END, ";", t.end, t.end_line, t.end, t.end_line))

    add = out.append
    for m in _LEX.finditer(source):
        kind = m.lastgroup
        if kind == "name":
            text = m[0]
            start, end = m.span()
            add(Token(WORD if text in KEYWORDS else NAME, text, start, line, end, line))
        elif kind == "bracket" or kind == "op":
            text = m[0]
            start, end = m.span()
            add(Token(END if text == ";" else OP, text, start, line, end, line))
        elif kind == "line":
            close()
            line += 1
        elif kind == "number":
            out.append(Token(LITERAL, m.group(), m.start(), line, m.end(), line))
        elif kind in ("raw", "text", "rune", "block"):
            text = m.group()
            lines = text.count("\n")
            if kind != "block":
                out.append(Token(LITERAL, text, m.start(), line, m.end(), line + lines))
            elif lines:
                close()
            line += lines
    close()
    return out


@dataclass(slots=True)
class Symbol:
    name: str
    kind: str
    recv: str
    line: int
    end_line: int
    sig: str
    offset: int


@dataclass(slots=True)
class Use:
    """A call or an identifier inside a body."""

    name: str
    line: int
    offset: int
    in_symbol: str
    call: bool


@dataclass(slots=True)
class File:
    package: str
    symbols: list[Symbol]
    uses: list[Use]


_OPEN = {"(": ")", "[": "]", "{": "}"}
_CLOSE = frozenset(_OPEN.values())


class Scanner:
    def __init__(self, source: str) -> None:
        self.source = source
        self.tokens = lex(source)
        self.n = len(self.tokens)
        # Texts and kinds by place, empty behind the end and (at -1) before the start.
        self.texts = [*[t.text for t in self.tokens], "", "", "", "", ""]
        self.kinds = [*[t.kind for t in self.tokens], "", "", "", "", ""]
        self.mate = self._mates()
        self.symbols: list[Symbol] = []
        self.bodies: list[tuple[int, int, str]] = []

    def _mates(self) -> list[int]:
        """For each opening bracket, the place of its closing one (the end where none is)."""
        mate = [self.n] * self.n
        stack: list[int] = []
        texts = self.texts
        for i, kind in enumerate(self.kinds):
            if kind != OP:
                continue
            text = texts[i]
            if text in _OPEN:
                stack.append(i)
            elif text in _CLOSE:
                for k in range(len(stack) - 1, -1, -1):  # brackets left open inside end here too
                    if _OPEN[texts[stack[k]]] == text:
                        for j in stack[k:]:
                            mate[j] = i
                        del stack[k:]
                        break
        return mate

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < self.n else ""

    def kind(self, i: int) -> str:
        return self.tokens[i].kind if 0 <= i < self.n else ""

    def between(self, a: int, b: int) -> str:
        """The source from token a up to (without) token b."""
        return self.source[self.tokens[a].start : self.tokens[min(b, self.n) - 1].end] if a < min(b, self.n) else ""

    def after(self, i: int) -> int:
        """The place behind the bracket that opens at i."""
        return min(self.mate[i] + 1, self.n)

    # -- types ---------------------------------------------------------------------------

    def type_end(self, i: int) -> int:
        """The place behind the type that starts at i (i itself where none does)."""
        while i < self.n:
            t = self.tokens[i]
            if t.text in ("*", "<-", "chan", "..."):
                i += 1
            elif t.text == "[" and t.kind == OP:
                i = self.after(i)
            elif t.text == "map" and t.kind == WORD:
                i = self.after(i + 1) if self.text(i + 1) == "[" else i + 1
            elif t.text == "(" and t.kind == OP:
                return self.after(i)
            elif t.text == "func" and t.kind == WORD:
                return self.signature_end(i + 1)
            elif t.text in ("struct", "interface") and t.kind == WORD:
                return self.after(i + 1) if self.text(i + 1) == "{" else i + 1
            elif t.kind == NAME:
                i += 1
                if self.text(i) == "." and self.kind(i + 1) == NAME:
                    i += 2
                return self.after(i) if self.text(i) == "[" and self.kind(i) == OP else i
            else:
                return i
        return i

    def signature_end(self, i: int) -> int:
        """The place behind parameters and result that start at i."""
        if self.text(i) != "(":
            return i
        i = self.after(i)
        if self.text(i) == "(":
            return self.after(i)
        return self.type_end(i)

    # -- declarations --------------------------------------------------------------------

    def entry_end(self, i: int, stop: int) -> int:
        """The place of the ``;`` (or stop) that ends a declaration's entry."""
        while i < stop:
            t = self.tokens[i]
            if t.kind == END:
                return i
            i = self.after(i) if t.kind == OP and t.text in _OPEN else i + 1
        return min(i, stop)

    def entries(self, i: int) -> list[tuple[int, int]]:
        """(start, end) of the entries of the declaration whose keyword stands at i."""
        if self.text(i + 1) == "(" and self.kind(i + 1) == OP:
            out, at, stop = [], i + 2, self.mate[i + 1]
            while at < stop:
                end = self.entry_end(at, stop)
                if end > at:
                    out.append((at, end))
                at = end + 1
            return out
        return [(i + 1, self.entry_end(i + 1, self.n))]

    def value_entry(self, a: int, b: int) -> tuple[int, int, int] | None:
        """(end of names, end of type, start of values or b) of a const or var entry."""
        if self.kind(a) != NAME:
            return None
        i = a + 1
        while self.text(i) == "," and i < b:
            i += 2
        names = i
        end = min(self.type_end(i), b) if i < b and self.text(i) != "=" else i
        return names, end, (end + 1 if self.text(end) == "=" and end < b else b)

    def values(self, i: int) -> None:
        word = self.text(i)
        for a, b in self.entries(i):
            found = self.value_entry(a, b)
            if found is None:
                continue
            names, end, value = found
            t = self.tokens[a]
            sig = f"{word} {t.text}"
            if end > names:
                sig += f" {self.between(names, end)}"
            if value < b:
                sig += f" = {self.between(value, b)}"
            self.symbols.append(Symbol(t.text, word, "", t.line, t.line, sig, t.start))

    def type_params_end(self, i: int) -> int:
        """Behind ``[T any]`` at i; i itself where ``[`` opens an array or slice."""
        if self.text(i) != "[" or self.kind(i + 1) != NAME:
            return i
        t, k = self.text(i + 2), self.kind(i + 2)
        params = k == NAME or t in (",", "~", "interface", "func", "map", "chan", "[") or (t == "*" and self.kind(i + 3) == NAME and self.text(i + 4) in (",", "|"))
        return self.after(i) if params else i

    def types(self, i: int) -> None:
        for a, b in self.entries(i):
            if self.kind(a) != NAME:
                continue
            at = self.type_params_end(a + 1)
            if self.text(at) == "=":
                continue
            first, last = self.tokens[a], self.tokens[min(b, self.n) - 1]
            word = self.text(at) if self.kind(at) == WORD else ""
            self.symbols.append(Symbol(first.text, word if word in ("struct", "interface") else "type", "", first.line, last.end_line, "", first.start))

    def receiver(self, i: int) -> str:
        """The receiver's base type: ``T`` and ``*T`` give T, ``*T[K]`` gives ``T[K]``, others nothing."""
        a, b = i + 1, self.mate[i]
        if self.kind(a) == NAME and self.text(a + 1) not in (".", "[", ")", ","):
            a += 1
        stop = a
        while stop < b and self.text(stop) != ",":
            stop = self.after(stop) if self.text(stop) in _OPEN else stop + 1
        if self.text(a) == "*":
            return self.between(a + 1, stop)
        return self.text(a) if stop == a + 1 and self.kind(a) == NAME else ""

    def function(self, i: int) -> int:
        """Read the function or method whose keyword stands at i; the place to go on from."""
        at, recv, method = i + 1, "", False
        if self.text(at) == "(":
            method = True
            recv = self.receiver(at)
            at = self.after(at)
        if self.kind(at) != NAME:
            return i + 1
        name = self.text(at)
        params = self.type_params_end(at + 1)
        if self.text(params) != "(":
            return at + 1
        behind = self.after(params)
        end = self.signature_end(params)
        sig = f"func {f'({recv}) ' if recv else ''}{name}{self.between(params, behind)}"
        if end > behind:
            sig += f" {self.between(behind, end)}"
        last = end - 1
        if self.text(end) == "{" and self.kind(end) == OP:
            last = min(self.mate[end], self.n - 1)
            self.bodies.append((end + 1, self.mate[end], f"{recv}.{name}" if recv else name))
        self.symbols.append(Symbol(name, "method" if method else "func", recv, self.tokens[i].line, self.tokens[last].end_line, sig, self.tokens[i].start))
        return end

    def declarations(self) -> None:
        depth = 0
        i = 0
        texts, kinds = self.texts, self.kinds
        while i < self.n:
            kind, text = kinds[i], texts[i]
            if kind == OP:
                if text in _OPEN:
                    depth += 1
                elif text in _CLOSE:
                    depth = max(0, depth - 1)
            elif kind == WORD:
                if text == "func" and depth == 0 and (i == 0 or kinds[i - 1] == END):
                    i = self.function(i)
                    continue
                if text in ("const", "var"):
                    self.values(i)
                elif text == "type" and not (self.text(i - 1) == "(" and self.text(i - 2) == "."):
                    self.types(i)
            i += 1
        self.symbols.sort(key=lambda s: s.offset)

    # -- bodies --------------------------------------------------------------------------

    def names_in_type(self, a: int, b: int, skip: set[int]) -> None:
        """Mark the names of a type; array lengths are expressions and stay."""
        i = a
        while i < min(b, self.n):
            t = self.tokens[i]
            if t.text == "[" and t.kind == OP and self.text(i - 1) != "map" and not (i and self.kind(i - 1) == NAME):
                i = self.after(i)
                continue
            if t.kind == NAME:
                skip.add(i)
            i += 1

    def parameters(self, a: int, b: int, skip: set[int]) -> None:
        """Mark the types of a parameter list between a and b."""
        groups, at = [], a
        while at < b:
            end = at
            while end < b and self.text(end) != ",":
                end = self.after(end) if self.text(end) in _OPEN else end + 1
            groups.append((at, end))
            at = end + 1
        named = any(self.kind(x) == NAME and y > x + 1 and self.text(x + 1) not in (".", "[") or (self.kind(x) == NAME and self.text(x + 1) == "[" and self.after(x + 1) < y) for x, y in groups)
        for x, y in groups:
            self.names_in_type(x + 1 if named and self.kind(x) == NAME else x, y, skip)

    def not_identifiers(self, a: int, b: int) -> set[int]:
        """Places of names in a body that are fields, types, type qualifiers or labels."""
        skip: set[int] = set()
        blocks: set[int] = set()
        texts, kinds = self.texts, self.kinds
        for i in range(a, min(b, self.n)):
            if kinds[i] == END:
                continue
            t, before, behind_it = self.tokens[i], texts[i - 1], texts[i + 1]
            if t.kind == WORD:
                if t.text in ("if", "for", "switch", "select"):
                    j = i + 1
                    while j < b and not (self.text(j) == "{" and self.kind(j) == OP):
                        j = self.after(j) if self.text(j) in ("(", "[") else j + 1
                    blocks.add(j)
                elif t.text in ("const", "var"):
                    for x, y in self.entries(i):
                        found = self.value_entry(x, y)
                        if found:
                            self.names_in_type(found[0], found[1], skip)
                elif t.text == "type" and before != "(":
                    for x, y in self.entries(i):
                        self.names_in_type(x, y, skip)
                elif t.text == "func" and self.text(i + 1) == "(":
                    self.parameters(i + 2, self.mate[i + 1], skip)
                    behind, end = self.after(i + 1), self.signature_end(i + 1)
                    if self.text(behind) == "(":
                        self.parameters(behind + 1, self.mate[behind], skip)
                    else:
                        self.names_in_type(behind, end, skip)
                elif t.text in ("map", "chan", "struct", "interface"):
                    self.names_in_type(i, self.type_end(i), skip)
                elif t.text in ("goto", "break", "continue") and self.kind(i + 1) == NAME:
                    skip.add(i + 1)
            elif t.kind == NAME:
                if before == ".":
                    skip.add(i)
                elif behind_it == "{" and i + 1 not in blocks and before != ".":
                    skip.add(i)
                elif behind_it == "." and self.kind(i + 2) == NAME and self.text(i + 3) == "{" and i + 3 not in blocks:
                    skip.add(i)
                elif behind_it == ":" and self.kind(i + 1) == OP and self.kind(i - 1) == END and self.text(i + 2) != "=":
                    skip.add(i)
                elif behind_it == "(" and t.text in ("make", "new"):
                    self.names_in_type(i + 2, min(self.type_end(i + 2), self.mate[i + 1]), skip)
            elif t.text == "[" and t.kind == OP and not (self.kind(i - 1) in (NAME, LITERAL) or before in (")", "]", "}")):
                end = self.type_end(i)
                if self.text(end) in ("{", "(", ")", ",") and end > self.after(i):
                    self.names_in_type(self.after(i), end, skip)
            elif t.text == "(" and before == "." and t.kind == OP:
                self.names_in_type(i + 1, self.mate[i], skip)
        return skip

    def uses(self) -> list[Use]:
        out: list[Use] = []
        tokens, texts, kinds = self.tokens, self.texts, self.kinds
        for a, b, symbol in self.bodies:
            skip = self.not_identifiers(a, b)
            calls: list[Use] = []
            names: list[Use] = []
            inside = 0  # behind the interface type being passed over: its methods are no calls
            for i in range(a, min(b, self.n)):
                kind = kinds[i]
                if kind == WORD and texts[i] == "interface" and texts[i + 1] == "{":
                    inside = max(inside, self.after(i + 1))
                if kind != NAME:
                    continue
                t = tokens[i]
                called = texts[i + 1] == "(" and kinds[i + 1] == OP and i >= inside and texts[i - 1] not in ("]", "chan", "func")
                if called:
                    calls.append(Use(t.text, t.line, t.start, symbol, True))
                elif i not in skip:
                    names.append(Use(t.text, t.line, t.start, symbol, False))
            out += calls + names
        return out


def package_name(tokens: list[Token]) -> str:
    for i, t in enumerate(tokens):
        if t.kind == WORD and t.text == "package" and i + 1 < len(tokens) and tokens[i + 1].kind == NAME:
            return tokens[i + 1].text
    return ""


def scan(source: str | bytes) -> File:
    """Everything the index takes from one file."""
    if isinstance(source, bytes):
        source = source.decode("utf-8", "replace")
    s = Scanner(source)
    s.declarations()
    return File(package_name(s.tokens), s.symbols, s.uses())

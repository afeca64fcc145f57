"""Functions and dependencies of TypeScript sources, by a scanner of our own.

Well-formed sources give the functions that a grammar gives: declarations, expressions, generators, arrows, methods. Brackets
that don't close make the function that holds them unsound; a declaration at the left margin ends what stands open, so a
broken function doesn't drag its neighbours along. `import x = require()` is no dependency, type-only imports are."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

LEXEME = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*(?:.*?\*/|.*))|(?P<str>'(?:[^'\\\n]|\\.)*'?|"(?:[^"\\\n]|\\.)*"?)|(?P<num>\d[\w.]*)|(?P<word>[^\W\d][\w$]*|[$\#@][\w$]*)|(?P<tick>`)|(?P<punct>=>|\.\.\.|\?\.|\?\?|\*\*|&&|\|\||.)""",
    re.S,
)
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, {")", "]", "}"}
BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "instanceof", "default"}
MARGIN = {"function", "export", "import", "class", "const", "let", "var", "interface", "type", "enum", "async", "abstract", "declare", "namespace"}
MODIFIERS = {"public", "private", "protected", "static", "async", "get", "set", "readonly", "override", "abstract", "accessor", "declare"}
NOT_METHODS = {"if", "for", "while", "switch", "catch", "with", "function", "return", "new", "await", "typeof"}
CONTINUES = {".", "?.", ",", "?", ":", "(", "[", "+", "-", "*", "/", "%", "&&", "||", "??", "=", "=>", "<", ">", "|", "&", "^", "**", "`"}
TYPE_PREFIX = {"keyof", "typeof", "readonly", "infer", "unique", "asserts", "new", "abstract"}


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


class Function(NamedTuple):
    kind: str
    start: int
    end: int
    sound: bool


class Scanner:
    """Tokens, which brackets match, and where types stand."""

    def __init__(self, source: str):
        self.source = source
        self.tokens: list[Token] = []
        self.match: dict[int, int] = {}
        self.unclosed: set[int] = set()
        self.limits: dict[int, int] = {}
        self.lex()
        self.types: set[int] = set()
        self.angled: dict[int, int | None] = {}
        self.class_bodies = self.bodies_of_classes()

    def lex(self) -> None:
        source, out, pos, n = self.source, self.tokens, 0, len(self.source)
        stack: list[int] = []

        def give_up(at: int) -> None:
            for i in stack:
                self.unclosed.add(i)
                self.limits[i] = at
            stack.clear()

        while pos < n:
            m = LEXEME.match(source, pos)
            kind, text = m.lastgroup, m[0]
            if kind == "skip":
                pos = m.end()
                continue
            if text == "/" and (not out or out[-1].text in BEFORE_VALUE or (out[-1].kind == "punct" and out[-1].text not in CLOSE)) and (r := REGEX.match(source, pos)):
                out.append(Token("regex", r[0], pos, r.end()))
                pos = r.end()
                continue
            if kind == "word" and text in MARGIN and stack and (pos == 0 or source[pos - 1] == "\n"):
                give_up(out[-1].end)
            i = len(out)
            out.append(Token(kind, text, pos, m.end()))
            pos = m.end()
            closed_hole = False
            if text in OPEN and kind == "punct":
                stack.append(i)
            elif text in CLOSE:
                if stack and OPEN[out[stack[-1]].text] == text:
                    closed_hole = out[stack[-1]].text == "${"
                    self.match[stack[-1]] = i
                    self.match[i] = stack.pop()
                else:
                    self.unclosed.add(i)
            if kind == "tick" or closed_hole:
                pos = TEMPLATE.match(source, pos).end()
                if source.startswith("${", pos):
                    out.append(Token("punct", "${", pos, pos + 2))
                    stack.append(len(out) - 1)
                    pos += 2
                elif pos < n:
                    out.append(Token("endtick", "`", pos, pos + 1))
                    pos += 1
        give_up(n)

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word"

    def after(self, i: int) -> int | None:
        """The token behind the bracket that closes i."""
        return self.match[i] + 1 if i in self.match else None

    def angles(self, i: int) -> int | None:
        """Behind the type parameters that open at i; brackets in them are passed over."""
        if i not in self.angled:
            open_, j, n = [], i, len(self.tokens)
            while j < n:
                t = self.text(j)
                if t == "<":
                    open_.append(j)
                elif t == ">":
                    self.angled[open_.pop()] = j + 1
                    if not open_:
                        break
                elif t in OPEN and j in self.match:
                    j = self.match[j]
                elif t in (";", "{") or t in CLOSE:
                    break
                j += 1
            for k in open_:
                self.angled[k] = None
        return self.angled[i]

    def type_end(self, i: int) -> int:
        """Behind the type that begins at i; its tokens are marked."""
        begun = i
        while True:
            while self.text(i) in TYPE_PREFIX or self.text(i) in ("|", "&"):
                i += 1
            t = self.text(i)
            if t == "<":
                i = self.angles(i) or i + 1
                continue
            if t in ("{", "[", "("):
                if i not in self.match:
                    break
                i = self.match[i] + 1
                if t == "(" and self.text(i) == "=>":
                    i += 1
                    continue
            elif self.is_word(i) or (i < len(self.tokens) and self.tokens[i].kind in ("str", "num")) or t == "-":
                i += 1
                while self.text(i) == "." and self.is_word(i + 1):
                    i += 2
                if self.text(i) == "<":
                    i = self.angles(i) or i + 1
            elif i < len(self.tokens) and self.tokens[i].kind == "tick":
                while i < len(self.tokens) and self.tokens[i].kind != "endtick":
                    i += 1
                i += 1
            else:
                break
            while self.text(i) == "[" and i in self.match and self.source[self.tokens[i - 1].end : self.tokens[i].start].count("\n") == 0:
                i = self.match[i] + 1
            if self.text(i) in ("|", "&", "is", "extends") or (self.text(i) in ("?", ":") and any(self.text(k) == "extends" for k in range(begun, i))):
                i += 1
                continue
            break
        self.types.update(range(begun, i))
        return i

    def mark_types(self) -> None:
        """Types of variables, aliases, interfaces, assertions and class fields; those of parameters come with their functions."""
        for i, t in enumerate(self.tokens):
            if t.kind != "word" or self.text(i - 1) == ".":
                continue
            if t.text in ("const", "let", "var"):
                j = self.after(i + 1) if self.text(i + 1) in ("{", "[") else i + 2
                if j and self.text(j) == "!":
                    j += 1
                if j and self.text(j) == ":":
                    self.type_end(j + 1)
            elif t.text == "type" and self.is_word(i + 1):
                j = self.angles(i + 2) if self.text(i + 2) == "<" else i + 2
                if j and self.text(j) == "=":
                    self.type_end(j + 1)
            elif t.text == "interface" and self.is_word(i + 1):
                j = next((k for k in range(i, len(self.tokens)) if self.text(k) == "{"), None)
                if j in self.match:
                    self.types.update(range(i, self.match[j]))
            elif t.text in ("as", "satisfies") and i and self.text(i + 1) != "const" and (self.is_word(i - 1) or self.text(i - 1) in CLOSE):
                self.type_end(i + 1)

    def mark_parameters(self, i: int) -> None:
        """Types of the parameters between the parenthesis i and its end."""
        end, j = self.match[i], i + 1
        while j < end:
            if self.text(j) in ("{", "["):
                j = self.after(j) or end
            if self.text(j) == ":" and j < end:
                j = self.type_end(j + 1)
            elif self.text(j) in OPEN:
                j = self.after(j) or end
            else:
                j += 1

    def body_after(self, i: int) -> tuple[int, bool, int | None] | None:
        """Of parameters that begin at i: (end of the function, whether it is sound, its body's brace); None: no body."""
        if i in self.unclosed:
            return self.limits.get(i, len(self.source)), False, None
        if i not in self.match:
            return None
        self.mark_parameters(i)
        j = self.match[i] + 1
        if self.text(j) == ":":
            j = self.type_end(j + 1)
        if self.text(j) != "{":
            return None
        if j in self.unclosed:
            return self.limits.get(j, len(self.source)), False, j
        end = self.match[j]
        return self.tokens[end].end, not any(k in self.unclosed for k in range(i, end)), j

    def expression_end(self, i: int) -> int:
        """Behind the last token of the expression that begins at i."""
        begun = i
        while i < len(self.tokens):
            t = self.text(i)
            if t in (",", ";") or t in CLOSE:
                break
            if i > begun and "\n" in self.source[self.tokens[i - 1].end : self.tokens[i].start] and t not in CONTINUES and self.text(i - 1) not in CONTINUES - {"`"} and self.tokens[i - 1].text not in BEFORE_VALUE:
                break
            i = self.match[i] + 1 if t in OPEN and i in self.match else i + 1
        return i

    def functions(self) -> list[Function]:
        """In order of their beginnings, outer ones first."""
        self.mark_types()
        out: list[Function] = []
        members = self.member_places()
        for i, t in enumerate(self.tokens):
            before = self.text(i - 1)
            if t.text == "function" and t.kind == "word" and before != "." and self.text(i + 1) != ":":
                j = i + 1
                star = self.text(j) == "*"
                j += star
                named = self.is_word(j)
                j += named
                j = (self.angles(j) if self.text(j) == "<" else j) or j
                found = self.body_after(j) if self.text(j) == "(" else None
                if found:
                    first = i - 1 if before == "async" else i
                    ahead = self.text(first - 1)
                    declared = named and (ahead in ("", ";", "{", "}", ")", "export", "default", "else", "declare") or first == 0)
                    kind = ("generator_function" if star else "function") + ("_declaration" if declared else "" if star else "_expression")
                    out.append(Function(kind, self.tokens[first].start, found[0], found[1]))
            elif i in members:
                j = members[i]
                found = self.body_after(j)
                if found:
                    out.append(Function("method_definition", t.start, found[0], found[1]))
        for i, t in enumerate(self.tokens):
            start = None
            if t.text == "=>" and i not in self.types:
                body = i + 1
                if self.is_word(i - 1) and self.text(i - 2) not in (":", "|", "&") and self.text(i - 1) not in ("void",):
                    start = i - 1
                elif self.text(i - 1) == ")" and i - 1 in self.match:
                    start = self.match[i - 1]
                    self.mark_parameters(start)
                if start is None or start in self.types:
                    continue
                self.arrow(out, start, body)
            elif t.text == "(" and i in self.match and self.text(self.match[i] + 1) == ":" and self.text(i - 1) != "?" and i not in members.values() and i not in self.types:
                marked = set(self.types)
                j = self.type_end(self.match[i] + 2)
                if self.text(j) == "=>":
                    self.mark_parameters(i)
                    self.types.add(j)
                    self.arrow(out, i, j + 1)
                else:
                    self.types = marked
        kept = [f for f in out if f.end > f.start]
        return sorted(set(kept), key=lambda f: (f.start, -f.end))

    def arrow(self, out: list[Function], start: int, body: int) -> None:
        if self.text(start - 1) == ">":
            start = self.opened_before(start)
        if self.text(start - 1) == "async":
            start -= 1
        if self.text(body) == "{":
            sound = body in self.match
            end = self.tokens[self.match[body]].end if sound else self.limits.get(body, len(self.source))
            sound = sound and not any(k in self.unclosed for k in range(start, self.match[body]))
        else:
            last = self.expression_end(body) - 1
            sound, end = last >= body, self.tokens[max(last, body - 1)].end
        out.append(Function("arrow_function", self.tokens[start].start, end, sound))

    def opened_before(self, i: int) -> int:
        """Where the type parameters open that end before i; i, if none do."""
        k, depth = i - 1, 0
        while k >= 0:
            t = self.text(k)
            if t in CLOSE and k in self.match:
                k = self.match[k]
            elif t == ";" or t in OPEN:
                break
            depth += (t == ">") - (t == "<")
            if not depth:
                return k if self.angles(k) == i else i
            k -= 1
        return i

    def member_places(self) -> dict[int, int]:
        """First token of each method, and its parameters' parenthesis."""
        out: dict[int, int] = {}
        for i in range(len(self.tokens)):
            if self.text(i) != "{" or self.tokens[i].kind != "punct":
                continue
            if not (self.class_body(i) or self.object_literal(i)):
                continue
            end = self.match.get(i, len(self.tokens))
            j = i + 1
            while j < end:
                first = j
                while self.text(j) in MODIFIERS and self.text(j + 1) not in ("(", ":", "=", ",", "}", ";", "?", "<") or self.text(j) == "*":
                    j += 1
                named = j
                if self.text(j) == "[":
                    j = self.after(j) or end
                elif j < len(self.tokens) and self.tokens[j].kind in ("word", "str", "num"):
                    j += 1
                if j > named:
                    j += self.text(j) == "?"
                    k = self.angles(j) if self.text(j) == "<" else j
                    if k and self.text(k) == "(" and self.text(named) not in NOT_METHODS:
                        out[first] = k
                        if k not in self.match:
                            break
                        j = self.match[k] + 1
                        if self.text(j) == ":":
                            j = self.type_end(j + 1)
                        if self.text(j) == "{":
                            j = self.after(j) or end
                        continue
                    if self.class_body(i) and self.text(j) in (":", "!"):
                        j = self.type_end(j + 1 + (self.text(j) == "!"))
                # To the next member.
                while j < end and self.text(j) not in (",", ";"):
                    if self.text(j) in OPEN:
                        j = self.after(j) or end
                        if self.class_body(i) and "\n" in self.source[self.tokens[j - 1].end : self.tokens[j].start if j < len(self.tokens) else None] and self.text(j) not in CONTINUES:
                            break
                    else:
                        j += 1
                        if self.class_body(i) and j < end and "\n" in self.source[self.tokens[j - 1].end : self.tokens[j].start] and self.text(j) not in CONTINUES and self.text(j - 1) not in CONTINUES:
                            break
                j += self.text(j) in (",", ";")
                if j == first:
                    j += 1
        return out

    def bodies_of_classes(self) -> set[int]:
        """Braces that open the body of a class: the first one behind its name, type parameters and bases."""
        out = set()
        for i, t in enumerate(self.tokens):
            if t.text != "class" or t.kind != "word" or self.text(i - 1) == ".":
                continue
            j = i + 1
            while j < len(self.tokens) and self.text(j) not in ("{", ";", "=", ":", ","):
                if self.text(j) == "<" and (end := self.angles(j)):
                    j = end
                elif self.text(j) in OPEN and j in self.match:
                    j = self.match[j] + 1
                else:
                    j += 1
                if self.text(j) == "," and j > i + 2:  # of several interfaces
                    j += 1
            if self.text(j) == "{":
                out.add(j)
        return out

    def class_body(self, i: int) -> bool:
        return i in self.class_bodies

    def object_literal(self, i: int) -> bool:
        t = self.text(i - 1)
        return t in ("(", ",", "=", ":", "[", "?", "&&", "||", "??", "return", "default", "yield", "throw") and i not in self.types

    def specifiers(self) -> list[str]:
        """Of all dependencies, in order."""
        out = []
        for i, t in enumerate(self.tokens):
            if t.kind != "word" or t.text not in ("import", "export") or self.text(i - 1) == ".":
                continue
            literal = None
            if t.text == "import" and self.text(i + 1) == "(":
                j, end = i + 2, self.match.get(i + 1, len(self.tokens))
                at_start = True
                while j < end and literal is None:
                    if at_start and self.tokens[j].kind == "str" and self.text(j + 1) in (",", ")"):
                        literal = self.tokens[j]
                    at_start = self.text(j) == ","
                    j = (self.match[j] if self.text(j) in OPEN and j in self.match else j) + 1
            elif t.text == "import" and i + 1 < len(self.tokens) and self.tokens[i + 1].kind == "str":
                literal = self.tokens[i + 1]
            else:
                j = i + 1
                if t.text == "export" and self.text(j) not in ("*", "{", "type"):
                    continue
                while j < len(self.tokens) and self.text(j) not in (";", "=", "(") and not (self.text(j) in MARGIN - {"type"} and j > i + 1):
                    if self.text(j) == "from" and j + 1 < len(self.tokens) and self.tokens[j + 1].kind == "str":
                        literal = self.tokens[j + 1]
                        break
                    j = (self.match[j] if self.text(j) == "{" and j in self.match else j) + 1
            if literal is not None:
                parts = [p for p in re.split(r"\\.", literal.text[1:-1], flags=re.S) if p]
                if parts:
                    out.append(parts[0])
        return out


def chunks_of(source: str) -> Iterator[tuple[int, str, int, int, int, bool]]:
    """(seq, kind, start_line, end_line, byte_len, has_error) of each function."""
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    line = lambda at: bisect.bisect_right(starts, at)
    for seq, f in enumerate(Scanner(source).functions()):
        yield seq, f.kind, line(f.start), line(max(f.start, f.end - 1)), len(source[f.start : f.end].encode()), not f.sound


def specifiers_of(source: str) -> list[str]:
    return Scanner(source).specifiers()

"""Python source by a lexer, a pushdown stack and a grammar of statements and expressions.

The lexer's stack turns every bracket, f-string and interpolation into one token with tokens of its own, so a line of
code is a flat list. Groups are judged one after the other from a work list by the role they stand in (call, display,
target, parameters, pattern and so on); nothing recurses, so no nesting is too deep. Lines form blocks by their
indentation, and each level remembers which clause may follow.
"""

from __future__ import annotations

import re
import unicodedata

from lodestrand.llm.grammar import Bad

#: The language's keywords and operators.
KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
AFTER_NUMBER = ("and", "else", "for", "if", "in", "is", "not", "or")
AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
ARITHMETIC = frozenset("+ - * / // % @ << >> & | ^ **".split())
COMPARISONS = frozenset("< > == != <= >=".split())
CLOSING = {")": "(", "]": "[", "}": "{"}
TOKEN = re.compile(
    r"(?P<space>[^\S\n]+|#[^\n]*|\\\n)|(?P<line>\n)"
    r"|(?P<string>(?i:rb|br|rf|fr|[rbfu])?(?:\"\"\"|'''|\"|'))"
    r"|(?P<number>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
    r"|(?P<name>[^\W\d]\w*)"
    r"|(?P<op>\.\.\.|\*\*=|//=|>>=|<<=|->|:=|\*\*|//|<<|>>|[=!<>+\-*/%@&|^]=|[()\[\]{}.,:;=<>+\-*/%@&|^~])"
)
ENDS = {q: re.compile(rf"(?:[^\\{q}\n]|\\[\s\S])*{q}") for q in "\"'"} | {q * 3: re.compile(rf"(?:[^\\]|\\[\s\S])*?{q * 3}") for q in "\"'"}
ESCAPE = re.compile(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4}|N\{([^}]*)\}|[\s\S])")


class Token:
    __slots__ = ("kind", "value", "items")

    def __init__(self, kind: str, value: str = "", items: list[Token] | None = None):
        self.kind, self.value, self.items = kind, value, items


END = Token("end")


def check_string(prefix: str, body: str) -> None:
    """Escapes that a literal's decoder refuses."""
    if "b" in prefix and not body.isascii():
        raise Bad("unterminated literal or unknown character")
    if "r" in prefix or "\\" not in body:
        return
    for m in ESCAPE.finditer(body):
        bad = m[0] in (("\\x",) if "b" in prefix else ("\\x", "\\u", "\\U", "\\N"))
        if m[1] is not None and "b" not in prefix:
            try:
                unicodedata.lookup(m[1])
            except KeyError:
                bad = True
        if bad:
            raise Bad("unterminated literal or unknown character")


def lexed(text: str) -> list[tuple[int, int, list[Token]]]:
    """The logical lines: column with tabs to eight, column with tabs as one, tokens."""
    lines: list[tuple[int, int, list[Token]]] = []
    items: list[Token] = []
    # open groups: what opened, its tokens, where they go on; for strings also the quote and whether it is raw
    stack: list[tuple[str, list[Token], str, bool]] = []
    i, n, column, alternative, fresh = 0, len(text), 0, 0, True
    while i < n:
        if stack and stack[-1][0] in ("f", "spec"):
            i, items = _in_string(text, i, stack, items)
            continue
        if fresh and not stack:
            column = alternative = 0
            while i < n and text[i] in " \t\f":
                if text[i] == "\t":
                    column, alternative = (column // 8 + 1) * 8, alternative + 1
                elif text[i] == "\f":
                    column = alternative = 0
                else:
                    column, alternative = column + 1, alternative + 1
                i += 1
            fresh = False
            continue
        m = TOKEN.match(text, i)
        if not m:
            if text[i] == "!" and stack and stack[-1][0] == "interp" and (c := re.match(r"![^\S\n]*[rsa]\s*(?=[:}])", text[i:])):
                i += c.end()
                continue
            raise Bad("unterminated literal or unknown character")
        kind, value = m.lastgroup, m[0]
        i = m.end()
        if kind == "space":
            if value[0] == "\\" and i >= n:
                raise Bad("premature end")
        elif kind == "line":
            if not stack:
                if items:
                    lines.append((column, alternative, items))
                    items = []
                fresh = True
        elif kind == "string":
            prefix, quote = value.rstrip("\"'").lower(), value.lstrip("rRbBfFuU")
            if "f" in prefix:
                stack.append(("f", items, quote, "r" in prefix))
                items = []
            else:
                e = ENDS[quote].match(text, i)
                if not e:
                    raise Bad("unterminated literal or unknown character")
                check_string(prefix, text[i : e.end() - len(quote)])
                items.append(Token("bytes" if "b" in prefix else "str"))
                i = e.end()
        elif kind == "number":
            tail = re.match(r"\w+", text[i : i + 64])
            if tail and not tail[0].startswith(AFTER_NUMBER) or re.fullmatch(r"0[\d_]*[1-9][\d_]*", value):
                raise Bad("unexpected token")
            items.append(Token("num"))
        elif kind == "name":
            items.append(Token("kw" if value in KEYWORDS else "name", value))
        elif value in "([{":
            stack.append((value, items, "", False))
            items = []
        elif value in ")]}":
            opened = stack.pop() if stack else ("", [], "", False)
            if value == "}" and opened[0] == "interp":
                opened[1].append(Token("interp", "", items))
            elif opened[0] == CLOSING[value]:
                opened[1].append(Token(opened[0], "", items))
            else:
                raise Bad("unbalanced delimiters")
            items = opened[1]
        elif stack and stack[-1][0] == "interp" and value == "=" and re.match(r"\s*[}!:]", text[i : i + 64]) and not text.startswith("!=", i):
            items.append(Token("debug"))
        elif stack and stack[-1][0] == "interp" and value in (":", ":="):
            i = m.start() + 1
            stack.append(("spec", items, stack[-1][2], stack[-1][3]))
            items = []
        else:
            items.append(Token("op", value))
    if stack:
        raise Bad("unterminated literal or unknown character" if stack[-1][0] in ("f", "spec") else "premature end")
    if items:
        lines.append((column, alternative, items))
    return lines


def _in_string(text: str, i: int, stack: list, items: list[Token]) -> tuple[int, list[Token]]:
    """One step inside the literal part of an f-string, or of a format specification."""
    kind, outer, quote, raw = stack[-1]
    c = text[i]
    if kind == "f" and text.startswith(quote, i):
        stack.pop()
        outer.append(Token("f", "", items))
        return i + len(quote), outer
    if kind == "spec" and c == "}":
        # the specification's own interpolations are judged beside what it belongs to
        stack.pop()
        _, around, _, _ = stack.pop()
        around += [Token("interp", "", outer), *items]
        return i + 1, around
    if c == "\n" and len(quote) == 1 or kind == "spec" and text.startswith(quote, i):
        raise Bad("unterminated literal or unknown character")
    if c == "\\":
        if not raw and (m := re.match(r"\\N\{[^}\n]*\}", text[i : i + 200])):
            check_string("", m[0])
            return i + m.end(), items
        if text[i + 1 : i + 2] in ("{", "}"):
            return i + 1, items
        if not raw:
            check_string("", text[i : i + 10] if text[i + 1 : i + 2] in ("x", "u", "U") else "")
        return i + 2, items
    if c == "{":
        if kind == "f" and text.startswith("{{", i):
            return i + 2, items
        stack.append(("interp", items, quote, raw))
        return i + 1, []
    if c == "}":
        if text.startswith("}}", i):
            return i + 2, items
        raise Bad("unbalanced delimiters")
    return i + 1, items


class Parser:
    """One flat list of tokens; groups go to the work list with their role."""

    def __init__(self, tokens: list[Token], work: list[tuple[Token, str]]):
        self.tokens, self.work, self.i = tokens, work, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i] if self.i < len(self.tokens) else END

    def at(self, *values: str) -> bool:
        t = self.now
        return t.kind in ("op", "kw") and t.value in values

    def take(self, *values: str) -> bool:
        if self.at(*values):
            self.i += 1
            return True
        return False

    def need(self, *values: str) -> None:
        if not self.take(*values):
            raise Bad("unexpected token")

    def name(self) -> None:
        if self.now.kind != "name":
            raise Bad("unexpected token")
        self.i += 1

    def group(self, kind: str, role: str) -> bool:
        if self.now.kind != kind:
            return False
        self.work.append((self.now, role))
        self.i += 1
        return True

    def end(self) -> None:
        if self.now is not END:
            raise Bad("unexpected token")

    def following(self) -> Token:
        return self.tokens[self.i + 1] if self.i + 1 < len(self.tokens) else END

    # -- expressions
    def primary(self) -> str:
        """What the value is: name, attribute, item or other."""
        t = self.now
        last = "other"
        if t.kind == "name":
            self.i += 1
            last = "name"
        elif t.kind == "num" or t.kind == "kw" and t.value in ("True", "False", "None") or t.kind == "op" and t.value == "...":
            self.i += 1
        elif t.kind in ("str", "bytes", "f"):
            kinds = set()
            while self.now.kind in ("str", "bytes", "f"):
                kinds.add(self.now.kind == "bytes")
                if self.now.kind == "f":
                    self.work.append((self.now, "fstring"))
                self.i += 1
            if len(kinds) > 1:
                raise Bad("unexpected token")
        elif not (self.group("(", "paren") or self.group("[", "list") or self.group("{", "brace")):
            raise Bad("unexpected token")
        while True:
            if self.take("."):
                self.name()
                last = "attribute"
            elif self.group("(", "arguments"):
                last = "other"
            elif self.group("[", "item"):
                last = "item"
            else:
                return last

    def arithmetic(self) -> None:
        while True:
            while self.take("+", "-", "~"):
                pass
            self.take("await")
            self.primary()
            if self.now.kind != "op" or self.now.value not in ARITHMETIC:
                return
            self.i += 1

    def disjunction(self) -> None:
        while True:
            while self.take("not"):
                pass
            self.arithmetic()
            while True:
                if self.now.kind == "op" and self.now.value in COMPARISONS or self.at("in"):
                    self.i += 1
                elif self.at("not") and self.following().value == "in":
                    self.i += 2
                elif self.take("is"):
                    self.take("not")
                else:
                    break
                self.arithmetic()
            if not self.take("and", "or"):
                return

    def expression(self) -> None:
        while True:
            if self.take("lambda"):
                self.parameters(False)
                self.need(":")
                continue
            self.disjunction()
            if not self.take("if"):
                return
            self.disjunction()
            self.need("else")

    def named(self) -> None:
        if self.now.kind == "name" and self.following().kind == "op" and self.following().value == ":=":
            self.i += 2
        self.expression()

    def star_named(self) -> bool:
        """Whether it is starred."""
        if self.take("*"):
            self.arithmetic()
            return True
        self.named()
        return False

    def star_expressions(self) -> None:
        while True:
            if self.take("*"):
                self.arithmetic()
            else:
                self.expression()
            if not self.take(",") or self.closes():
                return

    def closes(self) -> bool:
        return self.now is END or self.at("=", ":", ";", ")", "]", "}") or self.now.kind == "op" and self.now.value in AUGMENTED or self.now.kind == "debug"

    def value(self) -> None:
        """The right side of an assignment."""
        if self.take("yield"):
            self.after_yield()
        else:
            self.star_expressions()

    def after_yield(self) -> None:
        if self.take("from"):
            self.expression()
        elif not self.closes():
            self.star_expressions()

    def clauses(self) -> bool:
        """The for and if clauses of a comprehension, if there are any."""
        if not self.at("for") and not (self.at("async") and self.following().value == "for"):
            return False
        while self.at("for") or self.at("async"):
            self.take("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.disjunction()
            while self.take("if"):
                self.disjunction()
        return True

    # -- targets
    def target(self, groups: str = "target") -> None:
        t, f = self.now, self.following()
        if t.kind in ("(", "[") and not (f.kind in ("(", "[") or f.kind == "op" and f.value == "."):
            self.group(t.kind, groups)
        elif self.primary() == "other":
            raise Bad("unexpected token")

    def targets(self) -> None:
        while True:
            self.take("*")
            self.target()
            if not self.take(",") or self.closes() or self.at("in"):
                return

    def single_target(self) -> None:
        t, f = self.now, self.following()
        if t.kind == "(" and f is END:
            self.group("(", "single")
        elif self.primary() == "other":
            raise Bad("unexpected token")

    def sub(self, first: int) -> Parser:
        return Parser(self.tokens[first : self.i], self.work)

    # -- parameters
    def parameters(self, annotated: bool) -> None:
        default = star = slash = False
        first = True
        while self.now is not END and not self.at(":"):
            if self.take("**"):
                self.name()
                if annotated and self.take(":"):
                    self.expression()
                self.take(",")
                if self.now is not END and not self.at(":"):
                    raise Bad("unexpected token")
                return
            if self.take("*"):
                if star:
                    raise Bad("unexpected token")
                star = True
                if self.now.kind == "name":
                    self.name()
                    if annotated and self.take(":"):
                        if self.take("*"):
                            self.arithmetic()
                        else:
                            self.expression()
                elif not (self.at(",") and self.following().kind == "name"):
                    raise Bad("unexpected token")
            elif self.take("/"):
                if first or slash or star:
                    raise Bad("unexpected token")
                slash = True
            else:
                self.name()
                if annotated and self.take(":"):
                    self.expression()
                if self.take("="):
                    self.expression()
                    default = True
                elif default and not star:
                    raise Bad("unexpected token")
            first = False
            if not self.take(","):
                return

    # -- patterns
    def pattern(self) -> None:
        while True:
            if self.take("*"):
                self.name()
            else:
                self.alternatives()
                if self.take("as"):
                    self.name()
            if not self.take(",") or self.now is END or self.at("if", ":"):
                return

    def alternatives(self) -> None:
        while True:
            t = self.now
            if t.kind == "num" or self.at("-"):
                self.take("-")
                if self.now.kind != "num":
                    raise Bad("unexpected token")
                self.i += 1
                if self.take("+", "-"):
                    if self.now.kind != "num":
                        raise Bad("unexpected token")
                    self.i += 1
            elif t.kind in ("str", "bytes"):
                while self.now.kind in ("str", "bytes"):
                    self.i += 1
            elif t.kind == "kw" and t.value in ("True", "False", "None"):
                self.i += 1
            elif t.kind == "name":
                self.i += 1
                while self.take("."):
                    self.name()
                self.group("(", "class pattern")
            elif not (self.group("(", "patterns") or self.group("[", "patterns") or self.group("{", "mapping pattern")):
                raise Bad("unexpected token")
            if not self.take("|"):
                return

    # -- groups by their role
    def judge(self, role: str) -> None:
        getattr(self, "_" + role.replace(" ", "_"))()
        self.end()

    def _fstring(self) -> None:
        for t in self.tokens:
            self.work.append((t, "interpolation"))
        self.i = len(self.tokens)

    def _interpolation(self) -> None:
        self.value()
        if self.now.kind == "debug":
            self.i += 1
        while self.now.kind == "interp":
            self.group("interp", "interpolation")

    def _paren(self) -> None:
        if self.now is END:
            return
        if self.take("yield"):
            self.after_yield()
            return
        starred, several = self.star_named(), False
        if not starred and self.clauses():
            return
        while self.take(","):
            several = True
            if self.now is END:
                break
            self.star_named()
        if starred and not several:
            raise Bad("unexpected token")

    def _list(self) -> None:
        if self.now is END:
            return
        if not self.star_named() and self.clauses():
            return
        while self.take(",") and self.now is not END:
            self.star_named()

    def _brace(self) -> None:
        if self.now is END:
            return
        if not self.at("**"):
            before = self.i
            starred = self.star_named()
            if not self.at(":"):
                if not starred and self.clauses():
                    return
                while self.take(",") and self.now is not END:
                    self.star_named()
                return
            if starred or any(t.kind == "op" and t.value == ":=" for t in self.tokens[before : self.i]):
                raise Bad("unexpected token")
            self.need(":")
            self.expression()
            if self.clauses() or not self.take(","):
                return
        while self.now is not END:
            if self.take("**"):
                self.arithmetic()
            else:
                self.expression()
                self.need(":")
                self.expression()
            if not self.take(","):
                return

    def _arguments(self) -> None:
        keyword = unpacked = False
        first = True
        while self.now is not END:
            if self.take("*"):
                if unpacked:
                    raise Bad("unexpected token")
                self.expression()
            elif self.take("**"):
                self.expression()
                unpacked = True
            elif self.now.kind == "name" and self.following().kind == "op" and self.following().value == "=":
                self.i += 2
                self.expression()
                keyword = True
            else:
                if keyword or unpacked:
                    raise Bad("unexpected token")
                self.named()
                if self.clauses():
                    if not first:
                        raise Bad("unexpected token")
                    return
            first = False
            if not self.take(","):
                return

    def _item(self) -> None:
        while True:
            if self.take("*"):
                self.arithmetic()
            else:
                if not self.at(":"):
                    self.named()
                for _ in range(2):
                    if self.take(":") and self.now is not END and not self.at(":", ","):
                        self.expression()
            if not self.take(",") or self.now is END:
                return

    def _target(self) -> None:
        if self.now is END:
            return
        starred = self.at("*")
        self.targets()
        if starred and not any(t.kind == "op" and t.value == "," for t in self.tokens):
            raise Bad("unexpected token")

    _list_target = targets

    def _single(self) -> None:
        self.single_target()

    def _deleted(self) -> None:
        while self.now is not END and not self.at(";"):
            self.target("deleted")
            if not self.take(","):
                return

    def _parameters(self) -> None:
        self.parameters(True)

    def _type_parameters(self) -> None:
        while self.now is not END:
            self.take("*", "**")
            self.name()
            if self.take(":"):
                self.expression()
            if self.take("="):
                if self.take("*"):
                    self.arithmetic()
                else:
                    self.expression()
            if not self.take(","):
                return
        if not self.tokens:
            raise Bad("unexpected token")

    def _imported(self) -> None:
        while True:
            self.name()
            if self.take("as"):
                self.name()
            if not self.take(",") or self.now is END:
                return

    def _managers(self) -> None:
        while True:
            self.expression()
            if self.take("as"):
                self.target()
            if not self.take(",") or self.now is END:
                return

    def _patterns(self) -> None:
        if self.now is not END:
            self.pattern()

    def _class_pattern(self) -> None:
        keyword = False
        while self.now is not END:
            if self.now.kind == "name" and self.following().kind == "op" and self.following().value == "=":
                self.i += 2
                keyword = True
            elif keyword:
                raise Bad("unexpected token")
            self.alternatives()
            if self.take("as"):
                self.name()
            if not self.take(","):
                return

    def _mapping_pattern(self) -> None:
        while self.now is not END:
            if self.take("**"):
                self.name()
            else:
                self.alternatives()
                self.need(":")
                self.alternatives()
                if self.take("as"):
                    self.name()
            if not self.take(","):
                return

    # -- statements
    def simple_statements(self) -> None:
        while True:
            self.simple()
            if not self.take(";"):
                break
            if self.now is END:
                return
        self.end()

    def simple(self) -> None:
        if self.take("pass", "break", "continue"):
            return
        if self.take("return"):
            if not self.closes():
                self.star_expressions()
        elif self.take("raise"):
            if not self.closes():
                self.expression()
                if self.take("from"):
                    self.expression()
        elif self.take("global", "nonlocal"):
            self.name()
            while self.take(","):
                self.name()
        elif self.take("del"):
            if self.closes():
                raise Bad("unexpected token")
            self._deleted()
        elif self.take("assert"):
            self.expression()
            if self.take(","):
                self.expression()
        elif self.take("import"):
            while True:
                self.dotted()
                if self.take("as"):
                    self.name()
                if not self.take(","):
                    return
        elif self.take("from"):
            dots = False
            while self.take(".", "..."):
                dots = True
            if not dots or self.now.kind == "name":
                self.dotted()
            self.need("import")
            if self.take("*") or self.group("(", "imported"):
                return
            while True:
                self.name()
                if self.take("as"):
                    self.name()
                if not self.take(","):
                    return
        elif self.now.kind == "name" and self.now.value == "type" and self.following().kind == "name":
            self.i += 2
            self.group("[", "type parameters")
            self.need("=")
            self.expression()
        else:
            self.assignment()

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def assignment(self) -> None:
        first = self.i
        self.value()
        if self.at("="):
            while self.take("="):
                s = Parser(self.tokens[first : self.i - 1], self.work)
                s.targets()
                s.end()
                first = self.i
                self.value()
        elif self.now.kind == "op" and self.now.value in AUGMENTED:
            self.sub(first)._whole_single()
            self.i += 1
            self.value()
        elif self.at(":"):
            self.sub(first)._whole_single()
            self.i += 1
            self.expression()
            if self.take("="):
                self.value()

    def _whole_single(self) -> None:
        self.single_target()
        self.end()

    def header(self) -> None:
        """The rest of a compound statement's first line, up to its colon."""
        t = self.tokens[self.i].value
        self.i += 1
        if t == "async":
            t = self.now.value
            if t not in ("def", "for", "with"):
                raise Bad("unexpected token")
            self.i += 1
        if t in ("if", "elif", "while"):
            self.named()
        elif t == "for":
            self.targets()
            self.need("in")
            self.star_expressions()
        elif t == "with":
            inner = self.now
            f = self.following()
            if inner.kind == "(" and f.kind == "op" and f.value == ":" and any(x.kind == "kw" and x.value == "as" for x in inner.items):
                self.group("(", "managers")
            else:
                while True:
                    self.expression()
                    if self.take("as"):
                        self.target()
                    if not self.take(","):
                        break
        elif t == "except":
            star = self.take("*")
            if star or not self.at(":"):
                self.expression()
                if self.take("as"):
                    self.name()
        elif t == "def":
            self.name()
            self.group("[", "type parameters")
            if not self.group("(", "parameters"):
                raise Bad("unexpected token")
            if self.take("->"):
                self.expression()
        elif t == "class":
            self.name()
            self.group("[", "type parameters")
            self.group("(", "arguments")
        elif t == "match":
            while True:
                self.star_named()
                if not self.take(",") or self.at(":"):
                    break
        elif t == "case":
            self.pattern()
            if self.take("if"):
                self.named()
        self.need(":")


#: The clauses that may follow a statement, by its first word.
COMPOUND = frozenset("if elif else for while try except finally with def class async".split())
FOLLOWS = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except"), "except": ("try", "except"), "finally": ("try", "except", "try else")}


class Level:
    __slots__ = ("column", "alternative", "match", "last", "decorated")

    def __init__(self, column: int, alternative: int, match: bool = False):
        self.column, self.alternative, self.match, self.last, self.decorated = column, alternative, match, "", False

    def done(self) -> None:
        if self.last == "try" or self.decorated:
            raise Bad("premature end")


def fault(text: str) -> str | None:
    """What is wrong with a Python text, or None."""
    try:
        _judge(text)
    except Bad as e:
        return str(e)
    return None


def _judge(text: str) -> None:
    if "\0" in text:
        raise Bad("unterminated literal or unknown character")
    levels, opens, opens_match = [Level(0, 0)], False, False
    for column, alternative, tokens in lexed(text):
        top = levels[-1]
        if opens:
            if column <= top.column or alternative <= top.alternative:
                raise Bad("indentation")
            levels.append(Level(column, alternative, opens_match))
        else:
            if column > top.column:
                raise Bad("indentation")
            while column < levels[-1].column:
                levels.pop().done()
            if column != levels[-1].column or alternative != levels[-1].alternative:
                raise Bad("indentation")
        opens = opens_match = False
        level = levels[-1]
        work: list[tuple[Token, str]] = []
        p = Parser(tokens, work)
        first = tokens[0]
        word = first.value if first.kind == "kw" else ""
        if level.match and not (first.kind == "name" and first.value == "case"):
            raise Bad("unexpected token")
        if level.match:
            word = "case"
        elif first.kind == "name" and first.value == "match" and len(tokens) > 2 and tokens[-1].kind == "op" and tokens[-1].value == ":":
            word = "match"
        if word in FOLLOWS:
            if level.last not in FOLLOWS[word] or level.decorated:
                raise Bad("unexpected token")
        elif level.last == "try":
            raise Bad("unexpected token")
        if level.decorated and not (word in ("def", "class") or word == "async" and len(tokens) > 1 and tokens[1].value == "def" or first.kind == "op" and first.value == "@"):
            raise Bad("unexpected token")
        level.decorated = False
        if first.kind == "op" and first.value == "@":
            p.i = 1
            p.named()
            p.end()
            level.decorated, level.last = True, ""
        elif word in COMPOUND or word in ("match", "case"):
            p.header()
            if p.now is END:
                opens, opens_match = True, word == "match"
            elif word == "match":
                raise Bad("unexpected token")
            else:
                p.simple_statements()
            if word == "else":
                word = "try else" if level.last == "except" else ""
            elif word == "async":
                word = "for" if tokens[1].value == "for" else ""
            level.last = word
        else:
            p.simple_statements()
            level.last = ""
        while work:
            t, role = work.pop()
            Parser(t.items or [], work).judge(role)
    if opens:
        raise Bad("premature end")
    for level in levels:
        level.done()

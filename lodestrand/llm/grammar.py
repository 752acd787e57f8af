"""A recogniser for TypeScript and JavaScript over token classes.

A text is lexed to one character per token; brackets are matched with a stack, and each bracketed group's
content becomes a string in which the groups inside it are single characters (p: round, a: square, b: curly,
τ: an interpolation of a template).
What a content may be depends only on that string and on where its group stands, so verdicts are remembered:
source code repeats its shapes, and nearly all groups are answered by one look-up.
"""

from __future__ import annotations

import re
import sys

#: One character for each word that the grammar tells from a name.
WORDS = {
    "const": "v", "let": "v", "var": "v", "break": "B", "continue": "B", "case": "C", "catch": "c", "class": "K", "default": "D", "debugger": "g", "do": "d",
    "else": "E", "enum": "e", "export": "X", "extends": "x", "finally": "y", "for": "F", "function": "f", "if": "I", "import": "M", "in": "N", "instanceof": "O",
    "new": "W", "return": "R", "switch": "S", "throw": "H", "try": "T", "typeof": "u", "void": "u", "delete": "u", "await": "A", "while": "w", "yield": "Y", "with": "z",
    "as": "å", "satisfies": "å", "async": "ä", "abstract": "â", "declare": "đ", "from": "ƒ", "get": "ģ", "set": "ģ", "implements": "ī", "interface": "ï", "is": "ĭ",
    "keyof": "ķ", "unique": "ķ", "infer": "ķ", "namespace": "ñ", "module": "ñ", "global": "ñ", "of": "ø", "readonly": "ř", "static": "š", "type": "ť",
    "private": "π", "protected": "π", "public": "π", "override": "π", "accessor": "π", "asserts": "α",
}
#: Punctuators that are not their own class.
MARKS = {
    "=>": "⇒", "...": "…", "?.": "Q", "++": "±", "--": "±", "+": "+", "-": "+", "~": "!", "!": "!", "%": "o", "/": "o", "**": "o", "&&": "o", "||": "o", "??": "o", "^": "o",
    "<<": "o", "<=": "o", "==": "o", "!=": "o", "===": "o", "!==": "o", "+=": "≈", "-=": "≈", "*=": "≈", "/=": "≈", "%=": "≈", "**=": "≈", "<<=": "≈", "&=": "≈", "|=": "≈",
    "^=": "≈", "&&=": "≈", "||=": "≈", "??=": "≈",
}
CONTEXTUAL = "åäâđƒģīïĭķñøřšťπα"
IDENT = frozenset("iAY" + CONTEXTUAL)
NAME = frozenset("i" + "".join(set(WORDS.values())))
MODIFIERS = frozenset("πřšâđ")
ENDS = frozenset(";,:)=⇒?")

TOKEN = re.compile(
    r"""(?:[^\W\d]|\$)(?:\w|\$)*"""
    r"""|//[^\n]*|/\*[\s\S]*?\*/|\n\s*"""
    r"""|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'"""
    r"""|`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(?:`|\$\{)"""
    r"""|(?:(?<=[(=,:\[!&|?{};>\n])|(?<=[(=,:\[!&|?{};>+] )|(?<=return ))/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*"""
    r"""|\.?\d(?:[\w.]|(?<=[eE])[+-](?=\d))*"""
    r"""|=>|\.\.\.|\?\.(?!\d)|(?:\*\*|&&|\|\||\?\?)=|===|!==|\*\*|&&|\|\||\?\?|<<=?|<=|[=!+*/%&|^-]=|\+\+|--"""
    r"""|\#(?:[^\W\d]|\$)(?:\w|\$)*|\x01|[^\s]"""
)
#: What follows an interpolation of a template, to the template's end or the next interpolation.
TAIL = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(`|\$\{)")
NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|\d[\d_]*n|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?")
CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: |$)|^={7}$", re.M)
INVISIBLE = "﻿​‌‍‎‏⁠­"


class Bad(Exception):
    pass


class Classes(dict):
    """Token to class; '' drops the token, '\x00' is no token of the language."""

    def __missing__(self, token: str) -> str:
        c = self._of(token)
        if len(token) <= 40 and len(self) < 300_000:
            self[token] = c
        return c

    @staticmethod
    def _of(t: str) -> str:
        h = t[0]
        if t in WORDS:
            return WORDS[t]
        if h.isalpha() or h in "_$":
            return "i"
        if h == "\n":
            return "\n"
        if t.startswith("//"):
            return ""
        if t.startswith("/*"):
            return "\n" if "\n" in t else ""
        if h in "\"'" and len(t) > 1:
            return "s"
        if h == "`" and len(t) > 1:
            return "t"
        if h.isdigit() or (h == "." and len(t) > 1 and t[1].isdigit()):
            return "n" if NUMBER.fullmatch(t) else "\x00"
        if t in MARKS:
            return MARKS[t]
        if h == "/" and len(t) > 1:
            return "r"
        if h == "#" and len(t) > 1:
            return "i"
        if t == "\x01":
            return "j"
        if h in INVISIBLE:
            return ""
        if t in "()[]{};,:?.=*&|<>@":
            return t
        return "\x00"


class Node:
    __slots__ = ("kids", "text")

    def __init__(self):
        self.text, self.kids = "", []


def lexed(text: str, classes: Classes) -> str:
    """The classes of a text's tokens. Interpolations of templates stand between \x04 and \x05, lexed like other code."""
    if "${" not in text:
        return "".join(map(classes.__getitem__, TOKEN.findall(text)))
    out: list[str] = []
    stack: list[int] = []  # of each open interpolation the curly brackets open in it
    i, on = 0, True
    while on:
        on = False
        for m in TOKEN.finditer(text, i):
            t = m[0]
            if t[0] == "`" and t[-1] == "{":
                stack.append(0)
                out.append("t\x04")
                continue
            if stack and t == "{":
                stack[-1] += 1
            elif stack and t == "}":
                if not stack[-1]:
                    tail = TAIL.match(text, m.end())
                    if not tail:
                        return "\x00"
                    out.append("\x05\x04" if tail[1] == "${" else "\x05")
                    if tail[1] == "`":
                        stack.pop()
                    i, on = tail.end(), True
                    break
                stack[-1] -= 1
            out.append(classes[t])
    return "".join(out)


BRACKET = re.compile(r"[()\[\]{}\x04\x05]")
CLOSE = {")": "(", "]": "[", "}": "{", "\x05": "\x04"}
LETTER = {"(": "p", "[": "a", "{": "b", "\x04": "τ"}


def grouped(classes: str) -> Node:
    """The tree of bracketed groups, by a pushdown stack."""
    stack: list[tuple[str, Node, list[str]]] = [("", Node(), [])]
    at = 0
    for m in BRACKET.finditer(classes):
        i, c = m.start(), m[0]
        parts = stack[-1][2]
        if i > at:
            parts.append(classes[at:i])
        at = i + 1
        if c in LETTER:
            stack.append((c, Node(), []))
        else:
            opened, node, parts = stack.pop()
            if opened != CLOSE[c]:
                raise Bad("unbalanced delimiters")
            node.text = "".join(parts)
            stack[-1][2].append(LETTER[opened])
            stack[-1][1].kids.append(node)
    if len(stack) > 1:
        raise Bad("premature end")
    _, node, parts = stack[0]
    parts.append(classes[at:])
    node.text = "".join(parts)
    return node


class Parser:
    """One content string. kids collects, in order, the kind of each group that was passed."""

    def __init__(self, s: str, ts: bool, breaks: frozenset[int] | None = None):
        self.s, self.n, self.ts, self.breaks = s + "\x03\x03", len(s), ts, breaks
        self.i = 0
        self.kids: dict[int, str] = {}

    # -- helpers
    def at(self, c: str) -> bool:
        return self.s[self.i] == c

    def take(self, c: str) -> bool:
        if self.s[self.i] == c:
            self.i += 1
            return True
        return False

    def need(self, c: str) -> None:
        if self.s[self.i] != c:
            raise Bad("unexpected token")
        self.i += 1

    def group(self, letter: str, kind: str) -> None:
        if self.s[self.i] != letter:
            raise Bad("unexpected token")
        self.kids[self.i] = kind
        self.i += 1

    def name(self, allowed=NAME) -> None:
        if self.s[self.i] not in allowed:
            raise Bad("unexpected token")
        self.i += 1

    def typed(self) -> None:
        if not self.ts:
            raise Bad("types in a language without them")

    def attempt(self, f) -> bool:
        i, kids = self.i, dict(self.kids)
        try:
            f()
            return True
        except Bad:
            self.i, self.kids = i, kids
            return False

    def end(self) -> None:
        if self.i >= self.n or self.take(";"):
            return
        if self.breaks is not None and self.i in self.breaks:
            return
        raise Bad("unexpected token")

    def broken(self) -> bool:
        return self.breaks is not None and self.i in self.breaks

    # -- statements
    def statement(self) -> None:
        s, i = self.s, self.i
        c, d = s[i], s[i + 1]
        if c == "b":
            self.group("b", "block")
        elif c == ";":
            self.i += 1
        elif c == "v":
            self.i += 1
            if self.at("e"):
                self.enum()
            else:
                self.bindings()
                self.end()
        elif c == "f" or (c == "ä" and d == "f"):
            self.function(declared=True)
        elif c == "K" or (c == "â" and d == "K") or c == "@":
            self.classes()
        elif c == "I":
            self.i += 1
            self.group("p", "expr")
            self.statement()
            if self.take("E"):
                self.statement()
        elif c == "F":
            self.i += 1
            self.take("A")
            self.group("p", "for")
            self.statement()
        elif c == "w" or c == "z":
            self.i += 1
            self.group("p", "expr")
            self.statement()
        elif c == "d":
            self.i += 1
            self.statement()
            self.need("w")
            self.group("p", "expr")
            self.take(";")
        elif c == "S":
            self.i += 1
            self.group("p", "expr")
            self.group("b", "switch")
        elif c == "T":
            self.i += 1
            self.group("b", "block")
            caught = self.take("c")
            if caught:
                if self.at("p"):
                    self.group("p", "catch")
                self.group("b", "block")
            if self.take("y"):
                self.group("b", "block")
            elif not caught:
                raise Bad("try without catch")
        elif c == "R":
            self.i += 1
            if self.i < self.n and not self.at(";") and not self.broken():
                self.expression()
            self.end()
        elif c == "H":
            self.i += 1
            self.expression()
            self.end()
        elif c == "B":
            self.i += 1
            if self.s[self.i] in IDENT and not self.broken():
                self.i += 1
            self.end()
        elif c == "g":
            self.i += 1
            self.end()
        elif c == "M" and d not in "p.":
            self.imports()
        elif c == "X":
            self.exports()
        elif c == "ï" and d in IDENT:
            self.typed()
            self.i += 2
            self.type_parameters()
            if self.take("x"):
                self.type_list()
            self.group("b", "members")
        elif c == "ť" and d in IDENT and s[i + 2] in "=<":
            self.typed()
            self.i += 2
            self.type_parameters()
            self.need("=")
            self.type()
            self.end()
        elif c == "e":
            self.enum()
        elif c == "đ" and d in "vfKâïťeñä":
            self.typed()
            self.i += 1
            self.statement()
        elif c == "ñ" and (d in IDENT or d in "sb"):
            self.typed()
            self.i += 1
            if self.at("s"):
                self.i += 1
            elif not self.at("b"):
                self.name(IDENT)
                while self.take("."):
                    self.name()
            if self.at("b"):
                self.group("b", "block")
            else:
                self.end()
        elif c in IDENT and d == ":":
            self.i += 2
            self.statement()
        else:
            self.expression()
            self.end()

    def enum(self) -> None:
        self.typed()
        self.need("e")
        self.name(IDENT)
        self.group("b", "enum")

    def bindings(self) -> None:
        while True:
            self.pattern()
            if self.at("!") and self.s[self.i + 1] == ":":
                self.typed()
                self.i += 1
            if self.take(":"):
                self.typed()
                self.type()
            if self.take("="):
                self.assign()
            if not self.take(","):
                return

    def pattern(self) -> None:
        c = self.s[self.i]
        if c == "b":
            self.group("b", "object pattern")
        elif c == "a":
            self.group("a", "array pattern")
        else:
            self.name(IDENT)

    def function(self, declared: bool) -> None:
        self.take("ä")
        self.need("f")
        self.take("*")
        if self.s[self.i] in IDENT:
            self.i += 1
        elif declared is True:
            raise Bad("function without a name")
        self.signature()
        if self.at("b"):
            self.group("b", "block")
        elif declared and self.ts:
            self.end()
        else:
            raise Bad("function without a body")

    def signature(self) -> None:
        self.type_parameters()
        self.group("p", "params")
        if self.take(":"):
            self.typed()
            self.type(predicate=True)

    def classes(self) -> None:
        while self.take("@"):
            self.postfix()
        if self.take("X"):
            self.take("D")
        if self.take("â"):
            self.typed()
        self.need("K")
        if self.s[self.i] in IDENT and self.s[self.i] != "ī":
            self.i += 1
        self.type_parameters()
        if self.take("x"):
            self.postfix()
            if self.at("<"):
                self.type_arguments()
        if self.take("ī"):
            self.typed()
            self.type_list()
        self.group("b", "class")

    def imports(self) -> None:
        self.need("M")
        if self.take("s"):
            return self.tail_of_import()
        if self.at("ť") and self.s[self.i + 1] not in ",ƒ=":
            self.typed()
            self.i += 1
        if self.s[self.i] in IDENT:
            self.i += 1
            if self.at("="):
                self.typed()
                self.i += 1
                self.expression()
                return self.end()
            if not self.take(","):
                self.need("ƒ")
                self.need("s")
                return self.tail_of_import()
        if self.take("*"):
            self.need("å")
            self.name(IDENT)
        else:
            self.group("b", "names")
        self.need("ƒ")
        self.need("s")
        return self.tail_of_import()

    def tail_of_import(self) -> None:
        if self.at("z") or (self.s[self.i] in IDENT and self.s[self.i + 1] == "b"):
            self.i += 1
            self.group("b", "object")
        self.end()

    def exports(self) -> None:
        self.need("X")
        c, d = self.s[self.i], self.s[self.i + 1]
        if c == "D":
            self.i += 1
            e = self.s[self.i]
            if e == "f" or (e == "ä" and self.s[self.i + 1] == "f"):
                self.function(declared=1)
            elif e in "K@" or (e == "â" and self.s[self.i + 1] == "K") or (e == "ï" and self.s[self.i + 1] in IDENT):
                self.statement()
            else:
                self.assign()
                self.end()
        elif c == "=":
            self.typed()
            self.i += 1
            self.expression()
            self.end()
        elif c == "*" or (c == "ť" and d == "*"):
            self.i += 1 + (c == "ť")
            if self.take("å"):
                self.name()
            self.need("ƒ")
            self.need("s")
            self.tail_of_import()
        elif c == "b" or (c == "ť" and d == "b"):
            if c == "ť":
                self.typed()
                self.i += 1
            self.group("b", "names")
            if self.take("ƒ"):
                self.need("s")
                return self.tail_of_import()
            self.end()
        elif c == "å" and d == "ñ":
            self.i += 2
            self.name(IDENT)
            self.end()
        elif c in "vfKâïťeđñä@M":
            self.statement()
        else:
            raise Bad("unexpected token")

    # -- expressions
    def expression(self) -> None:
        self.assign()
        while self.take(","):
            self.assign()

    def arrow(self) -> bool:
        """An arrow function here? It's passed if so."""
        i = self.i
        c = self.s[i]
        if c == "ä" and (self.s[i + 1] in "p<" or (self.s[i + 1] in IDENT and self.s[i + 2] == "⇒")):
            self.i += 1
            if self.arrow():
                return True
            self.i = i
            return False
        if c in IDENT and self.s[i + 1] == "⇒":
            self.i += 2
            self.body()
            return True
        if c == "p" and self.s[i + 1] == "⇒":
            self.group("p", "params")
            self.i += 1
            self.body()
            return True
        if c == "<" or (c == "p" and self.s[i + 1] == ":"):
            if not self.ts:
                return False

            def typed_arrow() -> None:
                self.signature()
                self.need("⇒")

            if self.attempt(typed_arrow):
                self.body()
                return True
        return False

    def body(self) -> None:
        if self.at("b"):
            self.group("b", "block")
        else:
            self.assign()

    def assign(self) -> None:
        if self.arrow():
            return
        if self.at("Y"):
            self.i += 1
            self.take("*")
            if self.i < self.n and self.s[self.i] not in ";,:" and not self.broken():
                self.assign()
            return
        self.binary()
        c = self.s[self.i]
        if c == "?":
            self.i += 1
            self.assign()
            self.need(":")
            self.assign()
        elif c == "=" or c == "≈":
            self.i += 1
            self.assign()

    def binary(self) -> None:
        self.unary()
        while True:
            c = self.s[self.i]
            if c in "o+*&|<NO":
                self.i += 1
            elif c == ">":
                while self.take(">"):
                    pass
                if self.take("="):
                    self.take("=")
            elif c == "å" and not self.broken():
                self.typed()
                self.i += 1
                if self.at("v"):
                    self.i += 1
                else:
                    self.type()
                continue
            else:
                return
            self.unary()

    def unary(self) -> None:
        while True:
            c = self.s[self.i]
            if c == "<" and self.ts:
                self.type_arguments()
            elif c in "!+±u" or (c == "A" and self.s[self.i + 1] not in ".=,;)\x03oå"):
                self.i += 1
            else:
                break
        self.postfix()

    def postfix(self) -> None:
        self.primary()
        while True:
            c = self.s[self.i]
            if c == "." or c == "Q":
                self.i += 1
                if c == "Q" and self.s[self.i] in "pat":
                    continue
                self.name()
            elif c == "p":
                self.group("p", "args")
            elif c == "a":
                self.group("a", "index")
            elif c == "t":
                self.template("expr")
            elif c == "±":
                if self.broken():
                    return
                self.i += 1
            elif c == "!" and self.ts and not self.broken():
                self.i += 1
            elif c == "<" and self.ts:

                def generic_call() -> None:
                    self.type_arguments()
                    if self.s[self.i] not in "pt;,.)\x03":
                        raise Bad("unexpected token")

                if not self.attempt(generic_call):
                    return
            else:
                return

    def primary(self) -> None:
        c = self.s[self.i]
        if c == "t":
            self.template("expr")
        elif c in "insrj":
            self.i += 1
        elif c == "p":
            self.group("p", "paren")
        elif c == "a":
            self.group("a", "array")
        elif c == "b":
            self.group("b", "object")
        elif c == "f" or (c == "ä" and self.s[self.i + 1] == "f"):
            self.function(declared=False)
        elif c == "K":
            self.classes()
        elif c == "W":
            self.i += 1
            if self.take("."):
                return self.name()
            self.new()
        elif c == "M":
            self.i += 1
            if self.take("."):
                self.name()
            else:
                self.group("p", "args")
        elif c in IDENT:
            self.i += 1
        else:
            raise Bad("unexpected token")

    def template(self, kind: str) -> None:
        self.i += 1
        while self.at("τ"):
            self.group("τ", kind)

    def new(self) -> None:
        if self.at("W"):
            self.i += 1
            return self.new()
        self.primary()
        while True:
            if self.take("."):
                self.name()
            elif self.at("a"):
                self.group("a", "index")
            elif self.at("<") and self.ts:
                self.type_arguments()
            else:
                break
        if self.at("p"):
            self.group("p", "args")

    # -- types
    def type_parameters(self) -> None:
        if not self.at("<"):
            return
        self.typed()
        self.i += 1
        while not self.at(">"):
            while self.s[self.i] in "vNø" and self.s[self.i + 1] in NAME:
                self.i += 1
            self.name(IDENT)
            if self.take("x"):
                self.type()
            if self.take("="):
                self.type()
            if not self.take(","):
                break
        self.need(">")

    def type_arguments(self) -> None:
        self.need("<")
        self.type()
        while self.take(","):
            if self.at(">"):
                break
            self.type()
        self.need(">")

    def type_list(self) -> None:
        self.type()
        while self.take(","):
            self.type()

    def type(self, predicate: bool = False) -> None:
        c, d = self.s[self.i], self.s[self.i + 1]
        if predicate and c == "α" and d in IDENT:
            self.i += 2
            if self.take("ĭ"):
                self.type()
            return
        if c in IDENT and d == "ĭ" and predicate:
            self.i += 2
            return self.type()
        if c == "W" or (c == "â" and d == "W"):
            self.i += 1 + (c == "â")
            return self.function_type()
        if c == "<":
            return self.function_type()
        if c == "p" and d == "⇒":
            return self.function_type()
        if c in "|&":
            self.i += 1
        self.type_unary()
        while self.s[self.i] in "|&":
            self.i += 1
            self.type_unary()
        if self.at("x") and not self.broken():
            self.i += 1
            self.type()
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def function_type(self) -> None:
        self.type_parameters()
        self.group("p", "params")
        self.need("⇒")
        self.type(predicate=True)

    def type_unary(self) -> None:
        while self.s[self.i] in "ķř" and self.s[self.i + 1] not in ",;=)>|&[\x03":
            self.i += 1
        c, d = self.s[self.i], self.s[self.i + 1]
        if c == "u":
            self.i += 1
            if self.s[self.i] in IDENT or self.at("M"):
                self.names()
        elif c == "M":
            self.names()
        elif c in IDENT:
            self.names()
        elif c == "t":
            self.template("type")
        elif c in "sn":
            self.i += 1
        elif c == "+" and d == "n":
            self.i += 2
        elif c == "b":
            self.group("b", "members")
        elif c == "a":
            self.group("a", "tuple")
        elif c == "p":
            if d == "⇒":
                return self.function_type()
            self.group("p", "type")
        else:
            raise Bad("unexpected token")
        while self.at("a") and not self.broken():
            self.group("a", "type or nothing")

    def names(self) -> None:
        if self.take("M"):
            self.group("p", "args")
        else:
            self.i += 1
        while self.take("."):
            self.name()
        if self.at("<"):
            self.type_arguments()

    # -- contents of groups
    def listed(self, item, holes: bool = False) -> None:
        while self.i < self.n:
            if holes and self.take(","):
                continue
            item()
            if self.i < self.n:
                self.need(",")

    def parameter(self) -> None:
        while self.take("@"):
            self.postfix()
        while self.s[self.i] in MODIFIERS and self.s[self.i + 1] in "iba" + CONTEXTUAL:
            self.typed()
            self.i += 1
        self.take("…")
        self.pattern()
        if self.take("?"):
            self.typed()
        if self.take(":"):
            self.typed()
            self.type()
        if self.take("="):
            self.assign()

    def argument(self) -> None:
        self.take("…")
        self.assign()

    def property_name(self) -> None:
        if self.at("a"):
            self.group("a", "index")
        elif self.s[self.i] in "sn":
            self.i += 1
        else:
            self.name()

    def property(self) -> None:
        if self.take("…"):
            return self.assign()
        if self.at("ä") and self.s[self.i + 1] not in ",:p=\x03":
            self.i += 1
        self.take("*")
        if self.at("ģ") and self.s[self.i + 1] not in ",:p=\x03":
            self.i += 1
        plain = self.s[self.i] in IDENT
        self.property_name()
        if self.take(":"):
            return self.assign()
        if self.at("p") or self.at("<"):
            self.signature()
            return self.group("b", "block")
        if not plain:
            raise Bad("unexpected token")
        if self.take("="):
            self.assign()
        return None

    def bound(self) -> None:
        if self.take("…"):
            return self.pattern()
        plain = self.s[self.i] in IDENT
        self.property_name()
        if self.take(":"):
            self.pattern()
        elif not plain:
            raise Bad("unexpected token")
        if self.take("="):
            self.assign()
        return None

    def element(self) -> None:
        self.take("…")
        self.pattern()
        if self.take("="):
            self.assign()

    def specifier(self) -> None:
        if self.at("ť") and self.s[self.i + 1] not in ",å\x03":
            self.typed()
            self.i += 1
        if not self.take("s"):
            self.name()
        if self.take("å") and not self.take("s"):
            self.name()

    def constant(self) -> None:
        self.property_name()
        if self.take("="):
            self.assign()

    def tuple_item(self) -> None:
        self.take("…")
        if self.s[self.i] in NAME and (self.s[self.i + 1] == ":" or (self.s[self.i + 1] == "?" and self.s[self.i + 2] == ":")):
            self.i += 1
            self.take("?")
            self.need(":")
        self.type()
        self.take("?")

    def separated(self) -> None:
        """Between the members of a type: a mark, a line's end or the end."""
        if self.i >= self.n or self.take(";") or self.take(",") or self.broken():
            return
        raise Bad("unexpected token")

    def member(self) -> None:
        if self.take(";"):
            return
        if self.at("+"):
            self.i += 1
        while self.s[self.i] in "řšģ" and (self.s[self.i + 1] in NAME or self.s[self.i + 1] in "sna"):
            self.i += 1
        if self.at("W") and self.s[self.i + 1] in "p<":
            self.i += 1
            self.signature()
        elif self.s[self.i] in "p<":
            self.signature()
        elif self.at("a"):
            self.group("a", "key")
            self.take("+")
            self.take("?")
            if self.at("p") or self.at("<"):
                self.signature()
            elif self.take(":"):
                self.type()
        else:
            self.property_name()
            self.take("?")
            if self.at("p") or self.at("<"):
                self.signature()
            elif self.take(":"):
                self.type()
        self.separated()

    def class_member(self) -> None:
        if self.take(";"):
            return
        while self.take("@"):
            self.postfix()
        while self.s[self.i] in "πřšâđ" and self.s[self.i + 1] not in "=:p;?!<\x03":
            if self.at("š"):
                self.i += 1
                if self.at("b"):
                    return self.group("b", "block")
                continue
            self.typed()
            self.i += 1
        if self.at("ä") and self.s[self.i + 1] not in "=:p;?!<\x03":
            self.i += 1
        self.take("*")
        if self.at("ģ") and self.s[self.i + 1] not in "=:p;?!<\x03":
            self.i += 1
        if self.at("a"):
            self.group("a", "key")
        else:
            self.property_name()
        if self.at("?") or self.at("!"):
            self.typed()
            self.i += 1
        if self.at("p") or self.at("<"):
            self.signature()
            if self.at("b"):
                return self.group("b", "block")
            self.typed()
            return self.end()
        if self.take(":"):
            self.typed()
            self.type()
        if self.take("="):
            self.assign()
        return self.end()

    def whole(self, kind: str) -> None:
        s = self.s
        if kind == "args":
            self.listed(self.argument)
        elif kind == "params":
            self.listed(self.parameter)
        elif kind in ("expr", "paren", "index"):
            self.expression()
        elif kind == "array":
            self.listed(self.argument, holes=True)
        elif kind == "object":
            self.listed(self.property)
        elif kind == "object pattern":
            self.listed(self.bound)
        elif kind == "array pattern":
            self.listed(self.element, holes=True)
        elif kind == "names":
            self.listed(self.specifier)
        elif kind == "enum":
            self.listed(self.constant)
        elif kind == "tuple":
            self.listed(self.tuple_item)
        elif kind == "type":
            self.type()
        elif kind == "type or nothing":
            if self.n:
                self.type()
        elif kind == "catch":
            self.pattern()
            if self.take(":"):
                self.type()
        elif kind == "key":
            if s[0] in IDENT and s[1] == ":":
                self.typed()
                self.i = 2
                self.type()
            elif s[0] in IDENT and s[1] == "N" and self.ts:
                self.i = 2
                self.type()
                if self.take("å"):
                    self.type()
            else:
                self.expression()
        elif kind == "for":
            self.loop_head()
        elif kind == "members":
            while self.i < self.n:
                self.member()
        elif kind == "class":
            while self.i < self.n:
                self.class_member()
        elif kind == "switch":
            while self.i < self.n:
                if self.take("C"):
                    self.expression()
                    self.need(":")
                elif self.take("D"):
                    self.need(":")
                else:
                    raise Bad("unexpected token")
                while self.i < self.n and s[self.i] not in "CD":
                    self.statement()
        elif kind == "block":
            while self.i < self.n:
                self.statement()
        else:
            raise AssertionError(kind)
        if self.i != self.n:
            raise Bad("unexpected token")

    def loop_head(self) -> None:
        def each() -> None:
            if self.take("v"):
                self.pattern()
                if self.take(":"):
                    self.typed()
                    self.type()
            else:
                self.postfix()
            if not self.take("N"):
                self.need("ø")
            self.expression()
            if self.i != self.n:
                raise Bad("unexpected token")

        if self.attempt(each):
            return
        if self.take("v"):
            self.bindings()
        elif not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if self.i < self.n:
            self.expression()


class Recogniser:
    """Verdicts for one language (types allowed or not), remembered by shape."""

    def __init__(self, ts: bool):
        self.ts = ts
        self.known: dict[tuple[str, str], tuple[str, ...] | str] = {}
        self.chunks: dict[str, tuple[int, tuple[str, ...]] | None] = {}

    def kinds(self, kind: str, text: str) -> tuple[str, ...] | str:
        """The kinds of the groups inside; a string: what is wrong."""
        key = (kind, text)
        found = self.known.get(key)
        if found is None:
            found = self._block(text) if kind == "block" else self._whole(kind, text)
            if len(text) < 2000 and len(self.known) < 400_000:
                self.known[key] = found
        return found

    def _whole(self, kind: str, text: str) -> tuple[str, ...] | str:
        flat = text.replace("\n", "")
        try:
            return self._parsed(flat, text, kind)
        except RecursionError:
            # a very long chain (else if, ternary) calls once or a few times for each of its tokens
            usual = sys.getrecursionlimit()
            sys.setrecursionlimit(usual + 50 * len(flat))
            try:
                return self._parsed(flat, text, kind)
            finally:
                sys.setrecursionlimit(usual)

    def _parsed(self, flat: str, text: str, kind: str) -> tuple[str, ...] | str:
        try:
            p = Parser(flat, self.ts)
            p.whole(kind)
        except Bad as first:
            if "\n" not in text:
                return str(first)
            try:
                p = Parser(flat, self.ts, breaks(text))
                p.whole(kind)
            except Bad:
                return str(first)
        return tuple(p.kids[i] for i in sorted(p.kids))

    def _block(self, text: str) -> tuple[str, ...] | str:
        flat = text.replace("\n", "")
        i, out = 0, []
        while i < len(flat):
            j = flat.find(";", i) + 1 or len(flat)
            while j < len(flat) and flat[j] == "E":
                j = flat.find(";", j) + 1 or len(flat)
            chunk = flat[i:j]
            found = self.chunks.get(chunk, 0)
            if found == 0:
                try:
                    p = Parser(chunk, self.ts)
                    p.statement()
                    found = (p.i, tuple(p.kids[k] for k in sorted(p.kids)))
                except (Bad, RecursionError):
                    found = None
                if len(chunk) < 500 and len(self.chunks) < 400_000:
                    self.chunks[chunk] = found
            if found is None:
                return self._whole("block", text)
            i += found[0]
            out += found[1]
        return tuple(out)

    def fault(self, node: Node, kind: str = "block") -> str | None:
        todo = [(node, kind)]
        while todo:
            node, kind = todo.pop()
            kinds = self.kinds(kind, node.text)
            if isinstance(kinds, str):
                return kinds
            if node.kids and kinds != ("?",):
                todo += zip(node.kids, kinds)
        return None


def breaks(text: str) -> frozenset[int]:
    """Where, in the text without line feeds, a line begins."""
    out, k = set(), 0
    for c in text:
        if c == "\n":
            out.add(k)
        else:
            k += 1
    return frozenset(out)


# -- JSX
TAG = re.compile(r"<(?:>|([A-Za-z_$][\w$.:-]*))")
ROOT = re.compile(r"(?:\breturn|\bdefault|[=(?:,&|>{\[;])\s*(?=<(?:>|[A-Za-z_$][\w$.:-]*(?:\s+[A-Za-z_{$]|\s*/?>)))")
ATTRIBUTE = re.compile(r"\s*(?:([A-Za-z_$][\w$:.-]*)(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(?P<open>\{)))?|(?P<spread>\{\s*\.\.\.))")
INSIDE = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`|//[^\n]*|/\*[\s\S]*?\*/|[{}]|(?<=[\s(?:&|>{,=])<(?=[A-Za-z>])")


def braced(text: str, i: int) -> tuple[int, str]:
    """From behind a curly bracket to behind its partner; the code between, elements replaced."""
    depth, out, at = 1, [], i
    while m := INSIDE.search(text, i):
        c = m[0]
        i = m.end()
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                out.append(text[at : m.start()])
                return i, "".join(out)
        elif c == "<":
            try:
                end, code = element(text, m.start())
            except Bad:
                continue
            out += [text[at : m.start()], code]
            i = at = end
    raise Bad("premature end")


def element(text: str, i: int) -> tuple[int, str]:
    """A JSX element from its < on: where it ends, and code that holds its expressions."""
    inner: list[str] = []
    stack: list[str] = []
    while True:
        m = TAG.match(text, i)
        if not m:
            raise Bad("unexpected token")
        i, name, closed = m.end(), m[1] or "", False
        if m[1]:
            while a := ATTRIBUTE.match(text, i):
                i = a.end()
                if a["open"] or a["spread"]:
                    i, code = braced(text, i)
                    inner.append(code)
            m = re.compile(r"\s*(/?)>").match(text, i)
            if not m:
                raise Bad("unexpected token")
            i, closed = m.end(), bool(m[1])
        if not closed:
            stack.append(name)
        while stack:
            j = i
            while j < len(text) and text[j] not in "<{}":
                j += 1
            if j >= len(text):
                raise Bad("premature end")
            if text[j] == "}":
                raise Bad("unexpected token")
            if text[j] == "{":
                i, code = braced(text, j + 1)
                inner.append(re.sub(r"^\s*\.\.\.", "", code))
                continue
            m = re.compile(r"</\s*([\w$.:-]*)\s*>").match(text, j)
            if not m:
                i = j
                break
            if m[1] != stack.pop():
                raise Bad("unbalanced tags")
            i = m.end()
        if not stack:
            code = ",".join(f"({x}\n)" if re.sub(r"/\*[\s\S]*?\*/|//[^\n]*|\s", "", x) else "0" for x in inner)
            return i, f" \x01[{code}] " if inner else " \x01 "


def without_elements(text: str) -> str:
    if "</" not in text and "/>" not in text:
        return text
    out, at = [], 0
    while m := ROOT.search(text, at):
        try:
            end, code = element(text, m.end())
        except Bad:
            out.append(text[at : m.end() + 1])
            at = m.end() + 1
            continue
        out += [text[at : m.end()], code]
        at = end
    return "".join(out) + text[at:]

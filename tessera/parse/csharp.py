"""An error-tolerant parser for C#: text to syntax nodes in pre-order.

Tokens are cut by one expression; declarations and statements are parsed by descent, expressions by binding powers. What
the parser doesn't understand becomes a node ``Skipped`` up to the next semicolon or brace, so that every text has a tree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<word>@?[^\W\d]\w*)
    |(?P<mark>[(){}\[\];,])
    |(?P<ws>[\s﻿]+|//[^\n]*|/\*.*?(?:\*/|\Z)|^[ \t]*\#[^\n]*)
    |(?P<interp>\$@"|@\$"|\$"{3,}|\$")
    |(?P<raw>"{3,})
    |(?P<verbatim>@"(?:[^"]|"")*"?)
    |(?P<string>"(?:\\.|[^"\\\n])*"?)
    |(?P<char>'(?:\\.|[^'\\\n])*'?)
    |(?P<number>0[xX][0-9a-fA-F_]+[uUlL]*|0[bB][01_]+[uUlL]*|(?:[0-9][0-9_]*)?\.?[0-9][0-9_]*(?:[eE][+-]?[0-9]+)?[fFdDmMuUlL]*)
    |(?P<op>\?\?=|<<=|>>=|=>|->|::|\?\?|\?\.(?![0-9])|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\.\.|.)""",
    re.X | re.S | re.M,
)

MODIFIERS = set("public private protected internal static async virtual override sealed abstract readonly const extern unsafe new partial volatile required file ref".split())
TYPES = {"class", "struct", "interface", "record", "enum"}
PREDEFINED = set("bool byte sbyte short ushort int uint long ulong float double decimal string char object void dynamic nint nuint".split())
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
POWERS = {"??": 2, "||": 3, "&&": 4, "|": 5, "^": 6, "&": 7, "==": 8, "!=": 8, "<": 9, ">": 9, "<=": 9, ">=": 9, "is": 9, "as": 9, "<<": 10, ">>": 10, "+": 11, "-": 11, "*": 12, "/": 12, "%": 12, "..": 13}
STATEMENTS = set("if while lock fixed do for foreach await switch try return throw yield break continue goto checked unchecked unsafe using".split())
CLOSERS = {";", ")", ",", "]", "}"}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "??=", "<<=", ">>="}


class Token:
    """``sign`` is the text of words and operators, and empty for others."""

    __slots__ = ("kind", "text", "start", "end", "value", "holes", "sign")

    def __init__(self, kind: str, text: str, start: int, end: int, value: str | None = None, holes: list | tuple = ()):
        self.kind, self.text, self.start, self.end, self.value, self.holes = kind, text, start, end, value, holes
        self.sign = text if kind == "op" or kind == "word" else ""


@dataclass(slots=True)
class Node:
    kind: str
    start: int
    end: int = -1
    role: str = ""
    name: str | None = None
    op: str | None = None
    value: str | None = None
    type: str | None = None
    arity: int | None = None
    modifiers: tuple[str, ...] = ()
    children: list[Node] = field(default_factory=list)

    def add(self, child: Node | None, role: str = "") -> Node | None:
        if child is not None:
            child.role = role or child.role
            self.children.append(child)
        return child


def unescaped(body: str) -> str:
    def one(m):
        c = m[1]
        if c[0] in "uUx" and len(c) > 1:
            return chr(min(0x10FFFF, int(c[1:], 16)))
        return ESCAPES.get(c, c)

    return re.sub(r"\\(u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{1,4}|.)", one, body, flags=re.S)


def _interpolated(text: str, at: int, opening: str) -> tuple[int, str, list[tuple[int, int]]]:
    """End, literal text and holes (start, end) of an interpolated string whose opening ends at ``at``."""
    quotes = opening.count('"')
    verbatim, raw = "@" in opening, quotes >= 3
    out, holes, i, n = [], [], at, len(text)
    while i < n:
        c = text[i]
        if raw and text.startswith('"' * quotes, i):
            return i + quotes, "".join(out), holes
        if not raw and c == '"':
            if verbatim and text.startswith('""', i):
                out.append('"')
                i += 2
                continue
            return i + 1, "".join(out), holes
        if not raw and not verbatim and c == "\n":
            return i, "".join(out), holes
        if not raw and not verbatim and c == "\\":
            out.append(unescaped(text[i : i + 2]))
            i += 2
        elif c in "{}" and text.startswith(c * 2, i):
            out.append(c)
            i += 2
        elif c == "{":
            depth, j = 1, i + 1
            while j < n and depth:
                depth += {"{": 1, "}": -1}.get(text[j], 0)
                j += 1
            holes.append((i + 1, j - 1))
            i = j
        else:
            out.append(c)
            i += 1
    return n, "".join(out), holes


def tokens(text: str, start: int = 0, stop: int | None = None) -> list[Token]:
    out, i = [], start
    n = len(text) if stop is None else stop
    match, add = TOKEN.match, out.append
    while i < n:
        m = match(text, i, n)
        kind, s = m.lastgroup, m[0]
        end = i + len(s)
        if kind == "ws":
            pass
        elif kind == "word":
            add(Token("word", s, i, end))
        elif kind == "mark":
            add(Token("op", s, i, end))
        elif kind == "interp":
            end, value, holes = _interpolated(text, end, s)
            out.append(Token("interp", text[i:end], i, end, value, holes))
        elif kind == "raw":
            stop_at = text.find(s, end)
            end2 = len(text) if stop_at < 0 else stop_at + len(s)
            out.append(Token("string", text[i:end2], i, end2, text[end : end2 - len(s)].strip("\r\n")))
            end = end2
        elif kind == "verbatim":
            out.append(Token("string", s, i, end, s[2:].removesuffix('"').replace('""', '"')))
        elif kind == "string":
            body = s[1:-1] if len(s) > 1 and s.endswith('"') else s[1:]
            out.append(Token("string", s, i, end, unescaped(body)))
        else:
            add(Token(kind, s, i, end))
        i = end if end > i else i + 1
        if i < n and text[i] == " ":
            i += 1
    return out


class Parser:
    def __init__(self, text: str, start: int = 0, stop: int | None = None):
        self.text, self.t, self.i = text, tokens(text, start, stop), 0
        self.end = Token("end", "", len(text), len(text))

    # tokens

    def peek(self, k: int = 0) -> Token:
        try:
            return self.t[self.i + k]
        except IndexError:
            return self.end

    def at(self, *texts: str) -> bool:
        try:
            return self.t[self.i].sign in texts
        except IndexError:
            return False

    def next(self) -> Token:
        t = self.peek()
        self.i += 1
        return t

    def eat(self, text: str) -> bool:
        try:
            if self.t[self.i].sign == text:
                self.i += 1
                return True
        except IndexError:
            pass
        return False

    def last_end(self) -> int:
        return self.t[min(self.i, len(self.t)) - 1].end if self.t and self.i else 0

    def done(self, node: Node) -> Node:
        end = self.last_end()
        node.end = end if end > node.start else node.start
        return node

    def skip_pair(self, a: str, b: str) -> None:
        depth = 0
        while self.peek().kind != "end":
            t = self.next()
            depth += (t.text == a) - (t.text == b)
            if depth <= 0:
                return

    # brackets: found once, so that looking ahead over a bracket costs nothing, however deep they stand

    def after_bracket(self, i: int) -> int:
        """Index after the bracket that closes the one at token ``i``, or after all tokens."""
        if self.closing is None:
            self.closing, self.breaks, open_at = {}, [0], []
            for k, t in enumerate(self.t):
                if t.text == "(":
                    open_at.append(k)
                elif t.text == ")" and open_at:
                    self.closing[open_at.pop()] = k + 1
                self.breaks.append(self.breaks[-1] + (t.text in (";", "{")))
        return self.closing.get(i, len(self.t))

    closing: dict[int, int] | None = None

    # types

    def type_end(self, i: int) -> int | None:
        """Index after a type that starts at token i, or None."""
        t, n, end = self.t, len(self.t), self.end
        at = t[i] if i < n else end
        if at.text == "(":
            j = self.after_bracket(i)
            if self.breaks[j] > self.breaks[i]:
                return None
            i = j
        else:
            if at.text in ("ref", "scoped", "in", "out") and i + 1 < n and t[i + 1].kind == "word":
                i += 1
                at = t[i]
            while True:
                if at.kind != "word" or at.text in ("is", "as", "new", "return", "in"):
                    return None
                i += 1
                at = t[i] if i < n else end
                if at.text == "<":
                    j = self.generic_end(i)
                    if j is None:
                        return None
                    i = j
                    at = t[i] if i < n else end
                if at.text == "." or at.text == "::":
                    i += 1
                    at = t[i] if i < n else end
                    continue
                break
        while i < n:
            text = t[i].text
            if text == "?" or text == "*":
                i += 1
            elif text == "[":
                j = i + 1
                while j < n and t[j].text == ",":
                    j += 1
                if j >= n or t[j].text != "]":
                    return i
                i = j + 1
            else:
                return i
        return i

    def generic_end(self, i: int) -> int | None:
        get = lambda k: self.t[k] if k < len(self.t) else self.end
        i += 1
        while True:
            if get(i).text in (",", ">"):
                j = i
            else:
                while get(i).text in ("in", "out"):
                    i += 1
                j = self.type_end(i)
                if j is None:
                    return None
            if get(j).text == ",":
                i = j + 1
            elif get(j).text == ">":
                return j + 1
            else:
                return None

    def take_type(self) -> str:
        a = self.i
        b = self.type_end(a)
        if b is None or b == a:
            self.i = a + 1
        else:
            self.i = b
        return self.text[self.t[a].start : self.t[self.i - 1].end] if a < len(self.t) else ""

    # declarations

    def unit(self) -> Node:
        root = Node("CompilationUnit", 0)
        while self.peek().kind != "end":
            before = self.i
            self.declaration(root)
            if self.i == before:
                self.i += 1
        root.end = len(self.text)
        return root

    def attributes(self, into: Node) -> None:
        while self.at("[") and self.peek(1).kind == "word":
            self.next()
            if self.peek(1).text == ":" and self.peek(2).text != ":":
                self.i += 2
            while self.peek().kind == "word":
                a = Node("Attribute", self.peek().start)
                a.name = self.qualified()
                if self.at("("):
                    self.arguments(a)
                into.add(self.done(a), "attribute")
                if not self.eat(","):
                    break
            if not self.eat("]"):
                self.skip_pair("[", "]")

    def qualified(self) -> str:
        a = self.peek().start
        self.next()
        while self.at(".", "::", "<"):
            if self.at("<"):
                j = self.generic_end(self.i)
                if j is None:
                    break
                self.i = j
            elif self.peek(1).kind == "word":
                self.i += 2
            else:
                break
        return self.text[a : self.last_end()]

    def name_node(self, role: str) -> Node:
        start = self.peek().start
        text = self.qualified()
        return self.done(Node("Qualified" if "." in text else "Ident", start, role=role, name=text))

    def modifiers(self) -> tuple[str, ...]:
        out = []
        while self.peek().kind == "word" and self.peek().text in MODIFIERS:
            if self.peek().text in ("new", "ref", "partial", "file", "required") and self.peek(1).kind != "word":
                break
            out.append(self.next().text)
        return tuple(out)

    def declaration(self, into: Node) -> None:
        start = self.peek().start
        holder = Node("", start)
        self.attributes(holder)
        mods = self.modifiers()
        t = self.peek()
        if t.text in ("using", "global") and into.kind in ("CompilationUnit", "Namespace") and not (t.text == "using" and self.peek(1).text == "("):
            self.using(into, start)
        elif t.text == "namespace":
            self.next()
            n = Node("Namespace", start)
            name = self.name_node("name")
            n.name = name.name
            n.add(name)
            if self.eat(";"):
                while self.peek().kind != "end":
                    before = self.i
                    self.declaration(n)
                    self.i += self.i == before
            elif self.eat("{"):
                while not self.at("}") and self.peek().kind != "end":
                    before = self.i
                    self.declaration(n)
                    self.i += self.i == before
                self.eat("}")
            into.add(self.done(n))
        elif t.text in TYPES and (self.peek(1).kind == "word"):
            self.type_declaration(into, start, mods, holder)
        elif t.text == "delegate":
            while not self.at(";") and self.peek().kind != "end":
                self.next()
            self.eat(";")
        elif t.text in ("}", ";"):
            self.next()
        elif t.text == "event":
            self.next()
            self.member(into, start, mods, holder, "Event")
        elif t.text == "~":
            self.next()
            self.member(into, start, mods, holder, "Destructor")
        else:
            self.member(into, start, mods, holder, "")

    def using(self, into: Node, start: int) -> None:
        if self.eat("global"):
            pass
        self.next()
        n = Node("Using", start)
        self.eat("static")
        if self.peek(1).text == "=":
            n.op = "alias"
            n.value = self.next().text
            self.next()
        n.add(self.name_node("name"))
        n.name = n.children[-1].name
        while not self.at(";") and self.peek().kind != "end":
            self.next()
        self.eat(";")
        into.add(self.done(n))

    def type_declaration(self, into: Node, start: int, mods, holder: Node) -> None:
        kind = self.next().text
        if kind == "record" and self.peek().text in ("class", "struct"):
            self.next()
        n = Node("Type", start, op=kind, modifiers=mods, children=holder.children)
        n.name = self.next().text
        if self.at("<"):
            self.i = self.generic_end(self.i) or self.i + 1
        if self.at("("):
            self.parameters(n)
        if self.eat(":"):
            while self.peek().kind == "word" and not self.at("where"):
                start_b = self.peek().start
                n.add(self.done(Node("Base", start_b, name=self.take_type())), "base")
                if self.at("("):
                    self.arguments(n)
                if not self.eat(","):
                    break
        while self.at("where"):
            while not self.at("{", ";") and self.peek().kind != "end":
                self.next()
        if kind == "enum":
            self.skip_pair("{", "}")
        elif self.eat("{"):
            while not self.at("}") and self.peek().kind != "end":
                before = self.i
                self.declaration(n)
                self.i += self.i == before
            self.eat("}")
        self.eat(";")
        into.add(self.done(n))

    def member(self, into: Node, start: int, mods, holder: Node, kind: str) -> None:
        children = list(holder.children)
        if self.peek().kind == "word" and self.peek(1).text == "(" and (into.kind == "Type") and not kind.startswith("E"):
            n = Node(kind or "Constructor", start, modifiers=mods, children=children)
            name = self.next()
            n.name, n.value = name.text, str(name.start)
            self.parameters(n)
            if self.eat(":"):
                self.next()
                self.arguments(n)
            self.body(n)
            into.add(self.done(n))
            return
        if self.at("implicit", "explicit"):
            self.next()
        a = self.type_end(self.i)
        after = self.t[a] if a is not None and a < len(self.t) else self.end
        if a is None or not (after.kind == "word" or after.text == "("):
            statement = self.statement()
            if statement is not None:
                statement.children[:0] = children
                into.add(statement)
            return
        if into.kind in ("CompilationUnit", "Namespace") and after.kind == "word" and self.t[a + 1 : a + 2] and self.t[a + 1].text in ("=", ";", ",", "in"):
            into.add(self.statement())
            return
        kind_text = self.take_type()
        explicit = False
        if self.at("operator"):
            self.next()
            while not self.at("(") and self.peek().kind != "end":
                self.next()
            name = self.peek(-1)
        else:
            name = self.next()
            while self.at(".", "<") :
                if self.at("<"):
                    j = self.generic_end(self.i)
                    if j is None:
                        break
                    if j < len(self.t) and self.t[j].text == ".":
                        self.i = j
                        continue
                    self.i = j
                    break
                self.next()
                name, explicit = self.next(), True
        if name.text == "this" and self.at("["):
            n = Node("Indexer", start, name="this", type=kind_text, modifiers=mods, children=children, arity=0, value=str(name.start))
            self.parameters(n, "[", "]")
            self.accessors(n)
        elif self.at("("):
            local = into.kind not in ("Type", "CompilationUnit", "Namespace")
            n = Node("LocalFunction" if local else "Method", start, name=name.text, type=kind_text, modifiers=mods, children=children, value=str(name.start), op="explicit" if explicit else None)
            self.parameters(n)
            while self.at("where"):
                while not self.at("{", ";", "=>") and self.peek().kind != "end":
                    self.next()
            self.body(n)
        elif self.at("{", "=>"):
            n = Node("Event" if kind == "Event" else "Property", start, name=name.text, type=kind_text, modifiers=mods, children=children, arity=0, value=str(name.start))
            self.accessors(n)
        else:
            n = Node("Event" if kind == "Event" else "Field", start, name=name.text, type=kind_text, modifiers=mods, children=children, value=str(name.start))
            self.i -= 1
            self.declarators(n, kind_text)
            self.eat(";")
        into.add(self.done(n))

    def accessors(self, n: Node) -> None:
        if self.eat("=>"):
            n.add(self.expression(), "arrow")
            self.eat(";")
            return
        if self.eat("{"):
            while not self.at("}") and self.peek().kind != "end":
                before = self.i
                self.attributes(n)
                self.modifiers()
                if self.at("get", "set", "init", "add", "remove"):
                    a = Node("Accessor", self.peek().start, name=self.next().text)
                    self.body(a)
                    n.add(self.done(a))
                self.i += self.i == before
            self.eat("}")
        if self.eat("="):
            n.add(self.expression(), "initializer")
            self.eat(";")

    def body(self, n: Node) -> None:
        if self.at("{"):
            n.add(self.block(), "body")
        elif self.eat("=>"):
            n.add(self.expression(), "arrow")
            self.eat(";")
        else:
            self.eat(";")

    def parameters(self, n: Node, a: str = "(", b: str = ")") -> None:
        self.next()
        count = 0
        while not self.at(b) and self.peek().kind != "end":
            p = Node("Parameter", self.peek().start)
            self.attributes(p)
            while self.peek().text in ("this", "params", "ref", "out", "in", "scoped", "readonly"):
                self.next()
            p.type = self.take_type()
            if self.peek().kind == "word":
                p.name = self.next().text
            if self.eat("="):
                p.add(self.expression(), "default")
            n.add(self.done(p), "parameter")
            count += 1
            if not self.eat(","):
                break
        if not self.eat(b):
            self.skip_to(b)
        if n.arity is None:
            n.arity = count

    def skip_to(self, *ends: str) -> None:
        while self.peek().kind != "end" and not self.at(*ends, "{", "}", ";"):
            self.next()
        if self.at(*ends):
            self.next()

    def declarators(self, n: Node, kind: str) -> None:
        while self.peek().kind == "word":
            d = Node("Declarator", self.peek().start, type=kind)
            d.name = self.next().text
            if self.at("["):
                self.skip_pair("[", "]")
            if self.eat("="):
                d.add(self.array_or_expression(), "initializer")
            n.add(self.done(d))
            if not self.eat(","):
                break

    def array_or_expression(self) -> Node:
        return self.initializer() if self.at("{") else self.expression()

    # statements

    def block(self) -> Node:
        n = Node("Block", self.peek().start)
        self.next()
        while not self.at("}") and self.peek().kind != "end":
            before = self.i
            n.add(self.statement())
            self.i += self.i == before
        self.eat("}")
        return self.done(n)

    def paren(self, n: Node, role: str) -> None:
        if self.eat("("):
            n.add(self.expression(), role)
            if not self.eat(")"):
                self.skip_to(")")

    def statement(self) -> Node | None:
        t = self.peek()
        n = Node("", t.start)
        if t.text == "{":
            return self.block()
        if t.text == ";":
            self.next()
            return None
        if t.kind == "word":
            k = t.text
            if k not in STATEMENTS:
                if self.peek(1).text == ":" and self.peek(2).text != ":" and k != "default":
                    self.i += 2
                    return self.statement()
                return self.simple_statement()
            if k == "if":
                self.next()
                n.kind = "If"
                self.paren(n, "condition")
                n.add(self.statement(), "then")
                if self.at("else"):
                    self.next()
                    n.add(self.statement() or Node("Empty", self.last_end(), self.last_end()), "else")
                return self.done(n)
            if k in ("while", "lock", "fixed") and self.peek(1).text == "(":
                self.next()
                n.kind = {"while": "While"}.get(k, "Lock")
                if k == "fixed":
                    self.skip_pair("(", ")")
                else:
                    self.paren(n, "condition")
                n.add(self.statement(), "body")
                return self.done(n)
            if k == "do":
                self.next()
                n.kind = "Do"
                n.add(self.statement(), "body")
                if self.eat("while"):
                    self.paren(n, "condition")
                self.eat(";")
                return self.done(n)
            if k == "for" and self.peek(1).text == "(":
                self.i += 2
                n.kind = "For"
                if not self.at(";"):
                    n.add(self.simple(False), "init")
                self.eat(";")
                if not self.at(";"):
                    n.add(self.expression(), "condition")
                self.eat(";")
                while not self.at(")") and self.peek().kind != "end":
                    before = self.i
                    n.add(self.expression(), "step")
                    self.eat(",")
                    if self.i == before:
                        break
                if not self.eat(")"):
                    self.skip_to(")")
                n.add(self.statement(), "body")
                return self.done(n)
            if k == "foreach" or (k == "await" and self.peek(1).text == "foreach"):
                self.i += 1 + (k == "await")
                n.kind = "Foreach"
                if self.eat("("):
                    j = self.type_end(self.i)
                    if self.at("var") and self.peek(1).text == "(" or self.at("("):
                        n.kind = "ForeachDeconstruct"
                        while not self.at("in") and self.peek().kind != "end" and not self.at("{", ";"):
                            self.next()
                    elif j is not None:
                        n.type = self.take_type()
                        n.name = self.next().text
                    if self.eat("in"):
                        n.add(self.expression(), "source")
                    if not self.eat(")"):
                        self.skip_to(")")
                n.add(self.statement(), "body")
                return self.done(n)
            if k == "switch" and self.peek(1).text == "(":
                self.next()
                n.kind = "Switch"
                self.paren(n, "value")
                if self.eat("{"):
                    while not self.at("}") and self.peek().kind != "end":
                        s = Node("Section", self.peek().start)
                        before = self.i
                        while self.at("case", "default"):
                            while not self.at(":") and self.peek().kind != "end" and not self.at("{", "}"):
                                self.next()
                            self.eat(":")
                        while not self.at("case", "default", "}") and self.peek().kind != "end":
                            inner = self.i
                            s.add(self.statement())
                            self.i += self.i == inner
                        n.add(self.done(s))
                        self.i += self.i == before
                    self.eat("}")
                return self.done(n)
            if k == "try":
                self.next()
                n.kind = "Try"
                if self.at("{"):
                    n.add(self.block(), "body")
                while self.at("catch"):
                    c = Node("Catch", self.next().start)
                    if self.eat("("):
                        c.type = self.take_type()
                        if self.peek().kind == "word":
                            c.name = self.next().text
                        if not self.eat(")"):
                            self.skip_to(")")
                    if self.eat("when"):
                        self.paren(c, "filter")
                    if self.at("{"):
                        c.add(self.block(), "body")
                    n.add(self.done(c))
                if self.at("finally"):
                    f = Node("Finally", self.next().start)
                    if self.at("{"):
                        f.add(self.block(), "body")
                    n.add(self.done(f))
                return self.done(n)
            if k in ("return", "throw"):
                self.next()
                n.kind = "Return" if k == "return" else "Throw"
                if not self.at(";", "}"):
                    n.add(self.expression(), "value")
                self.eat(";")
                return self.done(n)
            if k == "yield" and self.peek(1).text in ("return", "break"):
                self.next()
                n.kind = "Yield"
                if self.next().text == "return":
                    n.add(self.expression(), "value")
                self.eat(";")
                return self.done(n)
            if k in ("break", "continue") and self.peek(1).text == ";":
                self.i += 2
                n.kind = k.capitalize()
                return self.done(n)
            if k == "goto":
                n.kind = "Goto"
                while not self.at(";") and self.peek().kind != "end":
                    self.next()
                self.eat(";")
                return self.done(n)
            if k in ("checked", "unchecked", "unsafe") and self.peek(1).text == "{":
                self.next()
                return self.block()
            if (k == "using" or (k == "await" and self.peek(1).text == "using")) and self.peek(1 + (k == "await")).text == "(":
                self.i += 2 + (k == "await")
                n.kind = "UsingStatement"
                n.add(self.simple(False), "resource")
                if not self.eat(")"):
                    self.skip_to(")")
                n.add(self.statement(), "body")
                return self.done(n)
            if self.peek(1).text == ":" and self.peek(2).text != ":" and k not in ("default",):
                self.i += 2
                return self.statement()
        return self.simple_statement()

    def simple_statement(self) -> Node | None:
        out = self.simple(True)
        if out is not None and out.kind == "LocalFunction":
            return out
        if not self.eat(";") and not self.at("}"):
            # lost: up to the end of the statement
            while not self.at(";", "}", "{") and self.peek().kind != "end":
                self.next()
            self.eat(";")
        if out is not None:
            out.end = max(out.end, self.last_end())
        return out

    def simple(self, whole: bool) -> Node | None:
        """A local declaration, a local function or an expression statement, without its semicolon."""
        start, before = self.peek().start, self.i
        mods = []
        while self.at("using", "const", "static", "async", "unsafe", "extern", "ref", "readonly") or (self.at("await") and self.peek(1).text == "using"):
            if self.at("ref", "async", "static") and self.peek(1).kind != "word":
                break
            mods.append(self.next().text)
        j = self.type_end(self.i)
        if j is not None and j < len(self.t) and self.t[j].kind == "word" and self.t[j].text not in POWERS and self.t[j].text not in ("switch", "with") and not self.at("await", "throw", "new"):
            after = self.t[j + 1].text if j + 1 < len(self.t) else ";"
            if after in ("=", ";", ",", ")", "in", "["):
                n = Node("LocalDeclaration", start, modifiers=tuple(mods))
                n.type = self.take_type()
                self.declarators(n, n.type)
                return self.done(n)
            if after in ("(", "<") and whole:
                holder = Node("Block", start)
                self.member(holder, start, tuple(mods), Node("", start), "")
                return holder.children[-1] if holder.children else None
        self.i = before
        n = Node("ExpressionStatement", start)
        n.add(self.expression(), "expression")
        return self.done(n)

    # expressions

    def expression(self) -> Node:
        left = self.conditional()
        t = self.peek()
        if t.kind == "op" and t.text == ">" and self.peek(1).text == ">=" and self.peek(1).start == t.end:
            self.i += 2
            return self.assign(left, ">>=")
        if t.kind == "op" and t.text in ASSIGN:
            self.next()
            return self.assign(left, t.text)
        return left

    def assign(self, left: Node, op: str) -> Node:
        n = Node("Assign", left.start, op=op)
        n.add(left, "left")
        n.add(self.array_or_expression(), "right")
        return self.done(n)

    def conditional(self) -> Node:
        left = self.binary(0)
        if self.at("?"):
            self.next()
            n = Node("Conditional", left.start)
            n.add(left, "condition")
            n.add(self.expression(), "then")
            if self.eat(":"):
                n.add(self.expression(), "else")
            return self.done(n)
        return left

    def binary(self, least: int) -> Node:
        left = self.unary()
        while True:
            t = self.peek()
            op = t.text
            if op in CLOSERS and t.kind == "op":
                return left
            if op == ">" and self.peek(1).text == ">" and self.peek(1).start == t.end and self.peek(2).text != "=":
                op = ">>"
            elif op == "<" and self.peek(1).text == "<" and self.peek(1).start == t.end:
                op = "<<"
            power = POWERS.get(op) if t.kind in ("op", "word") else None
            if op in ("switch", "with") and t.kind == "word" and self.peek(1).text == "{":
                self.next()
                n = Node("SwitchExpression" if op == "switch" else "With", left.start)
                n.add(left, "value")
                n.add(self.initializer() if op == "with" else self.arms())
                left = self.done(n)
                continue
            if power is None or power < least:
                return left
            self.i += 2 if op in (">>", "<<") else 1
            if op in ("is", "as"):
                n = Node("IsPattern" if op == "is" else "As", left.start, op=op)
                n.add(left, "left")
                self.pattern(n)
            else:
                n = Node("Binary", left.start, op=op)
                n.add(left, "left")
                if op == ".." and self.at("]", ")", ",", ";"):
                    return self.done(n)
                n.add(self.binary(power if op == "??" else power + 1), "right")
            left = self.done(n)

    def arms(self) -> Node:
        n = Node("Arms", self.peek().start)
        self.next()
        while not self.at("}") and self.peek().kind != "end":
            before = self.i
            depth = 0
            while self.peek().kind != "end" and not (self.at("=>") and depth <= 0):
                depth += self.at("(", "{", "[") - self.at(")", "}", "]")
                if depth < 0 or self.at(";"):
                    break
                self.next()
            if self.eat("=>"):
                n.add(self.expression(), "arm")
            self.eat(",")
            if self.i == before:
                break
        self.eat("}")
        return self.done(n)

    def pattern(self, n: Node) -> None:
        while self.at("not"):
            self.next()
        if self.peek().kind in ("string", "number", "char"):
            n.add(self.unary(), "right")
        elif self.at("null", "true", "false"):
            n.add(self.primary(), "right")
        elif self.at("<", ">", "<=", ">="):
            self.next()
            n.add(self.binary(10), "right")
        elif self.at("{"):
            self.skip_pair("{", "}")
            if self.peek().kind == "word" and not self.at("and", "or"):
                self.next()
        else:
            j = self.type_end(self.i)
            n.type = self.take_type() if j is not None else None
            # a question mark after a type may open a conditional
            if n.type and n.type.endswith("?") and not self.at(")", ";", "&&", "||"):
                self.i -= 1
                n.type = n.type[:-1]
            if self.at("{"):
                self.skip_pair("{", "}")
            if self.peek().kind == "word" and not self.at("and", "or", "when", "is", "as"):
                self.next()
        while self.at("and", "or"):
            self.next()
            self.pattern(n)

    def unary(self) -> Node:
        t = self.peek()
        if t.kind == "op" and t.text in ("!", "-", "+", "~", "++", "--", "&", "*", "^", ".."):
            self.next()
            n = Node("Unary", t.start, op=t.text)
            n.add(self.unary(), "operand")
            return self.done(n)
        if t.text == "await" and t.kind == "word" and (self.peek(1).kind in ("word", "interp") or self.peek(1).text == "("):
            self.next()
            n = Node("Await", t.start)
            n.add(self.unary(), "operand")
            return self.done(n)
        if t.text == "throw" and t.kind == "word":
            self.next()
            n = Node("ThrowExpression", t.start)
            n.add(self.unary(), "value")
            return self.done(n)
        if t.text == "(":
            lam = self.lambda_ahead()
            if lam:
                return lam
            # a cast: a type in parentheses before something that starts an operand
            j = self.type_end(self.i + 1)
            if j is not None and j < len(self.t) and self.t[j].text == ")":
                after = self.t[j + 1] if j + 1 < len(self.t) else self.end
                inside = self.t[self.i + 1]
                if after.kind in ("word", "string", "number", "char", "interp") and after.text not in POWERS and after.text not in ("switch", "with") or after.text in ("(", "!", "~") and (j > self.i + 2 or inside.text in PREDEFINED or after.text != "("):
                    self.next()
                    n = Node("Cast", t.start, type=self.take_type())
                    self.next()
                    n.add(self.unary(), "operand")
                    return self.done(n)
        return self.postfix(self.primary())

    def lambda_ahead(self) -> Node | None:
        start = self.peek().start
        i = self.after_bracket(self.i)
        if i >= len(self.t) or self.t[i].text != "=>":
            return None
        n = Node("Lambda", start)
        self.i += 1
        while not self.at(")") and self.peek().kind != "end":
            p = Node("Parameter", self.peek().start)
            while self.peek().text in ("ref", "out", "in", "scoped"):
                self.next()
            j = self.type_end(self.i)
            if j is not None and j < len(self.t) and self.t[j].kind == "word":
                p.type = self.take_type()
            p.name = self.next().text
            if self.eat("="):
                p.add(self.expression(), "default")
            n.add(self.done(p), "lambda_parameter")
            if not self.eat(","):
                break
        self.i = i
        return self.lambda_body(n)

    def lambda_body(self, n: Node) -> Node:
        self.next()
        n.add(self.block() if self.at("{") else self.expression(), "body")
        return self.done(n)

    def arguments(self, n: Node, a: str = "(", b: str = ")") -> int:
        self.next()
        count = 0
        while not self.at(b) and self.peek().kind != "end":
            before = self.i
            if self.peek().kind == "word" and self.peek(1).text == ":" and self.peek(2).text != ":":
                self.i += 2
            while self.at("ref", "in", "out"):
                self.next()
            j = self.type_end(self.i) if self.peek(-1).text == "out" else None
            if j is not None and j < len(self.t) and self.t[j].kind == "word":
                v = Node("OutVariable", self.peek().start, type=self.take_type())
                v.name = self.next().text
                n.add(self.done(v), "argument")
            else:
                n.add(self.expression(), "argument")
            count += 1
            if not self.eat(",") or self.i == before:
                break
        if not self.eat(b):
            self.skip_to(b)
        return count

    def initializer(self) -> Node:
        n = Node("Initializer", self.peek().start)
        self.next()
        while not self.at("}") and self.peek().kind != "end":
            before = self.i
            if self.at("["):
                self.skip_pair("[", "]")
                self.eat("=")
            n.add(self.array_or_expression(), "element")
            self.eat(",")
            if self.i == before:
                break
        if not self.eat("}"):
            self.skip_to("}")
        return self.done(n)

    def primary(self) -> Node:
        t = self.next()
        n = Node("Skipped", t.start, t.end)
        if t.kind == "string":
            n.kind, n.value = "String", t.value
        elif t.kind == "interp":
            n.kind, n.value, n.arity = "Interpolated", t.value, len(t.holes)
            for a, b in t.holes:
                inner = Parser(self.text, a, b)
                n.add(inner.expression(), "hole")
            n.end = t.end
            return n
        elif t.kind == "number":
            n.kind, n.value = "Number", t.text
        elif t.kind == "char":
            n.kind, n.value = "Char", t.text
        elif t.text in ("true", "false", "null", "default", "this", "base") and t.kind == "word":
            n.kind = t.text.capitalize()
            if t.text == "default" and self.at("("):
                self.skip_pair("(", ")")
        elif t.text == "(":
            n.kind = "Paren"
            n.add(self.expression(), "inner")
            if self.at(","):
                n.kind = "Tuple"
                while self.eat(","):
                    n.add(self.expression(), "inner")
            if not self.eat(")"):
                self.skip_to(")")
        elif t.text == "[":
            n.kind = "Collection"
            self.i -= 1
            self.arguments(n, "[", "]")
        elif t.text == "new":
            return self.creation(t)
        elif t.text in ("typeof", "sizeof", "nameof") and self.at("("):
            n.kind, n.name = "TypeOf", t.text
            a = self.peek(1).start
            self.skip_pair("(", ")")
            n.type = self.text[a : self.last_end() - 1].strip()
        elif t.text in ("async", "static") and t.kind == "word" and (self.peek().kind == "word" or self.at("(")):
            inner = self.unary()
            inner.modifiers = (*inner.modifiers, t.text)
            return inner
        elif t.text == "delegate":
            n.kind = "Lambda"
            if self.at("("):
                self.parameters(n)
                for c in n.children:
                    c.role = "lambda_parameter"
            if self.at("{"):
                n.add(self.block(), "body")
        elif t.kind == "word":
            if self.at("=>"):
                n.kind = "Lambda"
                n.add(Node("Parameter", t.start, t.end, name=t.text), "lambda_parameter")
                return self.lambda_body(n)
            n.kind, n.name = "Ident", t.text
            self.maybe_generic(n)
        else:
            self.i -= t.text in (";", "}", ")", "]", ",")
        return self.done(n)

    def maybe_generic(self, n: Node) -> None:
        if self.at("<"):
            j = self.generic_end(self.i)
            after = self.t[j].text if j is not None and j < len(self.t) else ";"
            if j is not None and after in ("(", ")", "]", ".", ";", ",", "{", "?.", "==", "!=", "::"):
                a = self.i
                self.i = j
                n.type = self.text[self.t[a].start : self.last_end()]

    def creation(self, t: Token) -> Node:
        n = Node("New", t.start)
        if self.at("("):
            n.kind = "ImplicitNew"
            n.arity = self.arguments(n)
        elif self.at("{"):
            n.kind = "Anonymous"
        elif self.at("["):
            n.kind = "NewArray"
            self.skip_pair("[", "]")
        else:
            a = self.i
            while self.peek().kind == "word":
                self.qualified()
                break
            n.type = self.text[self.t[a].start : self.last_end()] if a < len(self.t) else ""
            self.eat("?")
            if self.at("["):
                n.kind = "NewArray"
                while self.at("["):
                    self.arguments(n, "[", "]")
            elif self.at("("):
                n.arity = self.arguments(n)
            else:
                n.arity = 0
        if self.at("{"):
            n.add(self.initializer(), "initializer")
        return self.done(n)

    def postfix(self, left: Node) -> Node:
        while True:
            t = self.peek()
            if t.text in CLOSERS:
                return left
            if t.text in (".", "?.", "->", "::") and t.kind == "op" and self.peek(1).kind == "word":
                self.next()
                n = Node("Binding" if t.text == "?." else "Member", left.start, op=t.text)
                n.add(left, "receiver")
                name = self.next()
                n.name, n.value = name.text, str(name.start)
                self.maybe_generic(n)
            elif t.text == "(" and t.kind == "op":
                n = Node("Invocation", left.start)
                n.add(left, "callee")
                n.arity = self.arguments(n)
                n.name = left.name
            elif t.text == "[" and t.kind == "op" or t.text == "?" and self.peek(1).text == "[":
                if t.text == "?":
                    self.next()
                n = Node("Element", left.start)
                n.add(left, "receiver")
                n.arity = self.arguments(n, "[", "]")
            elif t.text in ("++", "--", "!") and t.kind == "op" and not (t.text == "!" and self.peek(1).text == "="):
                self.next()
                n = Node("Postfix", left.start, op=t.text)
                n.add(left, "operand")
            else:
                return left
            left = self.done(n)


def parse(text: str) -> Node:
    return Parser(text).unit()

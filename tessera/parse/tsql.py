"""A parser for the part of T-SQL that rules look at. All or nothing: a text with an error gives the error alone.

Statements are found by their first word; clauses are read for tables, hints, columns, stars and comparisons, expressions
by brackets. Strings, comments and quoted names are tokens and never read as anything else.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<ws>\s+|--[^\n]*)|(?P<comment>/\*)|(?P<string>[nN]?'(?:[^']|'')*')|(?P<quoted>\[(?:[^\]]|\]\])*\]|"(?:[^"]|"")*")
    |(?P<number>0[xX][0-9a-fA-F]*|[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+)|(?P<word>[@\#$\w][@\#$\w]*)|(?P<op><>|!=|<=|>=|!<|!>|\+=|-=|\*=|/=|::|[-+*/%=<>(),.;&|^~?:])|(?P<bad>.)""",
    re.X | re.S,
)

STATEMENTS = set(
    "select insert update delete merge create alter drop truncate exec execute declare set if else while begin end print return use grant revoke deny with raiserror throw try commit rollback save waitfor break continue goto open close fetch deallocate go enable disable backup restore dbcc bulk".split()
)
CLAUSES = set("where group having order union except intersect option for output values select set from on into when then go".split()) | {"left", "right", "full", "inner", "cross", "outer", "join"}
TYPE_WORDS = {"primary", "foreign", "unique", "check", "constraint", "index", "period"}


class SqlError(Exception):
    def __init__(self, message: str, at: int):
        super().__init__(message)
        self.at = at


@dataclass
class Item:
    """``kind``: SelectStar, Table, CreateTable, CreateProcedure, CreateView, Delete, Update, Insert, Select, NullComparison."""

    kind: str
    start: int
    end: int
    name: str | None = None
    schema: str | None = None
    op: str | None = None
    hints: int = 0
    where: bool = False
    tables: int = 0
    columns: list[str] = field(default_factory=list)


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int

    @property
    def low(self) -> str:
        return self.text.lower() if self.kind == "word" else self.text if self.kind == "op" else ""

    @property
    def name(self) -> str:
        return self.text[1:-1].replace("]]", "]").replace('""', '"') if self.kind == "quoted" else self.text


def tokens(text: str) -> list[Token]:
    out, i = [], 0
    while i < len(text):
        m = TOKEN.match(text, i)
        if m.lastgroup == "comment":
            depth, j = 1, m.end()
            while depth and j < len(text):
                if text.startswith("/*", j):
                    depth, j = depth + 1, j + 2
                elif text.startswith("*/", j):
                    depth, j = depth - 1, j + 2
                else:
                    j += 1
            if depth:
                raise SqlError("comment without end", i)
            i = j
            continue
        if m.lastgroup == "bad":
            raise SqlError(f"unexpected {m[0]!r}", i)
        if m.lastgroup != "ws":
            out.append(Token(m.lastgroup, m[0], m.start(), m.end()))
        i = m.end()
    return out


class Parser:
    def __init__(self, text: str):
        self.text, self.t, self.i, self.items = text, tokens(text), 0, []
        self.last = Token("end", "", len(text), len(text))

    def peek(self, k: int = 0) -> Token:
        return self.t[self.i + k] if self.i + k < len(self.t) else self.last

    def next(self) -> Token:
        t = self.peek()
        self.i += 1
        return t

    def eat(self, *words: str) -> bool:
        if self.peek().low in words:
            self.i += 1
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.eat(*words):
            raise SqlError(f"expected {words[0]}", self.peek().start)

    def identifier(self) -> bool:
        t = self.peek()
        return t.kind == "quoted" or t.kind == "word" and t.low not in CLAUSES and t.low not in STATEMENTS and t.low not in ("as", "and", "or", "not", "null")

    def dotted(self) -> tuple[str | None, str, Token, Token]:
        """(schema, name, first token, last token) of a name."""
        if not self.identifier():
            raise SqlError("expected a name", self.peek().start)
        parts, first = [self.next()], self.peek(-1)
        while self.peek().low == "." and (self.peek(1).kind in ("word", "quoted") or self.peek(1).low == "."):
            self.next()
            if self.peek().low != ".":
                parts.append(self.next())
        return (parts[-2].name if len(parts) > 1 else None), parts[-1].name, first, parts[-1]

    def parse(self) -> list[Item]:
        while self.peek().kind != "end":
            self.statement()
        return self.items

    def brackets(self) -> None:
        """Past a bracketed part, with the queries inside it."""
        self.need("(")
        while self.peek().low != ")":
            if self.peek().kind == "end" or self.peek().low in (";", "go"):
                raise SqlError("bracket without end", self.peek().start)
            if self.peek().low in ("select", "with") and self.peek(-1).low == "(":
                self.query()
            else:
                self.piece()
        self.next()

    def piece(self) -> None:
        """A token of an expression; a comparison with null is noted."""
        t = self.peek()
        if t.low == "(":
            self.brackets()
            return
        if t.low == ")":
            raise SqlError("unexpected )", t.start)
        if t.low in ("=", "<>", "!=") and (self.peek(1).low == "null" or self.peek(-1).low == "null") and self.comparing:
            self.items.append(Item("NullComparison", t.start, t.end, op=t.text))
        self.next()

    comparing = False

    def condition(self, *ends: str) -> None:
        self.comparing, before = True, self.i
        while self.peek().kind != "end" and self.peek().low not in (*ends, ";", ")"):
            if self.peek().low in STATEMENTS and self.peek().low not in ("select", "end", "with", "if", "set", "use") and self.peek(1).low != "(" and self.peek(-1).low != ".":
                break
            if self.peek().low == "end" and not self.cases:
                break
            if self.peek().low in ("select", "set", "if") and self.peek(-1).low not in ("(",):
                break
            self.cases += (self.peek().low == "case") - (self.peek().low == "end" and self.cases > 0)
            self.piece()
        self.comparing = False
        if self.i == before:
            raise SqlError("expected a condition", self.peek().start)

    cases = 0

    def statement(self) -> None:
        t = self.peek()
        k = t.low
        if k in (";", "go"):
            self.next()
            if k == "go" and self.peek().kind == "number":
                self.next()
        elif k in ("select", "with", "("):
            self.query()
        elif k == "insert":
            self.insert()
        elif k == "update":
            self.update()
        elif k == "delete":
            self.delete()
        elif k == "merge":
            self.merge()
        elif k in ("create", "alter"):
            self.create()
        elif k in ("if", "while"):
            self.next()
            self.condition("begin", "select", "update", "delete", "insert", "exec", "execute", "print", "return", "set", "drop", "create", "throw", "raiserror", "break", "continue")
        elif k in ("begin", "end", "else"):
            self.next()
            self.eat("try", "catch", "transaction", "tran", "distributed")
        elif k in STATEMENTS:
            self.next()
            while self.peek().kind != "end" and self.peek().low != ";" and not (self.peek().low in STATEMENTS and self.peek(-1).low not in ("=", ",", "for", ".", "(", "with") and self.peek().low not in ("with", "end")):
                if self.peek().low == "end":
                    break
                if self.peek().low == "select":
                    self.query()
                else:
                    self.piece()
        elif t.kind == "word" and self.peek(1).low == ":":
            self.i += 2
        elif t.kind in ("word", "quoted") and self.i == 0:
            # a procedure call without exec, as the first statement of a batch
            self.dotted()
            if self.peek().kind in ("word", "quoted"):
                raise SqlError(f"unexpected {t.text}", t.start)
            while self.peek().kind != "end" and self.peek().low not in (";", "go"):
                self.piece()
        else:
            raise SqlError(f"unexpected {t.text}", t.start)

    def query(self) -> None:
        if self.eat("with"):
            while True:
                self.dotted()
                if self.peek().low == "(":
                    self.brackets()
                self.need("as")
                self.brackets()
                if not self.eat(","):
                    break
            if self.peek().low in ("insert", "update", "delete", "merge"):
                return
        while True:
            if self.peek().low == "(":
                self.brackets()
            else:
                self.select()
            if self.eat("union", "except", "intersect"):
                self.eat("all")
                continue
            break
        if self.eat("order"):
            self.need("by")
            self.condition("option", "for", "union", "go")
        if self.eat("option"):
            self.brackets()
        if self.eat("for"):
            while self.peek().kind in ("word", "quoted", "string") and self.peek().low not in STATEMENTS or self.peek().low in (",", "("):
                self.piece()

    def select(self) -> None:
        start = self.peek().start
        self.need("select")
        item = Item("Select", start, start)
        self.eat("all", "distinct")
        if self.eat("top"):
            if self.peek().low == "(":
                self.brackets()
            else:
                self.next()
            self.eat("percent")
            if self.peek().low == "with" and self.peek(1).low == "ties":
                self.i += 2
        while True:
            self.element(item)
            if not self.eat(","):
                break
        if self.eat("into"):
            self.dotted()
        if self.eat("from"):
            self.sources(item)
        if self.eat("where"):
            item.where = True
            self.condition("group", "having", "order", "union", "except", "intersect", "option", "for", "go")
        if self.eat("group"):
            self.need("by")
            self.condition("having", "order", "union", "except", "intersect", "option", "for", "go")
        if self.eat("having"):
            self.condition("order", "union", "except", "intersect", "option", "for", "go")
        item.end = self.peek(-1).end
        self.items.append(item)

    def element(self, item: Item) -> None:
        t = self.peek()
        if t.low == "*":
            self.next()
            self.items.append(Item("SelectStar", t.start, t.end))
            return
        if t.kind in ("word", "quoted") and self.identifier():
            k = 0
            while self.peek(k).kind in ("word", "quoted") and self.peek(k + 1).low == ".":
                k += 2
            if k and self.peek(k).low == "*":
                self.items.append(Item("SelectStar", t.start, self.peek(k).end))
                self.i += k + 1
                return
        first, depth = self.i, 0
        while self.peek().kind != "end" and self.peek().low not in (",", ")", ";", "go"):
            low = self.peek().low
            depth += (low == "case") - (low == "end" and depth > 0)
            if low == "group" and self.peek(-1).low == "within":
                self.next()
                continue
            if not depth and (low in ("from", "where", "into", "union", "except", "intersect", "group", "having", "order", "option", "for") or low in STATEMENTS and low not in ("end",) and self.peek(1).low != "("):
                break
            if low == "end" and not depth and self.peek(-1).low != "end" and not any(x.low == "case" for x in self.t[first : self.i]):
                break
            self.piece()
        if self.i == first:
            raise SqlError("expected a column", self.peek().start)
        body = self.t[first : self.i]
        names = [x for x in body if x.kind in ("word", "quoted") or x.low == "."]
        if len(names) == len(body):
            # a column, perhaps with a table before it and an alias after it
            k = 0
            while k + 2 < len(body) and body[k + 1].low == ".":
                k += 2
            if body[k].kind == "quoted" or not body[k].text.startswith("@") and body[k].low not in ("null",):
                item.columns.append(body[k].name)

    def sources(self, item: Item) -> None:
        while True:
            self.source(item)
            while True:
                if self.eat(","):
                    break
                low = self.peek().low
                if low in ("inner", "left", "right", "full", "cross", "join", "outer"):
                    while self.peek().low in ("inner", "left", "right", "full", "cross", "outer", "hash", "merge", "loop"):
                        self.next()
                    self.need("join", "apply")
                    self.source(item)
                    if self.eat("on"):
                        self.condition("inner", "left", "right", "full", "cross", "join", "where", "group", "having", "order", "union", "except", "intersect", "option", "for", "go", ",", "when", "output")
                    continue
                return

    def source(self, item: Item) -> None:
        item.tables += 1
        if self.peek().low == "(":
            self.brackets()
            item.tables += 1
        else:
            schema, name, first, last = self.dotted()
            table = Item("Table", first.start, last.end, name=name, schema=schema)
            if self.peek().low == "(":
                self.brackets()
                table.kind = "Function"
                item.tables += 1
            if item.name is None:
                item.name, item.schema = name, schema
            self.items.append(table)
            if self.peek().low == "(" and self.peek(1).low in ("nolock",):
                self.brackets()
                table.hints += 1
            self.shaped()
            self.alias()
            if self.peek().low == "with" and self.peek(1).low == "(":
                self.next()
                table.hints += 1 + sum(1 for k in self.inside() if k == ",")
                self.brackets()
            self.shaped()
            return
        self.alias()
        self.shaped()

    def shaped(self) -> None:
        """A sample or a turn of what has been named as a source."""
        while self.peek().low in ("tablesample", "pivot", "unpivot"):
            if self.next().low == "tablesample":
                self.eat("system")
                self.brackets()
                if self.eat("repeatable"):
                    self.brackets()
            else:
                self.brackets()
                self.alias()

    def inside(self):
        depth = 0
        for k in range(self.i, len(self.t)):
            depth += (self.t[k].low == "(") - (self.t[k].low == ")")
            if not depth:
                return
            if depth == 1:
                yield self.t[k].low

    def alias(self) -> None:
        if self.eat("as"):
            if not self.identifier() and self.peek().kind != "string":
                raise SqlError("expected an alias", self.peek().start)
            self.next()
        elif self.identifier() and self.peek().low not in ("pivot", "unpivot", "tablesample", "using"):
            self.next()
        if self.peek().low == "(" and self.peek(-1).kind in ("word", "quoted"):
            self.brackets()

    def insert(self) -> None:
        start = self.next().start
        item = Item("Insert", start, start)
        self.eat("into")
        item.schema, item.name, _, _ = self.dotted()
        if self.peek().low == "(" :
            self.next()
            while not self.eat(")"):
                _, name, _, _ = self.dotted()
                item.columns.append(name)
                if self.peek().low != ")":
                    self.need(",")
        if self.eat("output"):
            self.condition("values", "select", "exec", "into", "default")
        if self.eat("values"):
            while True:
                self.brackets()
                if not self.eat(","):
                    break
        elif self.peek().low in ("select", "with", "("):
            self.query()
        elif self.eat("default"):
            self.need("values")
        elif self.peek().low not in ("exec", "execute"):
            raise SqlError("expected values", self.peek().start)
        item.end = self.peek(-1).end
        self.items.append(item)

    def assignments(self, item: Item) -> None:
        while True:
            _, name, _, _ = self.dotted()
            item.columns.append(name)
            self.need("=", "+=", "-=", "*=", "/=")
            first, depth = self.i, 0
            while self.peek().kind != "end" and self.peek().low not in (",", ";", "where", "from", "output", "option", "go", ")", "when"):
                low = self.peek().low
                depth += (low == "case") - (low == "end" and depth > 0)
                if low in STATEMENTS and not depth and low != "end" or low == "end" and not depth and "case" not in [x.low for x in self.t[first : self.i]]:
                    break
                self.piece()
                while depth and self.peek().low == "when":
                    self.piece()
            if self.i == first:
                raise SqlError("expected a value", self.peek().start)
            if not self.eat(","):
                break

    def merge(self) -> None:
        """A merge changes rows that its condition picks, so that none of its parts is an update or deletion of all rows."""
        self.next()
        if self.eat("top"):
            self.brackets()
            self.eat("percent")
        self.eat("into")
        item = Item("Merge", self.peek().start, self.peek().start)
        self.source(item)
        self.need("using")
        self.source(item)
        self.need("on")
        self.condition("when")
        if self.peek().low != "when":
            raise SqlError("expected WHEN", self.peek().start)
        while self.eat("when"):
            self.eat("not")
            self.need("matched")
            if self.eat("by"):
                self.need("source", "target")
            if self.eat("and"):
                self.condition("then")
            self.need("then")
            if self.eat("update"):
                self.need("set")
                self.assignments(item)
            elif self.eat("insert"):
                if self.peek().low == "(":
                    self.brackets()
                if self.eat("default"):
                    self.need("values")
                else:
                    self.need("values")
                    self.brackets()
            else:
                self.need("delete")
        if self.eat("output"):
            self.condition("option", "go")
        if self.eat("option"):
            self.brackets()

    def update(self) -> None:
        start = self.next().start
        if self.eat("statistics"):
            while self.peek().kind != "end" and self.peek().low not in (";", "go"):
                if self.peek().low in STATEMENTS and self.peek().low != "with":
                    break
                self.piece()
            return
        item = Item("Update", start, start)
        if self.eat("top"):
            self.brackets()
        item.schema, item.name, _, _ = self.dotted()
        if self.peek().low == "with":
            self.next()
            self.brackets()
        self.need("set")
        self.assignments(item)
        if self.eat("output"):
            self.condition("from", "where", "option")
        if self.eat("from"):
            item.tables = 1
            self.sources(item)
        if self.eat("where"):
            item.where = True
            self.condition("option", "go")
        item.end = self.peek(-1).end
        self.items.append(item)

    def delete(self) -> None:
        start = self.next().start
        item = Item("Delete", start, start)
        if self.eat("top"):
            self.brackets()
        self.eat("from")
        item.schema, item.name, _, _ = self.dotted()
        if self.peek().low == "with":
            self.next()
            self.brackets()
        if self.eat("output"):
            self.condition("from", "where", "option")
        if self.eat("from"):
            name = item.name
            self.sources(item)
            item.name = name
        if self.eat("where"):
            item.where = True
            self.condition("option", "go")
        item.end = self.peek(-1).end
        self.items.append(item)

    def create(self) -> None:
        start = self.next().start
        if self.eat("or"):
            self.need("alter")
        what = self.next().low
        if what == "table":
            schema, name, _, _ = self.dotted()
            item = Item("CreateTable", start, start, name=name, schema=schema)
            if self.peek().low == "(":
                begin = self.i
                self.brackets()
                item.columns = self.column_names(begin, self.i)
            elif self.t[self.i - 3 : self.i] and self.text[start : start + 6].lower() == "create":
                raise SqlError("expected columns", self.peek().start)
            while self.peek().kind != "end" and self.peek().low not in (";", "go") and self.peek().low not in STATEMENTS:
                self.piece()
            if self.text[start : start + 6].lower() == "create":
                item.end = self.peek(-1).end
                self.items.append(item)
            else:
                while self.peek().kind != "end" and self.peek().low not in (";", "go"):
                    self.piece()
        elif what in ("procedure", "proc", "view", "function", "trigger"):
            schema, name, _, last = self.dotted()
            kind = {"procedure": "CreateProcedure", "proc": "CreateProcedure", "view": "CreateView"}.get(what, "CreateOther")
            if self.text[start : start + 6].lower() == "create":
                self.items.append(Item(kind, start, last.end, name=name, schema=schema))
            while self.peek().kind != "end" and self.peek().low not in ("as", "go", ";"):
                self.piece()
            # parameters may be aliased; the body starts after the last "as" before a statement
            while self.peek().low == "as":
                self.next()
                if self.peek().low in STATEMENTS or self.peek().low in ("(", "begin"):
                    return
                while self.peek().kind != "end" and self.peek().low not in ("as", "go", ";"):
                    self.piece()
        else:
            while self.peek().kind != "end" and self.peek().low not in (";", "go"):
                self.piece()

    def column_names(self, a: int, b: int) -> list[str]:
        out, depth, fresh = [], 0, False
        for k in range(a, b):
            t = self.t[k]
            if fresh and depth == 1:
                if t.kind == "quoted" or t.kind == "word" and t.low not in TYPE_WORDS:
                    out.append(t.name)
                fresh = False
            depth += (t.low == "(") - (t.low == ")")
            if depth == 1 and t.low in ("(", ","):
                fresh = True
        return out


def parse(text: str) -> tuple[list[Item], SqlError | None]:
    try:
        return Parser(text).parse(), None
    except SqlError as e:
        return [], e

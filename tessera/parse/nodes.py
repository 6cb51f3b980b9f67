"""Syntax trees as rows: one for each node, in pre-order, with what rules ask of a node's surroundings as columns.

``node <= x <= last`` holds for all x below a node. ``method``, ``block``, ``member`` are the nearest enclosing ones; what a
rule would look up in a parent, a receiver or an operand stands beside the node, so that most rules are filters.
"""

from __future__ import annotations

import contextlib
import gc
import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.common import buckets_of, by_file, laid_out
from tessera.parse import csharp, tsql, tsql_format

NODES = """file_id long, node int, parent int, last int, role string, kind string, parent_kind string, name string, op string, value string, type string, arity int,
 modifiers array<string>, start_line int, start_col int, end_line int, end_col int, text string, receiver string, receiver_kind string, receiver_name string, left_kind string, left_name string, left_value string,
 right_kind string, right_name string, right_value string, argument_kind string, n_statements int, method int, block int, member int, type_node int, in_async boolean, in_loop boolean, in_const boolean, in_attribute boolean,
 catch_name string, weight int, nesting int, dynamic boolean, ord long"""
SQL_ITEMS = "file_id long, item int, kind string, name string, schema string, op string, hints int, has_where boolean, n_tables int, columns array<string>, line int, start_col int, end_line int, end_col int, error string"

LOOPS = {"For", "Foreach", "ForeachDeconstruct", "While", "Do"}
MEMBERS = {"Method", "Constructor", "LocalFunction", "Property", "Indexer", "Event"}
#: Kinds whose value is the place of their name, kinds whose text is kept, and kinds that change what holds below them.
PLACED = MEMBERS | {"Field"}
WRITTEN = {"Ident", "Member", "Binding", "Qualified", "Invocation", "New", "Binary"}
CONTEXTS = MEMBERS | LOOPS | {"Declarator", "Block", "Type", "Attribute", "Catch"}
NEWLINE = re.compile("\n")
SHOWN = 200
#: Rows of a batch, or those of one file if it has more.
GATHERED = 4096
#: Rows that a task remembers of the texts it has seen.
REMEMBERED = 20_000


def _unwrapped(n: csharp.Node) -> csharp.Node:
    while n.kind == "Paren" and n.children:
        n = n.children[0]
    return n


def is_dynamic(n: csharp.Node) -> bool:
    """A string put together at run time: an interpolation with holes, or a sum that isn't of literals alone."""
    n = _unwrapped(n)
    if n.kind == "Interpolated":
        return bool(n.arity)
    if n.kind == "Binary" and n.op == "+":
        parts, stack = [], [n]
        while stack:
            x = _unwrapped(stack.pop())
            if x.kind == "Binary" and x.op == "+":
                stack += x.children
            else:
                parts.append(x)
        return any(x.kind not in ("String", "Number", "Char") for x in parts) and any(x.kind in ("String", "Interpolated") for x in parts)
    return False


def _chain(n: csharp.Node) -> list[str]:
    """Logical operators of a maximal chain from left to right, through parentheses."""
    n = _unwrapped(n)
    if n.kind == "Binary" and n.op in ("&&", "||") and len(n.children) == 2:
        return [*_chain(n.children[0]), n.op, *_chain(n.children[1])]
    return []


def complexity(method: csharp.Node) -> dict[int, tuple[int, int]]:
    """(weight, nesting) by id() of the nodes that add to a method's cognitive complexity; the sum is weight * (1 + nesting) parts."""
    out: dict[int, tuple[int, int]] = {}

    def add(n, weight, nesting):
        w, k = out.get(id(n), (0, 0))
        out[id(n)] = (w + weight, k + nesting)

    body = next((c for c in method.children if c.role in ("body", "arrow")), None)
    if body is None:
        return out
    # nodes whose children are looked at, with their nesting
    walks = [(body, 0)]
    while walks:
        above, nesting = walks.pop()
        for c in above.children:
            if c.kind == "If":
                chain = [c]
                while chain:
                    n = chain.pop()
                    add(n, 1, nesting)
                    for x in n.children:
                        if x.role == "then":
                            walks.append((x, nesting + 1))
                        elif x.role == "else" and x.kind == "If":
                            chain.append(x)
                        elif x.role == "else":
                            add(x, 1, 0)
                            walks.append((x, nesting + 1))
            elif c.kind == "Switch":
                add(c, 1, nesting)
                walks.append((c, nesting + 1))
            elif c.kind in LOOPS or c.kind == "Catch":
                add(c, 1, nesting)
                walks += [(x, nesting + 1) for x in c.children if x.role == "body"]
            elif c.kind == "Conditional":
                add(c, 1, nesting)
                walks.append((c, nesting))
            elif c.kind == "Goto":
                add(c, 1, 0)
            elif c.children:
                walks.append((c, nesting))
    recursive, stack = False, [(body, False)]
    while stack:
        n, inside = stack.pop()
        logical = n.kind == "Binary" and n.op in ("&&", "||")
        if logical and not inside:
            ops = _chain(n)
            add(n, 1 + sum(a != b for a, b in zip(ops, ops[1:])), 0)
        if n.kind == "Invocation" and n.name == method.name and n.children and not recursive:
            callee = n.children[0]
            if callee.kind == "Ident" or callee.kind == "Member" and callee.children and callee.children[0].kind == "This":
                recursive = True
                add(n, 1, 0)
        if n.children:
            inside = logical or inside and n.kind == "Paren"
            stack += [(c, inside) for c in n.children]
    return out


@contextlib.contextmanager
def seldom_collected(allocations: int = 500_000):
    """Trees have no cycles and go with their last reference: looking for cycles after each few of them finds nothing."""
    before = gc.get_threshold()
    gc.set_threshold(allocations, *before[1:])
    try:
        yield
    finally:
        gc.set_threshold(*before)


@contextlib.contextmanager
def deep(frames: int = 200_000):
    """Room for trees as deep as long chains make them. Frames of Python functions lie on the heap."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, frames))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def guarded(make, error):
    """``make`` for one file after the other: what goes wrong in a file becomes a row of it, and the others go on."""

    def rows_of(file_id: int, text: str) -> list[tuple]:
        try:
            with deep():
                return list(make(file_id, text))
        except (RecursionError, MemoryError, ValueError, IndexError, AttributeError, TypeError) as e:
            return [error(file_id, f"{type(e).__name__}: {e}")]

    return rows_of


def rows(file_id: int, text: str, kinds: frozenset[str] | None = None, weighed: bool = True) -> Iterator[tuple]:
    """Rows of the schema ``NODES`` for a C# text; with ``kinds`` of those kinds and of nodes with a weight.

    Numbers and places don't depend on ``kinds``. Unless ``weighed``, no weights are given.
    """
    root = csharp.parse(text)
    starts = [0, *(m.end() for m in NEWLINE.finditer(text))]
    # of long texts the end is kept: rules ask for last names and empty argument lists
    shown = lambda n: text[n.start : n.end] if n.end - n.start <= SHOWN else "…" + text[n.end - SHOWN : n.end]
    order: list[list] = []
    parents: list[int] = []
    # (node, parent row, context): method, block, member, type, async, loop, const, attribute, catch, weights
    stack = [(root, None, None, (None, None, None, None, False, False, False, False, None, {}))]
    while stack:
        n, parent, parent_kind, context = stack.pop()
        method, block, member, type_node, is_async, loop, const, attribute, caught, weights = context
        me, kind, kids = len(parents), n.kind, n.children
        parents.append(parent)
        if kind == "Method" and weighed:
            weights = complexity(n)
        weight, nesting = weights.get(id(n), (0, 0)) if weights else (0, 0)
        if kinds is None or kind in kinds or weight:
            callee = left = right = arg = body = None
            for c in kids:
                role = c.role
                if role == "argument":
                    arg = arg or c
                elif role == "left" or role == "condition":
                    left = left or c
                elif role == "right" or role == "initializer":
                    right = right or c
                elif role == "body":
                    body = body or c
            recv = None
            if kids:
                if kind == "Invocation":
                    callee = kids[0]
                    recv = callee.children[0] if callee.kind in ("Member", "Binding") and callee.children else None
                elif kind in ("Member", "Binding", "Element"):
                    recv = kids[0]
            target = right if kind == "Assign" or kind == "Declarator" else arg
            value, start = n.value, n.start
            if value and kind in PLACED:
                start, value = int(value), None
            line, end_line = bisect_right(starts, start) - 1, bisect_right(starts, n.end) - 1
            order.append([
                file_id, me, parent, me, n.role or None, kind, parent_kind, n.name, n.op, value, n.type, n.arity,
                n.modifiers, line, start - starts[line], end_line, n.end - starts[end_line], shown(n) if kind in WRITTEN else None,
                *((None, None, None) if recv is None else (shown(recv), recv.kind, recv.name)),
                *((None, None, None) if left is None else (left.kind, left.name, left.value)),
                *((None, None, None) if right is None else (right.kind, right.name, right.value)),
                None if arg is None else arg.kind, None if body is None else len(body.children),
                method, block, member, type_node, is_async, loop, const, attribute, caught, weight, nesting, target is not None and is_dynamic(target), me,
            ])
        if not kids:
            continue
        if kind in CONTEXTS or n.modifiers:
            if kind == "Method":
                method, is_async = me, "async" in n.modifiers
            if kind in MEMBERS or kind == "Declarator" and parent_kind == "Field":
                member = me
            if kind == "Block":
                block = me
            if kind == "Type":
                type_node = me
            loop = loop or kind in LOOPS
            const = const or "const" in n.modifiers or kind == "Attribute"
            attribute = attribute or kind == "Attribute"
            if kind == "Catch":
                caught = n.name or ""
            context = (method, block, member, type_node, is_async, loop, const, attribute, caught, weights)
        if len(kids) == 1:
            stack.append((kids[0], me, kind, context))
        else:
            stack += [(c, me, kind, context) for c in reversed(kids)]
    lasts = list(range(len(parents)))
    for me in range(len(parents) - 1, 0, -1):
        if lasts[parents[me]] < lasts[me]:
            lasts[parents[me]] = lasts[me]
    for row in order:
        row[3] = lasts[row[1]]
    return map(tuple, order)


def sql_rows(file_id: int, text: str) -> Iterator[tuple]:
    items, error = tsql.parse(text)
    starts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]

    def place(offset: int) -> tuple[int, int]:
        line = bisect_right(starts, offset) - 1
        return line, offset - starts[line]

    if error is not None:
        yield (file_id, 0, "Error", None, None, None, 0, False, 0, [], *place(min(error.at, len(text))), *place(min(error.at + 1, len(text))), str(error))
    for i, x in enumerate(items):
        yield (file_id, i, x.kind, x.name, x.schema, x.op, x.hints, x.where, x.tables, x.columns, *place(x.start), *place(x.end), None)


def _table(files: DataFrame, make, schema: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """What ``make`` gives of each file; of its rows, in the order of ``schema``, only ``columns`` leave the task.

    Rows but for their first column, the file, go by the text alone: copies of a text that the task remembers are not parsed
    again. What is remembered is bounded by its rows, and rows of long files are not.
    """
    fields = [(k, *c.split()) for k, c in enumerate(schema.replace("\n", " ").split(","))]
    fields = [x for x in fields if columns is None or x[1] in columns]
    places, names, schema = [k for k, _, _ in fields], [name for _, name, _ in fields], ", ".join(f"{name} {kind}" for _, name, kind in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        held: list[tuple] = []
        seen: dict[str, list[tuple]] = {}
        remembered = 0

        def packed() -> pa.RecordBatch:
            whole = list(zip(*held, strict=True))
            whole[0] = ids
            return pa.RecordBatch.from_arrays([pa.array(whole[k], kind) for k, kind in zip(places, kinds.types, strict=True)], schema=kinds)

        with seldom_collected():
            for batch in batches:
                for i, t in zip(batch.column("file_id").to_pylist(), batch.column("text"), strict=True):
                    text = t.as_py() or ""
                    made = seen.get(text)
                    if made is None:
                        made = make(i, text)
                        if len(made) <= REMEMBERED // 20:
                            remembered += len(made) + 1
                            if remembered > REMEMBERED:
                                seen, remembered = {}, len(made) + 1
                            seen[text] = made
                    held += made
                    ids += [i] * len(made)
                    if len(held) >= GATHERED:
                        yield packed()
                        held, ids = [], []
            if held:
                yield packed()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return files.select(F.col("file_id").cast("long").alias("file_id"), "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Asked:
    """What a rule reads of the node table: rows of ``kinds`` (and, if it reads weights, those with one; None: all) and ``columns``."""

    kinds: tuple[str, ...] | None
    columns: tuple[str, ...]


def csharp_nodes(files: DataFrame, asked: Asked | None = None) -> DataFrame:
    """Nodes of the C# files (file_id, text). Every rule reads them: see ``tree_of``.

    A file that the parser gives up on has one row of kind ``Failed`` with the reason as its value. Whole files are parsed
    whatever is ``asked``; other rows and columns aren't sent out of the task.
    """
    width = len(NODES.split(","))
    made = rows if asked is None else partial(rows, kinds=None if asked.kinds is None else frozenset(asked.kinds), weighed="weight" in asked.columns)
    return _table(files, guarded(made, lambda i, why: (i, 0, None, 0, None, "Failed", None, None, None, why, *[None] * (width - 10))), NODES, asked and asked.columns)


def sql_items(files: DataFrame) -> DataFrame:
    return _table(files, guarded(sql_rows, lambda i, why: (i, 0, "Error", None, None, None, 0, False, 0, [], 0, 0, 0, 1, why)), SQL_ITEMS)


def tree_of(files: DataFrame, asked: Asked | None = None) -> DataFrame:
    """``csharp_nodes`` written once, in buckets by file and sorted by node: parsed in as many tasks as there are buckets."""
    n = buckets_of(files)
    return laid_out(csharp_nodes(by_file(files, n), asked), "node", buckets=n)


def items_of(files: DataFrame) -> DataFrame:
    """``sql_items`` written once in the same way."""
    n = buckets_of(files)
    return laid_out(sql_items(by_file(files, n)), "item", buckets=n)


def sql_layouts(files: DataFrame) -> DataFrame:
    """(file_id, formatted, changed, inline_comments) of the SQL files (file_id, text); a file that fails stays as it is."""

    def one(file_id: int, text: str) -> list[tuple]:
        out = tsql_format.formatted(text)
        return [(file_id, out, out != text, tsql_format.has_inline_comments(text))]

    return _table(files, guarded(one, lambda i, why: (i, None, False, False)), "file_id long, formatted string, changed boolean, inline_comments boolean")

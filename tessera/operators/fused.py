"""The rules of single files together: one scan of the node table, two windows, no exchange.

What ``code_rules`` joins, file by file, is told here by marks. A node gives a mark for each rule that asks about it and
for each fact that a rule needs of it. Marks carry the place where question and facts meet: a member, a parent, a block, a
name. A first window by (file, task, place) answers what lies at one place; what has to be looked up further, a name's
next use or the kind of the enclosing type, goes on to a second one. The table lies in buckets by file, so that both
windows sort within a task's buckets.

The findings are those of ``code_rules.all_plain`` but for rules across files (tested on all cases); repeated ones may
come once or more.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import code_rules as code
from tessera.parse.nodes import Asked

#: Rules that ``findings`` answers: those of one node, and those that look around in a file.
SINGLE = "ACME0001 AR0010 AR0011 AR0013 AR0015 AR0022 AR0050 AR0051 AR0054 AR0072 AR0073 SVC0001 SVC0002 SVC0003 SVC0010"
RULES = tuple(f"{SINGLE} AR0012 AR0014 AR0020 AR0021 AR0052 AR0053 AR0060 AR0061 AR0070 AR0071 AR0074 AR0075 AR0090 SVC0020".split())
NEXT_USE = ("AR0070", "AR0071")
MARK = dict(rule="string", task="string", k="int", s="string", role="string", at="int", last="int", message="string", name="string", n="int", flag="boolean")

#: What the rules read: rows of all kinds, as the body of a member may be any expression.
READS = Asked(None, tuple("""file_id node parent last role kind parent_kind name op value type arity modifiers start_line start_col receiver receiver_kind receiver_name left_kind left_name
 right_kind right_name right_value n_statements method block type_node in_async in_loop in_const in_attribute catch_name weight nesting dynamic""".split()))  # fmt: skip

c, L = F.col, F.lit


#: Kinds of the nodes that the predicates of ``code_rules`` can hold for.
KINDS = {
    "AR0010": "Member Binding Invocation", "AR0011": "Invocation", "AR0013": "Catch", "AR0015": "Invocation", "AR0022": "Invocation", "AR0050": "Declarator Assign", "AR0051": "New Invocation", "AR0054": "Assign New Invocation",
    "AR0072": "Binary If Conditional", "AR0073": "Invocation", "ACME0001": "New", "SVC0001": "Member", "SVC0002": "Member", "SVC0003": "Invocation", "SVC0010": "Declarator Assign",
}


@dataclass(frozen=True)
class Mark:
    """What nodes of some ``kinds`` (any, if empty) say for some ``rules``: a struct of the columns of ``MARK``, or null."""

    rules: frozenset[str]
    kinds: frozenset[str]
    cells: Column


def mark(rules: str, task: str, kinds: str, when: Column, role: str = "ask", **values: Column) -> Mark:
    values = {"at": c("node"), "task": L(task), "role": L(role), "rule": L(rules if role == "ask" else None)} | values
    cells = (values.get(x, L(None)).cast(kind).alias(x) for x, kind in MARK.items())
    return Mark(frozenset(rules.split()), frozenset(kinds.split()), F.when(F.coalesce(when, L(False)), F.struct(*cells)))


def said(*parts: Column | str) -> Column:
    return F.concat(*(L(p) if isinstance(p, str) else p for p in parts))


def at_members() -> list[Mark]:
    """What meets at a method or another member with parameters and a body."""
    name, always = c("name"), L(True)
    parameter = c("role") == "parameter"
    fixed = F.arrays_overlap("modifiers", F.array(L("override"), L("virtual"), L("abstract")))
    attribute = F.regexp_replace(code.last_name(name), "Attribute$", "")
    waits = ~name.endswith("Async") & (name != "Main") & ~F.array_contains("modifiers", "override")
    return [
        mark("AR0012", "member", "Method", F.array_contains("modifiers", "async") & (c("type") == "void"), k=c("node"), message=said("async void '", name, "'")),
        mark("SVC0020", "member", "Method", waits, k=c("node"), n=c("type_node"), message=said("'", name, "' awaits and isn't named Async")),
        mark("AR0060", "member", "Method", always, k=c("node"), message=said("'", name, "' has cognitive complexity ")),
        mark("AR0070", "member", "Parameter", parameter & ~name.startswith("_"), k=c("parent"), name=name, message=said("parameter '", name, "' is not used")),
        mark("AR0012 AR0070 SVC0020", "member", "Parameter", parameter, "parameter", k=c("parent"), flag=code.simple(c("type")).endswith("EventArgs")),
        mark("AR0070", "member", "Method Constructor LocalFunction", ~fixed & F.coalesce(c("op") != "explicit", always), "owner", k=c("node")),
        mark("AR0070", "member", "", c("role").isin("body", "arrow") & c("parent_kind").isin("Method", "Constructor", "LocalFunction"), "body", k=c("parent"), last=c("last")),
        mark("SVC0020", "member", "Await", c("method").isNotNull(), "await", k=c("method")),
        mark("SVC0020", "member", "Attribute", attribute.isin(*code.ENTRY_ATTRIBUTES) | attribute.startswith("Http"), "entry", k=c("parent")),
        mark("AR0060", "member", "", (c("weight") > 0) & c("method").isNotNull(), "weight", k=c("method"), n=c("weight") + c("nesting")),
    ]


def at_parents() -> list[Mark]:
    """What a node and its parent tell together."""
    kind, name, always = c("kind"), c("name"), L(True)
    regex = F.when(kind == "New", code.simple(c("type")) == "Regex").otherwise(name.isin(*code.REGEX_CALLS) & (code.last_name(c("receiver")) == "Regex"))
    bare = F.regexp_replace(F.regexp_replace(c("value"), r"\\.", "x"), r"\[\^?\]?[^\]]*\]", "x")
    open_field = F.array_contains("modifiers", "public") & ~F.arrays_overlap("modifiers", F.array(L("readonly"), L("const")))
    return [
        mark("AR0014", "throw", "Throw", c("catch_name") != "", k=c("node"), message=L("throw loses the stack")),
        mark("AR0014", "throw", "Ident", (c("role") == "value") & (name == c("catch_name")), "caught", k=c("parent")),
        mark("AR0020", "count", "Binary", c("op").isin("==", ">", "!=", ">="), k=c("node"), name=F.when(c("op") == ">=", "1").otherwise("0"), message=L("counts to test for emptiness")),
        mark("AR0020", "count", "Invocation", code.call("Count", 0) & c("receiver").isNotNull(), "counted", k=c("parent")),
        mark("AR0020", "count", "Number", always, "number", k=c("parent"), name=c("value")),
        mark("AR0052", "random", "New", (code.simple(c("type")) == "Random") & (c("role") == "initializer"), k=c("parent")),
        mark("AR0052", "random", "Declarator", code.any_of(name, code.RANDOM_SECRETS), "secret", k=c("node"), name=name),
        mark("AR0053", "regex", "String", (c("role") == "argument") & bare.rlike(code.NESTED_QUANTIFIER), k=c("parent"), message=L("expression may backtrack without bound")),
        mark("AR0053", "regex", "New Invocation", regex, "regex", k=c("node")),
        mark("AR0075", "field", "Declarator", c("parent_kind") == "Field", k=c("parent"), message=said("public field '", name, "'")),
        mark("AR0075", "field", "Field", open_field, "field", k=c("node"), n=c("parent")),
        mark("AR0075 SVC0020", "type", "Type", always, "type", k=c("node"), name=c("op")),
    ]


def in_blocks() -> list[Mark]:
    """Locals: a declaration precedes its declarators in its block, and what one is made of follows it."""
    name = c("name")
    local, inside = dict(k=c("block"), last=c("last"), name=name, n=c("parent")), c("parent_kind") == "LocalDeclaration"
    plain = ~F.arrays_overlap("modifiers", F.array(L("using"), L("const")))
    made = code.simple(c("type")).isin(*code.DISPOSABLE) & (c("role") == "initializer")
    return [
        mark("AR0071", "block", "Declarator", inside & ~name.startswith("_"), **local, message=said("local '", name, "' is not used")),
        mark("AR0074", "block", "Declarator", inside, **local, message=said("'", name, "' is never disposed")),
        mark("AR0071 AR0074", "block", "LocalDeclaration", L(True), "declaration", k=c("block"), flag=plain),
        mark("AR0071 AR0074", "block", "Block", L(True), "block", k=c("node"), last=c("last")),
        mark("AR0074", "block", "New", made, "made", k=c("block"), n=c("parent")),
    ]


def at_names(length: int) -> list[Mark]:
    """Uses and types of names, and literals by their value."""
    kind, name = c("kind"), c("name")
    turn = F.when(kind == "Parameter", 0).when(kind == "Property", 3).when(c("parent_kind") == "Field", 1).otherwise(2)
    cased = name.isin("ToUpper", "ToLower") & (c("arity") == 0)
    handed = c("role").isin("argument", "right", "value", "resource", "initializer", "element", "arrow") | (c("parent_kind") == "UsingStatement") | ((c("parent_kind") == "ExpressionStatement") & (c("role") == "expression"))
    return [
        mark("AR0021", "declared", "Assign", (c("op") == "+=") & c("in_loop") & (c("left_kind") == "Ident"), s=c("left_name"), message=said("adds to string '", c("left_name"), "' in a loop")),
        mark("AR0090", "found", "Invocation", cased & (c("receiver_kind") == "String"), message=said(name, " depends on the culture")),
        mark("AR0090", "declared", "Invocation", cased & (c("receiver_kind") == "Ident"), s=c("receiver_name"), message=said(name, " depends on the culture")),
        mark("AR0021 AR0090", "declared", "Parameter Declarator Property", name.isNotNull() & c("type").isNotNull() & (c("type") != "var"), "declared", s=name, n=turn, name=c("type")),
        mark("AR0061", "literal", "String", (F.length("value") >= length) & ~c("in_const"), s=c("value"), message=said("literal repeats: '", c("value"), "'")),
        mark("AR0070 AR0071", "use", "Ident", L(True), "use", s=name),
        mark("AR0074", "disposed", "Ident", handed, "use", s=name),
        mark("AR0074", "disposed", "Invocation", name.isin("Dispose", "DisposeAsync", "Close"), "use", s=c("receiver_name")),
    ]


def marks(nodes: DataFrame, rules: set[str], hosts: Iterable[str], length: int) -> DataFrame:
    """One scan: file_id, line, col and the columns of ``MARK``. A node is asked for what its kind can tell alone."""
    single = [mark(rule, "found", KINDS[rule], met, message=message) for rule, met, message in code.predicates(tuple(hosts))]
    asked = [m for m in (*single, *at_members(), *at_parents(), *in_blocks(), *at_names(length)) if m.rules & rules]
    told = lambda kind: F.array(*(m.cells for m in asked if not m.kinds or kind in m.kinds))
    anywhere = any(not m.kinds for m in asked)
    kinds = sorted(set().union(*(m.kinds for m in asked)))
    by_kind = F.when(c("kind") == kinds[0], told(kinds[0]))
    for kind in kinds[1:]:
        by_kind = by_kind.when(c("kind") == kind, told(kind))
    if anywhere:
        by_kind = by_kind.otherwise(told(None))
    # a column of its own before it is exploded: inside a generator the conditions would be interpreted, node by node
    told_by = nodes.select("file_id", c("start_line").alias("line"), c("start_col").alias("col"), by_kind.alias("_marks"))
    return told_by.select("file_id", "line", "col", F.explode("_marks").alias("m")).where("m is not null").select("file_id", "line", "col", "m.*")


def findings(nodes: DataFrame, rules: Iterable[str] = RULES, hosts: Iterable[str] = (), threshold: int = 15, length: int = 10, occurrences: int = 3) -> DataFrame:
    """(file_id, rule_id, message, line, col) of those of ``rules`` that are in ``RULES``."""
    asked = set(rules) & set(RULES)
    if not asked:
        return code.found(nodes.where(L(False)), "", "")
    place = Window.partitionBy("file_id", "task", "k", "s").orderBy("at")
    whole, so_far = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_a = lambda role: c("role") == role
    has = lambda *roles: F.coalesce(F.max(c("role").isin(*roles)).over(whole), L(False))
    the = lambda role, *values: F.max(F.when(is_a(role), F.struct(*values))).over(whole)
    met = marks(nodes, asked, hosts, length).withColumns({
        "_fact": has("owner", "caught", "counted", "regex"), "_await": has("await"), "_entry": has("entry"),
        "_n": F.count(F.when(c("role").isin("parameter") | (c("task") == "literal"), 1)).over(whole), "_nth": F.row_number().over(place),
        "_second": the("parameter", "at", "flag"), "_body": the("body", "at", "last"), "_type": the("declared", "n", "at", "name"), "_field": the("field", "n"), "_secret": the("secret", "name"), "_number": the("number", "name"),
        "_block": the("block", "last"), "_score": F.sum(F.when(is_a("weight"), c("n"))).over(whole),
        "_declaration": F.last(F.when(is_a("declaration"), F.struct("at", "flag")), ignorenulls=True).over(so_far),
        "_made": F.expr("lead(CASE WHEN role = 'made' THEN n END, 1) IGNORE NULLS OVER (PARTITION BY file_id, task, k, s ORDER BY at)"),
    })
    shaped = (c("_n") == 2) & F.coalesce(c("_second.flag"), L(False))
    local = (c("_declaration.at") == c("n")) & c("_declaration.flag") & c("_block.last").isNotNull()
    holds = {
        "AR0012": ~shaped, "AR0014": c("_fact"), "AR0020": c("_fact") & (c("_number.name") == c("name")), "AR0053": c("_fact"), "AR0060": c("_score") > threshold,
        "AR0061": (c("_n") >= occurrences) & (c("_nth") > 1), "AR0070": c("_fact") & ~shaped & c("_body").isNotNull(), "AR0071": local, "AR0074": local & (c("_made") == c("at")), "AR0075": c("_field").isNotNull(),
        "SVC0020": c("_await") & ~c("_entry") & ~shaped,
    }
    rule, ask = c("rule"), is_a("ask")
    by_task = F.when(c("task") == "found", L(True)).when(c("task") == "declared", c("_type.name") == "string").when(c("task") == "random", c("_secret").isNotNull())
    for r, condition in holds.items():
        by_task = by_task.when(rule == r, condition)
    met = met.where(F.when(ask, by_task).otherwise(is_a("use") | is_a("type")))
    until = F.when(rule == "AR0070", c("_body.last")).when(rule.isin("AR0071", "AR0074"), c("_block.last"))
    onward = met.select(
        "file_id", "line", "col", "rule", "role",
        F.when(rule == "AR0060", said(c("message"), c("_score").cast("string"))).when(c("task") == "random", said("'", c("_secret.name"), "' from Random")).otherwise(c("message")).alias("message"),
        F.when(rule.isin(*NEXT_USE), "use").when(rule == "AR0074", "disposed").when(rule.isin("AR0075", "SVC0020"), "type").otherwise(c("task")).alias("task"),
        F.when(rule == "AR0075", c("_field.n")).when(rule == "SVC0020", c("n")).when(is_a("type"), c("k")).alias("k"),
        F.when(rule.isin(*NEXT_USE, "AR0074"), c("name")).when(is_a("use"), c("s")).alias("s"),
        F.when(rule == "AR0070", c("_body.at")).when(rule.isin("AR0071", "AR0074"), c("last") + 1).otherwise(c("at")).alias("at"),
        F.when(is_a("use"), c("at")).alias("use"), until.alias("until"), F.when(is_a("type"), c("name")).alias("type"),
    )
    later = Window.partitionBy("file_id", "task", "k", "s").orderBy(c("at").desc(), c("use").desc_nulls_last())
    all_of = later.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = onward.withColumns({"_next": F.last("use", ignorenulls=True).over(later.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_kind": F.max("type").over(all_of)})
    stays = F.when(c("until").isNotNull(), F.coalesce(c("_next") > c("until"), L(True))).when(rule == "AR0075", c("_kind") == "class").when(rule == "SVC0020", F.coalesce(c("_kind") != "interface", L(True))).otherwise(L(True))
    return last.where(ask & stays).select("file_id", rule.alias("rule_id"), "message", "line", "col")

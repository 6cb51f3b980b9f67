"""Detection rules as queries over syntax nodes (``tessera.parse.nodes``). Each gives (file_id, rule_id, message, line, col).

Rules that look at one node are rows of a table of predicates and run in one scan. The rest are joins on (file_id, id),
with ranges of pre-order numbers as a residual condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.parse.nodes import Asked
from tessera.sources.files import longest_prefix, with_prefixes

# Names that the rules know.
CREDENTIALS = "password passwd pwd secret apikey api_key accesskey access_key clientsecret client_secret privatekey private_key".split()
RANDOM_SECRETS = "token password secret otp nonce salt sessionid session_id apikey api_key".split()
WEAK_TYPES = "MD5CryptoServiceProvider SHA1CryptoServiceProvider DESCryptoServiceProvider TripleDESCryptoServiceProvider RC2CryptoServiceProvider RijndaelManaged".split()
WEAK_FACTORIES = "MD5 SHA1 DES TripleDES RC2".split()
COMMANDS = "SqlCommand OdbcCommand OleDbCommand NpgsqlCommand MySqlCommand SqliteCommand".split()
RAW_SQL = "ExecuteSqlRaw ExecuteSqlRawAsync FromSqlRaw SqlQueryRaw".split()
DEFERRED = "Where Select SelectMany Any All First FirstOrDefault Single SingleOrDefault OrderBy OrderByDescending ThenBy GroupBy Skip Take Count Sum Min Max Average Distinct Reverse Contains ToDictionary".split()
DISPOSABLE = "SqlConnection SqlCommand SqlDataReader SqlDataAdapter OdbcConnection OleDbConnection NpgsqlConnection MySqlConnection SqliteConnection FileStream StreamReader StreamWriter BinaryReader BinaryWriter Mutex Semaphore SemaphoreSlim Timer Socket TcpClient".split()
FRAMEWORK = "ILogger IOptions IOptionsSnapshot IOptionsMonitor IConfiguration IServiceProvider IHttpContextAccessor".split()
CONFIGURATION = "IConfiguration IConfigurationRoot IConfigurationSection".split()
REGEX_CALLS = "IsMatch Match Matches Replace Split".split()
ALLOWED_HOSTS = "w3.org www.w3.org schemas.microsoft.com schemas.xmlsoap.org tempuri.org localhost 127.0.0.1 0.0.0.0 ::1".split()
ENTRY_ATTRIBUTES = "Test TestCase Theory Fact".split()
LIFETIMES = {"AddSingleton": 3, "AddScoped": 2, "AddTransient": 1}
EXEMPT_ENDINGS = "(Pattern|Template|Format|Scheme)$"

#: A quantified group that holds a quantified atom, one level deep, once escapes and character classes are single letters.
NESTED_QUANTIFIER = r"\([^()]*[^()|?](?:[*+]|\{[0-9]+,[0-9]*\})[^()]*\)(?:[*+]|\{[0-9]+,[0-9]*\})"


def c(name: str) -> Column:
    return F.col(name)


def simple(kind: Column) -> Column:
    """The last name of a type without its arguments, question mark or qualification."""
    bare = F.regexp_replace(F.regexp_replace(kind, r"<.*$", ""), r"[?\s]+", "")
    return F.regexp_extract(bare, r"([^.:]+)$", 1)


def last_name(text: Column) -> Column:
    return F.regexp_extract(text, r"([A-Za-z_]\w*)$", 1)


def any_of(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike("|".join(words))


def found(rows: DataFrame, rule_id: str, message: Column | str) -> DataFrame:
    said = F.lit(message) if isinstance(message, str) else message
    return rows.select("file_id", F.lit(rule_id).alias("rule_id"), said.alias("message"), F.col("start_line").alias("line"), F.col("start_col").alias("col"))


def call(name: str, arity: int | None = None) -> Column:
    out = (c("kind") == "Invocation") & (c("name") == name)
    return out if arity is None else out & (c("arity") == arity)


def task_like() -> Column:
    return ((c("receiver_kind") == "Invocation") & c("receiver_name").endswith("Async")) | (c("receiver_kind").isin("Ident", "Member") & c("receiver_name").rlike("[Tt]ask$"))


def endpoint(value: Column) -> Column:
    """The host of a URL, UNC path or IPv4 address, or null."""
    url = F.regexp_extract(value, r"(?i)^https?://\[?([^/:\]?#]*)", 1)
    unc = F.regexp_extract(value, r"^\\\\([^\\]+)", 1)
    ip = F.when(value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & (F.array_max(F.transform(F.split(value, r"\."), lambda x: F.try_to_number(x, F.lit("999")))) <= 255), value)
    return F.coalesce(F.nullif(url, F.lit("")), F.nullif(unc, F.lit("")), ip)


def predicates(hosts: tuple[str, ...] = ()) -> list[tuple[str, Column, Column]]:
    """(rule, condition on a node, message); ``hosts``: further ones that may stand in code."""
    at = lambda *k: c("kind").isin(*k)
    say = F.lit
    literal = (c("right_kind") == "String") & (F.length("right_value") > 0)
    named = F.coalesce(c("left_name"), F.when(at("Declarator"), c("name")))
    sets = at("Declarator") | (at("Assign") & (c("op") == "="))
    host = endpoint(c("right_value"))
    wait = F.when(c("name").isin("Wait", "WaitAll") & (c("arity") == 0), True) | ((c("name") == "GetResult") & (c("arity") == 0) & (c("receiver_kind") == "Invocation") & (c("receiver_name") == "GetAwaiter"))
    return [
        ("AR0010", at("Member", "Binding") & (c("name") == "Result") & ~((c("parent_kind") == "Invocation") & (c("role") == "callee")) & (task_like() | c("in_async")), say("blocks on a task with .Result")),
        ("AR0010", at("Invocation") & F.coalesce(wait, F.lit(False)) & (task_like() | (c("name") == "GetResult") | c("in_async")), say("blocks on a task")),
        ("AR0011", at("Invocation") & c("name").endswith("Async") & (c("parent_kind") == "ExpressionStatement"), F.concat(say("task of '"), c("name"), say("' is discarded"))),
        ("AR0013", at("Catch") & (F.coalesce(c("n_statements"), F.lit(0)) == 0), say("catch block is empty")),
        ("AR0015", call("Sleep") & (last_name(c("receiver")) == "Thread") & c("in_async"), say("Thread.Sleep in an async method")),
        ("AR0022", at("Invocation") & c("name").isin(*DEFERRED) & (c("receiver_kind") == "Invocation") & c("receiver_name").isin("ToList", "ToArray") & c("receiver").rlike(r"\(\s*\)$"), F.concat(say("materialises before '"), c("name"), say("'"))),
        ("AR0050", sets & literal & any_of(named, CREDENTIALS), F.concat(say("credential in source: '"), named, say("'"))),
        ("AR0051", at("New") & simple(c("type")).isin(*WEAK_TYPES), F.concat(say("weak algorithm "), simple(c("type")))),
        ("AR0051", call("Create") & last_name(c("receiver")).isin(*WEAK_FACTORIES), F.concat(say("weak algorithm "), last_name(c("receiver")))),
        ("AR0054", at("Assign") & (c("left_name") == "CommandText") & c("left_kind").isin("Member", "Binding") & c("dynamic"), say("command text is put together at run time")),
        ("AR0054", ((at("New") & simple(c("type")).isin(*COMMANDS)) | (at("Invocation") & c("name").isin(*RAW_SQL))) & c("dynamic"), say("SQL is put together at run time")),
        ("AR0072", at("Binary") & (c("op") == "==") & (c("left_kind") == "Ident") & (c("right_kind") == "Ident") & (c("left_name") == c("right_name")), say("compares a value with itself")),
        ("AR0072", at("If", "Conditional") & c("left_kind").isin("True", "False"), say("condition is constant")),
        ("AR0073", at("Invocation") & c("name").isin("Write", "WriteLine") & c("receiver").rlike(r"(^|\.)Console(\.(Error|Out))?$"), say("writes to the console")),
        ("ACME0001", at("New") & (c("type") == "HttpClient"), say("creates an HttpClient")),
        ("SVC0001", at("Member") & c("name").isin("Now", "Today") & ((last_name(c("receiver")) == "DateTime") | ((last_name(c("receiver")) == "DateTimeOffset") & (c("name") == "Now"))), say("reads the local clock")),
        ("SVC0002", at("Member") & c("name").isin("CurrentCulture", "CurrentUICulture") & (last_name(c("receiver")) == "CultureInfo"), say("reads the ambient culture")),
        ("SVC0003", call("GetCurrentDirectory") & (last_name(c("receiver")) == "Directory"), say("reads the working directory")),
        ("SVC0010", sets & literal & ~c("in_attribute") & ~named.rlike(EXEMPT_ENDINGS) & host.isNotNull() & ~F.lower(host).isin(*ALLOWED_HOSTS, *(h.lower() for h in hosts)), F.concat(say("endpoint in source: '"), c("right_value"), say("'"))),
    ]


def single_node(nodes: DataFrame, hosts: tuple[str, ...] = (), rule: str | None = None) -> DataFrame:
    """All rules of ``predicates``, or one of them, in one scan."""
    met = F.array_compact(F.array(*(F.when(F.coalesce(p, F.lit(False)), F.struct(F.lit(r).alias("rule_id"), m.alias("message"))) for r, p, m in predicates(hosts) if rule in (None, r))))
    return nodes.select("file_id", F.explode(met).alias("x"), F.col("start_line").alias("line"), F.col("start_col").alias("col")).select("file_id", "x.rule_id", "x.message", "line", "col")


def of(nodes: DataFrame, prefix: str, *columns: str) -> DataFrame:
    """The side of a join on (file_id, ...). Both sides lie in the same buckets and are merged there: by the size of its
    files a side may look small enough to be broadcast, but it grows with the input.
    """
    return nodes.select(F.col("file_id").alias(f"{prefix}_file"), *(F.col(x).alias(f"{prefix}_{x}") for x in columns)).hint("merge")


def parameters(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'Parameter' and role = 'parameter'")


def event_shaped(nodes: DataFrame) -> DataFrame:
    """(e_file, e_parent): members of two parameters, the second of which is of an EventArgs type."""
    nth = F.row_number().over(Window.partitionBy("file_id", "parent").orderBy("node"))
    n = F.count("*").over(Window.partitionBy("file_id", "parent"))
    p = parameters(nodes).withColumns({"_nth": nth, "_n": n}).where((F.col("_n") == 2) & (F.col("_nth") == 2) & simple(F.col("type")).endswith("EventArgs"))
    return of(p, "e", "parent")


def async_void(nodes: DataFrame) -> DataFrame:
    m = nodes.where((c("kind") == "Method") & F.array_contains("modifiers", "async") & (c("type") == "void"))
    return found(m.join(event_shaped(nodes), (c("file_id") == c("e_file")) & (c("node") == c("e_parent")), "left_anti"), "AR0012", F.concat(F.lit("async void '"), c("name"), F.lit("'")))


def rethrow(nodes: DataFrame) -> DataFrame:
    value = of(nodes.where("role = 'value' and kind = 'Ident'"), "v", "parent", "name")
    t = nodes.where("kind = 'Throw' and catch_name <> ''")
    return found(t.join(value, (c("file_id") == c("v_file")) & (c("node") == c("v_parent")) & (c("catch_name") == c("v_name"))), "AR0014", "throw loses the stack")


def count_compared(nodes: DataFrame) -> DataFrame:
    number = of(nodes.where("kind = 'Number'"), "k", "parent", "value")
    counted = of(nodes.where(call("Count", 0) & c("receiver").isNotNull()), "i", "parent")
    b = nodes.where("kind = 'Binary' and op in ('==', '>', '!=', '>=')")
    both = b.join(counted, (c("file_id") == c("i_file")) & (c("node") == c("i_parent"))).join(number, (c("file_id") == c("k_file")) & (c("node") == c("k_parent")))
    tests = (c("op").isin("==", ">", "!=") & (c("k_value") == "0")) | ((c("op") == ">=") & (c("k_value") == "1"))
    return found(both.where(tests), "AR0020", "counts to test for emptiness")


def declared_types(nodes: DataFrame) -> DataFrame:
    """(d_file, d_name, d_type): what a name is declared as in its file; the last of parameters, fields, locals, properties holds."""
    turn = F.when(c("kind") == "Parameter", 0).when((c("kind") == "Declarator") & (c("parent_kind") == "Field"), 1).when(c("kind") == "Declarator", 2).when(c("kind") == "Property", 3)
    rows = nodes.where(turn.isNotNull() & c("name").isNotNull() & c("type").isNotNull() & (c("type") != "var"))
    return rows.groupBy(F.col("file_id").alias("d_file"), F.col("name").alias("d_name")).agg(F.max_by("type", F.struct(turn, "node")).alias("d_type")).hint("merge")


def concat_in_loop(nodes: DataFrame) -> DataFrame:
    a = nodes.where("kind = 'Assign' and op = '+=' and in_loop and left_kind = 'Ident'")
    return found(a.join(declared_types(nodes).where("d_type = 'string'"), (c("file_id") == c("d_file")) & (c("left_name") == c("d_name"))), "AR0021", F.concat(F.lit("adds to string '"), c("left_name"), F.lit("' in a loop")))


def culture_case(nodes: DataFrame) -> DataFrame:
    calls = nodes.where(c("name").isin("ToUpper", "ToLower") & (c("kind") == "Invocation") & (c("arity") == 0))
    text = declared_types(nodes).where("d_type = 'string'")
    named = calls.where("receiver_kind = 'Ident'").join(text, (c("file_id") == c("d_file")) & (c("receiver_name") == c("d_name")), "left_semi")
    return found(calls.where("receiver_kind = 'String'").unionByName(named), "AR0090", F.concat(c("name"), F.lit(" depends on the culture")))


def weak_random(nodes: DataFrame) -> DataFrame:
    d = of(nodes.where((c("kind") == "Declarator") & any_of(c("name"), RANDOM_SECRETS)), "d", "node", "name")
    r = nodes.where((c("kind") == "New") & (simple(c("type")) == "Random") & (c("role") == "initializer"))
    return found(r.join(d, (c("file_id") == c("d_file")) & (c("parent") == c("d_node"))), "AR0052", F.concat(F.lit("'"), c("d_name"), F.lit("' from Random")))


def nested_quantifiers(nodes: DataFrame) -> DataFrame:
    calls = nodes.where(((c("kind") == "Invocation") & c("name").isin(*REGEX_CALLS) & (last_name(c("receiver")) == "Regex")) | ((c("kind") == "New") & (simple(c("type")) == "Regex")))
    bare = F.regexp_replace(F.regexp_replace(c("value"), r"\\.", "x"), r"\[\^?\]?[^\]]*\]", "x")
    text = nodes.where((c("kind") == "String") & (c("role") == "argument") & bare.rlike(NESTED_QUANTIFIER))
    return found(text.join(of(calls, "k", "node"), (c("file_id") == c("k_file")) & (c("parent") == c("k_node")), "left_semi"), "AR0053", "expression may backtrack without bound")


def complexity(nodes: DataFrame) -> DataFrame:
    """(file_id, method, score): the cognitive complexity of each method."""
    return nodes.where("weight > 0 and method is not null").groupBy("file_id", "method").agg(F.sum(F.col("weight") + F.col("nesting")).alias("score"))


def too_complex(nodes: DataFrame, threshold: int = 15) -> DataFrame:
    over = of(complexity(nodes).where(F.col("score") > threshold), "s", "method", "score")
    m = nodes.where("kind = 'Method'").join(over, (c("file_id") == c("s_file")) & (c("node") == c("s_method")))
    return found(m, "AR0060", F.concat(F.lit("'"), c("name"), F.lit("' has cognitive complexity "), c("s_score")))


def duplicate_literals(nodes: DataFrame, least_length: int = 10, least: int = 3) -> DataFrame:
    same = Window.partitionBy("file_id", "value")
    s = nodes.where((c("kind") == "String") & (F.length("value") >= least_length) & ~c("in_const")).withColumns({"_n": F.count("*").over(same), "_k": F.row_number().over(same.orderBy("node"))})
    return found(s.where((F.col("_n") >= least) & (F.col("_k") > 1)), "AR0061", F.concat(F.lit("literal repeats: '"), c("value"), F.lit("'")))


def next_use(events: DataFrame) -> DataFrame:
    """``events`` (file_id, name, at, use, ...) with ``next``: for each row the place of the next use of its name.

    A use has its own place as ``at`` and ``use``; other rows have null as ``use``, and as ``at`` the first place that counts
    for them. One sort by file, name and place, and a running window: however often a name occurs, a row stays a row.
    """
    later = Window.partitionBy("file_id", "name").orderBy(F.col("at").desc(), F.col("use").desc_nulls_last())
    return events.withColumn("next", F.last("use", ignorenulls=True).over(later.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def unused(events: DataFrame) -> DataFrame:
    """Rows of ``events`` that ask (``until`` is not null) and have no use from ``at`` to ``until``."""
    return next_use(events).where(c("until").isNotNull() & F.coalesce(c("next") > c("until"), F.lit(True)))


def unused_parameters(nodes: DataFrame) -> DataFrame:
    owner = of(nodes.where("kind in ('Method', 'Constructor', 'LocalFunction')"), "o", "node", "modifiers", "op")
    owner = owner.where(~F.arrays_overlap("o_modifiers", F.array(F.lit("override"), F.lit("virtual"), F.lit("abstract"))) & F.coalesce(c("o_op") != "explicit", F.lit(True)))
    body = of(nodes.where("role in ('body', 'arrow') and parent_kind in ('Method', 'Constructor', 'LocalFunction')"), "b", "parent", "node", "last")
    owner = owner.join(event_shaped(nodes), (c("o_file") == c("e_file")) & (c("o_node") == c("e_parent")), "left_anti")
    inside = owner.join(body, (c("o_file") == c("b_file")) & (c("o_node") == c("b_parent"))).select("b_file", "b_parent", "b_node", "b_last")
    asks = (c("kind") == "Parameter") & (c("role") == "parameter") & ~c("name").startswith("_")
    rows = nodes.where((c("kind") == "Ident") | asks).select("file_id", "node", "kind", "role", "name", "start_line", "start_col", F.when(asks, c("parent")).alias("asks"))
    met = rows.join(inside, (c("file_id") == c("b_file")) & (c("asks") == c("b_parent")), "left").where((c("kind") == "Ident") | c("b_node").isNotNull())
    use = F.when(c("kind") == "Ident", c("node"))
    events = met.select("file_id", "name", "start_line", "start_col", F.coalesce(use, "b_node").alias("at"), use.alias("use"), c("b_last").alias("until"))
    return found(unused(events), "AR0070", F.concat(F.lit("parameter '"), c("name"), F.lit("' is not used")))


def locals_and(nodes: DataFrame, asks: Column, use: Column, name: Column) -> DataFrame:
    """Events of the declarators ``asks`` of locals that are neither using nor const, and of the nodes ``use`` under ``name``."""
    owner = of(nodes.where("kind = 'LocalDeclaration'").where(~F.arrays_overlap("modifiers", F.array(F.lit("using"), F.lit("const")))), "l", "node")
    block = of(nodes.where("kind = 'Block'"), "b", "node", "last")
    asks, use = F.coalesce((c("kind") == "Declarator") & asks, F.lit(False)), F.coalesce(use, F.lit(False))
    rows = nodes.where(asks | use).select(
        "file_id", "node", "last", name.alias("name"), "start_line", "start_col", use.alias("uses"), F.when(asks, c("parent")).alias("declares"), F.when(asks, c("block")).alias("inside")
    )
    met = rows.join(owner, (c("file_id") == c("l_file")) & (c("declares") == c("l_node")), "left")
    met = met.join(block, (c("file_id") == c("b_file")) & (c("inside") == c("b_node")), "left")
    until = F.when(c("l_node").isNotNull(), c("b_last"))
    at = F.when(c("uses"), c("node")).otherwise(c("last") + 1)
    return met.select("file_id", "node", "name", "start_line", "start_col", at.alias("at"), F.when(c("uses"), c("node")).alias("use"), until.alias("until"))


def unused_locals(nodes: DataFrame) -> DataFrame:
    events = locals_and(nodes, ~c("name").startswith("_"), c("kind") == "Ident", c("name"))
    return found(unused(events), "AR0071", F.concat(F.lit("local '"), c("name"), F.lit("' is not used")))


def undisposed(nodes: DataFrame) -> DataFrame:
    made = of(nodes.where((c("kind") == "New") & simple(c("type")).isin(*DISPOSABLE) & (c("role") == "initializer")), "m", "parent")
    ident = (c("kind") == "Ident") & (c("role").isin("argument", "right", "value", "resource", "initializer", "element", "arrow") | (c("parent_kind") == "UsingStatement"))
    within_using = (c("kind") == "Ident") & (c("parent_kind") == "ExpressionStatement") & (c("role") == "expression")
    disposed = c("name").isin("Dispose", "DisposeAsync", "Close") & (c("kind") == "Invocation")
    events = locals_and(nodes, F.lit(True), ident | within_using | disposed, F.when(disposed, c("receiver_name")).otherwise(c("name")))
    d = unused(events).join(made, (c("file_id") == c("m_file")) & (c("node") == c("m_parent")), "left_semi")
    return found(d, "AR0074", F.concat(F.lit("'"), c("name"), F.lit("' is never disposed")))


def public_fields(nodes: DataFrame) -> DataFrame:
    f = of(nodes.where((c("kind") == "Field") & F.array_contains("modifiers", "public") & ~F.arrays_overlap("modifiers", F.array(F.lit("readonly"), F.lit("const")))), "f", "node", "parent")
    t = of(nodes.where("kind = 'Type' and op = 'class'"), "t", "node")
    d = nodes.where("kind = 'Declarator'").join(f, (c("file_id") == c("f_file")) & (c("parent") == c("f_node"))).join(t, (c("file_id") == c("t_file")) & (c("f_parent") == c("t_node")), "left_semi")
    return found(d, "AR0075", F.concat(F.lit("public field '"), c("name"), F.lit("'")))


def async_names(nodes: DataFrame) -> DataFrame:
    waits = of(nodes.where("kind = 'Await'"), "w", "method").distinct()
    m = nodes.where((c("kind") == "Method") & ~c("name").endswith("Async") & (c("name") != "Main") & ~F.array_contains("modifiers", "override"))
    m = m.join(waits, (c("file_id") == c("w_file")) & (c("node") == c("w_method")), "left_semi").join(event_shaped(nodes), (c("file_id") == c("e_file")) & (c("node") == c("e_parent")), "left_anti")
    marker = F.regexp_replace(last_name(c("name")), "Attribute$", "")
    entry = of(nodes.where((c("kind") == "Attribute") & (marker.isin(*ENTRY_ATTRIBUTES) | marker.startswith("Http"))), "a", "parent")
    m = m.join(entry, (c("file_id") == c("a_file")) & (c("node") == c("a_parent")), "left_anti")
    contracts = of(nodes.where("kind = 'Type' and op = 'interface'"), "t", "node")
    return found(m.join(contracts, (c("file_id") == c("t_file")) & (c("type_node") == c("t_node")), "left_anti"), "SVC0020", F.concat(F.lit("'"), c("name"), F.lit("' awaits and isn't named Async")))


def forbidden_namespaces(nodes: DataFrame, namespaces: list[str]) -> DataFrame:
    u = nodes.where("kind = 'Using' and op is null")
    first = F.coalesce(*(F.when((c("name") == n) | c("name").startswith(n + "."), F.lit(n)) for n in namespaces), F.lit(None).cast("string"))
    return found(u.where(first.isNotNull()), "ACME0002", F.concat(F.lit("namespace '"), first, F.lit("' is forbidden")))


def layers(nodes: DataFrame, prefixes: DataFrame, edges: list[tuple[str, str]], allowlist: bool) -> DataFrame:
    """AR0001. ``prefixes``: prefix, layer, ord. ``edges``: (from, to), denied, or with ``allowlist`` the only ones allowed."""
    dot = lambda x: F.concat(x, F.lit("."))
    # settings: few, and nearly all names start with the same ones, so that they are not to be dealt out by them
    pre = F.broadcast(prefixes.withColumn("prefix", dot(F.col("prefix"))))
    own = nodes.where("kind = 'Namespace'").groupBy("file_id").agg(dot(F.min_by("name", "node")).alias("own"))
    own = longest_prefix(own, "own", pre).select(F.col("file_id").alias("o_file"), F.col("layer").alias("from_layer"))
    using = F.expr("kind = 'Using' and op is null")
    qualified = F.expr("kind in ('Qualified', 'Member') and parent_kind <> 'Using' and not (parent_kind = 'Member' and role = 'receiver')") & F.coalesce(c("text"), c("name")).contains(".")
    target = F.when(using, dot(c("name"))).otherwise(F.regexp_replace(F.coalesce("text", "name"), r"[^.]*$", ""))
    named = nodes.where(using | qualified).select("file_id", "start_line", "start_col", "node", target.alias("target"), F.when(using, 0).otherwise(1).alias("turn"))
    met = longest_prefix(named, "target", pre).join(own, c("file_id") == c("o_file")).where(c("layer") != c("from_layer"))
    listed = F.lit(False)
    for a, b in edges:
        listed = listed | ((c("from_layer") == a) & (c("layer") == b))
    met = met.where(~listed if allowlist else listed)
    first_turn = F.min("turn").over(Window.partitionBy("file_id", "start_line"))
    nth = F.row_number().over(Window.partitionBy("file_id", "start_line", "turn").orderBy("node"))
    met = met.withColumns({"_first": first_turn, "_nth": nth}).where((c("turn") == 0) | ((F.col("_first") == 1) & (F.col("_nth") == 1)))
    return found(met, "AR0001", F.concat(F.lit("layer '"), c("from_layer"), F.lit("' uses '"), c("layer"), F.lit("'")))


def registrations(nodes: DataFrame) -> DataFrame:
    """(service, implementation, lifetime, file_id, node): calls of AddX<S, I>() and AddX<S>(); the implementation is unknown for factories."""
    calls = nodes.where((c("kind") == "Member") & c("name").isin(*LIFETIMES) & c("type").isNotNull())
    args = F.split(F.regexp_extract(c("type"), r"^<(.*)>$", 1), r"\s*,\s*(?![^<]*>)")
    lifetime = F.coalesce(*(F.when(c("name") == k, F.lit(v)) for k, v in LIFETIMES.items()))
    factory = of(nodes.where("kind = 'Lambda' and role = 'argument'"), "f", "parent")
    out = calls.select("file_id", "node", "parent", "start_line", "start_col", simple(args[0]).alias("service"), F.when(F.size(args) > 1, simple(args[1])).otherwise(simple(args[0])).alias("implementation"), lifetime.alias("lifetime"))
    return out.join(factory, (c("file_id") == c("f_file")) & (c("parent") == c("f_parent")), "left").withColumn("implementation", F.when(c("f_parent").isNull(), c("implementation"))).drop("f_file", "f_parent", "parent")


def captive(nodes: DataFrame) -> DataFrame:
    """AR0002 to AR0005."""
    reg = registrations(nodes)
    place = F.struct("file_id", "node")
    life = reg.groupBy(F.col("service").alias("s_service")).agg(F.max_by("lifetime", place).alias("s_lifetime"))
    types = nodes.where("kind = 'Type' and op in ('class', 'record')").groupBy(F.col("name").alias("t_name")).agg(F.min(place).alias("t_at"))
    ctors = nodes.where((c("kind") == "Constructor") & F.array_contains("modifiers", "public"))
    best = ctors.groupBy(F.col("file_id").alias("c_file"), F.col("type_node").alias("c_type")).agg(F.max_by("node", F.struct("arity", -F.col("node"))).alias("c_node"))
    p = of(parameters(nodes).withColumn("needs", simple(F.col("type"))), "p", "parent", "needs")
    uses = reg.where("implementation is not null").join(types, c("implementation") == c("t_name")).join(best, (c("t_at.file_id") == c("c_file")) & (c("t_at.node") == c("c_type"))).join(p, (c("c_file") == c("p_file")) & (c("c_node") == c("p_parent")))
    known = uses.join(life, c("p_needs") == c("s_service")).where(c("lifetime") > c("s_lifetime"))
    rule = F.when((c("lifetime") == 3) & (c("s_lifetime") == 2), "AR0002").when(c("lifetime") == 3, "AR0003").otherwise("AR0004")
    said = F.concat(F.lit("'"), c("implementation"), F.lit("' outlives '"), c("p_needs"), F.lit("'"))
    out = known.select("file_id", rule.alias("rule_id"), said.alias("message"), c("start_line").alias("line"), c("start_col").alias("col"))
    unknown = uses.join(life, c("p_needs") == c("s_service"), "left_anti").where(c("p_needs").rlike("^I[A-Z]") & ~c("p_needs").isin(*FRAMEWORK))
    return out.unionByName(found(unknown, "AR0005", F.concat(F.lit("'"), c("p_needs"), F.lit("' is not registered"))))


def unknown_keys(nodes: DataFrame, file_projects: DataFrame, settings: DataFrame) -> DataFrame:
    """AR0030. ``file_projects``: file_id, project. ``settings``: project, path. Projects without settings are left alone."""
    first = of(nodes.where("kind = 'String' and role = 'argument'"), "a", "parent", "value")
    typed = declared_types(nodes).where(simple(c("d_type")).isin(*CONFIGURATION))
    element = nodes.where("kind = 'Element' and receiver_kind = 'Ident'").join(typed, (c("file_id") == c("d_file")) & (c("receiver_name") == c("d_name")), "left_semi")
    calls = nodes.where((c("kind") == "Invocation") & c("name").isin("GetSection", "GetValue", "GetConnectionString"))
    used = element.unionByName(calls).where("argument_kind = 'String'").join(first, (c("file_id") == c("a_file")) & (c("node") == c("a_parent")))
    key = F.when(c("name") == "GetConnectionString", F.concat(F.lit("ConnectionStrings:"), c("a_value"))).otherwise(c("a_value"))
    used = used.withColumn("key", key).join(file_projects.select(F.col("file_id").alias("p_file"), "project"), c("file_id") == c("p_file"))
    used = used.join(settings.select(F.col("project").alias("_s")).distinct(), c("project") == c("_s"), "left_semi")
    known = with_prefixes(settings).select(F.col("project").alias("_p"), F.lower("key").alias("_k"))
    return found(used.join(known, (c("project") == c("_p")) & (F.lower("key") == c("_k")), "left_anti"), "AR0030", F.concat(F.lit("unknown setting '"), c("key"), F.lit("'"))).distinct()


def embedded_sql(nodes: DataFrame, items_of) -> tuple[DataFrame, DataFrame]:
    """String literals that look like SQL, and the parsed items of those; ``items_of`` parses (file_id, text)."""
    s = nodes.where((c("kind") == "String") & (F.length("value") >= 10) & F.lower("value").rlike("select|insert|update")).withColumn("sql_id", F.xxhash64("file_id", "node"))
    return s, items_of(s.select(F.col("sql_id").alias("file_id"), F.col("value").alias("text")))


def inline_star(literals: DataFrame, items: DataFrame) -> DataFrame:
    star = items.where("kind = 'SelectStar'").select(F.col("file_id").alias("_i")).distinct()
    return found(literals.where(F.lower("value").contains("select")).join(star, c("sql_id") == c("_i"), "left_semi"), "AR0023", "SQL in code selects all columns")


def catalog(items: DataFrame) -> DataFrame:
    """(table, columns): the last CREATE TABLE of each name; temporary tables are left out."""
    t = items.where((c("kind") == "CreateTable") & ~c("name").startswith("#"))
    name = F.concat_ws(".", F.lower(F.coalesce("schema", F.lit("dbo"))), F.lower("name"))
    return t.groupBy(name.alias("table")).agg(F.max_by(F.transform("columns", F.lower), F.struct("file_id", "item")).alias("known"))


def unknown_columns(literals: DataFrame, items: DataFrame, tables: DataFrame) -> DataFrame:
    """AR0080: columns of single-table statements in code that the catalog's table doesn't have."""
    one = items.where("(kind = 'Select' and n_tables = 1) or kind = 'Insert' or (kind = 'Update' and n_tables = 0)").where(c("name").isNotNull())
    name = F.concat_ws(".", F.lower(F.coalesce("schema", F.lit("dbo"))), F.lower("name"))
    each = one.select(F.col("file_id").alias("_i"), name.alias("table"), F.explode(F.array_distinct("columns")).alias("column")).join(tables, "table").where(~F.array_contains("known", F.lower("column")))
    return found(literals.join(each, c("sql_id") == c("_i")), "AR0080", F.concat(F.lit("'"), c("table"), F.lit("' has no column '"), c("column"), F.lit("'"))).distinct()


def sql_rules(items: DataFrame, policy: str | None = None, temp_pattern: str | None = None, procedure_pattern: str | None = None) -> DataFrame:
    """SQ0001 to SQ0021 in one scan."""
    no, temp = F.lit(False), F.coalesce(c("name").startswith("#"), F.lit(False))
    hint = {"required": c("hints") == 0, "forbidden": c("hints") > 0}.get(policy or "", no)
    rules = [
        ("SQ0001", c("kind") == "SelectStar", "selects all columns"),
        ("SQ0002", c("kind") == "Error", "does not parse"),
        ("SQ0010", (c("kind") == "Table") & hint, "table hint is against the policy"),
        ("SQ0011", (c("kind") == "CreateTable") & temp & (~c("name").rlike(temp_pattern) if temp_pattern else no), "name of temporary table"),
        ("SQ0012", (c("kind") == "CreateProcedure") & (~c("name").rlike(procedure_pattern) if procedure_pattern else no), "name of procedure"),
        ("SQ0020", ((c("kind") == "Delete") & ~temp | (c("kind") == "Update")) & ~c("has_where"), "changes all rows"),
        ("SQ0021", c("kind") == "NullComparison", "compares with NULL"),
    ]
    met = F.array_compact(F.array(*(F.when(p, F.struct(F.lit(r).alias("rule_id"), F.lit(m).alias("message"))) for r, p, m in rules)))
    return items.select("file_id", F.explode(met).alias("x"), "line", F.col("start_col").alias("col")).select("file_id", "x.rule_id", "x.message", "line", "col")


#: Rules that need the nodes alone.
PLAIN = (single_node, async_void, rethrow, count_compared, concat_in_loop, culture_case, weak_random, nested_quantifiers, too_complex, duplicate_literals, unused_parameters, unused_locals, undisposed, public_fields, async_names, captive)


def all_plain(nodes: DataFrame) -> DataFrame:
    out = None
    for rule in PLAIN:
        out = rule(nodes) if out is None else out.unionByName(rule(nodes))
    return out


PLACE = ("file_id", "node", "kind", "start_line", "start_col")


def asked(kinds: str, columns: str) -> Asked:
    return Asked(tuple(kinds.split()), (*PLACE, *columns.split()))


#: What rules read, for a table that serves one of them alone (tested: the findings equal those from whole trees).
READS = {
    single_node: asked("Member Binding Invocation Catch Declarator Assign New Binary If Conditional", "role parent_kind name op type arity receiver receiver_kind receiver_name left_kind left_name right_kind right_name right_value n_statements in_async in_attribute dynamic"),
    count_compared: asked("Number Invocation Binary", "parent name op value arity receiver"),
    concat_in_loop: asked("Assign Parameter Declarator Property", "parent_kind name op type left_kind left_name in_loop"),
    complexity: asked("Method", "method weight nesting"),
    too_complex: asked("Method", "name method weight nesting"),
    unused_locals: asked("LocalDeclaration Block Declarator Ident", "parent last name modifiers block"),
    undisposed: asked("LocalDeclaration Block Declarator Ident New Invocation", "parent last role parent_kind name type modifiers receiver_name block"),
    captive: asked("Member Lambda Type Constructor Parameter", "parent role name op type arity modifiers type_node"),
    layers: asked("Namespace Using Qualified Member", "role parent_kind name op text"),
}


def members(nodes: DataFrame) -> DataFrame:
    """(file_id, node, key, line, col, is_test): callable members; key is name/arity, fields and properties have arity 0."""
    tests = "(^|\\.)(Fact|Theory|Test|TestCase|TestMethod|DataTestMethod)(Attribute)?$"
    m = nodes.where("kind in ('Method', 'Constructor', 'LocalFunction', 'Property', 'Indexer', 'Event') or (kind = 'Declarator' and parent_kind = 'Field')")
    marked = of(nodes.where((c("kind") == "Attribute") & c("name").rlike(tests)), "a", "parent").distinct()
    out = m.join(marked, (c("file_id") == c("a_file")) & (c("node") == c("a_parent")), "left")
    return out.select("file_id", "node", F.concat_ws("/", "name", F.coalesce("arity", F.lit(0)).cast("string")).alias("key"), c("start_line").alias("line"), c("start_col").alias("col"), c("a_parent").isNotNull().alias("is_test"))


def call_edges(nodes: DataFrame) -> DataFrame:
    """(callee, caller, file_id, node): keys that each member calls, once each."""
    target = F.when(c("kind") == "New", F.concat_ws("/", simple(c("type")), c("arity").cast("string"))).when(c("kind") == "Invocation", F.concat_ws("/", c("name"), c("arity").cast("string"))).otherwise(F.concat(c("name"), F.lit("/0")))
    called = nodes.where((c("kind") == "Invocation") & c("name").isNotNull() | (c("kind") == "New") | (c("kind").isin("Member", "Binding") & (F.coalesce(c("role"), F.lit("")) != "callee")))
    called = called.where("member is not null").select("file_id", F.col("member").alias("m"), target.alias("callee")).distinct()
    own = members(nodes).select(F.col("file_id").alias("_f"), F.col("node").alias("_n"), F.col("key").alias("caller"))
    return called.join(own, (c("file_id") == c("_f")) & (c("m") == c("_n"))).select("callee", "caller", "file_id", F.col("m").alias("node"))

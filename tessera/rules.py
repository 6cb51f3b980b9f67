"""The rules by id: category, default severity, scope and title."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Id, category, default severity, scope, title.
RULES = """
AR0001 architecture warning file Layer uses a layer that it may not use
AR0002 lifetime error workspace Long-lived service holds a scoped one
AR0003 lifetime warning workspace Long-lived service holds a transient one
AR0004 lifetime information workspace Scoped service holds a transient one
AR0005 lifetime off workspace Constructor needs a service that is not registered
AR0010 async warning file Blocks on a task
AR0011 async warning file Task is discarded
AR0012 async warning file Async method returns void
AR0013 async warning file Catch block is empty
AR0014 async warning file Throw loses the stack
AR0015 async warning file Sleeps in an async method
AR0020 performance information file Counts to test for emptiness
AR0021 performance information file Adds to a string in a loop
AR0022 performance hint file Materialises before a deferred operator
AR0023 performance information file SQL in code selects all columns
AR0030 configuration warning project Setting is not known
AR0031 configuration information project Settings file can't be read
AR0040 architecture error workspace Projects refer to one another in a cycle
AR0041 architecture information workspace Project file can't be read
AR0050 security warning file Credential in source
AR0051 security warning file Weak algorithm
AR0052 security information file Secret from a weak generator
AR0053 security warning file Expression may backtrack without bound
AR0054 security warning file SQL is put together at run time
AR0060 complexity warning file Method is too complex
AR0061 complexity information file Literal repeats
AR0070 maintainability hint file Parameter is not used
AR0071 maintainability information file Local is not used
AR0072 maintainability information file Condition says nothing
AR0073 maintainability hint file Writes to the console
AR0074 maintainability warning file Disposable is never disposed
AR0075 maintainability information file Field is public
AR0080 sql warning workspace SQL in code names an unknown column
AR0090 globalization information file Case change depends on the culture
SQ0001 sql warning file Selects all columns
SQ0002 sql information file Does not parse
SQ0010 sql warning file Table hint is against the policy
SQ0011 sql warning file Name of a temporary table
SQ0012 sql warning file Name of a procedure
SQ0020 sql warning file Changes all rows
SQ0021 sql warning file Compares with NULL
ACME0001 sample warning file Creates an HttpClient
ACME0002 sample warning file Uses a forbidden namespace
ACME0003 sample information file Option is malformed
SVC0001 conventions warning file Reads the local clock
SVC0002 conventions warning file Reads the ambient culture
SVC0003 conventions information file Reads the working directory
SVC0010 conventions warning file Endpoint in source
SVC0020 conventions hint file Awaits and isn't named Async
"""

TABLE = [tuple(line.split(" ", 4)) for line in RULES.strip().splitlines()]
CATEGORIES = {r[0]: r[1] for r in TABLE}


SCHEMA = "rule_id string, category string, default_severity string, scope string, title string"


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TABLE, SCHEMA)

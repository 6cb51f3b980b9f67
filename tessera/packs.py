"""Rule packs: modules that bring rules of their own.

A pack is a module with ``RULES`` (rows of id, category, severity, scope, title) and ``find(nodes, items, options)``, which gives
(file_id, rule_id, message, line, col). Nothing here raises: what is wrong with a pack becomes a message.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tessera.operators.findings import SEVERITIES

SCOPES = ("file", "project", "workspace")


@dataclass(frozen=True)
class Pack:
    name: str
    rules: tuple[tuple[str, str, str, str, str], ...]
    find: Callable[[DataFrame, DataFrame, dict], DataFrame]


def declared(name: str, rows, taken: set[str]) -> tuple[list[tuple], list[str]]:
    """The rows that hold, and messages on those that don't."""
    good, messages = [], []
    for row in rows:
        if not isinstance(row, (tuple, list)) or len(row) != 5 or not all(isinstance(x, str) and x.strip() for x in row):
            messages.append(f"pack '{name}': a rule needs id, category, severity, scope and title")
        elif row[0].lower() in taken:
            messages.append(f"pack '{name}': rule '{row[0]}' is known already")
        elif row[2] not in SEVERITIES or row[3] not in SCOPES:
            messages.append(f"pack '{name}': rule '{row[0]}' has an unknown severity or scope")
        else:
            good.append(tuple(row))
            taken.add(row[0].lower())
    return good, messages


def load(names: list[str], known: list[str]) -> tuple[list[Pack], list[str]]:
    """Packs by module name; ``known``: ids that are taken."""
    packs, messages, taken = [], [], {k.lower() for k in known}
    for name in names:
        try:
            module = importlib.import_module(name)
        except Exception as e:  # a pack may fail in any way
            messages.append(f"pack '{name}' can't be loaded: {type(e).__name__}: {e}")
            continue
        if not callable(getattr(module, "find", None)) or not getattr(module, "RULES", None):
            messages.append(f"'{name}' is not a rule pack")
            continue
        rows, said = declared(name, module.RULES, taken)
        messages += said
        if rows:
            packs.append(Pack(name, tuple(rows), module.find))
    return packs, messages

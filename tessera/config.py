"""Settings of a workspace: read leniently, checked with suggestions, and written as a scaffold."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

#: The name of the settings file and the keys that it may hold.
FILE_NAME, BASELINE = ".lens.json", "lens-baseline.json"
KEYS = ("rules", "exclude", "layers", "rulePacks", "options", "baseline")


@dataclass
class Config:
    rules: dict[str, str] = field(default_factory=dict)
    exclude: list[str] = field(default_factory=list)
    layers: dict = field(default_factory=dict)
    rule_packs: list[str] = field(default_factory=list)
    options: dict[str, dict] = field(default_factory=dict)
    baseline: str | None = None
    session: dict[str, str] = field(default_factory=dict)
    messages: list[str] = field(default_factory=list)


def without_comments(text: str) -> str:
    """JSON without comments and trailing commas; strings are left as they are."""
    token = r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/'
    bare = re.sub(token, lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(\s*[\]}])', lambda m: m[1] or m[2], bare, flags=re.S)


def locate(start: str) -> Path | None:
    """The nearest settings file at or above a folder."""
    here = Path(start).resolve()
    return next((p / FILE_NAME for p in (here, *here.parents) if (p / FILE_NAME).is_file()), None)


def parse(text: str) -> Config:
    """Malformed text gives the defaults and a message."""
    out = Config()
    try:
        said = json.loads(without_comments(text))
        if not isinstance(said, dict):
            raise ValueError("not an object")
    except ValueError as e:
        out.messages.append(f"settings can't be read: {e}")
        return out
    out.messages += [f"unknown key '{k}'" + did_you_mean(k, KEYS) for k in said if k not in KEYS]
    out.rules = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in (said.get("rules") or {}).items()}
    out.exclude = [str(x) for x in said.get("exclude") or []]
    out.layers, out.options = said.get("layers") or {}, said.get("options") or {}
    out.rule_packs, out.baseline = list(said.get("rulePacks") or []), said.get("baseline")
    return out


def load(start: str) -> Config:
    found = locate(start)
    return parse(found.read_text(encoding="utf-8-sig")) if found else Config()


def read_entries(path: Path) -> tuple[list[dict], str | None]:
    """Entries of a baseline file, none without one; a message if it can't be read."""
    try:
        said = json.loads(path.read_text(encoding="utf-8-sig"))
        return [x for x in said if isinstance(x["fingerprint"], str)], None
    except FileNotFoundError:
        return [], None
    except (OSError, ValueError, KeyError, TypeError) as e:
        return [], f"baseline can't be read: {e}"


def read_baseline(path: Path) -> tuple[list[str], str | None]:
    """The fingerprints alone."""
    entries, message = read_entries(path)
    return [e["fingerprint"] for e in entries], message


def edits(a: str, b: str, most: int) -> int:
    """Edit distance, or ``most + 1`` as soon as it is over ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]


def nearest(word: str, known, most: int = 2) -> str | None:
    """The known word within ``most`` edits, whatever the case; the first in the alphabet on ties."""
    near = [(d, k.lower(), k) for k in known if (d := edits(word.lower(), k.lower(), most)) <= most]
    return min(near)[2] if near else None


def did_you_mean(word: str, known) -> str:
    found = nearest(word, known)
    return f"; did you mean '{found}'?" if found else ""


def validate(config: Config, rules: dict[str, str], severities, spellings) -> list[str]:
    """Messages on what the settings name and nothing knows; ``rules``: category by rule id."""
    out, known = list(config.messages), [*rules, *sorted(set(rules.values()))]
    low = {k.lower() for k in known}
    for k, v in config.rules.items():
        if k.lower() not in low:
            out.append(f"unknown rule or category '{k}'" + did_you_mean(k, known))
        if v.strip().lower() not in (*severities, *spellings):
            out.append(f"'{k}': unknown severity '{v}'" + did_you_mean(v, severities))
    ids = {k.lower() for k in rules}
    out += [f"options for unknown rule '{k}'" + did_you_mean(k, rules) for k in config.options if k.lower() not in ids]
    names = set(config.layers.get("layers", {}))
    edges = [(kind, edge) for kind in ("deny", "allow") for edge in config.layers.get(kind, [])]
    if edges and not names:
        out.append("layers: edges are given but no layers, so that none can be met")
    for kind, edge in edges if names else []:
        for end in ("from", "to"):
            name = edge.get(end) or ""
            if not name.strip():
                out.append(f"layer edge in '{kind}' has no '{end}'")
            elif name not in names:
                same = [x for x in sorted(names) if x.lower() == name.lower()]
                out.append(f"layer edge names unknown layer '{name}'" + (f"; names differ by case, the layer is '{same[0]}'" if same else did_you_mean(name, names)))
    if config.layers.get("deny") and config.layers.get("allow"):
        out.append("layers: both deny and allow are given")
    return out


def with_severity(text: str, rule: str, severity: str) -> str:
    """The settings text with one rule's severity set; everything else, comments included, stays."""
    entry = re.compile(rf'("{re.escape(rule)}"\s*:\s*)"[^"]*"')
    if entry.search(text):
        return entry.sub(lambda m: f'{m[1]}"{severity}"', text, count=1)
    rules = re.search(r'"rules"\s*:\s*\{', text)
    if rules:
        empty = re.match(r"\s*\}", text[rules.end() :])
        return f'{text[: rules.end()]} "{rule}": "{severity}"{"" if empty else ","}{text[rules.end() :]}'
    brace = text.find("{")
    if brace < 0:
        return json.dumps({"rules": {rule: severity}}, indent=2)
    empty = re.match(r"\s*\}", text[brace + 1 :])
    return f'{text[: brace + 1]} "rules": {{ "{rule}": "{severity}" }}{"" if empty else ","}{text[brace + 1 :]}'


def schema(rules: dict[str, str], severities) -> dict:
    """A JSON Schema (draft 07) of the settings."""
    level = {"type": "string", "enum": list(severities)}
    strings = {"type": "array", "items": {"type": "string"}}
    edge = {"type": "array", "items": {"type": "object", "properties": {"from": {"type": "string"}, "to": {"type": "string"}}, "required": ["from", "to"]}}
    return {
        "$schema": "http://json-schema.org/draft-07/schema#",
        "type": "object",
        "additionalProperties": False,
        "properties": {
            "rules": {"type": "object", "properties": {k: level for k in (*sorted(rules), *sorted(set(rules.values())))}, "additionalProperties": level},
            "exclude": strings,
            "rulePacks": strings,
            "baseline": {"type": "string"},
            "options": {"type": "object"},
            "layers": {"type": "object", "properties": {"layers": {"type": "object", "additionalProperties": strings}, "deny": edge, "allow": edge}},
        },
    }


def scaffold(folder: str, rules: dict[str, str], severities, force: bool = False) -> list[Path]:
    """Writes starting settings and their schema; existing files stay unless ``force``."""
    made = []
    for name, content in ((FILE_NAME, {"$schema": "./lens.schema.json", "rules": {}, "exclude": []}), ("lens.schema.json", schema(rules, severities))):
        path = Path(folder) / name
        if path.exists() and not force:
            raise FileExistsError(path)
        path.write_text(json.dumps(content, indent=2) + "\n", encoding="utf-8")
        made.append(path)
    return made

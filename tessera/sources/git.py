"""Single questions to the git command. ``commits`` reads the history."""

from __future__ import annotations

import subprocess


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=120)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def repository_root(path: str) -> str | None:
    out = _git(path, "rev-parse", "--show-toplevel")
    return out.strip() if out else None


def show_at(root: str, revision: str, path: str) -> str | None:
    return _git(root, "show", f"{revision}:{path}")

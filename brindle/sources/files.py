"""Discovery of files on the driver: listings are small and must show empty files too."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class IndexFile:
    path: str
    format: str  # typed or enveloped
    source: str  # session or archive
    header: bool = False  # only if its first line is a session header


@dataclass(frozen=True)
class Rule:
    root: str
    format: str
    source: str
    suffix: str
    header: bool = False


# Where the tools keep their transcripts, below the home or configuration folder.
DEFAULT_ROOTS = (
    ("home", ".claude/projects", "typed", "session", (".jsonl",), False),
    ("home", ".claude/archive", "typed", "archive", (".jsonl.zst", ".jsonl"), False),
    ("home", ".codex/sessions", "enveloped", "session", (".jsonl",), False),
    ("home", ".codex/archived_sessions", "enveloped", "archive", (".jsonl",), False),
    ("config", "pi/agent/sessions", "typed", "session", (".jsonl",), True),
)


def default_rules(home: str, config: str, headed: bool = True) -> list[Rule]:
    """Rules of the default folders; ``headed`` adds those that need a session header."""
    base = {"home": home, "config": config}
    return [Rule(os.path.join(base[below], folder), kind, source, suffix, header) for below, folder, kind, source, suffixes, header in DEFAULT_ROOTS if headed or not header for suffix in suffixes]


def walk(root: str, suffix: str) -> list[str]:
    """Regular files below ``root`` that end so; a missing root has none."""
    found = []
    for folder, _, names in os.walk(root):
        found += [p for n in names if n.endswith(suffix) and os.path.isfile(p := os.path.join(folder, n))]
    return found


def by_component(path: str) -> tuple[str, ...]:
    """Paths sort by component, so that a/b comes before a-b."""
    return Path(path).parts


def discover(rules: list[Rule]) -> list[IndexFile]:
    """The union of all rules in path order."""
    found = {IndexFile(p, r.format, r.source, r.header) for r in rules for p in walk(r.root, r.suffix)}
    return sorted(found, key=lambda f: (by_component(f.path), f.format, f.source, f.header))


def is_archive_session(path: str) -> bool:
    """Fixed names of archive folders."""
    parts = Path(path).parts
    return "archived_sessions" in parts or any(a == ".claude" and b == "archive" for a, b in zip(parts, parts[1:]))


def is_enveloped_session(path: str) -> bool:
    return ".codex" in Path(path).parts


def markdown_files(root: str) -> list[str]:
    return sorted((p for p in walk(root, ".md")), key=by_component)


def manifest(root: str) -> list[tuple[str, int, int]]:
    """(relative path, mtime in ns, size) of every Markdown file."""
    out = []
    for p in markdown_files(root):
        s = os.stat(p)
        out.append((os.path.relpath(p, root), s.st_mtime_ns, s.st_size))
    return out


def disjoint(kb: str, index: str) -> None:
    """Neither folder may hold the other."""
    a, b = Path(os.path.realpath(kb)), Path(os.path.realpath(index))
    if a == b or a in b.parents or b in a.parents:
        raise ValueError(f"{kb} and {index} must not contain each other")

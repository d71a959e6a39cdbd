"""Append-only dated Markdown logs."""

from __future__ import annotations

import os
from datetime import datetime


def _append(path: str, head: str, content: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(f"\n## {head}\n{content}\n")


def daily(root: str, content: str, category: str | None = None, project: str | None = None, now: datetime | None = None) -> str:
    now = now or datetime.now()
    path = os.path.join(root, "daily", f"{now:%Y-%m-%d}.md")
    _append(path, f"{now:%H:%M}" + (f" [{category}]" if category else "") + (f" ({project})" if project else ""), content)
    return path


def project(root: str, name: str, content: str, now: datetime | None = None) -> str:
    path = os.path.join(root, "projects", f"{name}.md")
    _append(path, f"{now or datetime.now():%Y-%m-%d %H:%M}", content)
    return path


def category(kb: str, content: str, name: str | None = None, project: str | None = None, now: datetime | None = None) -> str | None:
    """Nothing happens where the knowledge base is absent."""
    if not os.path.isdir(kb):
        return None
    path = os.path.join(kb, "memory", f"{name or 'uncategorized'}.md")
    _append(path, f"{now or datetime.now():%Y-%m-%d %H:%M}" + (f" ({project})" if project else ""), content)
    return path

"""Command line over the plans: brindle <command> --help."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from . import config
from .client import BATCH, factory
from .operators import present
from .plans import enrich, history_index, kb_index, transcript_index
from .sources import files


def session_filter(value: str) -> str:
    if not value.strip():
        raise argparse.ArgumentTypeError("session filter must not be empty")
    return value


# Folders of a user, as the environment names them.
HOME = os.path.expanduser("~")
CONFIG = os.environ.get("XDG_CONFIG_HOME") or os.path.join(HOME, ".config")
CACHE = os.environ.get("XDG_CACHE_HOME") or os.path.join(HOME, ".cache")
KB = os.environ.get("BRINDLE_KB") or os.path.join(HOME, "KB")


def batches(c: argparse.ArgumentParser) -> None:
    c.add_argument("--batch-size", type=int, default=BATCH, help="texts of a request to the embedding service")
    c.add_argument("--delay-ms", type=int, default=0, help="wait between two requests")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("brindle")
    p.add_argument("--store", default="brindle-store")
    p.add_argument("--config", default=os.path.join(CONFIG, "brindle", "config.toml"))
    p.add_argument("--key-file", default=os.path.join(CONFIG, "brindle", "credentials.toml"), help="TOML file with the api_key of the hosted backend")
    p.add_argument("--url", help="where the embedding service answers")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("index")
    c.add_argument("roots", nargs="*", help="folder:format:source; format typed, headed (typed, with a session header) or enveloped; without any, the tools' own folders")
    c.add_argument("--fresh", action="store_true")
    batches(c)
    c = sub.add_parser("index-file")
    c.add_argument("path")
    batches(c)
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("--limit", type=int, default=5)
    c.add_argument("--type", choices=("prompts", "answers"))
    c.add_argument("--session", type=session_filter)
    c.add_argument("--json", action="store_true")
    c = sub.add_parser("stats")
    c = sub.add_parser("kb")
    c.add_argument("action", choices=("build", "query"))
    c.add_argument("query", nargs="?", default="")
    c.add_argument("--kb", default=KB)
    c.add_argument("--index", default=os.path.join(CACHE, "brindle", "kb-index"))
    c.add_argument("--limit", type=int, default=5)
    c = sub.add_parser("transcript")
    c.add_argument("action", choices=("build", "document", "structure", "content", "query"))
    c.add_argument("args", nargs="*")
    c.add_argument("--index", default="brindle-transcripts")
    c.add_argument("--max-sessions", type=int)
    c.add_argument("--limit", type=int, default=5)
    c = sub.add_parser("enrich")
    c.add_argument("prompt", nargs="?")
    c.add_argument("--kb", default=KB)
    c.add_argument("--index", default=os.path.join(CACHE, "brindle", "kb-index"))
    c.add_argument("--limit", type=int, default=5)
    return p


def rules(roots: list[str]) -> list[files.Rule]:
    out = []
    for text in roots:
        root, kind, source = text.rsplit(":", 2)
        out += [files.Rule(root, "typed" if kind == "headed" else kind, source, suffix, kind == "headed") for suffix in (".jsonl", ".jsonl.zst")]
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("brindle").getOrCreate()
    own = config.load(a.config)
    profile = config.resolve(own, os.environ.get)
    make = None
    if a.command in ("index", "index-file", "search") or (a.command == "enrich" and own.search_enabled):
        try:
            make = factory(profile, a.key_file, a.url, getattr(a, "batch_size", BATCH), getattr(a, "delay_ms", 0) / 1000)
        except (OSError, ValueError) as e:
            raise SystemExit(f"brindle: {e}") from e
    if a.command == "index":
        own_rules = rules(a.roots) if a.roots else files.default_rules(HOME, CONFIG)
        found = files.discover(own_rules)
        bases = {r.root: r.root for r in own_rules}
        print(f"indexed {history_index.index(spark, found, a.store, make, a.fresh, bases)} new chunks")
    elif a.command == "index-file":
        print(f"indexed {history_index.index_file(spark, a.path, a.store, make)} new chunks")
    elif a.command == "search":
        kind = {"prompts": "prompt", "answers": "answer", None: None}[a.type]
        rows = history_index.search(spark, a.store, a.query, make(), a.limit, a.session, kind, enabled=own.search_enabled)
        print("\n".join(r["line"] for r in present.ndjson(rows).collect()) if a.json else present.results_listing(rows.collect()))
    elif a.command == "stats":
        print(f"points: {history_index.stats(spark, a.store)}")
    elif a.command == "kb":
        if a.action == "build":
            s = kb_index.build(spark, a.kb, a.index)
            print(f"indexed {s.files} files, {s.nodes} nodes")
        else:
            print(present.kb_listing(kb_index.search(spark, a.kb, a.index, a.query, a.limit).collect()))
    elif a.command == "transcript":
        if a.action == "build":
            print(transcript_index.build(spark, rules(a.args) if a.args else files.default_rules(HOME, CONFIG, headed=False), a.index, a.max_sessions))
        elif a.action == "query":
            print(present.transcript_listing(transcript_index.query(spark, a.index, a.args[0], a.limit).collect()))
        elif a.action == "content":
            print(transcript_index.content(spark, a.index, *a.args[:2]), end="")
        else:
            docs, nodes = transcript_index.load(spark, a.index)
            rows = docs.drop("text") if a.action == "document" else nodes.drop("text")
            print("\n".join(rows.where(rows["doc_id"] == a.args[0]).toJSON().collect()))
    else:
        prompt = enrich.read_prompt(a.prompt, sys.stdin)
        print(enrich.run(spark, prompt, a.store, make() if make else None, a.kb, a.index, a.limit, enabled=own.search_enabled))
    return 0


if __name__ == "__main__":
    sys.exit(main())

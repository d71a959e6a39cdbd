"""Incremental indexing as a stream of transcripts that grow.

New lines become messages by the batch plan's own expressions.  For each file and type the state
holds the text from the start of the first window that more text may still change, and the chunks
it gave; a batch puts the chunks of the new windows into the store and takes out those that the
text has outgrown.  After the last line the store holds what a batch run over the files leaves.
A repeated micro-batch changes nothing: points go by identity.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..embed import Embedder
from ..functions.chunking import OVERLAP, SIZE
from ..plans import history_index
from ..sources import files, transcripts
from . import growing

#: What a batch does to the store: put or drop a chunk of a file's stream.
CHANGES = "type string, source string, full_path string, chunk string, chunk_idx int, put boolean"
STATE = "tail string, open array<string>, closed int, moved boolean"


def advance(tail: str, more: str, moved: bool) -> tuple[list[str], str, list[str], bool]:
    """(chunks that stay, text from the first window that may change, its chunks so far, moved).

    ``moved`` tells whether a window has been cut for good: a text of one window is one chunk,
    while the last window of a longer one is followed by its own overlap.
    """
    text = f"{tail}\n{more}" if tail and more else tail or more
    stay, at, end = [], 0, len(text.rstrip())
    while at + SIZE < end:  # a window with text behind it is cut for good
        newline = text.rfind("\n", at, at + SIZE)
        stop = newline + 1 if newline - at > OVERLAP else at + SIZE
        if piece := text[at:stop].strip():
            stay.append(piece)
        at += max(stop - at - OVERLAP, 0) or SIZE
    rest, moved = text[at:], moved or at > 0
    return stay, rest, windows(rest) if moved or len(rest.rstrip()) > SIZE else [x for x in (rest.strip(),) if x], moved


def windows(text: str) -> list[str]:
    """Chunks of the last text of a stream, which starts where a window does."""
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        end = min(at + SIZE, len(text))
        if piece := text[at:end].strip():
            out.append(piece)
        at = end - OVERLAP if end - at > OVERLAP else end
    return out


def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The changes that new messages of a stream make; state as in ``STATE``."""
    kind, source, path = key
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["position", "place", "seq"])
    tail, was, closed, moved = state.get if state.exists else ("", [], 0, False)
    stay, tail, now, moved = advance(tail, "\n".join(rows["text"]), moved)
    put = [(c, closed + k) for k, c in enumerate(stay + now)]
    gone = [c for c in was if c not in {c for c, _ in put}]
    state.update((tail, now, closed + len(stay), moved))
    made = [(kind, source, path, c, k, True) for c, k in put] + [(kind, source, path, c, 0, False) for c in gone]
    yield pd.DataFrame(made, columns=["type", "source", "full_path", "chunk", "chunk_idx", "put"])


def messages(lines: DataFrame) -> DataFrame:
    """(type, source, path, position, place, seq, text) of the lines of a batch."""
    lines = lines.withColumn("line_no", F.lit(0))
    typed, env = lines.where("format = 'typed'"), lines.where("format = 'enveloped'")
    keys = ("path", "source", "position", "place")
    prompts = transcripts.typed_prompts(typed, *keys).unionByName(transcripts.enveloped_messages(env, "user", *keys))
    answers = transcripts.typed_answers(typed, *keys).unionByName(transcripts.enveloped_messages(env, "assistant", *keys))
    return prompts.withColumn("type", F.lit("prompt")).unionByName(answers.withColumn("type", F.lit("answer")))


def watch(spark: SparkSession, root: str | list[files.Rule], rule_format: str, store: str, make: Callable[[], Embedder], checkpoint: str, once: bool = True, bases: dict[str, str] | None = None, most_files: int = growing.FILES, most_bytes: int = growing.BYTES) -> StreamingQuery:
    """Index what is new below ``root`` (a folder, or rules of folders); ``once`` stops when all is read.

    A batch takes at most ``most_files`` files and, but for a single larger one, ``most_bytes`` bytes.
    """
    if isinstance(root, str):
        bases = bases or {"root": root}
        archive = files.is_archive_session(os.path.join(root, "x"))
        root = [files.Rule(root, "typed" if rule_format == "headed" else rule_format, "archive" if archive else "session", suffix, rule_format == "headed") for suffix in (".jsonl", ".jsonl.zst")]
    os.makedirs(checkpoint, exist_ok=True)
    spark.dataSource.register(growing.GrowingSource)
    own = growing.options(root, os.path.join(checkpoint, "growing.json"), most_files, most_bytes)
    source = spark.readStream.format(growing.NAME).options(**own).load()
    changes = messages(source).groupBy("type", "source", "path").applyInPandasWithState(follow, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)

    def batch(df: DataFrame, _: int) -> None:
        history_index.change(spark, df, store, make, bases)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    query = writer.start()
    if once:
        query.processAllAvailable()
        query.stop()
    return query

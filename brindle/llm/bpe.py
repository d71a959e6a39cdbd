"""Byte-level BPE by recursive DuckDB queries inside each partition.

Pieces (matches of the pattern) that a worker has not met before go, all at once, through
one recursive query: rows (word, position, token) join the merge table, and every word
contracts its leftmost pair of least rank, until no word has a pair left.  Decoding joins
ids with the vocabulary and aggregates the bytes in order; what is decoded are the ids of the
whole text, as they are returned.  A text is cut into chunks of whole pieces; what the queries
gave for a chunk is kept for later batches of the task in a table of bounded size, which only
saves time.  At the end of a task the worker gives this table and its DuckDB connection back.

Defined results: a null or empty text has no tokens; special tokens are ordinary text;
repeated rows give repeated results; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import struct
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import give_back, utf8

#: Chunks kept during a task; beyond that only the first so many, which tend to be the frequent
#: ones, and those in use stay.
KEEP_CHUNKS, KEEP_FIRST = 300_000, 200_000
#: Texts are handled in groups of about so many characters, ids in groups of so many, pieces
#: to contract in groups of so many bytes.
GROUP_CHARS, GROUP_IDS, GROUP_BYTES = 1_000_000, 100_000, 100_000
#: Rows of all steps of a recursive query, about.
MOST_ROWS = 2_000_000
#: What DuckDB may take, and more for each byte of a single longer word; it never writes to disk.
MEMORY, WORD_BYTES = "120MB", 600
#: In a text without these, each single space or newline starts a chunk that holds whole pieces.
UNEVEN = re.compile(r"\s\s|[^\S \n]|\x00")

#: Pieces of more bytes contract every occurrence of their least pair in a step.
LONG_PIECE = 64
#: A recursive query runs so many steps at most; what is left starts the next one.
STEPS = 256

#: Rows (word, pos) link to the next token of their word; {step} makes the rows of a step.  The
#: rows of all steps come back, and those of a word's last step are its tokens.
CONTRACT = """
WITH RECURSIVE state(word, pos, nxt, tok, ntok, step) AS (
    SELECT word, pos, nxt, tok, ntok, 0 FROM seed
    UNION ALL
    (WITH {step})
)
SELECT word, pos, nxt, tok, ntok, step FROM state
"""

#: Contracts the leftmost pair of least rank of each word.
LEFTMOST = """
best AS (
    SELECT s.word, min(m.merged::BIGINT * 4294967296 + s.pos) AS best
    FROM state s JOIN merges m ON m.pair = (s.tok::BIGINT << 32) + s.ntok GROUP BY s.word
), hit AS (
    SELECT b.word, s.pos, (best >> 32)::INT AS merged, s.nxt AS gone
    FROM best b JOIN state s ON s.pos = (b.best & 4294967295)::INT
)
SELECT s.word, s.pos,
       CASE WHEN s.pos = h.pos THEN g.nxt ELSE s.nxt END,
       CASE WHEN s.pos = h.pos THEN h.merged ELSE s.tok END,
       CASE WHEN s.pos = h.pos THEN g.ntok WHEN s.nxt = h.pos THEN h.merged ELSE s.ntok END,
       s.step + 1
FROM state s JOIN hit h ON h.word = s.word LEFT JOIN state g ON g.pos = h.gone
WHERE s.pos <> h.gone AND s.step < {most}"""

#: All pairs of least rank, every other one where they overlap: the same as one by one up to the
#: first merge whose token makes a pair of lesser rank with a neighbour; later ones wait a step.
EVERY = """
pairs AS (
    SELECT s.word, s.pos, s.nxt, s.place, s.before, m.merged, min(m.merged) OVER (PARTITION BY s.word) AS least,
           s.place - row_number() OVER (PARTITION BY s.word, m.merged ORDER BY s.pos) AS island
    FROM (SELECT *, row_number() OVER (ORDER BY pos) AS place, lag(tok) OVER (PARTITION BY word ORDER BY pos) AS before FROM state) s
    JOIN merges m ON m.pair = (s.tok::BIGINT << 32) + s.ntok
), other AS (
    SELECT * FROM pairs WHERE merged = least QUALIFY row_number() OVER (PARTITION BY word, island ORDER BY pos) % 2 = 1
), seen AS (
    SELECT o.word, o.pos, o.nxt, o.merged, g.ntok AS behind,
           CASE WHEN lag(o.place) OVER (PARTITION BY o.word ORDER BY o.pos) = o.place - 2 THEN o.merged ELSE o.before END AS ahead
    FROM other o JOIN state g ON g.pos = o.nxt
), early AS (
    SELECT x.word, min(x.pos) AS stop
    FROM (SELECT word, pos, merged, (ahead::BIGINT << 32) + merged AS pair FROM seen UNION ALL SELECT word, pos, merged, (merged::BIGINT << 32) + behind FROM seen) x
    JOIN merges m ON m.pair = x.pair WHERE m.merged < x.merged GROUP BY x.word
), hit AS (
    SELECT p.word, p.pos, p.merged, p.nxt AS gone FROM seen p LEFT JOIN early e ON e.word = p.word WHERE e.stop IS NULL OR p.pos <= e.stop
)
SELECT s.word, s.pos, coalesce(g.nxt, s.nxt), coalesce(h.merged, s.tok),
       coalesce(n.merged, CASE WHEN h.pos IS NOT NULL THEN g.ntok ELSE s.ntok END), s.step + 1
FROM state s
JOIN (SELECT DISTINCT word FROM hit) w ON w.word = s.word
LEFT JOIN hit h ON h.pos = s.pos
LEFT JOIN state g ON g.pos = h.gone
LEFT JOIN hit n ON n.pos = coalesce(g.nxt, s.nxt) AND n.word = s.word
LEFT JOIN hit d ON d.gone = s.pos AND d.word = s.word
WHERE d.gone IS NULL AND s.step < {most}"""

DECODE = """
SELECT i.doc, string_agg(v.bytes, '' ORDER BY i.pos) AS bytes
FROM ids i JOIN vocab v ON v.id = i.id GROUP BY i.doc
"""


def chunks_of(text: str, split, by_blanks: bool = True) -> list[str]:
    """Parts of a text whose pieces, one after the other, are those of the whole text.

    Where blanks stand alone, a space starts a piece and a newline is one; other texts are
    cut into their pieces at once, and so are all texts under a pattern of the caller's own.
    """
    if not by_blanks or UNEVEN.search(text):
        return split(text)
    return [c for c in text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if c]


class Codec:
    """The vocabulary, and while it works DuckDB tables of it and a table of chunks."""

    def __init__(self, path: str, pattern: str):
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.split, self.by_blanks = regex.compile(pattern).findall, pattern == public_tokenizers.PATTERN
        merges = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        left, right, merged = (np.array(x, np.int64) for x in zip(*merges))
        self.tables = {
            "merges": pa.table({"pair": (left << 32) + right, "merged": merged.astype(np.int32)}),
            "vocab": pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "bytes": [t.decode("latin-1") for t in self.ranks]}),
        }
        self.chunks: dict[str, bytes] = {}
        self._db = None

    @property
    def db(self):
        if self._db is None:
            import duckdb

            self._db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
            for name, rows in self.tables.items():
                self._db.register("incoming", rows)
                self._db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
                self._db.unregister("incoming")
        return self._db

    def contract(self, raw: list[bytes], step: str) -> list[bytes]:
        """The ids of pieces as little-endian 32-bit integers."""
        out, first = [], 0
        while first < len(raw):
            last, n = first, 0
            while last < len(raw) and (last == first or n + len(raw[last]) <= GROUP_BYTES):
                n += len(raw[last])
                last += 1
            out += self.contract_group(raw[first:last], step, max(2, min(STEPS, MOST_ROWS // n)))
            first = last
        return out

    def contract_group(self, raw: list[bytes], step: str, most: int) -> list[bytes]:
        out = [b""] * len(raw)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        tok = self.byte[np.frombuffer(b"".join(raw), np.uint8)].astype(np.int32)
        after = np.append(tok[1:], np.int32(-1))
        after[ends - 1] = -1
        place = np.arange(len(tok), dtype=np.int32)
        seed = pa.table({"word": np.repeat(np.arange(len(raw), dtype=np.int32), sizes), "pos": place, "nxt": place + 1, "tok": tok, "ntok": after})
        if len(tok) > GROUP_BYTES:  # one long word
            self.db.execute(f"SET memory_limit = '{120 + WORD_BYTES * len(tok) // 1_000_000}MB'")
        while seed.num_rows:
            self.db.register("seed", seed)
            found = self.db.sql(CONTRACT.format(step=step.format(most=most))).to_arrow_table()
            self.db.unregister("seed")
            word, steps, pos = (found[n].to_numpy() for n in ("word", "step", "pos"))
            last = np.zeros(len(raw), np.int32)
            np.maximum.at(last, word, steps)
            at = np.flatnonzero(steps == last[word])
            at = at[np.argsort(pos[at])]  # positions ascend from word to word
            more = at[steps[at] == most]
            word, ids = word[at], found["tok"].to_numpy()[at].astype("<u4")
            blob, firsts = ids.tobytes(), np.flatnonzero(np.diff(word, prepend=-1))
            for k, first, end in zip(word[firsts].tolist(), firsts.tolist(), np.append(firsts[1:], len(word)).tolist()):
                out[k] = blob[4 * first : 4 * end]
            seed = found.take(pa.array(more)).drop_columns("step")
        if len(tok) > GROUP_BYTES:
            self.db.execute(f"SET memory_limit = '{MEMORY}'")
        return out

    def pieces_to_ids(self, words: set[str]) -> dict[str, bytes]:
        whole, parts = {}, {LEFTMOST: ([], []), EVERY: ([], [])}
        for w in words:
            if (have := self.chunks.get(w)) is not None:  # a chunk of one piece
                whole[w] = have
                continue
            b = utf8(w)
            if (rank := self.ranks.get(b)) is not None:
                whole[w] = struct.pack("<I", rank)
            else:
                names, raw = parts[LEFTMOST if len(b) <= LONG_PIECE else EVERY]
                names.append(w)
                raw.append(b)
        for step, (names, raw) in parts.items():
            whole.update(zip(names, self.contract(raw, step)))
        return whole

    def known(self, wanted: set[str]) -> dict[str, bytes]:
        """A table with the ids of all these chunks; new ones are encoded through their pieces."""
        if new := list(wanted - self.chunks.keys()):
            if len(self.chunks) + len(new) > KEEP_CHUNKS:
                old = self.chunks
                self.chunks = dict(islice(old.items(), KEEP_FIRST))
                self.chunks.update((c, old[c]) for c in wanted if c in old)
            gc.disable()  # many small lists and no cycles
            try:
                cut = list(map(self.split, new))
                ids = self.pieces_to_ids({w for words in cut for w in words})
                self.chunks.update({c: ids[words[0]] if len(words) == 1 else b"".join([ids[w] for w in words]) for c, words in zip(new, cut)})
            finally:
                gc.enable()
        return self.chunks

    def rest(self) -> None:
        """What a worker does between tasks: give memory back."""
        self.chunks = {}
        if self._db is not None:
            self._db.close()
            self._db = None
        give_back()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, chunk by chunk, as little-endian 32-bit integers."""
        cut = [chunks_of(t, self.split, self.by_blanks) if t else [] for t in texts]
        get = self.known({c for chunks in cut for c in chunks}).__getitem__
        return [b"".join(map(get, chunks)) for chunks in cut]

    def round_trip(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """(ids, what these ids decode to) of each text."""
        coded = self.encode(texts)
        return list(zip(coded, self.decode(coded)))

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids; long lists in parts."""
        parts, owner = [], []
        for k, x in enumerate(ids):
            for at in range(0, len(x), 4 * GROUP_IDS):
                parts.append(x[at : at + 4 * GROUP_IDS])
                owner.append(k)
        out, first = [[] for _ in ids], 0
        while first < len(parts):
            last, n = first, 0
            while last < len(parts) and (last == first or n + len(parts[last]) // 4 <= GROUP_IDS):
                n += len(parts[last]) // 4
                last += 1
            sizes = np.fromiter(map(len, parts[first:last]), np.int64, last - first) // 4
            rows = pa.table({"doc": np.repeat(np.arange(first, last, dtype=np.int32), sizes), "pos": np.arange(n, dtype=np.int32), "id": np.frombuffer(b"".join(parts[first:last]), "<i4")})
            self.db.register("ids", rows)
            found = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("ids")
            for part, text in sorted(zip(found["doc"].to_pylist(), found["bytes"].to_pylist())):
                out[owner[part]].append(text.encode("latin-1"))  # a character stands for a byte
            first = last
        return list(map(b"".join, out))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process, which Spark keeps for many tasks."""
    return Codec(path, pattern)


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """(path, pattern) of a public rank file; the file is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def groups(it):
    """Rows of Arrow batches, in groups of bounded size."""
    for batch in it:
        sizes = np.cumsum([0, *(n or 0 for n in pc.binary_length(batch.column(1)).to_pylist())])
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(sizes, sizes[first] + GROUP_CHARS, "right")) - 1)
            part = batch.slice(first, last - first)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()
            first = last


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids array<int>): the token ids of each text."""
    path, pattern = (path, pattern) if path else vocabulary()

    def rows(it):
        schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for keys, texts in groups(it):
            coded = codec(path, pattern).encode(texts)
            yield pa.RecordBatch.from_pydict({"id": keys, "ids": pa.array([np.frombuffer(b, "<i4") for b in coded], pa.list_(pa.int32()))}, schema=schema)
        codec(path, pattern).rest()

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(rows, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, decoded binary): the bytes that the ids stand for; null ids give none."""
    path, pattern = (path, pattern) if path else vocabulary()

    def rows(it):
        schema = pa.schema([("id", pa.int64()), ("decoded", pa.binary())])
        for batch in it:
            ids = [np.array(x if x is not None else [], "<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "decoded": codec(path, pattern).decode(ids)}, schema=schema)
        codec(path, pattern).rest()

    src = tokens.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return src.mapInArrow(rows, "id long, decoded binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode in one pass and give digests of both."""
    path, pattern = (path, pattern) if path else vocabulary()

    def rows(it):
        schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        for keys, texts in groups(it):
            both = codec(path, pattern).round_trip(texts)
            coded, plain = [x[0] for x in both], [x[1] for x in both]
            hexed = lambda xs: [hashlib.sha256(x).hexdigest() for x in xs]
            yield pa.RecordBatch.from_pydict({"id": keys, "n_tokens": [len(x) // 4 for x in coded], "ids_sha256": hexed(coded), "decoded_sha256": hexed(plain)}, schema=schema)
        codec(path, pattern).rest()

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(rows, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)

"""SentencePiece BPE: encoding by vectorised merge rounds, decoding by table lookups.

A normalised text is cut into words before every blank mark that follows another character.  The
distinct new words of a slice lie side by side in one flat numpy array of symbols.  In a round
every word finds its least pair rank and merges all pairs of this rank at once, from the left
and without overlap; then the arrays are compacted and words without a pair leave.  Where a
merge makes a pair that would come before the word's next merge, the later ones wait for the
next round, so the ids are those of one merge at a time.

Defined results: a null text counts as empty (the end id only), very long texts are encoded by
segments that end between words, repeated words and rows have equal ids, an empty table gives no
rows, columns other than the named ones are ignored or carried along.  Memory is that of a slice
of texts and of a bounded table of known words; only a single word without any blank is held
whole.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fresh, give_back

MARK = "▁"
#: Code points of a segment, and rows and bytes of a slice that is encoded together.
SEGMENT, ROWS, SIZE = 1 << 20, 512, 4 << 20
#: Distinct words and code points of them that a task remembers.
WORDS, LETTERS = 1 << 18, 4 << 20
NONE = np.iinfo(np.int32).max
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: One well-formed UTF-8 character.
CHARACTER = re.compile(rb"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The pieces ``which`` of a flat table, one after the other."""
    size = lengths[which]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[which] - ends + size, size) + np.arange(total)]


def table_of(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat, starts, lengths) of byte strings."""
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    return np.frombuffer(b"".join(items), np.uint8), np.cumsum(lengths) - lengths, lengths


@dataclass
class Known:
    """Words with their ids: word number k has ids[starts[k] : starts[k] + lengths[k]]."""

    number: dict[str, int] = field(default_factory=dict)
    ids: list[np.ndarray] = field(default_factory=list)
    lengths: list[np.ndarray] = field(default_factory=list)
    letters: int = 0
    joined: tuple | None = None

    def add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        for w in words:
            self.number[w] = len(self.number)
        self.letters += sum(map(len, words))
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.joined = None

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.joined is None:
            ids, lengths = np.concatenate(self.ids), np.concatenate(self.lengths)
            self.ids, self.lengths = [ids], [lengths]
            self.joined = ids, np.cumsum(lengths) - lengths, lengths
        return self.joined


class Pieces:
    """The vocabulary of a model file as tables.

    A model is read by the library; only BPE models that replace blanks by marks, put one before
    the text, keep all blanks and fall back to bytes are accepted, others raise.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.unknown, self.end = model.unk_id(), model.eos_id()
        self.control = np.fromiter((model.is_control(i) for i in range(n)), bool, n)
        byte = np.fromiter((model.is_byte(i) for i in range(n)), bool, n)
        if byte.sum() != 256 or any(model.is_unused(i) for i in range(n)):
            raise ValueError(f"{path}: byte fallback without unused pieces is needed")
        if model.normalize("a  Ａ ") != f"{MARK}a{MARK}{MARK}Ａ{MARK}":
            raise ValueError(f"{path}: only the identity normaliser with a mark before the text is known")
        self.byte_ids = np.zeros(256, np.int64)
        for i in np.flatnonzero(byte):
            self.byte_ids[int(BYTE.fullmatch(self.pieces[i])[1], 16)] = i
        self._merges(model, byte)
        self._runs()
        shown = [self._shown(i, bool(byte[i])) for i in range(n)]
        self.shown, self.numbers = table_of(shown), table_of([b" %d" % i for i in range(n)])
        self.byte = byte
        self.known = Known()

    def _merges(self, model, byte: np.ndarray) -> None:
        """Symbols are pieces and, above them, characters that only longer pieces have.

        ``keys`` has left * symbols + right of every pair that makes a piece, sorted.
        """
        symbols = {p: i for i, p in enumerate(self.pieces) if not (self.control[i] or byte[i] or i == self.unknown)}
        own = list(symbols.items())
        for char in sorted({c for p, _ in own for c in p} - symbols.keys()):
            symbols[char] = len(self.pieces) + len(symbols) - len(own)
        self.size = len(self.pieces) + len(symbols) - len(own)
        scores = {i: model.get_score(i) for _, i in own}
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = [(symbols[p[:k]] * self.size + symbols[p[k:]], i, ranks[scores[i]]) for p, i in own for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.keys, self.made, self.ranks = np.ascontiguousarray(table[:, 0]), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        # No piece has these two characters side by side: nothing ever merges across.
        inner = sorted({(ord(p[k]) << 21) | ord(p[k + 1]) for p, _ in own for k in range(len(p) - 1)})
        self.inner = np.array(inner, np.int64)

    def _runs(self) -> None:
        """The pattern of words, and where a run of marks longer than the longest such piece is cut.

        The cut holds where the leftmost merges of a run begin with that piece whatever follows,
        which is tried out, and where only marks are ever merged behind a mark.
        """
        only = [len(p) for p in self.pieces if set(p) == {MARK}]
        longest = max(only, default=0)
        run = lambda n: self.merge(np.full(n, self.of_char[ord(MARK)], np.int32), np.zeros(n, np.int64))[0].tolist()
        regular = longest > 1 and not any(MARK * 2 in p and set(p) != {MARK} for p in self.pieces)
        for n in range(longest + 1, 3 * longest + 2) if regular else ():
            regular = regular and run(n) == [self.pieces.index(MARK * longest), *run(n - longest)]
        last = max(self.ranks[self.made == self.pieces.index(MARK * n)].min() for n in only if n > 1) if regular else 0
        # Runs come last of all: what follows has taken its mark by then.
        regular = regular and all(self.ranks[self.made == self.pieces.index(MARK * n)].min() == last == self.ranks.max() for n in only if n > 1)
        first = f"{MARK}{{{longest}}}(?={MARK})|" if regular else ""
        # A word is a run of marks and what follows it; a piece may have a mark behind a letter.
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces)
        self.words = re.compile(f"{first}{MARK}*[^{MARK}]+|{MARK}+" if self.splits else "(?s).+")

    def _shown(self, i: int, byte: bool) -> bytes:
        if byte:
            return bytes([int(BYTE.fullmatch(self.pieces[i])[1], 16)])
        if self.control[i]:
            return b""
        return " ⁇ ".encode() if i == self.unknown else self.pieces[i].replace(MARK, " ").encode()

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; symbols below 0 and pairs that make no piece rank NONE."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.made[at], -1)

    def merge(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all segments once no pair is left, and their segment numbers (ascending)."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = self._pairs(symbols, segment)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            least = np.minimum.reduceat(rank, starts)
            own = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(symbols)]))
            live = (least < NONE)[own]
            if not live.all():
                done.append((symbols[~live], segment[~live]))
                symbols, segment, rank, made, own = symbols[live], segment[live], rank[live], made[live], own[live]
                if not len(symbols):
                    break
            at = self._leftmost(np.flatnonzero(rank == least[own]))
            at = self._in_turn(at, symbols, segment, rank, made)
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbols, segment, rank, made = symbols[keep], segment[keep], rank[keep], made[keep]
            touched = np.zeros(len(symbols), bool)
            touched[place[at]] = True
            touched[np.maximum(place[at] - 1, 0)] = True
            again = np.flatnonzero(touched)
            rank[again], made[again] = self._pairs_at(again, symbols, segment)
        if not done:
            return symbols, segment
        symbols, segment = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(segment, kind="stable")
        return symbols[order], segment[order]

    def _pairs(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._pairs_at(np.arange(len(symbols)), symbols, segment)

    def _pairs_at(self, at: np.ndarray, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pair that starts at each of these places."""
        if not len(symbols):
            return np.empty(0, np.int32), np.empty(0, np.int32)
        after = np.minimum(at + 1, len(symbols) - 1)
        rank, made = self.pair(symbols[at], symbols[after])
        last = (after == at) | (segment[after] != segment[at])
        rank[last] = NONE
        return rank, made

    @staticmethod
    def _leftmost(at: np.ndarray) -> np.ndarray:
        """Of neighbours in a row, the first, third and so on."""
        starts = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        begin = np.repeat(at[starts], np.diff(np.r_[starts, len(at)]))
        return at[(at - begin) % 2 == 0]

    def _in_turn(self, at: np.ndarray, symbols: np.ndarray, segment: np.ndarray, rank: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Merges of a segment up to the first whose new pair comes before the next merge."""
        n, own = len(symbols), segment[at]
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, n - 1)
        left = symbols[before]
        chained = np.r_[False, (np.diff(at) == 2)]  # the left neighbour has just been merged
        left = np.where(chained, made[np.maximum(at - 2, 0)], left)
        on_left, _ = self.pair(left, made[at])
        on_left[(at == 0) | (segment[before] != own)] = NONE
        on_right, _ = self.pair(made[at], symbols[after])
        on_right[(at + 2 >= n) | (segment[after] != own)] = NONE
        early = np.minimum(on_left, on_right) <= rank[at]
        if not early.any():
            return at
        seen = np.cumsum(early) - early
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        base = np.repeat(seen[starts], np.diff(np.r_[starts, len(at)]))
        return at[seen == base]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word) of words that are not empty."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        key = (codes[:-1] << 21) | codes[1:]
        found = self.inner[np.minimum(np.searchsorted(self.inner, key), len(self.inner) - 1)] == key if len(self.inner) else np.zeros(len(key), bool)
        segment = np.cumsum(np.r_[False, ~found | (word[1:] != word[:-1])])
        known = self.of_char[codes]
        symbols = np.where(known >= 0, known, -1 - codes).astype(np.int32)
        of_segment = word[np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])] if len(segment) else word
        symbols, segment = self.merge(symbols, segment)
        word = of_segment[segment]
        return self._bytes(symbols.astype(np.int64), word, len(words))

    def _bytes(self, symbols: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become those of their bytes."""
        lone = (symbols < 0) | (symbols >= len(self.pieces))
        if lone.any():
            char = {v: k for k, v in enumerate(self.of_char) if v >= len(self.pieces)} if (symbols >= len(self.pieces)).any() else {}
            which, inverse = np.unique(symbols[lone], return_inverse=True)
            spelled = [self.byte_ids[np.frombuffer(chr(-1 - s if s < 0 else char[s]).encode(), np.uint8)] for s in which.tolist()]
            lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
            times = np.ones(len(symbols), np.int64)
            times[lone] = lengths[inverse]
            word = np.repeat(word, times)
            out = np.repeat(symbols, times)
            out[np.repeat(lone, times)] = gather(np.concatenate(spelled), np.cumsum(lengths) - lengths, lengths, inverse)
            symbols = out
        return symbols, np.bincount(word, minlength=n)

    def segments(self, text: str):
        """The normalised text in parts that end between words."""
        text, at = MARK + text.replace(" ", MARK) if text else "", 0
        while at < len(text):
            stop = at + SEGMENT
            if self.splits:
                while stop < len(text) and not (text[stop] == MARK and text[stop - 1] != MARK):
                    stop += 1
            else:
                stop = len(text)
            yield text[at:stop]
            at = stop

    def encode_parts(self, parts: list[str]) -> list[np.ndarray]:
        """The ids of normalised parts; new words are encoded together."""
        if len(self.known.number) > WORDS or self.known.letters > LETTERS:
            self.known = Known()
        known = self.known
        cut = [self.words.findall(p) for p in parts]
        number = known.number
        new = list({w: None for words in cut for w in words if w not in number})
        if new:
            known.add(new, *self.encode_words(new))
        if not number:
            return [np.empty(0, np.int64) for _ in parts]
        tables = known.tables()
        return [gather(*tables, np.fromiter(map(number.__getitem__, words), np.int64, len(words))) for words in cut]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, the end id last."""
        out = [[] for _ in texts]
        for row, _, ids in row_parts(self, texts):
            out[row] += ids.tolist()
        return [ids + [self.end] for ids in out]

    def decoded(self, ids: np.ndarray, first: bool = True) -> bytes:
        """UTF-8 of ids; ``first`` takes the blank of the first piece off; broken bytes become U+FFFD."""
        control = self.control[ids]
        if control.any():  # bytes on both sides of such an id make no character
            inner = np.split(ids, np.flatnonzero(control))
            parts = [x[self.control[x].argmin() :] if len(x) and not self.control[x].all() else x[:0] for x in inner]
            parts = [x for x in parts if len(x)]
            return b"".join(self.decoded(x, first and k == 0) for k, x in enumerate(parts))
        out = gather(*self.shown, ids).tobytes()
        if first and len(ids) and not self.byte[ids[0]] and self.pieces[ids[0]].startswith(MARK):
            out = out[1:]
        try:
            out.decode()
            return out
        except UnicodeDecodeError:
            good, at = [], 0
            while at < len(out):
                m = CHARACTER.match(out, at)
                good.append(m[0] if m else "\ufffd".encode())
                at += len(m[0]) if m else 1
            return b"".join(good)

    def decode(self, ids: list[int]) -> str:
        return self.decoded(np.asarray(ids, np.int64)).decode()


def load(path: str, cache: dict = {}) -> Pieces:
    """The tables of a model file, kept for the life of a worker."""
    if path not in cache:
        cache[path] = Pieces(path)
    return cache[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def slices(batch: pa.RecordBatch):
    """Parts of a batch with few rows and about ``SIZE`` bytes."""
    step = max(1, min(ROWS, SIZE * batch.num_rows // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def row_parts(model: Pieces, texts: list[str | None]):
    """(row, first, ids of a part) in order; parts of short texts are encoded together."""
    held, letters = [], 0

    def flush():
        nonlocal held, letters
        for (row, first, _), ids in zip(held, model.encode_parts([p for _, _, p in held])):
            yield row, first, ids
        held, letters = [], 0

    for row, text in enumerate(texts):
        for k, part in enumerate(model.segments(text or "")):
            if held and letters + len(part) > SEGMENT:
                yield from flush()
            held.append((row, k == 0, part))
            letters += len(part)
    if held:
        yield from flush()


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """All columns and the ids of a text column, the end id last."""
    path = path or default_model()
    (out,) = fresh(docs, out)

    def run(batches):
        model = load(path)
        for batch in batches:
            for part in slices(batch):
                lists = [[] for _ in range(part.num_rows)]
                for row, _, ids in row_parts(model, part.column(text).to_pylist()):
                    lists[row].append(ids)
                values = pa.array([np.r_[(*x, [model.end])].astype(np.int32) for x in lists], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, values], names=[*part.schema.names, out])
        give_back()

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, `{out}` array<int>")


def decode(docs: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """All columns and the text of a column of ids; null stands for no ids."""
    path = path or default_model()
    (out,) = fresh(docs, out)

    def run(batches):
        model = load(path)
        for batch in batches:
            for part in slices(batch):
                texts = [model.decode(x or []) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])
        give_back()

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, `{out}` string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what is hashed last is decoded from the ids."""
    path = path or default_model()
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        model = load(path)
        tail = b" %d" % model.end
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                counts, hashes = [1] * len(texts), [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
                begun = [False] * len(texts)
                for row, first, ids in row_parts(model, texts):
                    said = gather(*model.numbers, ids).tobytes()
                    hashes[row][0].update(said[1:] if first else said)
                    hashes[row][1].update(model.decoded(ids, first))
                    counts[row] += len(ids)
                    begun[row] = True
                for row, on in enumerate(begun):
                    hashes[row][0].update(tail if on else tail[1:])
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array([a.hexdigest() for a, _ in hashes]), pa.array([b.hexdigest() for _, b in hashes])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

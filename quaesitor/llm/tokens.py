"""Token counts (2): a word-end byte-pair tokenizer compiled to finite-state transducers.

Two machines. The first cuts the normalised text into pieces by character class
with one character behind and two ahead. The second reads the bytes of a piece,
the last one marked as such, and emits with each byte the change in the number
of tokens. Its state is what the encodings of the piece's prefixes can still
lend to a longer token: the longest suffix read that begins some token, and for
each place in it the last token of the encoding up to there and the count
relative to now. There are finitely many of these; they are compiled when first
reached and kept in a table, which is begun anew when it reaches its size limit.

A text is read in chunks in parallel. After the mark of a piece's end the state
is the initial one, so the map of a chunk from entry states to exit states is
constant behind its first mark; the part before it is read once the exit state
of the chunk to the left is known. Counts are composed by a prefix sum.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: What the tokenizer takes for white space and its contractions after an apostrophe.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT, LONG = "stmd", ("re", "ve", "ll")
SPACE, LETTER, DIGIT, OTHER = range(4)
END = 256  # added to a piece's last byte
CHUNK = 256
#: Characters read at once, and bytes of a transducer's table.
SLICE, TABLE_BYTES = 1 << 22, 128 << 20


@functools.cache
def char_classes() -> np.ndarray:
    of = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            of[cp] = LETTER
        elif kind == "N":
            of[cp] = DIGIT
    of[WHITE] = SPACE
    return of


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """The piece machine of a byte-pair tokenizer with word ends, compiled as it is used."""

    def __init__(self, merges: Iterable[tuple[str, str]], suffix: str):
        at = byte_symbols()

        def symbols(token: str) -> str:
            body = token.removesuffix(suffix)
            out = [at[c] for c in body]
            if token != body:
                out[-1] += END
            return "".join(map(chr, out))

        self.rank = {(symbols(a), symbols(b)): k for k, (a, b) in enumerate(merges)}
        self.tokens = {chr(s) for s in range(2 * END)} | {a + b for a, b in self.rank}
        self.begins = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.restart()

    def restart(self) -> None:
        self.fits.clear()
        # a state: (suffix read, last tokens, counts relative to the last) for the places from before the suffix to now
        self.states = [("", (None,), (0,))]
        self.number = {self.states[0]: 0}
        self.column = np.full(2 * END, -1, np.int32)
        self.next = np.full((1024, 64), -1, np.int32)
        self.emits = np.zeros((1024, 64), np.int16)
        self.columns = 0

    def encode(self, piece: str) -> list[str]:
        """By the definition: the lowest-ranked, leftmost merge first."""
        parts = list(piece)
        while len(parts) > 1:
            rank, k = min((self.rank.get(p, 1 << 30), k) for k, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _follows(self, before: str | None, token: str) -> bool:
        if before is None:
            if token not in self.whole:
                self.whole[token] = self.encode(token) == [token]
            return self.whole[token]
        if (before, token) not in self.fits:
            self.fits[before, token] = self.encode(before + token) == [before, token]
        return self.fits[before, token]

    def compile(self, state: int, symbol: int) -> None:
        """Fills the transition of `state` under `symbol`."""
        suffix, last, count = self.states[state]
        read = suffix + chr(symbol)
        for size in range(len(read), 0, -1):
            token = read[-size:]
            if token in self.tokens and self._follows(last[len(read) - size], token):
                now = count[len(read) - size] + 1
                break
        if symbol >= END:
            target = 0
        else:
            keep = next(k for k in range(len(read), -1, -1) if k == 0 or read[-k:] in self.begins)
            last, count = (*last, token), (*count, now)
            to = (read[len(read) - keep :], last[len(last) - keep - 1 :], tuple(c - now for c in count[len(count) - keep - 1 :]))
            target = self.number.setdefault(to, len(self.states))
            if target == len(self.states):
                self.states.append(to)
        if self.column[symbol] < 0:
            self.column[symbol] = self.columns
            self.columns += 1
        rows, columns = self.next.shape
        grown = (2 * rows if len(self.states) > rows else rows, 2 * columns if self.columns > columns else columns)
        if grown != (rows, columns):
            for name, fill in (("next", -1), ("emits", 0)):
                old = getattr(self, name)
                new = np.full(grown, fill, old.dtype)
                new[:rows, :columns] = old
                setattr(self, name, new)
        self.next[state, self.column[symbol]] = target
        self.emits[state, self.column[symbol]] = now

    def advance(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and emitted counts of many lanes at once."""
        to = self.next[states, self.column[symbols]]
        missing = (to < 0) | (self.column[symbols] < 0)
        if missing.any():
            for pair in np.unique(states[missing].astype(np.int64) * 2 * END + symbols[missing]).tolist():
                self.compile(*divmod(pair, 2 * END))
            to = self.next[states, self.column[symbols]]
        return to, self.emits[states, self.column[symbols]]

    def counts(self, symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Running token counts before each symbol of a stream of whole pieces, and after the last."""
        if self.next.nbytes + self.emits.nbytes > TABLE_BYTES:
            self.restart()
        n = len(symbols)
        emitted = np.zeros(n, np.int16)
        if n:
            begin = np.arange(0, n, chunk)
            end = np.minimum(begin + chunk, n)
            fresh = np.flatnonzero(np.concatenate(([True], symbols[:-1] >= END)))
            first = np.append(fresh, n)[np.searchsorted(fresh, begin)]
            known = first < end  # the map is constant: what is read behind the first mark doesn't depend on the entry
            leave = np.zeros(len(begin), np.int64)

            def read(lanes: np.ndarray, start: np.ndarray, stop: np.ndarray, states: np.ndarray) -> np.ndarray:
                states = states.copy()
                live = np.arange(len(lanes))
                at = start.copy()
                while len(live := live[at[live] < stop[live]]):
                    states[live], emitted[at[live]] = self.advance(states[live], symbols[at[live]].astype(np.int64))
                    at[live] += 1
                return states

            lanes = np.flatnonzero(known)
            leave[lanes] = read(lanes, first[lanes], end[lanes], np.zeros(len(lanes), np.int64))
            todo = begin < np.minimum(first, end)  # heads, composed as soon as the chunk to the left is known
            while todo.any():
                lanes = np.flatnonzero(todo & np.concatenate(([True], known[:-1])))
                got = read(lanes, begin[lanes], np.minimum(first, end)[lanes], leave[lanes - 1])
                through = ~known[lanes]
                leave[lanes[through]] = got[through]
                known[lanes] = True
                todo[lanes] = False
        return np.concatenate(([0], np.cumsum(emitted, dtype=np.int64)))


def piece_ends(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kept, last): which characters of a normalised text belong to a piece, and which end one."""
    kind = char_classes()[cp]
    n = len(cp)
    ahead = np.concatenate((cp, [0x20, 0x20]))
    before = np.concatenate(([SPACE], kind[:-1]))
    start = (kind != before) | (kind == DIGIT)
    quote = np.flatnonzero((cp == ord("'")) & (before != OTHER))
    one = np.isin(ahead[quote + 1], [ord(c) for c in SHORT])
    two = np.zeros(len(quote), bool)
    for a, b in LONG:
        two |= (ahead[quote + 1] == ord(a)) & (ahead[quote + 2] == ord(b))
    inside, after = quote[one | two] + 1, np.concatenate((quote[one] + 2, quote[two] + 3))
    start[inside] = False
    start[after[after < n]] = True
    kept = kind != SPACE
    return kept, kept & np.concatenate((start[1:] | ~kept[1:], [True]))[:n]


def normalised(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # capital sigma is lowered alike at a word's end
    return text.lower()


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all pieces of `texts`, and where each text begins in them, with the end."""
    norm = [normalised(t) for t in texts]
    joined = " ".join(norm) + " "
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in norm]))).astype(np.int64)
    kept, last = piece_ends(cp)
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    raw = np.frombuffer(joined.encode("utf-8"), np.uint8).astype(np.uint16)
    raw[(np.cumsum(width) - 1)[last]] += END
    of = np.concatenate(([0], np.cumsum(np.where(kept, width, 0))))
    return raw[np.repeat(kept, width)], of[starts]


class Counter:
    """Counts tokens as the tokenizer of a .json file does, without added special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.machine = Transducer([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]], spec["model"]["end_of_word_suffix"])

    def _slices(self, text: str) -> Iterable[str]:
        """`text` in parts of about SLICE characters, cut behind white space only."""
        begin = 0
        while len(text) - begin > SLICE:
            cut = re.compile(r"[\t-\r ]").search(text, begin + SLICE)
            if not cut:
                break
            yield text[begin : cut.end()]
            begin = cut.end()
        yield text[begin:]

    def count(self, texts: Iterable[str | None]) -> list[int]:
        texts = list(texts)
        out = [0] * len(texts)
        parts: list[str] = []
        owner: list[int] = []
        size = 0

        def flush():
            nonlocal parts, owner, size
            symbols, at = stream(parts)
            total = self.machine.counts(symbols)[at]
            for k, n in zip(owner, np.diff(total).tolist()):
                out[k] += n
            parts, owner, size = [], [], 0

        for k, text in enumerate(texts):
            for m, part in enumerate(self.special.split(text or "")):
                out[k] += m > 0  # a special string inside a text is one token and parts what stands around it
                for piece in self._slices(part):
                    parts.append(piece)
                    owner.append(k)
                    size += len(piece)
                    if size > SLICE:
                        flush()
        flush()
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    `vocabulary` names a file of `public_tokenizers`, found on each executor. Null
    texts count as empty; repeated rows and null ids stay as they are; other
    columns are not read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def count(texts):
        import pandas as pd
        import public_tokenizers

        return pd.Series(counter(public_tokenizers.path(vocabulary)).count(texts), dtype="int64")

    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), count(F.col(text_col)).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

"""Token counts at every prefix of a text, by dynamic programming over byte-pair tokens.

The encoding of a prefix of a piece ends in exactly one token that may follow the last token of the shorter prefix
before it, so one left-to-right pass gives the count at every prefix. A stored table of counts then answers budget and
truncation questions without encoding again.

Cases: a null text counts as empty; an empty text has 0 tokens and an empty table; the string of an added token is that
one token wherever it stands, as the tokenizer does by default; repeated rows give repeated rows; an empty table gives an
empty table; other columns of the input are not read, and columns with the names of the outputs do not clash.
"""

from __future__ import annotations

import functools
import json
import sys
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

#: The word pattern of byte-level byte-pair vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 250_000
#: Marks that never join a word before them; they are bytes, so tokens.
SINGLE = frozenset(".,;:!?)")
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, n_chars bigint, cut_chars bigint, prefix_deltas binary"


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    hidden = (b for b in range(256) if b not in set(printable))
    return letters | {chr(256 + i): b for i, b in enumerate(hidden)}


class Recent(dict):
    """Remembers what ``make`` gave for a key, in two generations of bounded size."""

    def __init__(self, make, most: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(key) <= 64:  # long keys are not worth their memory
            self[key] = value
        return value


class BytePairs:
    """Vocabulary of a byte-level tokenizer file, with encoding and prefix tables of texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letters = _byte_letters()
        added = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.ranks = {bytes(letters[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in added}
        self.added = added
        self.tokens = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.piece = self.tokens._core_bpe.encode_single_piece
        self.split_pieces = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.leading = regex.compile(r"\p{White_Space}*").match
        self.split_added = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")").split if added else None
        self.token = {i: token for token, i in self.ranks.items()}
        self.suffixes = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.suffixes.add_word(token.decode("latin-1"), (i, len(token)))
        self.suffixes.make_automaton()
        self.follows = Recent(self._follows, 400_000)
        self.piece_ids = Recent(lambda piece: np.array(self.piece(piece.encode()), dtype="<u4").tobytes(), 100_000)
        self.chunk_ids = Recent(self._chunk_ids, 400_000)
        self.pieces = Recent(self._piece_counts, 100_000)
        self.chunk_counts = Recent(self._chunk_counts)

    def _chunks(self, text: str) -> tuple[str, list[str], str] | None:
        """First word, words that each follow one space, white space at the end; None where words are not cut by single spaces."""
        body = text.rstrip(" \t\n\r")
        first, *rest = body.split(" ")
        return (first, rest, text[len(body):]) if first and not first[-1].isspace() and all(rest) else None

    # ids -------------------------------------------------------------------------------------------------------------
    def _split_ids(self, text: str) -> bytes:
        return b"".join(map(self.piece_ids.__getitem__, self.split_pieces(text)))

    def _chunk_ids(self, chunk: str) -> bytes | None:
        if chunk.isalpha():
            return np.array(self.piece((" " + chunk).encode()), dtype="<u4").tobytes()
        return None if chunk[0].isspace() or chunk[-1].isspace() else self._split_ids(" " + chunk)

    def _plain_ids(self, text: str) -> bytes:
        if not text:
            return b""
        if cut := self._chunks(text):
            ids = list(map(self.chunk_ids.__getitem__, cut[1]))
            if None not in ids:
                return self._split_ids(cut[0]) + b"".join(ids) + (self.piece_ids[cut[2]] if cut[2] else b"")
        return self._split_ids(text)

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.split_added is None or not any(x in text for x in self.added):
            return self._plain_ids(text)
        return b"".join(np.array([self.added[x]], dtype="<u4").tobytes() if x in self.added else self._plain_ids(x) for x in self.split_added(text))

    # counts at prefixes ----------------------------------------------------------------------------------------------
    def _follows(self, pair: tuple[int, int]) -> bool:
        """Whether the second token may stand behind the first: together they are encoded as themselves."""
        return self.piece(self.token[pair[0]] + self.token[pair[1]]) == list(pair)

    def _byte_counts(self, data: bytes) -> list[int]:
        """Tokens of data[:i] for i = 1, 2, ..., shortest first.

        An automaton names the tokens that end at a byte; of these exactly one may follow the last token of the prefix
        before it, and its end and count are those of the prefix.
        """
        follows, last, counts = self.follows, [], []
        for end, (token, size) in self.suffixes.iter(data.decode("latin-1")):
            if end < len(last):  # found for this prefix
                continue
            before = end - size
            if before < 0:
                last.append(token)
                counts.append(1)
            elif follows[last[before], token]:
                last.append(token)
                counts.append(counts[before] + 1)
        if len(counts) < len(data):
            raise ValueError("a byte is missing from the vocabulary")
        return counts

    def _piece_counts(self, piece: str) -> list[int]:
        """Tokens of each prefix of a piece, by code points."""
        if piece in ("'re", "'ve", "'ll"):  # shorter, these are two pieces
            return [1, 2, 1]
        data = piece.encode()
        counts = self._byte_counts(data)
        return counts if len(data) == len(piece) else [n for n, octet in zip(counts, [*data[1:], 0], strict=True) if octet & 0xC0 != 0x80]

    def _plain_counts(self, text: str) -> list[int]:
        """Counts at the prefixes of a text without added tokens."""
        out, total, run, run_base = [], 0, "", 0
        for piece in self.split_pieces(text):
            local = self.pieces[piece]
            spaces = 0 if piece[0].isalnum() else self.leading(piece).end()
            if run and spaces:  # a prefix that ends in white space has all of its run as one piece
                whole = self.pieces[run + piece[:spaces]][len(run):]
                out += [n + run_base for n in whole]
                out += [n + total for n in local[spaces:]]
            else:
                out += [n + total for n in local] if total else local
                if spaces:
                    run_base = total
            run = run + piece if spaces == len(piece) else ""
            total += local[-1]
        return out

    def _chunk_counts(self, chunk: str) -> tuple[bytes, int] | None:
        if chunk.isalpha():
            local = self._piece_counts(" " + chunk)
        elif chunk[-1] in SINGLE and chunk[:-1].isalpha():  # a word, and a mark that is a piece and a token of its own
            known, total = self.chunk_counts[chunk[:-1]]
            return known + (total + 1).to_bytes(4, sys.byteorder), total + 1
        elif chunk[0].isspace() or chunk[-1].isspace():
            return None
        else:
            local = self._plain_counts(" " + chunk)
        return array("i", local).tobytes(), local[-1]

    def _section_counts(self, text: str) -> np.ndarray:
        cut = self._chunks(text)
        tables = list(map(self.chunk_counts.__getitem__, cut[1])) if cut else [None]
        if None in tables:
            return np.array(self._plain_counts(text), dtype=np.int32)
        first, rest, tail = cut
        head = self._plain_counts(first)
        ends = np.cumsum(np.fromiter((x[1] for x in tables), np.int32, len(tables)), dtype=np.int32) + head[-1]
        sizes = np.fromiter(map(len, rest), np.int64, len(rest)) + 1
        local = np.frombuffer(b"".join([x[0] for x in tables]), dtype=np.int32)
        total = ends[-1] if rest else head[-1]
        return np.concatenate([head, local + np.repeat(np.append(head[-1], ends[:-1]), sizes) if rest else local, np.add(self.pieces[tail] if tail else [], total)]).astype(np.int32)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for i = 1, 2, ..., len(text)."""
        if self.split_added is None or not any(x in text for x in self.added):
            return self._section_counts(text) if text else np.zeros(0, dtype=np.int32)
        parts, total, sections = [], 0, self.split_added(text)
        for section, token in zip(sections[::2], [*sections[1::2], ""], strict=True):
            counts = self._section_counts(section + token) if section + token else np.zeros(0, dtype=np.int32)
            if token:  # only the whole string is the added token
                counts = np.append(counts[:-1], (int(self._section_counts(section)[-1]) if section else 0) + 1)
            parts.append(counts + total)
            total += int(counts[-1]) if len(counts) else 0
        return np.concatenate(parts)


@functools.lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


def pack_counts(counts: np.ndarray) -> bytes:
    """A table as steps of two bytes: a code point changes the count by little."""
    return np.diff(counts, prepend=0).astype("<i2").tobytes()


def unpack_counts(table: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(table, dtype="<i2"), dtype=np.int64)


def tokens_at(table: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` code points, from a stored table."""
    return int(unpack_counts(table)[chars - 1]) if chars else 0


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def token_prefixes(docs: DataFrame, tokenizer: str, budget: int = 512, stored: bool = True) -> DataFrame:
    """Per document its bytes, tokens, the longest prefix within ``budget`` tokens, and the table of counts at all prefixes.

    ``prefix_deltas`` is read with ``unpack_counts`` and ``tokens_at``; it is null unless ``stored``. One pass, no shuffle; a task holds one batch of
    texts and a bounded memory of frequent words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(tokenizer)
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                text = text or ""
                counts = pairs.prefix_counts(text)
                total = int(counts[-1]) if len(counts) else 0
                rows.append((key, len(text.encode()), total, len(text),
                             len(text) if total <= budget else longest_prefix(counts, budget), pack_counts(counts) if stored else None))
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)],
                                             ["doc_id", "n_bytes", "n_tokens", "n_chars", "cut_chars", "prefix_deltas"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(count, SCHEMA)

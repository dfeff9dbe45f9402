"""Token ids with the public byte-level BPE vocabularies, by cached pieces.

Their pattern never joins a single white space character to what stands before
it, so a text may be cut before each one and the pieces encoded one by one: the
ids are those of the whole text. Most pieces occur again and again, so each
worker keeps a bounded cache of them and hands only new ones to the tokenizer.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE_RUN = re.compile(r"\s\s")
_SPACE = re.compile(r"\s")
#: Marks that may follow a word.
_MARKS = ".,;:!?"
#: Ids as little-endian unsigned 32-bit numbers, by how many there are.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(12)]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 for itself, the others, in order, for the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(other)}


_BYTE_LETTERS = _byte_letters()


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _tiktoken(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def encoder(path: str) -> "PieceEncoder":
    """One encoder for each worker process, kept between its tasks."""
    return PieceEncoder(path)


class PieceEncoder:
    """Encodes batches of texts with one tokenizer file (.json or .tiktoken).

    The cache maps a piece to its ids as little-endian unsigned 32-bit numbers
    and is emptied when it holds more than ``limit`` pieces."""

    def __init__(self, path: str, limit: int = 700_000):
        self._path, self._limit = path, limit
        self._ids: dict[str, bytes] = {}
        self._first: dict[str, bytes] = {}
        self._special: tuple[str, ...] = ()
        if path.endswith(".json"):
            self._special = tuple(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())
        self._merges = _tokenizer(path).model if path.endswith(".json") else None
        self._tails: dict[str, bytes] = {}
        self._newline = self._whole("\n")
        self._break = np.array(self._newline, np.uint32).tobytes()

    def _whole(self, text: str) -> list[int]:
        if self._path.endswith(".json"):
            return _tokenizer(self._path).encode(text, add_special_tokens=False).ids
        return _tiktoken(self._path).encode_ordinary(text)

    def _learn(self, known: dict[str, bytes], pieces: list[str], lead: str) -> list[bytes]:
        """Ids of new pieces, each after ``lead`` (one that starts with a newline:
        as it is).

        A word with marks after it is two of the pattern's matches, so its letters
        go straight to the vocabulary's merges. Of the others, many without white
        space are encoded at a time, on a line each; the newlines' ids separate
        their ids."""
        out: list[bytes | None] = [None] * len(pieces)
        space = _BYTE_LETTERS[32] if lead else ""
        rest = []
        for i, p in enumerate(pieces):
            word = p.rstrip(_MARKS)
            if self._merges is not None and word.isalpha():
                marked = len(word) < len(p)
                raw = known.get(word) if marked else None
                if raw is None:
                    letters = space + word if word.isascii() else space + word.encode().decode("latin-1").translate(_BYTE_LETTERS)
                    ids = [t.id for t in self._merges.tokenize(letters)]
                    raw = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, np.uint32).tobytes()
                out[i] = raw + self._tail(p[len(word) :]) if marked else raw
            elif p[:1] == "\n":
                out[i] = self._break + self._look_up(self._first, [p[1:]], "")[0]
            elif p and not _SPACE.search(p):
                rest.append(i)
            else:
                out[i] = np.array(self._whole(lead + p), np.uint32).tobytes()
        for k in range(0, len(rest), 2000):
            some = [pieces[i] for i in rest[k : k + 2000]]
            ids = np.array(self._whole(lead + ("\n" + lead).join(some)), np.uint32)
            cuts = np.flatnonzero(ids == self._newline[0])
            if len(self._newline) != 1 or len(cuts) != len(some) - 1:
                raw = [np.array(self._whole(lead + p), np.uint32).tobytes() for p in some]
            else:
                raw = [x.tobytes() for x in np.split(ids, cuts)]
                raw[1:] = [x[4:] for x in raw[1:]]
            for i, x in zip(rest[k : k + 2000], raw, strict=True):
                out[i] = x
        return out

    def _tail(self, marks: str) -> bytes:
        found = self._tails.get(marks)
        if found is None:
            if len(self._tails) > 10_000:
                self._tails.clear()
            found = self._tails[marks] = np.array(self._whole(marks), np.uint32).tobytes()
        return found

    def _look_up(self, known: dict[str, bytes], pieces: list[str], lead: str) -> list[bytes]:
        found = list(map(known.get, pieces))
        if None in found:
            at = [i for i, x in enumerate(found) if x is None]
            new = [pieces[i] for i in at]
            for i, p, x in zip(at, new, self._learn(known, new, lead), strict=True):
                found[i] = known[p] = x
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and how many each has.

        Texts with two white space characters in a row, or with a special token's string
        (where the library cuts), are encoded on their own."""
        for known in (self._ids, self._first):
            if len(known) > self._limit:
                known.clear()
        plain = [i for i, t in enumerate(texts) if not _SPACE_RUN.search(t) and not any(s in t for s in self._special)]
        lengths = np.zeros(len(texts), np.int64)
        flat = np.empty(0, np.uint32)
        if plain:
            lists = pc.split_pattern(pa.array([texts[i].replace("\n", " \n") for i in plain], pa.large_string()), " ")
            starts = lists.offsets.to_numpy()[:-1]
            pieces = lists.flatten()
            coded = pieces.dictionary_encode()
            index = coded.indices.to_numpy().copy()
            first = pieces.take(pa.array(starts)).to_pylist()
            index[starts] = len(coded.dictionary) + np.arange(len(first))
            ids = self._look_up(self._ids, coded.dictionary.to_pylist(), " ") + self._look_up(self._first, first, "")
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            table, at = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(n) - n
            n_of = n[index]
            shift = at[index] - (np.cumsum(n_of) - n_of)
            flat = table[np.repeat(shift, n_of) + np.arange(n_of.sum())]
            lengths[plain] = np.add.reduceat(n_of, starts)
        if len(plain) < len(texts):
            parts, own, rest = [], np.cumsum(lengths), set(plain)
            for i, t in enumerate(texts):
                if i in rest:
                    parts.append(flat[own[i] - lengths[i] : own[i]])
                else:
                    parts.append(np.array(self._whole(t), np.uint32))
            lengths, flat = np.array([len(p) for p in parts], np.int64), np.concatenate(parts)
        return flat, lengths

    def encode_slices(self, texts: list[str], limit: int = 6_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, ids, lengths) for runs of texts of about ``limit``
        characters, so working memory does not follow the batch size."""
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= limit or i == len(texts) - 1:
                yield (start, i + 1, *self.encode(texts[start : i + 1]))
                start, size = i + 1, 0

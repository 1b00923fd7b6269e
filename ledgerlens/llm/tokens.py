"""Vectorised words: boundaries and 64-bit hashes of all words of many texts at once, in pieces of bounded size.

A word is a run of letters a-z, digits and bytes above 127, after lower-casing A-Z. The hash of bytes s..e is
(H[e] - H[s]) * P^-s modulo 2^64, where H sums byte * P^position: one pass gives every substring's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
P = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_CACHE: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0..P^(n-1) and their inverses modulo 2^64."""
    if len(_CACHE.get("up", ())) < n:
        most = max(n, PIECE + 64)
        _CACHE["up"], _CACHE["down"] = _powers(P, most), _powers(pow(P, -1, 1 << 64), most)
    return _CACHE["up"][:n], _CACHE["down"][:n]


def _letters() -> np.ndarray:
    """For each byte its lower-cased value, or 0 where words end."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        c = b + 32 if 65 <= b <= 90 else b
        if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128:
            out[b] = c
    return out


LETTERS = _letters()


def _unblank() -> np.ndarray:
    """For each byte its lower-cased value and one, or 0 where it is a blank."""
    out = np.arange(1, 257, dtype=np.uint16)
    out[65:91] += 32
    out[[9, 10, 11, 12, 13, 32]] = 0
    return out


UNBLANK = _unblank()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xD6E8FEB86659FD93)


class Words:
    """starts, ends (byte positions in codes) and hashes of the words of one piece."""

    def __init__(self, raw: bytes, letters: np.ndarray = LETTERS):
        codes = letters[np.frombuffer(raw, np.uint8)]
        inside = np.empty(len(codes) + 2, np.bool_)
        inside[0] = inside[-1] = False
        np.not_equal(codes, 0, out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.codes, self.starts, self.ends = codes, edge[0::2], edge[1::2]
        up, self.down = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[:-1], out=self.sums[1:])
        self.hashes = mixed(self.span(self.starts, self.ends))

    def span(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (self.sums[e] - self.sums[s]) * self.down[s]


def pieces(raw: bytes, letters: np.ndarray = LETTERS) -> Iterator[bytes]:
    """raw in parts of about PIECE bytes, cut where no word is."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and letters[raw[end]]:  # a word may be longer than a piece
            end += 1
        yield raw[at:end]
        at = end


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts are together about size bytes, or one longer text; null is empty."""
    for batch in batches:
        col = batch.column(text)
        begin, held, texts = 0, 0, []
        for i in range(batch.num_rows):
            one = (col[i].as_py() or "").encode()
            texts.append(one)
            held += len(one)
            if held >= size or i + 1 == batch.num_rows:
                yield batch.slice(begin, i + 1 - begin), texts
                begin, held, texts = i + 1, 0, []


def word_hashes(texts: list[bytes], letters: np.ndarray = LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's begin (one more entry than texts)."""
    if sum(map(len, texts)) <= 2 * PIECE:
        words = Words(b"\n".join(texts), letters)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return words.hashes, np.searchsorted(words.starts, begins)
    each = [np.concatenate([Words(p, letters).hashes for p in pieces(t, letters)] or [np.zeros(0, np.uint64)]) for t in texts]
    return np.concatenate(each), np.cumsum([0, *map(len, each)])

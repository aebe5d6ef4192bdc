"""Words and hashes of whole Arrow batches of texts, in NumPy.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D. Hashes are 64 bits wide, the same on every machine.
Texts of any length are cut into blocks of about BLOCK bytes at white space, so memory follows words, not bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 17
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0xD6E8FEB86659FD93  # 3 modulo 8
_ODD2 = 0xC2B2AE3D27D4EB4B  # 3 modulo 8


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def byte_table(seed: int, lower: bool) -> np.ndarray:
    """A random number for each byte; with lower, A-Z count as a-z."""
    t = mix(np.arange(1, 257, dtype=np.uint64) * _STEP + np.uint64(seed))
    if lower:
        t[65:91] = t[97:123]
    return t


def spaces() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[32, *range(9, 14)]] = True
    return t


class Powers:
    """Powers of an odd number modulo 2**64 and their inverses, as far as asked for."""

    def __init__(self, odd: int):
        self.odd, self.n = odd, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 12)
            self.pow, self.inv = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n - 1, x, np.uint64)])) for x in (self.odd, pow(self.odd, -1, 1 << 64)))
        return self.pow, self.inv


def string_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary array, without a copy; nulls are empty."""
    wide = "large" in str(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    if column.null_count:  # a null's bytes, if any, aren't read
        lens = np.diff(off)
        gone = np.asarray(column.is_null())
        if lens[gone].any():
            keep = np.repeat(~gone, lens)
            data, off = data[keep], np.concatenate([[0], np.cumsum(np.where(gone, 0, lens))])
    return data, off


class Words:
    """Word hashes of texts. ``hashes(data, offsets)`` gives, over all texts, each word's start, end and hashes (one
    array for each seed), and the number of the first word of each text, with the total at the end."""

    def __init__(self, seeds: tuple[int, ...] = (1,), lower: bool = False, prefixes: tuple[int, ...] = ()):
        """prefixes: for the first seed, also the hashes of each word's first so many bytes, after the words' own; 0
        where a word isn't longer."""
        self.tables, self.space, self.powers, self.prefixes = [byte_table(s, lower) for s in seeds], spaces(), Powers(_ODD), prefixes

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        starts, ends, out, at = [], [], [[] for _ in range(len(self.tables) + len(self.prefixes))], 0
        edge = offsets[1:-1]
        while at < len(data):
            to = min(at + BLOCK, len(data))
            while to < len(data):  # up to the next white space or start of a text
                piece = self.space[data[to : to + 65536]]
                stop = to + int(piece.argmax()) if piece.any() else to + len(piece)
                k = np.searchsorted(edge, to)
                if k < len(edge) and edge[k] <= stop:
                    to = int(edge[k])
                    break
                to = stop
                if piece.any():
                    break
            part = data[at:to]
            solid = ~self.space[part]
            begin, end = solid.copy(), solid.copy()
            begin[1:] &= ~solid[:-1]
            end[:-1] &= ~solid[1:]
            cut = edge[np.searchsorted(edge, at, "right") : np.searchsorted(edge, to)] - at
            begin[cut] = solid[cut]
            end[cut - 1] = solid[cut - 1]
            s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
            power, inverse = self.powers.upto(len(part) + 1)
            for k, t in enumerate(self.tables):
                total = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(t[part] * power[: len(part)], out=total[1:])
                out[k].append(mix((total[e] - total[s]) * inverse[s]))
                for j, n in enumerate(self.prefixes if k == 0 else ()):
                    cut = np.where(s + n < e, s + n, s)
                    out[len(self.tables) + j].append(mix((total[cut] - total[s]) * inverse[s] * np.uint64(2 * n + 1)))
            starts.append(s + at)
            ends.append(e + at)
            at = to
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        starts, ends = join(starts, np.int64), join(ends, np.int64)
        return starts, ends, [join(x, np.uint64) for x in out], np.searchsorted(starts, offsets)


class Windows:
    """Hashes of all runs of k words: number i is of the words from i on, whatever text they are of; where fewer than k
    words are left in all, there is none."""

    def __init__(self, k: int):
        self.k, self.powers = k, Powers(_ODD2)

    def sums(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        power, inverse = self.powers.upto(len(words) + 1)
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * power[: len(words)], out=total[1:])
        return total, inverse

    def hashes(self, words: np.ndarray) -> np.ndarray:
        if len(words) < self.k:
            return np.zeros(0, np.uint64)
        total, inverse = self.sums(words)
        n = len(words) - self.k + 1
        return mix((total[self.k :] - total[:n]) * inverse[:n])


def slices(batch, text: str, most: int) -> Iterator:
    """Parts of an Arrow batch of about so many bytes of text, one row at least."""
    _, off = string_parts(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to

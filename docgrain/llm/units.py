"""Cut texts into units that byte-level BPE never merges across, so that each distinct unit is encoded once.

A space that follows a character other than white space and precedes one always starts a match of the GPT-2 style
split pattern, so a text can be cut there whatever else it holds. Texts with any other white space around a space
(runs, leading or trailing space) are handed to a whole-text encoder instead; the results are the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units held by one Python worker, in two generations; the older one goes when the younger is full. Bounds memory only,
#: never the result.
CACHE_UNITS = 500_000
#: Marks at a unit's end that are a match of their own after a letter or digit, so that what they follow is encoded once.
TAIL = ".,;:!?"


def _ends(units: pa.Array, start: int, stop: int | None, holds: Callable[[str], bool]) -> np.ndarray:
    """Whether the character of each unit there (none: no) has a property, which is asked once for each distinct character."""
    coded = pc.utf8_slice_codeunits(units, start, stop).dictionary_encode()
    met = np.array([bool(c) and holds(c) for c in coded.dictionary.to_pylist()], bool)
    return met[coded.indices.to_numpy()] if len(met) else np.zeros(len(units), bool)


class UnitEncoder:
    """encode(texts) -> ids of each text as packed bytes.

    encode_many: packed ids of each of a list of strings, every one encoded by itself. width: bytes of a packed id.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], width: int, cache_units: int = CACHE_UNITS):
        self.encode_many, self.width, self.cache_units = encode_many, width, cache_units
        self.encode_units = encode_many  # for units with their space, which may be joined
        self.rest: dict[str, bytes | None] = {}  # for " " + unit; None: not to be cut there
        self.old: dict[str, bytes | None] = {}
        self.first: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _learn(self, need: list[str]) -> None:
        """Put all of need into the younger generation."""
        rest, old = self.rest, self.old
        need = [u for u in need if u not in rest]
        rest.update({u: old[u] for u in need if u in old})
        need = [u for u in need if u not in rest]
        if not need:
            return
        units = pa.array(need, pa.large_string())
        odd = _ends(units, 0, 1, str.isspace) | _ends(units, -1, None, str.isspace) | (pc.utf8_length(units).to_numpy() == 0)
        stems = pc.utf8_rtrim(units, TAIL)
        ended = ~odd & (pc.binary_length(stems).to_numpy() < pc.binary_length(units).to_numpy()) & _ends(stems, -1, None, str.isalnum)
        rest.update(dict.fromkeys([need[i] for i in np.flatnonzero(odd).tolist()]))
        at = np.flatnonzero(ended).tolist()
        own = [need[i] for i in at]
        roots = stems.take(pa.array(at, pa.int64())).to_pylist()
        plain = [need[i] for i in np.flatnonzero(~odd & ~ended).tolist()]
        # stems that no other unit brings along
        rest.update({u: old[u] for u in roots if u not in rest and u in old})
        new = set(roots).difference(plain)
        plain += [u for u in new if u not in rest]
        rest.update(zip(plain, self.encode_units([" " + u for u in plain]), strict=True))
        tails = [u[len(r) :] for u, r in zip(own, roots, strict=True)]
        marks = list(set(tails) - self.tails.keys())
        self.tails.update(zip(marks, self.encode_many(marks), strict=True))
        for u, stem, tail in zip(own, roots, tails, strict=True):
            rest[u] = rest[stem] + self.tails[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.rest) > self.cache_units // 2:
            self.rest, self.old = {}, self.rest
        for held in (self.first, self.tails):
            if len(held) > self.cache_units // 2:
                held.clear()
        if not texts:
            return []
        # cut and numbered in Arrow; only the distinct units are looked up here
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        start = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        units = coded.dictionary.to_pylist()
        self._learn(units)
        heads = [t.split(" ", 1)[0] for t in texts]
        self.first.update(zip(new := list(set(heads) - self.first.keys()), self.encode_many(new), strict=True))
        packed = list(map(self.rest.__getitem__, units))
        odd = np.fromiter((x is None for x in packed), bool, len(packed))
        table = [x or b"" for x in packed] + [self.first[h] for h in heads]
        number = coded.indices.to_numpy().copy()
        uncut = np.add.reduceat(odd[number], start[:-1]) - odd[number[start[:-1]]] > 0
        number[start[:-1]] = len(units) + np.arange(len(texts))
        # the ids of all texts, one unit's after another's
        length = np.fromiter(map(len, table), np.int64, len(table)) // self.width
        flat = np.frombuffer(b"".join(table), f"<u{self.width}")
        own = length[number]
        ends = np.cumsum(own)
        kind = np.int32 if max(len(flat), int(own.sum())) < 1 << 31 else np.int64
        at = np.repeat(((np.cumsum(length) - length)[number] - (ends - own)).astype(kind), own)
        at += np.arange(len(at), dtype=kind)
        ids = flat[at].tobytes()
        stops = (ends[start[1:] - 1] * self.width).tolist()
        out = [ids[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
        whole = [i for i, t in enumerate(heads) if uncut[i] or t[-1:].isspace()]
        for i, ids in zip(whole, self.encode_many([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out

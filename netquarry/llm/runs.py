"""Token ids of many texts at once, by the distinct runs of text between their spaces.

Where no white space adjoins other white space, a space always begins a piece of byte-level vocabularies,
and no merge crosses that. So a text's ids are those of its first run and of " " + run for each other
one. Arrow cuts the texts and numbers the distinct runs, each of which is looked up once; NumPy puts
the ids of all runs together. Other texts, and those that hold special tokens, are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points of the longest run whose ids are remembered.
LONG = 64
#: Runs whose ids are put together at a time.
BLOCK = 1 << 16
#: Two adjoining white space characters, as Unicode and Python have them.
CLUMSY = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"


class Runs:
    """whole: ids of a text; after_space: ids of " " + run for each of some runs; both 4 bytes each, little-endian.
    remembered: runs whose ids are kept; beyond that, those of the texts at hand are."""

    def __init__(self, whole: Callable[[str], bytes], after_space: Callable[[list[str]], list[bytes]], special: list[str], remembered: int):
        self.whole, self.after_space, self.special, self.remembered = whole, after_space, special, remembered
        self.known: dict[str, bytes] = {}

    def _spaced(self, runs: list[str]) -> list[bytes]:
        got = list(map(self.known.get, runs))
        new = [i for i, b in enumerate(got) if b is None]
        if new:
            for i, b in zip(new, self.after_space([runs[i] for i in new]), strict=True):
                got[i] = b
            if len(self.known) + len(new) > self.remembered:  # what these texts have goes on
                self.known = dict(zip(runs[: self.remembered], got, strict=False))
            else:
                self.known.update((runs[i], got[i]) for i in new)
            for r in [runs[i] for i in new if len(runs[i]) > LONG]:
                self.known.pop(r, None)
        return got

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.split_pattern(texts, " ")
        starts = cut.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        runs = cut.flatten().dictionary_encode()
        starts = starts - starts[0]
        index = runs.indices.to_numpy(zero_copy_only=False).copy()
        names = runs.dictionary.to_pylist()
        firsts = [names[i] for i in index[starts[:-1]].tolist()]
        own = {r: k for k, r in enumerate(dict.fromkeys(firsts))}
        ids = [*self._spaced(names), *map(self.whole, own)]
        index[starts[:-1]] = [len(names) + own[r] for r in firsts]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        del cut, runs, names, firsts, own
        flat, begins = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        del ids
        ends = np.cumsum(sizes[index])
        out = np.empty(ends[-1], np.uint32)
        for at in range(0, len(index), BLOCK):  # places of ids take twice their room
            part = index[at : at + BLOCK]
            n, end = sizes[part], ends[at : at + BLOCK]
            first = int(end[0] - n[0])
            out[first : end[-1]] = flat[np.repeat(begins[part] - (end - n), n) + np.arange(first, end[-1])]
        return out, ends[starts[1:] - 1]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, uint32; where each text's end): null texts have none."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.equal(texts, ""), pc.match_substring_regex(texts, CLUMSY))
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        whole = np.nonzero(odd.to_numpy(zero_copy_only=False))[0]
        plain = texts.filter(pc.invert(odd)) if len(whole) else texts
        ids, ends = self._plain(plain) if len(plain) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if not len(whole):
            return ids, ends
        parts: list = [None] * len(texts)
        for i in whole.tolist():
            parts[i] = np.frombuffer(self.whole(texts[i].as_py()), "<u4")
        rest = np.split(ids, ends[:-1]) if len(plain) else []
        for i, p in zip(np.setdiff1d(np.arange(len(texts)), whole).tolist(), rest, strict=True):
            parts[i] = p
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

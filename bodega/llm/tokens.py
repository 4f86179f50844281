"""What the three tokenizer operators share: cutting a text into units that
tokenize alone.

A single space between two non-space characters always begins a new
pre-token, so a text may be cut there and every piece (with its leading
space) gives the same ids alone as in its place. Words repeat, so the work per
text becomes a dictionary lookup per unit.
"""
from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain, filterfalse, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r"(?<=\S) (?=\S)")


def cut(text: str) -> list[str]:
    """The text's units. All but the first stand for a leading space and themselves."""
    return _CUT.split(text)


def tokenizer_path(name: str) -> str:
    return name if os.path.sep in name else public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load_tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path(name))
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def tokenizer_json(name: str) -> dict:
    with open(tokenizer_path(name), encoding="utf-8") as f:
        return json.load(f)


def special_strings(name: str) -> dict[str, int]:
    return {x["content"]: x["id"] for x in tokenizer_json(name)["added_tokens"]}


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def ragged(runs: list) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of lists of integers, and all of them in one array."""
    lens = np.fromiter(map(len, runs), np.int64, len(runs))
    return lens, np.fromiter(chain.from_iterable(runs), np.int32, int(lens.sum()))


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs flat[start:start + len], one after another."""
    ends = np.cumsum(lens)
    if not len(ends):
        return np.empty(0, flat.dtype)
    return flat[np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1])]


class UnitPool:
    """Numbers the units seen by a worker and keeps, for each, a run of integers
    (ids, or pre-token numbers). ``make(units)`` gives (units, lengths, flat runs) of
    new units, in any order. ``marks`` maps a sign that is a pre-token of its own
    behind a letter to its run: such a unit is put together from the one without the
    sign. The pool starts anew when it holds ``limit`` units, which bounds its memory."""

    def __init__(self, make, limit: int = 1_200_000, marks: dict[str, int] | None = None):
        self.make, self.limit, self.marks = make, limit, marks or {}
        self.clear()

    def clear(self) -> None:
        self.first: dict[str, int] = {}   # units at the beginning of a text
        self.later: dict[str, int] = {}   # units after a space
        self.n = self.used = 0
        self.starts, self.lens, self.flat = np.empty(1024, np.int64), np.empty(1024, np.int64), np.empty(4096, np.int32)

    def _store(self, lens: np.ndarray, flat: np.ndarray) -> range:
        def fit(x: np.ndarray, n: int) -> np.ndarray:
            return x if n <= len(x) else np.concatenate([x, np.empty(max(n, 2 * len(x)) - len(x), x.dtype)])
        n, used = self.n + len(lens), self.used + len(flat)
        self.starts, self.lens, self.flat = fit(self.starts, n), fit(self.lens, n), fit(self.flat, used)
        self.lens[self.n:n] = lens
        self.starts[self.n:n] = self.used + np.cumsum(lens) - lens
        self.flat[self.used:used] = flat
        numbers = range(self.n, n)
        self.n, self.used = n, used
        return numbers

    def _learn(self, heads: set[str], tails: set[str]) -> None:
        marked = [u for u in tails if u[-1] in self.marks and "A" <= u[-2:-1] <= "ɏ" and u[-2].isalpha()] if self.marks else []
        plain = (tails - set(marked)) | ({u[:-1] for u in marked} - self.later.keys())
        if heads:
            units, lens, flat = self.make(list(heads))
            self.first.update(zip(units, self._store(lens, flat)))
        if plain:
            units, lens, flat = self.make([" " + u for u in plain])
            self.later.update(zip((u[1:] for u in units), self._store(lens, flat)))
        if marked:
            stem = np.fromiter((self.later[u[:-1]] for u in marked), np.int64, len(marked))
            lens = self.lens[stem]
            flat = np.empty(int(lens.sum()) + len(stem), np.int32)
            at = np.cumsum(lens + 1) - 1
            body = np.ones(len(flat), bool)
            body[at] = False
            flat[body] = gather(self.flat, self.starts[stem], lens)
            flat[at] = [self.marks[u[-1]] for u in marked]
            self.later.update(zip(marked, self._store(lens + 1, flat)))

    def cut_all(self, texts: list[str]) -> list[list[str]]:
        """Cut the texts and make every unit known. Cutting at every space is right
        unless a piece is empty or begins or ends with white space; such pieces are
        never stored, so they show up here and their text is cut with care."""
        if self.n > self.limit:
            self.clear()
        known, out, heads, tails = self.later.__contains__, [], set(), set()
        for t in texts:
            units = t.split(" ")
            new = set(filterfalse(known, units[1:]))
            if len(units) > 1 and units[0][-1:].isspace() or any(not u or u[0].isspace() or u[-1].isspace() for u in new - tails):
                units = cut(t)
                new = set(filterfalse(known, units[1:]))
            tails |= new
            if units[0] and units[0] not in self.first:
                heads.add(units[0])
            out.append(units)
        self._learn(heads, tails)
        return out

    def run(self, units: list[str]) -> np.ndarray:
        """The runs of a cut text's units, in order, as one array."""
        u = np.fromiter(map(self.later.__getitem__, units[1:]), np.int64, len(units) - 1)
        if units[0]:
            u = np.concatenate([[self.first[units[0]]], u])
        return gather(self.flat, self.starts[u], self.lens[u])

    def runs(self, column: pa.Array) -> list[np.ndarray]:
        """The runs of the texts of a column of UTF-8 bytes (null: empty), each as one array.
        As ``cut_all`` and ``run``, but Arrow cuts and numbers the pieces, so that Python sees
        each different piece of the column once."""
        if self.n > self.limit:
            self.clear()
        if not len(column):
            return []
        column = pc.fill_null(column, b"")
        pieces = pc.split_pattern(column, pattern=" ")
        ends = np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False), dtype=np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        coded = pieces.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        try:
            units = coded.dictionary.cast(pa.string()).to_numpy(zero_copy_only=False).tolist()
        except pa.ArrowInvalid:
            units = [x.decode("utf-8", "replace") for x in coded.dictionary.to_pylist()]
        later = np.ones(len(code), bool)
        later[begins] = False
        seen = np.zeros(len(units), bool)  # behind a space
        seen[code[later]] = True
        number = np.fromiter(map(self.later.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(seen & (number < 0)).tolist()
        odd = np.zeros(len(units), bool)
        odd[[i for i in new if not (u := units[i]) or u[0].isspace() or u[-1].isspace()]] = True
        heads = [units[c] for c in code[begins].tolist()]
        care = np.array([u[-1:].isspace() for u in heads], bool) & (ends - begins > 1)
        if odd.any():
            care |= np.add.reduceat(odd[code] & later, begins) > 0
        with_care = {i: cut(column[i].as_py().decode("utf-8", "replace")) for i in np.flatnonzero(care).tolist()}

        firsts = {u for i, u in enumerate(heads) if not care[i]}
        tails = {units[i] for i in new if not odd[i]}
        for parts in with_care.values():
            firsts.add(parts[0])
            tails.update(filterfalse(self.later.__contains__, parts[1:]))
        self._learn({u for u in firsts if u and u not in self.first}, tails)

        number[new] = [self.later.get(units[i], -1) for i in new]
        number = number[code]
        number[begins] = [self.first.get(u, -1) for u in heads]  # -1: a text that begins with a space
        out = []
        for i, (a, z) in enumerate(zip(begins.tolist(), ends.tolist())):
            if care[i]:
                out.append(self.run(with_care[i]))
            else:
                u = number[a + (number[a] < 0):z]
                out.append(gather(self.flat, self.starts[u], self.lens[u]))
        return out


def groups_by_bytes(column, limit: int):
    """(from, to) slices of a column of byte strings holding about ``limit`` bytes
    each; a longer value stands alone."""
    yield from slices_by_bytes([len(x) if x is not None else 0 for x in column], limit)


def slices_by_bytes(sizes, limit: int):
    """The same by the sizes of the values."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)

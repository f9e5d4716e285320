"""Tokenisation with the ``tokenizers`` library on executors, remembered by unit.

A unit is a stretch of text over whose start no token and no normalisation step of the public vocabularies used
here reaches (byte-level BPE with the usual split pattern; word BPE that drops white space), so the ids of a text
are the ids of its units in order. Units begin where white space follows something else, where an ASCII
punctuation mark follows a letter, and after a lone line end. They are found in the bytes of a whole Arrow
column at once, and each distinct one goes through the library once per worker; the rest are looked up.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts worked on at once (a longer text goes in pieces of whole units), and the longest unit remembered.
BLOCK, LONGEST = 1 << 18, 64
#: Slots of the table of remembered units; it is emptied when half full. Only memory and time depend on these.
SLOTS_LOG2 = 22

SPACE, LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
SPACE[list(b"\t\n\x0b\x0c\r ")] = True
LETTER[list(range(65, 91)) + list(range(97, 123))] = True
MARK[[b for b in range(33, 127) if not (LETTER[b] or 48 <= b < 58)]] = True
#: Lead byte of the Latin-1 letters in UTF-8, and the second bytes of the two signs among them (fixed values).
LATIN, SIGNS = 0xC3, (0x97, 0xB7)
FACTOR = 0x9E3779B97F4A7C15 | 1


def unit_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Whether a unit begins at each byte; ``texts``: where texts begin (ascending; equal ones are empty texts)."""
    n = len(data)
    starts = np.zeros(n + 1, bool)
    if n > 1:
        space, before = SPACE[data], data[:-1]
        latin = np.zeros(n, bool)
        latin[1:] = before == LATIN
        # what is surely not white space: ASCII but white space, and the second byte of a Latin-1 letter
        solid = ((data < 128) & ~space) | latin
        starts[1:n] = space[1:] & solid[:-1]
        letter = LETTER[data] | (latin & (data != SIGNS[0]) & (data != SIGNS[1]))
        starts[1:n] |= MARK[data[1:]] & letter[:-1]
        if n > 2:
            starts[2:n] |= (data[1:-1] == 10) & solid[:-2] & LETTER[data[2:]]
        # a control token's string must stay whole: such texts are one unit
        odd = np.flatnonzero((before == 60) & (data[1:] == 124))
        if len(odd):
            ends = np.append(texts[1:], n)
            for t in np.unique(np.searchsorted(texts, odd, "right") - 1):
                starts[texts[t] : ends[t]] = False
    starts[texts] = True
    return starts[:n]


class UnitEncoder:
    """Columns of texts to token ids."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._mix = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self._powers = self._inverse = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self._keys = np.zeros(1 << SLOTS_LOG2, np.uint64)
        self._at = np.full(1 << SLOTS_LOG2, -1, np.int32)
        self._ids, self._n_ids = np.empty(1 << 16, np.uint32), 0
        self._off, self._n = np.zeros(1 << 16, np.int64), 0
        self._kept = 0

    def _add(self, units: list[str]) -> np.ndarray:
        """Encode new units and append their ids to the store; their numbers there."""
        first, flat, sizes = self._n, [], []
        for at in range(0, len(units), 4096):
            for e in self._tokenizer.encode_batch_fast(units[at : at + 4096], add_special_tokens=False):
                ids = e.ids
                flat += ids
                sizes.append(len(ids))
        while self._n_ids + len(flat) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.empty_like(self._ids)])
        while self._n + len(units) + 1 > len(self._off):
            self._off = np.concatenate([self._off, np.zeros_like(self._off)])
        self._ids[self._n_ids : self._n_ids + len(flat)] = flat
        self._off[first + 1 : first + 1 + len(units)] = self._n_ids + np.cumsum(sizes)
        self._n_ids, self._n = self._n_ids + len(flat), first + len(units)
        return np.arange(first, self._n)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the units, from running sums of the bytes' random values times powers of a factor."""
        if len(data) > len(self._powers):
            for name, by in (("_powers", FACTOR), ("_inverse", pow(FACTOR, -1, 1 << 64))):
                steps = np.full(max(len(data), BLOCK) + 1, by, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._mix[data] * self._powers[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self._inverse[starts]
        h = (h ^ (h >> np.uint64(32)) ^ (ends - starts).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        return np.where(h == 0, np.uint64(1), h)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of remembered units, -1 for others."""
        found, mask = np.full(len(hashes), -1, np.int32), np.uint64((1 << SLOTS_LOG2) - 1)
        todo, slot = np.arange(len(hashes)), hashes >> np.uint64(64 - SLOTS_LOG2)
        while len(todo):
            keys = self._keys[slot]
            hit = keys == hashes[todo]
            found[todo[hit]] = self._at[slot[hit]]
            on = ~hit & (keys != 0)
            todo, slot = todo[on], (slot[on] + np.uint64(1)) & mask
        return found

    def _remember(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        mask, slot = np.uint64((1 << SLOTS_LOG2) - 1), hashes >> np.uint64(64 - SLOTS_LOG2)
        todo = np.arange(len(hashes))
        while len(todo):
            free = self._keys[slot] == 0
            self._keys[slot[free]] = hashes[todo[free]]  # of several for one slot the last stays
            won = np.zeros(len(todo), bool)
            won[free] = self._keys[slot[free]] == hashes[todo[free]]
            self._at[slot[won]] = numbers[todo[won]]
            todo, slot = todo[~won], (slot[~won] + np.uint64(1)) & mask
        self._kept += len(hashes)

    def _block(self, data: np.ndarray, texts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of the texts in ``data`` that begin at ``texts``."""
        starts = np.flatnonzero(unit_starts(data, texts[texts < len(data)]))
        ends = np.append(starts[1:], len(data))[: len(starts)]
        if self._kept > 1 << (SLOTS_LOG2 - 1):
            self._forget()
        hashes = self._hashes(data, starts, ends)
        long = ends - starts > LONGEST
        numbers = np.full(len(starts), -1, np.int32)
        numbers[~long] = self._find(hashes[~long])
        new, inverse = np.unique(hashes[(numbers < 0) & ~long], return_index=True)
        if len(new):
            where = np.flatnonzero((numbers < 0) & ~long)
            self._remember(new, self._add([bytes(data[starts[w] : ends[w]]).decode("utf-8", "replace") for w in where[inverse]]))
            numbers[where] = self._find(hashes[where])
        n, n_ids = self._n, self._n_ids
        passing = np.flatnonzero(long)
        numbers[passing] = self._add([bytes(data[starts[w] : ends[w]]).decode("utf-8", "replace") for w in passing])
        last = np.searchsorted(starts, np.append(texts[1:], len(data)))  # units before the end of each text
        if end_id is not None:
            end = self._n
            self._add([""])
            self._off[end + 1] = self._n_ids = self._n_ids + 1
            if self._n_ids > len(self._ids):
                self._ids = np.concatenate([self._ids, np.empty_like(self._ids)])
            self._ids[self._n_ids - 1] = end_id
            numbers = np.insert(numbers, last, end)
            last = last + np.arange(1, len(last) + 1)
        first = self._off[numbers]
        sizes = self._off[numbers.astype(np.int64) + 1] - first
        after = np.concatenate([[0], np.cumsum(sizes)])
        places = np.repeat(first - after[:-1], sizes) + np.arange(after[-1])
        ids = self._ids[places]
        self._n, self._n_ids = n, n_ids  # what is not remembered is overwritten
        return np.diff(after[np.concatenate([[0], last])]), ids

    def _long(self, data: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_block`, for one long text, piece by piece; pieces end before units."""
        parts, at, zero = [], 0, np.zeros(1, np.int64)
        while at < len(data):
            size = BLOCK
            while True:
                end = min(at + size, len(data))
                starts = np.flatnonzero(unit_starts(data[at:end], zero))
                if end == len(data) or len(starts) > 1:
                    break
                size *= 2  # within one unit
            cut = end if end == len(data) else at + int(starts[-1])
            parts.append(self._block(data[at:cut], zero, end_id if cut == len(data) else None)[1])
            at = cut
        ids = np.concatenate(parts)
        return np.array([len(ids)]), ids

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a column: text k has ids[offsets[k] : offsets[k + 1]], with ``end_id`` last if given.

        A null is an empty text; every text is encoded whole.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, raw_offsets, raw = texts.buffers()
        offsets = np.frombuffer(raw_offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        sizes, ids, at = [np.zeros(1, np.int64)], [np.empty(0, np.uint32)], 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
            if offsets[upto] - offsets[at] > BLOCK:
                found = self._long(data[offsets[at] : offsets[upto]], end_id)
            else:
                found = self._block(data[offsets[at] : offsets[upto]], offsets[at:upto] - offsets[at], end_id)
            sizes.append(found[0])
            ids.append(found[1])
            at = upto
        return np.cumsum(np.concatenate(sizes)), np.concatenate(ids)


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """This worker's encoder for a vocabulary file; ``path`` is a file, or a name that ``public_tokenizers`` knows."""
    if path not in _ENCODERS:
        place = path
        if not os.path.exists(place):
            import public_tokenizers

            place = public_tokenizers.path(path)
        _ENCODERS[path] = UnitEncoder(place)
    return _ENCODERS[path]

"""Exact encoding with a table of known units in front of the tokenizer.

The tokenizer ``word_bpe_49k`` lower-cases, drops white space, and cuts texts into runs of letters
and runs of other characters before it merges anything, so the ids of a text are those of its
*units*, one after the other.  Each worker encodes a unit once; after that a unit is found by a
keyed 64-bit hash, its bytes are compared with the stored ones, and its ids are copied, all in
numpy.  Units that share a hash with another are kept by their bytes in a plain dictionary.

Units end at white space, before and after a run of letters; an apostrophe is kept together with
letters that follow it, for the tokenizer has contractions of its own.  This holds for texts of
ASCII and the letters of Latin-1 and Latin Extended-A, except a few named in ``_PLAIN``.  A text
with any other character, or with the start of a special token, goes through the tokenizer itself.
Texts are worked on in spans of about ``SPAN_CHARS`` characters that end at white space, so that the
tables of a very long text stay small.

A vocabulary file is looked at when it is loaded: if its normaliser, its cutting or its special
tokens are not the ones that all this rests on, every text goes through the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import _piece_sums, mix64

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

TOKENIZER = "word_bpe_49k.json"
_PLAIN = re.compile("[\\x01-\\x1b\\x20-\\x7fÀ-ÖØ-öø-įı-ňŊ-ž]*")
MAX_UNITS = 1_000_000
SPAN_CHARS = 1 << 18
_SLOT_BITS = 21
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: 0 white space, 1 letter (all bytes of the letters above ASCII), 2 other
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_APOSTROPHE = 39
#: The characters by which byte-level vocabularies show the bytes that are not printable.
_SHOWN = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


# fixed values: how the vocabulary file says that texts are changed and cut before merging
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUTTERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def has_units(path: str) -> bool:
    """Whether a vocabulary file cuts texts as the module's text says."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    step = lambda name, kinds: (spec.get(name) or {}).get(kinds)
    special = all(t["content"].startswith("<|") and t["content"].split() == [t["content"]] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec.get("added_tokens") or [])
    model = spec["model"].get("type") == "BPE" and not spec["model"].get("continuing_subword_prefix") and not spec["model"].get("dropout")
    return special and model and step("normalizer", "normalizers") == _NORMALIZERS and step("pre_tokenizer", "pretokenizers") == _CUTTERS


def spans(text: str, limit: int | None = None) -> list[str]:
    """A text cut before white space into parts of at most ``limit`` characters, or of one word."""
    limit, out, at = limit or SPAN_CHARS, [], 0
    while len(text) - at > limit:
        stop = max(text.rfind(c, at + 1, at + limit) for c in " \n\t")
        if stop < 0:
            stop = min((i for c in " \n\t" if (i := text.find(c, at + limit)) >= 0), default=len(text))
        out.append(text[at:stop])
        at = stop
    return [*out, text[at:]]


class _Table:
    """Open addressing from 64-bit keys to row numbers, probed for many keys at once."""

    def __init__(self):
        self.keys = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.rows = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.mask = np.int64((1 << _SLOT_BITS) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 for unknown keys."""
        slot = self._slot(keys)
        out = self.rows[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            row = self.rows[slot]
            out[todo] = row
            more = (row >= 0) & (self.keys[slot] != keys[todo])
            todo, slot = todo[more], slot[more]
        return out

    def add(self, keys: np.ndarray, first_row: int) -> None:
        """Insert distinct unknown keys with consecutive rows."""
        rows, slot = np.arange(first_row, first_row + len(keys), dtype=np.int32), self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.rows[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]], self.rows[slot[won]] = keys[won], rows[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            keys, rows, slot = keys[lost], rows[lost], (slot[lost] + 1) & self.mask


class UnitEncoder:
    """Ids of whole texts, ``add_special_tokens=False``; nulls are empty."""

    def __init__(self, path: str, table: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = has_units(path)
        self.table = table and self.split
        self._clear()

    def _clear(self) -> None:
        self.known = _Table()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 15, np.int64)
        self.bytes = np.zeros(1 << 18, np.uint8)
        self.byte_ends = np.zeros(1 << 15, np.int64)
        self.odd: dict[bytes, int] = {}
        self.n, self.used, self.used_bytes = 0, 0, 0

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes.  A unit of letters alone needs no cutting, so it goes to the model itself."""
        ids: list[list[int]] = [[]] * len(units)
        other, model, shown = [], self.tokenizer.model, _SHOWN
        for i, u in enumerate(units):
            if u.isalpha():
                ids[i] = [t.id for t in model.tokenize(u.decode().lower())]
            elif u[0] > 127 and all(b > 127 or 65 <= b & 95 <= 90 for b in u):
                ids[i] = [t.id for t in model.tokenize(u.decode().lower().encode().decode("latin-1").translate(shown))]
            else:
                other.append(i)
        for i, one in zip(other, self._raw([units[i].decode() for i in other])):
            ids[i] = one
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.array([i for one in ids for i in one], np.uint32), sizes

    def _learn(self, units: list[bytes]) -> None:
        new, sizes = self._encode_units(units)
        text = np.frombuffer(b"".join(units).lower(), np.uint8)
        need, rows, need_bytes = self.used + len(new), self.n + len(units), self.used_bytes + len(text)
        for name, size in (("ids", need), ("ends", rows + 1), ("bytes", need_bytes), ("byte_ends", rows + 1)):
            while size > len(getattr(self, name)):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        self.ids[self.used : need] = new
        self.ends[self.n + 1 : rows + 1] = self.used + np.cumsum(sizes)
        self.bytes[self.used_bytes : need_bytes] = text
        self.byte_ends[self.n + 1 : rows + 1] = self.used_bytes + np.cumsum([len(u) for u in units])
        self.n, self.used, self.used_bytes = rows, need, need_bytes

    def _unlike(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The places of units whose bytes are not those of their rows."""
        at = self.byte_ends[row]
        wrong = self.byte_ends[row + 1] - at != size
        n = np.where(wrong, 0, size)
        before = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(before, n)
        differ = _LOW[data[np.repeat(start, n) + step]] != self.bytes[np.repeat(at, n) + step]
        if differ.any():
            wrong[np.repeat(np.arange(len(n)), n)[differ]] = True
        return np.flatnonzero(wrong)

    def _rows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Unit rows of all plain texts and the bounds per text."""
        raw = b"\n".join(texts)
        data = np.frombuffer(raw, np.uint8)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        kind = _CLASS[data]
        before = np.concatenate([[np.uint8(0)], kind[:-1]])
        glued = np.concatenate([[False], data[:-1] == _APOSTROPHE]) & (kind == 1)
        start = np.flatnonzero((kind > 0) & (kind != before) & ~glued)
        change = np.append((kind[1:] != kind[:-1]) & ~glued[1:], True)
        size = np.flatnonzero((kind > 0) & change) + 1 - start
        key = mix64(_piece_sums(data, start, size, 0, 1)[0] + size.astype(np.uint64))
        row = self.known.find(key).astype(np.int64)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            fresh, at = np.unique(key[miss], return_index=True)
            at = miss[at]
            self.known.add(fresh, self.n)
            self._learn([raw[a : a + n] for a, n in zip(start[at].tolist(), size[at].tolist())])
            row[miss] = self.known.find(key[miss])
        odd = self._unlike(data, start, size, row)
        if len(odd):  # other units of the same hash
            units = [raw[a : a + n].lower() for a, n in zip(start[odd].tolist(), size[odd].tolist())]
            new = [u for u in dict.fromkeys(units) if u not in self.odd]
            self.odd.update((u, self.n + i) for i, u in enumerate(new))
            self._learn(new)
            row[odd] = [self.odd[u] for u in units]
        edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        return row, np.searchsorted(start, edges).astype(np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of spans and how many each has."""
        if self.n > MAX_UNITS:
            self._clear()
        plain, whole = [b""] * len(texts), {}
        for i, text in enumerate(texts):
            if self.table and _PLAIN.fullmatch(text) and "<|" not in text:
                plain[i] = text.encode()
            else:
                whole[i] = None
        row, last = self._rows(plain)
        at, size = self.ends[row], self.ends[row + 1] - self.ends[row]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(at - total[:-1], size) + np.arange(int(total[-1]))]
        bounds = total[last]
        if not whole:
            return flat, np.diff(bounds)
        for i, ids in zip(whole, self._raw([texts[i] for i in whole])):
            whole[i] = np.array(ids, np.uint32)
        parts = [whole[i] if i in whole else flat[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, bounds)``: text ``i`` has ``ids[bounds[i]:bounds[i + 1]]``."""
        ids, size, group, held = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [], 0
        n_spans = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            cuts = (spans(text) if self.split else [text]) if text else []
            n_spans[i + 1] = len(cuts)
            for cut in cuts:
                if held + len(cut) > 2 * SPAN_CHARS and group:
                    for out, new in zip((ids, size), self._encode(group)):
                        out.append(new)
                    group, held = [], 0
                group.append(cut)
                held += len(cut)
        if group:
            for out, new in zip((ids, size), self._encode(group)):
                out.append(new)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(size))])
        return np.concatenate(ids), bounds[np.cumsum(n_spans)]


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

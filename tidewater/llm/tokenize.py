"""Token ids of a word-level BPE tokenizer at corpus speed.

The tokenizer drops white space and never merges across it, so a text's ids are those of its space-separated chunks in a
row. Chunks are looked up by a 64-bit hash in a bounded table of numpy arrays; those missing are cut as the tokenizer cuts them and merged by a byte-pair
encoder over the same vocabulary, in which a word's end is a byte of its own. Chunks with characters beyond Latin letters,
digits and ASCII signs, and texts with the strings of special tokens, go to the tokenizer itself.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Chunks kept in a worker's table before it is emptied, and bytes of texts looked up at once.
CACHE = 400_000
BATCH = 1 << 18
_SLOTS = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class ChunkTable:
    """Hash to a run of ids in one pool, by open addressing on whole arrays."""

    def __init__(self) -> None:
        self.slots = np.full(_SLOTS, -1, np.int32)
        self.hashes = np.zeros(1 << 12, np.uint64)
        self.bounds = np.zeros((1 << 12) + 1, np.int64)
        self.pool = np.zeros(1 << 14, np.uint32)
        self.size = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash's entry, -1 if there is none."""
        out, where = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        slot = (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(where):
            entry = self.slots[slot]
            same = (entry >= 0) & (self.hashes[entry] == hashes[where])
            out[where[same]] = entry[same]
            on = (entry >= 0) & ~same
            where, slot = where[on], (slot[on] + 1) % _SLOTS
        return out

    def add(self, hashes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """New distinct hashes with the numbers of their ids, and these in a row."""
        low, high = self.size, self.size + len(hashes)
        while high > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.bounds = np.concatenate([self.bounds, np.zeros(len(self.bounds) - 1, np.int64)])
        used = int(self.bounds[low])
        while used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[used : used + len(ids)] = ids
        self.hashes[low:high] = hashes
        self.bounds[low + 1 : high + 1] = used + np.cumsum(counts)
        self.size = high
        entry, slot = np.arange(low, high), (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            on = self.slots[slot] != entry
            entry, slot = entry[on], (slot[on] + 1) % _SLOTS

    def runs(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries in a row, and how many each has."""
        starts, counts = self.bounds[entries], self.bounds[entries + 1] - self.bounds[entries]
        shift = np.repeat(starts - np.cumsum(counts) + counts, counts)
        return self.pool[shift + np.arange(len(shift))], counts


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)
_END = "\x01"
_LETTERS = "a-zà-öø-įı-ňŋ-ž"  # lower-case; none changes under NFC
_SIMPLE = re.compile(rf"[\x20-\x7e{_LETTERS}]*")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+| ")


class WordBpe:
    def __init__(self, path: str) -> None:
        self.path, self._own = path, None
        self.table = ChunkTable()
        self.powers = self.inverse = np.zeros(0, np.uint64)
        model = json.loads(open(path, encoding="utf-8").read())
        vocab, suffix = model["model"]["vocab"], model["model"]["end_of_word_suffix"]
        specials = [t["content"] for t in model["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)")
        byte = self._bytes()
        ranks, ids, rest = {}, [], []
        for token, number in vocab.items():
            if token in specials:
                continue
            whole = token.removesuffix(suffix)
            raw = bytes(byte[c] for c in whole) + (_END.encode() if token.endswith(suffix) else b"")
            rest.append((len(whole) > 1, token.endswith(suffix) if len(whole) == 1 else False, number, raw))
        for i, (_, _, number, raw) in enumerate(sorted(rest)):  # bytes, bytes at a word's end, then merges in their order
            if raw in ranks:
                raise ValueError("two tokens of the same bytes")
            ranks[raw] = i
            ids.append(number)
        self.ids = np.array(ids, "<u4")
        self.space = ranks[b" " + _END.encode()]
        self.encoder = tiktoken.Encoding("words", pat_str=rf"[^{_END}]*{_END}", mergeable_ranks=ranks, special_tokens={})

    @property
    def tokenizer(self) -> Tokenizer:
        """The tokenizer itself, loaded when a text first needs it."""
        if self._own is None:
            self._own = Tokenizer.from_file(self.path)
        return self._own

    @staticmethod
    def _bytes() -> dict[str, int]:
        """Bytes by the printable characters that stand for them in byte-level vocabularies."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def _ids(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in a row, and how many each has."""
        texts = b" ".join(chunks).decode("utf-8", "replace").lower()
        if not _SIMPLE.fullmatch(texts):
            each: list[np.ndarray | None] = [None] * len(chunks)
            plain = []
            for i, chunk in enumerate(chunks):
                text = chunk.decode("utf-8", "replace")
                if _SIMPLE.fullmatch(text.lower()):
                    plain.append(i)
                else:
                    each[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            if plain:
                ids, counts = self._ids([chunks[i] for i in plain])
                for i, own in zip(plain, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    each[i] = own
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        ranks = self.encoder.encode_to_numpy(_END.join(_PIECES.findall(texts)) + _END)
        between = ranks == self.space
        edges = np.concatenate(([-1], np.flatnonzero(between), [len(ranks)]))
        return self.ids[ranks[~between]], np.diff(edges) - 1

    def _batch(self, data: list[bytes]) -> list[bytes]:
        joined = b" ".join(data) + b" "
        letters = np.frombuffer(joined, np.uint8)
        space = _SPACE[letters]
        before = np.concatenate(([True], space[:-1]))
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        if len(letters) > len(self.powers):
            self.powers, self.inverse = _powers(len(letters), _BASE), _powers(len(letters), pow(_BASE, -1, 1 << 64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((letters + np.uint64(1)) * self.powers[: len(letters)], dtype=np.uint64)))
        hashes = (sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64)
        hashes ^= hashes >> np.uint64(31)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(29)
        entries = self.table.find(hashes)
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            if self.table.size + len(missing) > CACHE:
                self.table, missing = ChunkTable(), np.arange(len(hashes))
            fresh, first = np.unique(hashes[missing], return_index=True)
            where = missing[first]
            ids, counts = self._ids([joined[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            self.table.add(fresh, counts, ids)
            entries[missing] = self.table.find(hashes[missing])
        ids, counts = self.table.runs(entries)
        edges = np.concatenate(([0], np.cumsum(counts)))
        lengths = np.array([len(d) + 1 for d in data], np.int64)
        cuts = edges[np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))]
        ids = ids.astype("<u4", copy=False)
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, special tokens not added; null is empty."""
        raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]  # of bytes: A-Z only
        out: list[bytes] = []
        while len(out) < len(raw):
            low, size = len(out), 0
            high = low
            while high < len(raw) and (high == low or size + len(raw[high]) <= BATCH):
                size += len(raw[high])
                high += 1
            out += self._batch(raw[low:high])
        for i, text in enumerate(texts):
            if text and "<|" in text and self.special.search(text.lower()):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return out

"""Rank-synchronous byte-level BPE over ragged numpy arrays.

A batch of pre-tokens is one flat array of symbols with the length of each sequence. A round finds the lowest-rank pair
of every sequence at once, merges all its occurrences there (leftmost first where they overlap), and looks up anew only
the pairs beside a merge; sequences without a pair left leave the batch. Merging all occurrences at once equals merging
one at a time, since a pair that a merge makes ranks behind the merge itself.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = np.int32(2**31 - 1)
#: Fixed value: the pre-tokenizer's pattern of the byte-level vocabulary, with white space and classes as Unicode has them.
PRE_TOKENS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BITS = 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pre_tokens(text: Column, specials: list[str]) -> Column:
    """The pre-tokens of a text as an array of strings, on the JVM; special strings come out whole, as the library's default has it."""
    plain = F.regexp_extract_all(text, F.lit(PRE_TOKENS), F.lit(0))
    if not specials:
        return plain
    either = "|".join("\\Q" + s + "\\E" for s in sorted(specials, key=len, reverse=True))
    found = F.regexp_extract_all(text, F.lit(f"({either})"), F.lit(1))
    parts = F.transform(F.split(text, either, -1), lambda s: F.regexp_extract_all(s, F.lit(PRE_TOKENS), F.lit(0)))
    mixed = F.flatten(F.zip_with(parts, found, lambda p, s: F.when(s.isNull(), p).otherwise(F.concat(p, F.array(s)))))
    has = F.contains(text, F.lit(specials[0]))
    for s in specials[1:]:
        has = has | F.contains(text, F.lit(s))
    return F.when(has, mixed).otherwise(plain)


def _byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it prints in Latin-1, else one from 256 on, in order."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


@dataclass
class ByteBpe:
    byte_ids: np.ndarray
    keys: np.ndarray  # open-addressed table of pairs
    ranks: np.ndarray
    merged: np.ndarray  # by rank
    specials: dict[str, int]
    width: int  # bytes that hold any id

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        vocab = made["model"]["vocab"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in made["model"]["merges"]]
        left, right, merged = (np.array([vocab[x] for x in column], np.int64) for column in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        keys, ranks = np.full(1 << _BITS, -1, np.int64), np.full(1 << _BITS, NONE, np.int32)
        wanted = (left << 32) | right
        spots = ((wanted.astype(np.uint64) * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)
        for rank, (key, spot) in enumerate(zip(wanted.tolist(), spots.tolist(), strict=True)):
            while keys[spot] >= 0:
                spot = (spot + 1) & ((1 << _BITS) - 1)
            keys[spot], ranks[spot] = key, rank
        specials = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
        most = max([*vocab.values(), *specials.values()])
        return cls(np.array([vocab[c] for c in _byte_characters()], np.int32), keys, ranks, merged.astype(np.int32), specials, 2 if most < 1 << 16 else 4)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        spot = ((key.view(np.uint64) * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)
        held = self.keys[spot]
        out = np.where(held == key, self.ranks[spot], NONE)
        rest = np.flatnonzero((held != key) & (held >= 0))
        while len(rest):
            spot[rest] = (spot[rest] + 1) & ((1 << _BITS) - 1)
            held = self.keys[spot[rest]]
            hit = held == key[rest]
            out[rest[hit]] = self.ranks[spot[rest[hit]]]
            rest = rest[~hit & (held >= 0)]
        return out

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences of bytes, as offsets into data, to (ids, ids of each sequence)."""
        n = len(offsets) - 1
        data = data[offsets[0] : offsets[-1]]
        lens = np.diff(offsets).astype(np.int64)
        total = np.zeros(n, np.int64)
        seq = np.flatnonzero(lens)
        lens = lens[seq]
        sym = self.byte_ids[data]
        done = []
        starts = np.cumsum(lens) - lens
        rank = np.full(len(sym), NONE, np.int32)
        if len(sym) > 1:
            rank[:-1] = self.rank(sym[:-1], sym[1:])
            rank[starts[1:] - 1] = NONE
        while len(seq):
            least = np.minimum.reduceat(rank, starts)
            live = least < NONE
            if not live.all():
                held = np.repeat(live, lens)
                done.append((seq[~live], lens[~live], sym[~held]))
                seq, lens, least, sym, rank = seq[live], lens[live], least[live], sym[held], rank[held]
                starts = np.cumsum(lens) - lens
                if not len(seq):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lens))
            near = np.diff(at) == 1
            if near.any():  # of a run like aaaa, every other pair
                order = np.arange(len(at))
                first = np.maximum.accumulate(np.where(np.r_[True, ~near], order, 0))
                at = at[(order - first) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            gone = np.add.reduceat(~keep, starts, dtype=np.int64)
            at -= np.arange(len(at))  # each merge before moves it by one
            sym, rank, lens = sym[keep], rank[keep], lens - gone
            starts = np.cumsum(lens) - lens
            first, last = np.zeros(len(sym), bool), np.zeros(len(sym), bool)
            first[starts] = last[starts + lens - 1] = True
            for spot in (at, at[~first[at]] - 1):
                rank[spot] = NONE
                spot = spot[~last[spot]]
                rank[spot] = self.rank(sym[spot], sym[spot + 1])
        for own, size, _ in done:
            total[own] = size
        before = np.cumsum(total) - total
        out = np.empty(int(total.sum()), np.int32)
        for own, size, ids in done:
            out[np.repeat(before[own] - (np.cumsum(size) - size), size) + np.arange(len(ids))] = ids
        return out, total

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids and their number for each of an array of strings without nulls."""
        words = words.cast(pa.large_string())
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        found = words.to_numpy(zero_copy_only=False) if self.specials else []
        ids, lens = self.encode(offsets, data)
        which = [(i, self.specials[w]) for i, w in enumerate(found) if w in self.specials] if self.specials else []
        for i, special in reversed(which):
            at = int(lens[:i].sum())
            ids = np.concatenate([ids[:at], np.array([special], np.int32), ids[at + lens[i] :]])
            lens[i] = 1
        return ids, lens


def slices(lists: pa.ListArray, most: int):
    """(from, to) stretches of an array of lists with about `most` values each, a list at least."""
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(lists):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        upto = max(at + 1, upto)
        yield at, upto
        at = upto


def coded(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct values, the number of the value of each element, and where each list begins and ends."""
    values = lists.flatten().dictionary_encode()
    bounds = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
    return values.dictionary, values.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds

"""Token ids in a binary format of independently reset, checksummed blocks, coded by context mixing.

A block holds BLOCK ids and is coded on its own: its model starts afresh, so any block can be read alone. Ids are
named by the order in which the block first has them. Each id is compared with two predictions - what followed the
last two ids before (order 2) and what followed the last id (order 1) - and otherwise falls into a class of names
(order 0: the names of frequent ids are small). Which prediction hits, or which class, is one symbol of eight. Two
adaptive distributions say how likely it is: one by how reliable both predictions have been there and whether they
agree, one by the last symbol. They are mixed with a weight that moves towards the one which did better, and the
mixture drives a range coder. The lower bits of names, and each new id, follow as plain bits.

All blocks of a segment are coded in step, one array element a block, so the work is some array operations for each
place in a block and not for each id. The encoder finds names and order 2 ahead, by sorting the places of each block.
Only whole numbers are used (and quotients of such below 2^53), so decoding repeats encoding exactly.

A segment is one row of a file: magic, sizes, then per block the lengths of both parts and their CRC-32, then the parts.
Files are Parquet with segments as rows, in ascending doc_id order: Spark's committer keeps them whole
when executors are lost, and any file system that Spark reaches will do. A document lies in one segment.

Defined results: null and empty texts have the end id alone; null doc_ids come first; rows of one doc_id come in the
order of their texts, equal rows one after another; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.shared import shared_folder, shuffle_partitions, text_of

MAGIC = b"CMX4"
_FILE = pa.schema([
    ("file", pa.int64()), ("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("known", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())),
    ("n_ids", pa.int64()), ("coded", pa.binary()),
])
#: Ids of a block, and of a segment (its blocks are coded in step); slots of the order-2 predictions of a block.
#: Half of a step's time does not depend on how many blocks share it, with 2,000 of them.
BLOCK, SEGMENT_IDS, SLOTS = 1 << 12, 1 << 24, 1 << 12
#: Symbols: a hit of order 2, a hit of order 1, four classes of names (of 8, 32 and 256 names, and the rest), a new small id, another new id.
SYMBOLS, HIT_TWO, HIT_ONE, SMALL, NEW = 8, 0, 1, 6, 7
#: Distributions are the ends of all symbols out of 2^14; a symbol moves them by 1/32 of the way to itself (more in the first
#: steps of a block), and none gets less than GAP of the target.
TOTAL_BITS, RATE, GAP = 14, 5, 40
TOTAL = 1 << TOTAL_BITS
#: The coder's span is kept from 2^28 to 2^52 (so that doubles divide exactly); 24 bits leave at a time, at most once in two steps.
WORD_BITS, LEAST_BITS = 24, 28
RAW_BITS, SMALL_BY = 16, 6  # bits of a new id, at most, that a small one is measured by; bits that it saves
#: Blocks whose names and predictions are found together; steps whose places are.
TOGETHER, STEPS = 32, 16

_LOW_BITS = np.array([0, 0, 3, 5, 8, 12, 0, 0], dtype=np.int64)  # of what follows a class
_LOW_MASK = (1 << _LOW_BITS) - 1
_FIRST = np.array([0, 0, 0, 8, 40, 296, 0, 0], dtype=np.int64)  # of a class
_CLASS = (np.searchsorted(_FIRST[2:SMALL], np.arange(BLOCK), side="right") + 1).astype(np.uint8)
_REST = (np.arange(BLOCK) - _FIRST[_CLASS]).astype(np.int16)
_AT = np.arange(1, SYMBOLS + 1)
_AIM = np.array([np.where(_AT <= s, GAP * _AT, TOTAL - GAP * (SYMBOLS - _AT)) for s in range(SYMBOLS)], dtype=np.int16)
_AIM_ROWS = _AIM.reshape(-1).view(np.complex128)  # 16 bytes in one
_EVEN = (_AT * TOTAL // SYMBOLS).astype(np.int16)
_BY_LAST, _BY_BEFORE = np.int16(40503 - (1 << 16)), np.int16(30011)  # of the slot of two names


def _row_of(value: np.ndarray) -> np.ndarray:
    """Each number eight times, as 16 bits: four copies in one product, and those twice."""
    out = np.empty((len(value), 2), dtype=np.int64)
    out[:, 0] = out[:, 1] = value * 0x0001_0001_0001_0001
    return out.reshape(-1).view(np.int16)


class _Mixer:
    """Mixed distributions of many blocks in step. Tables have a place for each block beside one another."""

    def __init__(self, n: int):
        self.row = np.arange(n) * SYMBOLS
        by_match, by_last = np.tile(_EVEN, (n * 32, 1)), np.tile(_EVEN, (n * SYMBOLS, 1))
        self.match_rows, self.last_rows = by_match.reshape(-1).view(np.complex128), by_last.reshape(-1).view(np.complex128)
        self.weight, self.eighths, self.steps = np.full(n, 64), np.full(n * SYMBOLS, 4, dtype=np.int16), 0

    def mix(self, match: np.ndarray, tail: np.ndarray) -> None:
        """Where each symbol ends out of 2^14, by the places of both distributions."""
        self.match, self.tail = match, tail
        self.p, self.q = self.match_rows.take(match, mode="clip").view(np.int16), self.last_rows.take(tail, mode="clip").view(np.int16)
        # by eighths: what is lost to rounding is below the least share
        mixture = self.q - self.p
        mixture >>= 3
        mixture *= self.eighths
        mixture += self.p
        self.mixture = mixture

    def share(self, at: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the symbols at these places of all rows start and how much they have."""
        start = self.mixture.take(before, mode="wrap")
        start &= TOTAL - 1  # before a row is the end of another one, which is all
        return start, self.mixture.take(at, mode="clip") - start

    def symbol_at(self, place: np.ndarray) -> np.ndarray:
        return np.bitwise_count((self.mixture <= _row_of(place)).view(np.uint64))

    def update(self, symbol: np.ndarray, at: np.ndarray, before: np.ndarray) -> None:
        """After a symbol, one of the two distributions moves, in turn; the weight after every fourth."""
        if self.steps & 3 == 3:
            p, q = self.p, self.q
            of_p = p.take(at, mode="clip") - (p.take(before, mode="wrap") & TOTAL - 1)
            better = q.take(at, mode="clip") - (q.take(before, mode="wrap") & TOTAL - 1) > of_p
            self.weight = np.minimum(np.maximum(self.weight + better * 16 - 8, 16), 112)
            self.eighths = _row_of(self.weight >> 4)
        was = self.q if self.steps & 1 else self.p
        moved = _AIM_ROWS.take(symbol, mode="clip").view(np.int16)
        moved -= was
        moved >>= RATE - (self.steps < 512) - (self.steps < 64)
        moved += was
        if self.steps & 1:
            self.last_rows[self.tail] = moved.view(np.complex128)
        else:
            self.match_rows[self.match] = moved.view(np.complex128)
        self.steps += 1


class _Writer:
    """A range coder over many streams in step. Words may carry into the ones before; that is settled at the end."""

    def __init__(self, n: int, steps: int):
        self.n, self.low, self.span, self.room = n, np.zeros(n, dtype=np.int64), np.full(n, 1 << WORD_BITS + LEAST_BITS), steps // 2 + 8
        self.out, self.at = np.zeros(self.room * n, dtype=np.int32), np.arange(n)

    def symbol(self, start: np.ndarray, size: np.ndarray) -> None:
        self.span >>= TOTAL_BITS
        self.low += self.span * start
        self.span *= size

    def words(self) -> None:
        """Words out where the span has become small."""
        small = self.span - (1 << LEAST_BITS)
        small >>= 63  # -1 or 0
        self.out[self.at] = self.low >> LEAST_BITS  # stays only where the place moves on
        self.low &= ~(small & -1 << LEAST_BITS)
        self.at += small & self.n
        small &= WORD_BITS
        self.low <<= small
        self.span <<= small

    def bodies(self) -> list[bytes]:
        n, down = self.n, LEAST_BITS - WORD_BITS
        low = self.low & (1 << LEAST_BITS) - 1
        self.out[self.at], self.out[self.at + n], self.out[self.at + 2 * n] = self.low >> LEAST_BITS, low >> down, (low & (1 << down) - 1) << WORD_BITS - down
        sizes = self.at // n + 3
        words = self.out.reshape(self.room, n)[: int(sizes.max())]
        while (carry := words >> WORD_BITS).any():
            words &= (1 << WORD_BITS) - 1
            words[:-1] += carry[1:]
        held = np.ascontiguousarray(words.T).astype(">u4").view(np.uint8).reshape(n, -1, 4)[:, :, 1:].copy()
        return [held[i, :k].tobytes() for i, k in enumerate(sizes.tolist())]


class _Reader:
    def __init__(self, bodies: list[bytes]):
        n, most, down = len(bodies), max(map(len, bodies)) // 3 + 4, LEAST_BITS - WORD_BITS
        held = np.zeros((n, most, 4), dtype=np.uint8)
        for i, body in enumerate(bodies):
            held[i, : len(body) // 3, 1:] = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        words = np.ascontiguousarray(held.reshape(-1).view(">u4").reshape(n, most).astype(np.int32).T)
        following = words[1:] >> WORD_BITS - down
        self.n, self.value, self.span = n, words[0].astype(np.int64) << LEAST_BITS, np.full(n, 1 << WORD_BITS + LEAST_BITS)
        self.value |= words[1].astype(np.int64) << down | following[1]
        self.next = ((words[2:-1] & (1 << WORD_BITS - down) - 1) << down | following[2:]).reshape(-1)
        self.at = np.arange(n)

    def place(self) -> np.ndarray:
        self.span >>= TOTAL_BITS
        return (self.value / self.span).astype(np.int64)

    def symbol(self, start: np.ndarray, size: np.ndarray) -> None:
        self.value -= self.span * start
        self.span *= size

    def words(self) -> None:
        small = self.span - (1 << LEAST_BITS)
        small >>= 63  # -1 or 0
        more = self.next.take(self.at, mode="clip") & small
        self.at += small & self.n
        small &= WORD_BITS
        self.value <<= small
        self.value |= more
        self.span <<= small


def _packed(values: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Fields of up to 31 bits one after another, of each block on their own in whole bytes."""
    upto = np.cumsum(sizes)
    bits = np.r_[0, upto][np.r_[0, np.cumsum(counts)]]
    first = np.r_[0, np.cumsum(-(-np.diff(bits) // 32))]
    words = np.zeros(int(first[-1]) + 2, dtype=np.int64)  # fields without bits may lie behind the last word
    if len(values):
        at = upto - sizes + np.repeat(32 * first[:-1] - bits[:-1], counts)
        word = at >> 5
        begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sums, word = np.add.reduceat(values << (at & 31), begins), word[begins]
        words[word] = sums & 0xFFFF_FFFF
        words[word + 1] += sums >> 32
    held = words.astype("<u4").tobytes()
    return [held[4 * a : 4 * a + b] for a, b in zip(first[:-1].tolist(), (-(-np.diff(bits) // 8)).tolist(), strict=True)]


def _windows(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each word of 32 bits of all parts, it and the next one; the bit at which each part begins."""
    parts = [p + bytes(-len(p) % 4) for p in parts]
    words = np.frombuffer(b"".join([*parts, bytes(8)]), dtype="<u4").astype(np.int64)
    return words[:-1] | words[1:] << 32, np.cumsum([0, *(8 * len(p) for p in parts[:-1])])


def _new_bits(width: int) -> np.ndarray:
    """Of the bits of a new id, by symbol."""
    out = np.zeros(SYMBOLS, dtype=np.int64)
    out[NEW], out[SMALL] = width, max(min(width, RAW_BITS) - SMALL_BY, 0)
    return out


def _in_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of numbers below 2^19 (or 2^51 of 64 bits): places in order of number and place, and whether the one before has the same number."""
    rows, block = keys.shape
    keys = keys << 12
    keys |= np.arange(block, dtype=keys.dtype)
    keys.sort(axis=1)
    at = keys & 4095
    at += np.arange(0, rows * block, block, dtype=keys.dtype)[:, None]
    keys >>= 12
    same = np.zeros((rows, block), dtype=bool)
    np.equal(keys[:, 1:], keys[:, :-1], out=same[:, 1:])
    return at.reshape(-1), same.reshape(-1)


def _names_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names in rows of ids, and which are new."""
    at, same = _in_runs(ids)
    begins = ~same
    first = at[begins]
    new, name = np.zeros(ids.shape, dtype=bool), np.empty(ids.shape, dtype=np.int16)
    new.reshape(-1)[first] = True
    rank = np.cumsum(new, axis=1, dtype=np.int16)
    rank -= 1
    run = np.cumsum(begins, dtype=np.int32)
    run -= 1
    name.reshape(-1)[at] = rank.reshape(-1).take(first).take(run)
    return name, new


def _held_two(context: np.ndarray, name: np.ndarray) -> np.ndarray:
    """What the predictions of order 2 hold before each name: four times the last name there, plus whether the last two were right."""
    at, same = _in_runs(context)
    here = name.reshape(-1).take(at)
    last, right = np.zeros_like(here), np.zeros_like(same)
    np.multiply(here[:-1], same[1:], out=last[1:])
    hit = last == here
    np.logical_and(hit[:-1], same[1:], out=right[1:])
    last <<= 2
    last += right
    last[1:] += (right[:-1] & same[1:]) * np.int16(2)
    out = np.empty(name.shape, dtype=np.int16)
    out.reshape(-1)[at] = last
    return out


def _told_one(held: np.ndarray, name: np.ndarray) -> np.ndarray:
    """What a prediction of order 1 holds afterwards: four times a name, plus how often it was right (0 to 3), as often as it may fail."""
    missed = np.where(held & 3, held - 1, name << 2)
    return np.where(held >> 2 == name, np.minimum(held + 1, held | 3), missed)


def _held_one(names: np.ndarray) -> np.ndarray:
    """What the predictions of order 1 hold before each name, in rows of a step."""
    block, n = names.shape
    held, table, lane = np.zeros((block, n), dtype=np.int16), np.zeros(n * BLOCK, dtype=np.int16), np.arange(n)
    at = lane
    for step, name in enumerate(names):
        table.take(at, mode="clip", out=held[step])
        table[at] = _told_one(held[step], name)
        at = name * np.int64(n)
        at += lane
    return held


def _slot(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The slot of two names, in 16 bits."""
    slot = last * _BY_LAST
    slot += before * _BY_BEFORE
    slot &= SLOTS - 1
    return slot


def _matched(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    """One of 32 by how reliable both predictions are and whether they agree."""
    match = two & 3
    match <<= 2
    match |= one & 3
    match <<= 1
    match += (two ^ one) > 3
    return match


def encode_ids(ids: np.ndarray) -> bytes:
    """A segment's bytes for an array of ids below 2^31."""
    n, width = len(ids), int(ids.max()).bit_length() if len(ids) else 0
    count, block = -(-n // BLOCK), min(BLOCK, n)
    parts: list[tuple[bytes, bytes]] = []
    if n:
        grid = np.zeros((count, block), dtype=np.int32)
        grid.reshape(-1)[:n] = ids
        symbols, matches = np.empty((block, count), dtype=np.uint8), np.empty((block, count), dtype=np.uint8)
        names, fresh_at = np.empty((block, count), dtype=np.int16), np.empty((count, block), dtype=bool)
        for top in range(0, count, TOGETHER):  # by parts that fit a cache
            part = grid[top : top + TOGETHER]
            name, fresh_at[top : top + TOGETHER] = _names_of(part if width < 19 else part.astype(np.int64))
            names[:, top : top + TOGETHER] = name.T
        held_one = _held_one(names)
        new_bits, fields = _new_bits(width), []
        for top in range(0, count, TOGETHER):
            part, new = grid[top : top + TOGETHER], fresh_at[top : top + TOGETHER]
            name, one = (np.ascontiguousarray(x[:, top : top + TOGETHER].T) for x in (names, held_one))
            last, before = np.zeros_like(name), np.zeros_like(name)
            last[:, 1:], before[:, 2:] = name[:, :-1], name[:, :-2]
            two = _held_two(_slot(last, before).astype(np.int32), name)
            symbol = _CLASS.take(name)
            symbol[one >> 2 == name] = HIT_ONE
            symbol[two >> 2 == name] = HIT_TWO
            fresh = part[new]
            symbol[new] = np.where(fresh >> new_bits[SMALL], NEW, SMALL)
            symbols[:, top : top + TOGETHER], matches[:, top : top + TOGETHER] = symbol.T, _matched(two, one).T
            classed = (symbol > HIT_ONE) & ~new
            held = np.concatenate([(symbol > HIT_ONE) & ~new, new], axis=1)
            values, kinds = np.concatenate([_REST.take(name), part], axis=1)[held], np.concatenate([symbol, symbol], axis=1)[held]
            fields += _packed(values.astype(np.int64), (_LOW_BITS + new_bits).take(kinds), held.sum(axis=1))
        del grid, names, held_one, fresh_at
        mixer, coder, wide, lane = _Mixer(count), _Writer(count, block), np.int64(count), np.arange(count)
        tail = lane
        for top in range(0, block, STEPS):
            many, match = symbols[top : top + STEPS].astype(np.int64), matches[top : top + STEPS] * wide
            match += lane
            at = many + mixer.row
            for step, (symbol, place, here, before) in enumerate(zip(many, match, at, at - 1, strict=True)):
                mixer.mix(place, tail)
                coder.symbol(*mixer.share(here, before))
                if step & 1:
                    coder.words()
                mixer.update(symbol, here, before)
                tail = symbol * wide
                tail += lane
        parts = list(zip(coder.bodies(), fields, strict=True))
    head = MAGIC + struct.pack("<QIII", n, count, block, width)
    sizes = b"".join(struct.pack("<HHI", *map(len, held), zlib.crc32(b"".join(held))) for held in parts)
    return b"".join([head, sizes, struct.pack("<I", zlib.crc32(head + sizes)), *(x for held in parts for x in held)])


def decode_ids(held: bytes) -> np.ndarray:
    """The ids of a segment; a damaged one raises ValueError."""
    if held[:4] != MAGIC or len(held) < 28:
        raise ValueError("not a segment of token ids")
    n, count, block, width = struct.unpack_from("<QIII", held, 4)
    at = 24 + 8 * count
    if len(held) < at + 4 or zlib.crc32(held[:at]) != struct.unpack_from("<I", held, at)[0]:
        raise ValueError("a segment's header fails its checksum")
    at, parts = at + 4, []
    for i in range(count):
        coded, more, check = struct.unpack_from("<HHI", held, 24 + 8 * i)
        upto = at + coded + more
        if len(held) < upto or zlib.crc32(held[at:upto]) != check:
            raise ValueError(f"block {i} fails its checksum")
        parts.append((held[at : at + coded], held[at + coded : upto]))
        at = upto
    if not n:
        return np.empty(0, dtype=np.int64)
    window, bit = _windows([fields for _, fields in parts])
    symbols, names = _decoded_names(block, [body for body, _ in parts], window, bit)
    # new ids follow, in the order of their names
    bits, wide, ids, first = _new_bits(width), np.int64(block), np.empty((count, block), dtype=np.int32), 0
    for top in range(0, count, TOGETHER):  # by parts that fit a cache
        symbol = np.ascontiguousarray(symbols[:, top : top + TOGETHER].T)
        new = symbol >= SMALL
        counts, sizes = new.sum(axis=1), bits.take(symbol[new])
        upto = np.r_[0, np.cumsum(sizes)]
        before = np.r_[0, np.cumsum(counts)]
        place = upto[:-1] + np.repeat(bit[top : top + TOGETHER] - upto[before[:-1]], counts)
        fresh = (window.take(place >> 5) >> (place & 31) & (1 << sizes) - 1).astype(np.int32)
        ids[top : top + TOGETHER] = fresh.take(names[:, top : top + TOGETHER].T + before[:-1, None])
    return ids.reshape(-1)[:n]


def _decoded_names(block: int, bodies: list[bytes], window: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols and names of all blocks, a row for each step; `bit` moves on behind their fields."""
    n = len(bodies)
    symbols, names = np.empty((block, n), dtype=np.uint8), np.empty((block, n), dtype=np.int16)
    mixer, coder, wide, lane = _Mixer(n), _Reader(bodies), np.int64(n), np.arange(n)
    after_two, after_one = np.zeros(n * SLOTS, dtype=np.int16), np.zeros(n * BLOCK, dtype=np.int16)
    last = before = seen = np.zeros(n, dtype=np.int16)
    tail = slot_one = lane
    for step in range(block):
        slot_two = _slot(last, before).astype(np.int64)
        slot_two *= wide
        slot_two += lane
        held_two, held_one = after_two.take(slot_two, mode="clip"), after_one.take(slot_one, mode="clip")
        match = _matched(held_two, held_one).astype(np.int64)
        match *= wide
        match += lane
        mixer.mix(match, tail)
        short = mixer.symbol_at(coder.place())
        symbols[step] = short
        symbol = short.astype(np.int64)
        at = mixer.row + symbol
        at_before = at - 1
        coder.symbol(*mixer.share(at, at_before))
        if step & 1:
            coder.words()
        mixer.update(symbol, at, at_before)
        rest = window.take(bit >> 5, mode="clip")
        rest >>= bit & 31
        rest &= _LOW_MASK.take(symbol, mode="clip")
        rest += _FIRST.take(symbol, mode="clip")
        bit += _LOW_BITS.take(symbol, mode="clip")
        kind, two, one = short.astype(np.int16), held_two >> 2, held_one >> 2
        is_two, new = kind - 1 >> 15, SMALL - 1 - kind >> 15  # -1 or 0
        name = names[step]
        np.bitwise_and(seen, new, out=name)
        name += rest.astype(np.int16)  # none where the name is new or predicted
        name += one & (kind - 2 >> 15 ^ is_two)
        name += two & is_two
        seen = seen - new
        after_one[slot_one] = _told_one(held_one, name)
        held_two &= 1
        held_two <<= 1
        held_two |= name << 2
        held_two += two == name
        after_two[slot_two] = held_two
        last, before = name, last
        tail, slot_one = symbol * wide, name * wide
        tail += lane
        slot_one += lane
    return symbols, names


#: Kinds of bytes: letters, digits, marks, the apostrophe, the space, other ASCII white space, and what may be any of them.
_LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _BREAK, _ANY = range(7)
_KIND = np.full(256, _MARK, dtype=np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]], _KIND[48:58], _KIND[39], _KIND[32], _KIND[9:14], _KIND[28:32], _KIND[128:] = _LETTER, _DIGIT, _QUOTE, _SPACE, _BREAK, _ANY, _ANY
#: First bytes of two that are always a letter (U+00C0 to U+027F but two signs, U+0400 to U+047F).
_TWO_BYTES = np.isin(np.arange(256), [*range(0xC3, 0xCA), 0xD0, 0xD1]).tobytes()
#: Whether a pre-token surely begins between two kinds; 2 where that depends on what follows.
_CUT = np.zeros((8, 8), dtype=np.uint8)
_CUT[:_ANY, :_ANY] = 1 - np.eye(_ANY, dtype=np.uint8)
_CUT[_MARK, _QUOTE] = _CUT[_QUOTE, _MARK] = _CUT[_QUOTE, _LETTER] = 0  # 's, 'll
_CUT[_SPACE, :_SPACE] = 0
_CUT[_SPACE : _BREAK + 1, _SPACE : _BREAK + 1] = 2
_CUT[[_ANY, _ANY, _BREAK], [_SPACE, _BREAK, _ANY]] = 1
_KINDS, _CUTS = _KIND.tobytes(), _CUT.tobytes() + bytes(192)
#: First bytes of white space besides ASCII's six characters, as any of the libraries may see it.
_ODD = np.isin(np.arange(256), [*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]).tobytes()
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: The pattern that the above is made for, which is also the one built into byte-level pre-tokenizers.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units that are one pre-token: of ASCII alone but the apostrophe, or a word.
_PLAIN = r"^(?:[\x00-&(-\x7f]*| ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{400}-\x{47f}]+)$"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The character that stands for each byte in byte-level vocabularies.
_LETTERS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_CODES = np.array([ord(_LETTERS[b]) for b in range(256)], dtype="<u4")


def _mapped(raw: np.ndarray, by: bytes, kind: type = np.uint8) -> np.ndarray:
    """Each byte by a table of 256."""
    return np.frombuffer(raw.tobytes().translate(by), dtype=kind)


class _Tokenizer:
    """The tokenizers library's model behind a cache of units: pre-tokens, or a few of them where only the library can tell.

    Units end where a pre-token surely does, by the kinds of the bytes around, so they can be encoded on their own. Texts with
    other white space than ASCII's are cut by the library. Equal units of a few texts are found by Arrow.
    """

    MOST_UNITS, LONGEST_UNIT, TOGETHER = 900_000, 1 << 12, 1 << 23
    #: Plain units go to the library many at once, unless there are few.
    FEW, AT_ONCE = 100, 1 << 15

    def __init__(self, definition: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        held = json.loads(definition)
        cut = held.get("pre_tokenizer") or {}
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or held.get("normalizer") or not all(t["special"] for t in held.get("added_tokens", [])):
            raise ValueError("not a plain byte-level tokenizer")
        self.by_kind = pattern == _PATTERN and cut.get("use_regex", True)
        whole = Tokenizer.from_str(definition)
        self.cut, self.tokens_of = whole.pre_tokenizer.pre_tokenize_str, whole.model.tokenize
        # the same model for units between spaces, which are no letters of byte-level vocabularies
        whole.pre_tokenizer, whole.encode_special_tokens = pre_tokenizers.CharDelimiterSplit(" "), True
        whole.no_truncation()
        whole.no_padding()
        self.together = whole.encode_batch_fast
        vocabulary = whole.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        self.lengths[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.ends, self.hits = np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int64)

    def thin(self) -> None:
        """Keep the units that were met most, half of the limit at most."""
        kept = np.sort(np.argsort(-self.hits, kind="stable")[: min(self.MOST_UNITS // 2, int((self.hits > 1).sum()))])
        self.known, sizes = self.known.take(pa.array(kept)), np.diff(self.ends)[kept]
        self.ids, self.ends, self.hits = _spans(self.ids, self.ends[kept], sizes), np.r_[0, np.cumsum(sizes)], self.hits[kept] // 2

    def starts(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where units begin in the bytes of texts, which begin and end at `bounds`."""
        kind = _mapped(raw, _KINDS).copy()
        lead = np.flatnonzero(_mapped(raw, _TWO_BYTES, np.bool_))
        sign = (raw[lead] == 0xC3) & ((raw[lead + 1] == 0x97) | (raw[lead + 1] == 0xB7))
        lead = lead[~sign]
        kind[lead] = kind[lead + 1] = _LETTER
        begins = np.zeros(len(raw) + 1, dtype=np.uint8)
        begins[1:-1] = _mapped(kind[:-1] * np.uint8(8) + kind[1:], _CUTS)
        first = np.zeros(len(raw) + 1, dtype=bool)
        first[bounds] = True
        # of white space before something else, the last character is by itself or goes with what follows
        white = np.flatnonzero(begins == 2)
        after = np.minimum(white + 1, len(raw) - 1)
        begins[white] = ~first[white + 1] & (kind[after] != _SPACE) & (kind[after] != _BREAK)
        begins[first] = 1
        odd = np.flatnonzero(_mapped(raw, _ODD, np.bool_)) if self.by_kind else bounds[:-1]
        for i in np.unique(np.searchsorted(bounds, odd, side="right") - 1).tolist():
            text = raw[bounds[i] : bounds[i + 1]].tobytes().decode()
            if not self.by_kind or _OTHER_SPACE.search(text):
                begins[bounds[i] : bounds[i + 1]] = 0
                begins[bounds[i] + np.cumsum([0, *(len(piece) for piece, _ in self.cut(text))])[:-1]] = 1  # a character is a byte there
        return np.flatnonzero(begins[:-1])

    def learn(self, fresh: pa.Array) -> np.ndarray:
        """Encode new units; the place of each among all known ones."""
        plain = pc.match_substring_regex(fresh, _PLAIN).to_numpy(zero_copy_only=False)
        order, many = np.argsort(~plain, kind="stable"), int(plain.sum())
        fresh, place = fresh.take(pa.array(order)), np.empty(len(order), dtype=np.int64)
        place[order] = len(self.known) + np.arange(len(order))
        ids, sizes = [self.ids], [np.diff(self.ends)]
        for at in range(0, len(fresh), self.AT_ONCE):
            part = fresh.slice(at, self.AT_ONCE)
            joined = min(max(many - at, 0), len(part))
            found = self._at_once(part.slice(0, joined)) if joined > self.FEW else None
            if found:
                ids.append(found[0])
                sizes.append(found[1])
                part, joined = part.slice(joined), 0
            more, size = self._one_by_one(part.to_pylist(), joined)
            ids.append(more)
            sizes.append(size)
        self.known, self.ids = pa.concat_arrays([self.known, fresh]), np.concatenate(ids)
        self.ends = np.r_[0, np.cumsum(np.concatenate(sizes))]
        self.hits = np.r_[self.hits, np.zeros(len(order), dtype=np.int64)]
        return place

    def _one_by_one(self, units: list[str], plain: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each unit, of which the first ones are plain."""
        ids, ends, tokens_of = [], [0], self.tokens_of
        for i, unit in enumerate(units):
            for piece in ["".join(map(_LETTERS.get, unit.encode()))] if i < plain else [piece for piece, _ in self.cut(unit)]:
                ids += [t.id for t in tokens_of(piece)]
            ends.append(len(ids))
        return np.array(ids, dtype=np.int32), np.diff(ends)

    def _at_once(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for plain units in one call; ids know how many bytes they are of. None where these don't add up to the units."""
        ends = np.frombuffer(units.buffers()[1], dtype=np.int64, count=len(units) + units.offset + 1)[units.offset :]
        raw = np.frombuffer(units.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
        ends = ends[1:] - ends[0]
        codes, held = np.full(len(raw) + len(units), ord(" "), dtype="<u4"), np.ones(len(raw) + len(units), dtype=bool)
        held[ends + np.arange(len(units))] = False
        codes[held] = _CODES.take(raw)
        ids = np.array(self.together([codes.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, dtype=np.int32)
        upto = np.cumsum(self.lengths.take(ids))
        last = np.searchsorted(upto, ends)
        if not len(upto) or upto[-1] != len(raw) or (upto.take(last) != ends).any():
            return None
        return ids, np.diff(last, prepend=-1)

    def encode(self, texts: pa.Array | list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; a few texts at a time are looked up together."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + texts.offset + 1)[texts.offset :] if len(texts) else np.zeros(1, dtype=np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + self.TOGETHER, side="right")) - 1)
            yield from self._look_up(raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
            at = to

    def _look_up(self, raw: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        if not len(raw):
            return [self.ids[:0]] * (len(bounds) - 1)
        starts = self.starts(raw, bounds)
        upto = np.append(starts, len(raw))
        held = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(upto), pa.py_buffer(raw)).dictionary_encode()
        units, which = held.dictionary, held.indices.to_numpy()
        found = pc.index_in(units, value_set=self.known)
        if len(self.known) + found.null_count > self.MOST_UNITS:
            self.thin()
            found = pc.index_in(units, value_set=self.known)
        new, at = found.is_null().to_numpy(zero_copy_only=False), found.fill_null(0).to_numpy().astype(np.int64)
        if found.null_count:
            at[new] = self.learn(units.filter(found.is_null()))
        self.hits[at] += 1
        sizes = (self.ends[at + 1] - self.ends[at]).astype(np.int32)[which]
        ids = _spans(self.ids, self.ends[at].astype(np.int32)[which], sizes)
        ends = np.r_[0, np.cumsum(sizes)][np.searchsorted(starts, bounds[1:-1])]
        if np.diff(upto).max() > self.LONGEST_UNIT:
            self.forget()
        return np.split(ids, ends)


def _spans(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of spans one after another."""
    upto = np.cumsum(sizes)
    total = int(upto[-1]) if len(upto) else 0
    at = np.repeat((first + sizes - upto).astype(np.int32), sizes)  # a cache and a few texts have far less than 2^31 ids
    at += np.arange(total, dtype=np.int32)
    return values.take(at)


_held: dict[tuple[str, str], _Tokenizer] = {}


def _tokenizer_of(definition: str, pattern: str) -> _Tokenizer:
    """One a worker process, whose cache serves all its tasks."""
    if (definition, pattern) not in _held:
        _held.clear()
        _held[definition, pattern] = _Tokenizer(definition, pattern)
    return _held[definition, pattern]


def write_ids(documents: DataFrame, definition: str, pattern: str, end_id: int = 0, path: str | None = None) -> str:
    """Encode and write all documents in ascending doc_id order; the folder of the files."""
    spark = documents.sparkSession
    path = path or f"{shared_folder(spark)}/strandline-ids-{uuid.uuid4().hex}"
    with open(definition) as held:
        shared = spark.sparkContext.broadcast(held.read())

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer_of(shared.value, pattern)
        file, number = TaskContext.get().partitionId(), 0
        docs: list = []
        ids: list[np.ndarray] = []
        held = 0

        def segment() -> pa.RecordBatch:
            row = {"file": file, "segment": number, "doc_ids": [d or 0 for d in docs], "known": [d is not None for d in docs], "lengths": [len(x) for x in ids], "n_ids": held, "coded": encode_ids(np.concatenate(ids))}
            return pa.RecordBatch.from_pylist([row], schema=_FILE)

        for batch in batches:
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), tokenizer.encode(batch.column("text")), strict=True):
                new = np.append(found, np.int32(end_id))
                if held and held + len(new) > SEGMENT_IDS:
                    yield segment()
                    docs, ids, held, number = [], [], 0, number + 1
                docs.append(doc_id)
                ids.append(new)
                held += len(new)
        if held:
            yield segment()

    # half as many partitions, as twice as many blocks share a step then
    ordered = text_of(documents).repartitionByRange(-(-shuffle_partitions(spark) // 2), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(segments, "file long, segment long, doc_ids array<long>, known array<boolean>, lengths array<long>, n_ids long, coded binary")
    rows.write.option("compression", "none").parquet(path)
    return path


def read_ids(spark, path: str) -> DataFrame:
    """doc_id, ids (array), start (ids before the document) from the files alone."""
    return _decoded(spark, path, lambda ids: ids.tolist(), "array<long>", "ids")


def read_digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files alone."""
    return _decoded(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "long", "ids_crc32")


def _decoded(spark, path: str, shown, kind: str, name: str) -> DataFrame:
    files = spark.read.parquet(path)
    # one row a segment: where its ids begin; files first, then segments within each
    per_file = files.groupBy("file").agg(F.sum("n_ids").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("file", "segment", within.alias("within")).join(per_file.select("file", above.alias("above")), "file")
    starts = starts.select("file", "segment", (F.col("within") + F.col("above")).alias("first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for file, number, docs, known, lengths, coded in zip(*(rows[c] for c in ("file", "segment", "doc_ids", "known", "lengths", "coded")), strict=True):
                ids = decode_ids(coded)
                ends = np.cumsum(lengths)
                pieces = np.split(ids, ends[:-1])
                yield pd.DataFrame({
                    "file": file, "segment": number, "doc_id": pd.arrays.IntegerArray(np.array(docs), ~np.array(known, dtype=bool)),
                    "offset": ends - np.asarray(lengths), "n_tokens": lengths, name: [shown(p) for p in pieces],
                })

    decoded = files.mapInPandas(run, f"file long, segment long, doc_id long, offset long, n_tokens long, {name} {kind}")
    return decoded.join(starts, ["file", "segment"]).select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", name)

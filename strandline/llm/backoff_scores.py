"""Stupid-backoff scores, relationally.

The score of a text is the mean of ln S over its words, where for n-grams of up to `order` words (three unless
told otherwise) S(w | context) = count(context w) / count(context) if that n-gram occurs in the corpus, and else
ALPHA * S(w | context less its first word); a word alone scores its count, at least 1, over the number of words.
Where a corpus scores itself, each document is scored by the counts of all *other* documents (the corpus counts
less its own), so that unseen n-grams back off and copies of other documents stand out.

1. Documents are bundled into blocks of about PIECE bytes of text and written, so that a block keeps its name.
2. Each block is exploded into its n-grams; every distinct one is one entry (hash, count). Entries are
   partitioned by hash into buckets, and travel as compressed lists, one for each block and bucket.
3. A bucket adds up its count table and joins it to the entries: each list is answered by the corpus counts, in
   the order of the entries. However common an n-gram is, it is one entry a block, so no bucket is hot; the
   number of buckets follows from the number of words, so a bucket stays at about BUCKET_ENTRIES.
4. Answers and blocks meet by block. A block's n-grams are taken again, in the same order; each word's log S is
   worked out and summed per document.

Hashes have 56 bits: of g different n-grams, a share of g / 2^56 shares its hash with another and counts too much
(4e-5 of them for 100 TB of text).

Defined results: every row is a document of its own, also rows that repeat a doc_id or have none; null, empty and
blank texts have 0 tokens and a null score; a word that no other document holds counts as once; where a document
is the whole corpus, the number of words counts as one; extra columns are ignored. Words are case-sensitive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import shuffle_partitions, text_of, written

ALPHA, ORDER = 0.4, 3
#: Bytes of text in a block; entries in a bucket.
PIECE, BUCKET_ENTRIES = 12 << 20, 4_000_000
#: Bytes of text that are hashed at once: eight bytes of working memory each, several times over.
CHUNK = 1 << 21
U64 = np.uint64
HASH_BITS = 56
_MIX = (U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))
_CHARACTER = (np.arange(1, 257, dtype=U64) * _MIX[0]) ^ (np.arange(1, 257, dtype=U64) * _MIX[1] >> U64(29))
_BASE = 0xD1342543DE82EF95
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_POWERS: dict[int, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * _MIX[1]
    x = (x ^ (x >> U64(29))) * _MIX[2]
    return x ^ (x >> U64(32))


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(1 << max(12, (n - 1).bit_length()), U64(base))
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def _edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and the text that each is in."""
    words, of, first, size = [np.empty(0, dtype=U64)], [np.empty(0, dtype=np.int64)], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > CHUNK or i == len(texts) - 1:
            some, place = _hashes(texts[first : i + 1])
            words.append(some)
            of.append(place + first)
            first, size = i + 1, 0
    return np.concatenate(words), np.concatenate(of)


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    start, end = _edges(raw)
    if not len(start):
        return np.empty(0, dtype=U64), np.empty(0, dtype=np.int64)
    total = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(_CHARACTER[raw] * _powers(_BASE, len(raw)), out=total[1:])
    back = _powers(pow(_BASE, -1, 1 << 64), len(raw))
    words = _mixed((total[end] - total[start]) * back[start] + (end - start).astype(U64))
    return words, np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")


class Grams:
    """The n-grams of all orders of a block of texts, in one array: those of one word, of two, and so on."""

    def __init__(self, texts: list[bytes], order: int):
        words, self.text = word_hashes(texts)
        n = len(words)
        starts = np.flatnonzero(np.r_[True, self.text[1:] != self.text[:-1]]) if n else np.empty(0, dtype=np.int64)
        self.place = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))  # of a word in its text
        gram, parts, self.ends_at = words, [], []
        for k in range(1, order + 1):
            if k > 1:
                gram = _mixed(gram[:-1] * U64(3) + _mixed(words[k - 1 :] + U64(11)))
            at = np.flatnonzero(self.place >= k - 1)  # the last word of each n-gram
            parts.append(_mixed(gram[at - (k - 1)] + U64(k)) >> U64(64 - HASH_BITS))
            self.ends_at.append(at)
        self.hashes = np.concatenate(parts)

    def names(self) -> np.ndarray:
        """Sorted distinct hashes."""
        every = np.sort(self.hashes)
        return every[np.r_[True, every[1:] != every[:-1]]] if len(every) else every

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes and how often the block has each."""
        return np.unique(self.hashes, return_counts=True)

    def counts(self, names: np.ndarray, totals: np.ndarray, leave_out: bool) -> Iterator[np.ndarray]:
        """For one order after another, per word, how often the corpus has the n-gram that ends there, 0 where none fits;
        without the word's own text if `leave_out`. `totals` are the corpus counts of `names`, the distinct hashes."""
        n, at = len(self.text), 0
        for ends in self.ends_at:
            hashes, text = self.hashes[at : at + len(ends)], self.text[ends]
            at += len(ends)
            out = np.zeros(n, dtype=np.int64)
            if len(ends):
                order = np.argsort(hashes, kind="stable")  # texts come one after another and stay so
                hashes, text = hashes[order], text[order]
                new = np.r_[True, hashes[1:] != hashes[:-1]]
                found = totals[np.searchsorted(names, hashes[new])][np.cumsum(new) - 1]
                if leave_out:  # runs of equal n-gram and text
                    starts = np.flatnonzero(new | np.r_[True, text[1:] != text[:-1]])
                    size = np.diff(np.r_[starts, len(hashes)])
                    found -= np.repeat(size, size)
                out[ends[order]] = found
            yield out


def log_scores(grams: Grams, counts: Iterator[np.ndarray], words: np.ndarray, alpha: float) -> np.ndarray:
    """ln S of every word; `words` is the number of words of the corpus that scores it."""
    before = next(counts)
    out = np.log(np.maximum(before, 1)) - np.log(np.maximum(words, 1))
    for k, found in enumerate(counts, 1):
        seen = found > 0
        out[(grams.place >= k) & ~seen] += math.log(alpha)
        at = np.flatnonzero(seen)
        out[at] = np.log(found[at]) - np.log(before[at - 1])
        before = found
    return out


# --- blocks of texts


def _packed(texts: list[bytes]) -> bytes:
    return zstandard.compress(b"".join(texts), 9)  # they are written and moved once


def _unpacked(held: bytes, lengths: np.ndarray) -> list[bytes]:
    whole = zstandard.decompress(held, max_output_size=max(1, int(np.sum(lengths)))) if len(lengths) and np.sum(lengths) else b""
    ends = np.cumsum(lengths).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


_BLOCKS = pa.schema([
    ("block", pa.int64()), ("words", pa.int64()), ("ids", pa.list_(pa.int64())), ("known", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("texts", pa.binary()),
])


def blocks(documents: DataFrame) -> DataFrame:
    """(block, words, ids, known, lengths, texts), written; an id that is not known is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def block() -> pa.RecordBatch:
            words = sum(len(_edges(np.frombuffer(t, dtype=np.uint8))[0]) for t in texts)
            row = {"block": name, "words": words, "ids": [i or 0 for i in ids], "known": [i is not None for i in ids], "lengths": [len(t) for t in texts]}
            return pa.RecordBatch.from_pylist([row | {"texts": _packed(texts)}], schema=_BLOCKS)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if texts and size + len(text) > PIECE:
                    yield block()
                    name, ids, texts, size = name + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if texts:
            yield block()

    rows = text_of(documents).mapInArrow(run, "block long, words long, ids array<long>, known array<boolean>, lengths array<long>, texts binary")
    return written(rows, "blocks")


# --- counts by hash


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compress better."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def _from_planes(held: bytes, kind) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(held), dtype=np.uint8).reshape(wide, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def entries(held: DataFrame, order: int, buckets: int, answered: bool) -> DataFrame:
    """(bucket, block, hashes, counts) for each block and bucket; blocks that are not to be answered have no name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for block, texts, lengths in zip(rows["block"], rows["texts"], rows["lengths"], strict=True):
                hashes, counts = Grams(_unpacked(texts, lengths), order).distinct()
                edges = np.searchsorted(_bucket(hashes, buckets), np.arange(buckets + 1))
                out = [(b, block, _planes(np.diff(hashes[i:j], prepend=U64(0))), _planes(counts[i:j].astype(np.int32)))
                       for b, i, j in zip(range(buckets), edges.tolist(), edges[1:].tolist(), strict=False) if j > i]
                if out:
                    frame = pd.DataFrame(out, columns=["bucket", "block", "hashes", "counts"]).astype({"block": "Int64"})
                    yield frame if answered else frame.assign(block=pd.array([None] * len(frame), dtype="Int64"))

    return held.select("block", "texts", "lengths").mapInPandas(run, "bucket long, block long, hashes binary, counts binary")


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> U64(HASH_BITS - 31)).astype(np.int64) * buckets >> 31


def answers(rows: DataFrame) -> DataFrame:
    """(block, bucket, totals): the corpus count of each entry, in the entries' order; one count table a bucket."""

    def join(group: pd.DataFrame) -> pd.DataFrame:
        lists = [np.cumsum(_from_planes(h, U64), dtype=U64) for h in group["hashes"]]
        counts = np.concatenate([_from_planes(c, np.int32) for c in group["counts"]])
        _, place = np.unique(np.concatenate(lists), return_inverse=True)
        totals = np.bincount(place, counts).astype(np.int64)[place]  # exact: counts are below 2^53
        out, at = [], 0
        for bucket, block, held in zip(group["bucket"], group["block"], lists, strict=True):
            if not pd.isna(block):
                out.append((int(block), bucket, _planes(totals[at : at + len(held)])))
            at += len(held)
        return pd.DataFrame(out, columns=["block", "bucket", "totals"])

    return rows.groupBy("bucket").applyInPandas(join, "block long, bucket long, totals binary")


def scores(documents: DataFrame, corpus: DataFrame | None = None, alpha: float = ALPHA, order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens and score (mean of ln S over the tokens) of every document.

    Counts come from `corpus`, or from the other documents if there is none.
    """
    asked, own = blocks(documents), corpus is None
    counted = asked if own else blocks(corpus)
    total = counted.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    buckets = max(shuffle_partitions(documents.sparkSession), -(-order * total // BUCKET_ENTRIES))
    rows = entries(asked, order, buckets, True)
    if not own:  # the documents' n-grams are asked for but do not count
        nothing = F.pandas_udf(lambda counts: counts.map(lambda c: _planes(np.zeros_like(_from_planes(c, np.int32)))), "binary")
        rows = rows.withColumn("counts", nothing("counts")).unionByName(entries(counted, order, buckets, False))

    def score(held: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        totals = np.concatenate([np.empty(0, dtype=np.int64), *(_from_planes(x, np.int64) for x in found.sort_values("bucket")["totals"])])
        for ids, known, lengths, texts in zip(held["ids"], held["known"], held["lengths"], held["texts"], strict=True):
            grams, n = Grams(_unpacked(texts, lengths), order), len(ids)
            size = np.bincount(grams.text, minlength=n)
            sums = np.zeros(n)
            if len(grams.text):
                each = log_scores(grams, grams.counts(grams.names(), totals, own), (total - size if own else np.full(n, total))[grams.text], alpha)
                sums = np.bincount(grams.text, each, n)
            score_ = pd.array([x / k if k else None for x, k in zip(sums.tolist(), size.tolist(), strict=True)], dtype="Float64")
            out.append(pd.DataFrame({"doc_id": pd.arrays.IntegerArray(np.array(ids), ~np.array(known, dtype=bool)), "n_tokens": size, "score": score_}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "n_tokens": [], "score": []})

    by_block = asked.select("block", "ids", "known", "lengths", "texts").groupBy("block")
    return by_block.cogroup(answers(rows).groupBy("block")).applyInPandas(score, "doc_id long, n_tokens long, score double")

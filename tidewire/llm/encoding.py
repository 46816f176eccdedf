"""Problem 8: encoding of a whole collection with a public tokenizer.

Texts are split by the tokenizer's pattern. The distinct pieces of a chunk are merged together: pieces of similar length are the rows of a padded
matrix of token ids, and in each round every row merges its leftmost pair of least rank. Ranks are looked up in a hash table of pairs held
in numpy arrays; a merge is a compaction of the row; finished rows leave the matrix. Pieces of over ``LONG`` bytes (a run of
thousands of letters, say) are merged alone, all places of the least pair at once in each round, which gives the same ids, as no pair made by a
merge can rank before it.

No shuffle: a scan, one Arrow pass, a projection.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.words import chunks, ranges
from tidewire.sources.tables import table

#: Folder of the vocabulary files; another may be passed or set.
TOKENIZERS = os.environ.get("TIDEWIRE_TOKENIZERS", "/opt/tokenizers")
#: The published split pattern of byte-level BPE (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes beyond which a piece is merged alone.
LONG = 64
#: Characters of a chunk, and pieces whose ids a worker keeps.
CHUNK, KEPT = 2_000_000, 300_000
_NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files of byte-level BPE: printable bytes stand for themselves, the rest follow from 256."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Rank and merged id of pairs of ids: an open hash table in numpy arrays, looked up for whole arrays at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        bits = max(4, int(len(left) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, _NONE, np.int32)
        self.merged = np.full(1 << bits, -1, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, todo, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(todo):  # each round places the pairs whose slot is free; the rest go one slot further
            self.probes += 1
            at = slot[todo]
            free = self.keys[at] == -1
            first = np.zeros(len(todo), bool)
            first[np.unique(at[free], return_index=True)[1]] = True
            won = np.flatnonzero(free)[first[: free.sum()]] if free.any() else np.empty(0, int)
            self.keys[at[won]] = key[todo[won]]
            self.ranks[at[won]] = todo[won]
            self.merged[at[won]] = merged[todo[won]]
            lost = np.ones(len(todo), bool)
            lost[won] = False
            todo = todo[lost]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and slot of each pair; a pair that doesn't merge has the greatest rank."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        rank = np.full(key.shape, _NONE, np.int32)
        flat_key, flat_slot, flat_rank = key.reshape(-1), slot.reshape(-1), rank.reshape(-1)
        todo = np.flatnonzero(((left >= 0) & (right >= 0)).reshape(-1))
        for _ in range(self.probes):
            if not len(todo):
                break
            there = self.keys[flat_slot[todo]]
            hit = there == flat_key[todo]
            flat_rank[todo[hit]] = self.ranks[flat_slot[todo[hit]]]
            todo = todo[~hit & (there != -1)]
            flat_slot[todo] = (flat_slot[todo] + 1) & self.mask
        return rank, slot


class Merger:
    """Byte-pair merges of many pieces at once."""

    def __init__(self, byte_ids: np.ndarray, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.byte_ids, self.pairs = byte_ids, PairTable(left, right, merged)

    def matrix(self, rows: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a matrix padded with -1."""
        out: list[np.ndarray] = [None] * len(rows)  # type: ignore[list-item]
        live = np.arange(len(rows))
        while len(live):
            if rows.shape[1] > 1:
                rank, slot = self.pairs.find(rows[:, :-1], rows[:, 1:])
                at = rank.argmin(axis=1)  # of equal ranks the leftmost
                least = rank[np.arange(len(rows)), at]
                done = least == _NONE
            else:
                done = np.ones(len(rows), bool)
            for i in np.flatnonzero(done):
                out[live[i]] = rows[i][rows[i] >= 0]
            if done.all():
                break
            rows, live, at, slot = rows[~done], live[~done], at[~done], slot[~done]
            every = np.arange(len(rows))
            rows[every, at] = self.pairs.merged[slot[every, at]]
            column = np.arange(rows.shape[1] - 1)[None, :]
            rows = np.take_along_axis(rows, column + (column > at[:, None]), axis=1)
            rows = rows[:, : max(1, int((rows >= 0).sum(axis=1).max()))]
        return out

    def single(self, row: np.ndarray) -> np.ndarray:
        """Ids of one long piece."""
        while len(row) > 1:
            rank, slot = self.pairs.find(row[:-1], row[1:])
            least = rank.min()
            if least == _NONE:
                break
            at = np.flatnonzero(rank == least)
            if len(at) > 1:  # in a run of overlapping places, every second one merges
                starts = np.concatenate([[True], np.diff(at) > 1])
                first = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            row = row.copy()
            row[at] = self.pairs.merged[slot[at]]
            row = np.delete(row, at + 1)
        return row

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 0
        for high in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, LONG):
            own = np.flatnonzero((size > low) & (size <= high))
            low = high
            for part in np.array_split(own, max(1, len(own) // 20_000 + 1)):
                if not len(part):
                    continue
                n = size[part]
                rows = np.full((len(part), high), -1, np.int32)
                rows[np.repeat(np.arange(len(part)), n), ranges(np.zeros(len(part), np.int64), n)] = self.byte_ids[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
                for i, ids in zip(part, self.matrix(rows), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(size > LONG):
            out[i] = self.single(self.byte_ids[np.frombuffer(pieces[i], np.uint8)])
        for i in np.flatnonzero(size == 0):
            out[i] = np.empty(0, np.int32)
        return out


def load(name: str = "byte_bpe_50k", folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the single bytes, and left id, right id and merged id of each merge in order of rank. A vocabulary's size bounds them (about 1 MB)."""
    with open(f"{folder or TOKENIZERS}/{name}.json", encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab, letters = model["vocab"], byte_letters()
    byte_ids = np.zeros(256, np.int32)
    for letter, byte in letters.items():
        byte_ids[byte] = vocab[letter]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int32)
    return byte_ids, ids[:, 0], ids[:, 1], ids[:, 2]


class Encoder:
    """Ids of texts. Pieces seen before are looked up; up to ``KEPT`` of them are kept, as the ranges of one array."""

    def __init__(self, *tables: np.ndarray) -> None:
        import regex

        self.split, self.merger = regex.compile(PATTERN).findall, Merger(*tables)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.length, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts in the ids of all, and these."""
        split = [self.split(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(split))
        if len(self.known) > KEPT:
            self._reset()
        new = list(set(flat) - self.known.keys())
        if new:
            made = self.merger.encode([p.encode("utf-8", "replace") for p in new])
            length = np.fromiter(map(len, made), np.int64, len(made))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.ids = np.concatenate([self.ids, *made])
        piece = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        n = self.length[piece]
        upto = np.concatenate([[0], np.cumsum(n)])
        offsets = upto[np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])]
        return offsets, self.ids[ranges(self.start[piece], n)]


def encode_column(texts: DataFrame, id_column: str = "doc_id", text_column: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """Token ids of every text: columns ``id_column`` and ``ids`` (array<int>).

    Null and empty texts have the empty list. Special tokens' strings in a text are ordinary text. Rows with a null id stay; repeated
    rows stay as they are, each with its ids. Other columns are not read. Texts of any length are encoded whole.
    """
    tables = load(name, folder)
    id_type = texts.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*tables)
        for batch in batches:
            text = batch.column(1)
            size = np.diff(np.frombuffer(text.buffers()[1], np.int32 if pa.types.is_string(text.type) else np.int64)[text.offset : text.offset + len(text) + 1]) if len(text) else np.empty(0, int)
            for part in chunks(size, CHUNK):
                rows = batch.slice(part.start, part.stop - part.start)
                offsets, ids = encoder.encode(rows.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], [id_column, "ids"])

    return texts.select(id_column, text_column).mapInArrow(run, f"{id_column} {id_type}, ids array<int>")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of each document; doc_id is unique, so the rows are distinct."""
    return encode_column(table(spark, folder, "documents"))

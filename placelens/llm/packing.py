"""Packing of token documents into sequences of a fixed size, by the online sum-of-squares rule.

A document's ids, with an end id, are cut into whole sequences and a rest. The level array N holds how many open sequences are filled to each level; a rest of s ids
takes the move for which the sum of the squares of N grows least:

* to a level h <= size - s: 2 (N[h + s] - N[h]) + 2, or 1 - 2 N[h] where it fills the sequence;
* a new sequence: 2 N[s] + 1.

Ties go to the fuller level. The rule never cuts a rest. A piece's place is known when it is placed, so its row goes out at once; of an open sequence only its number
is kept, in its level's stack, so open sequences need no cap.

The end of a task: the last documents, as many as hold the ids that the open sequences lack at the time, wait in a queue. When the rows end, they're cut to fill the open
sequences, fullest first, and then new ones, so each task leaves one unfull sequence (more only where its whole input is less than the queue).

Each scan task packs its own rows in order, in one pass without a shuffle, so a lost task is repeated alone; memory is one document, the queue (SIZE ids
for each open sequence at most: 212,000 in a task of 40 million) and the level stacks. A sequence id is the task's number times 2^40 plus a count. Null texts are empty ones (the end id alone); rows of equal id are
packed each for itself, rows without an id too. An empty table gives an empty result. The last sequence of a task is padded to the
size by whoever writes tensors, unless its length is a power of two.
"""

from __future__ import annotations

import json
import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import process_cache

SIZE, END_ID, FAR = 1024, 0, np.iinfo(np.int64).max
VOCABULARY = "byte_bpe_50k.json"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """Ids of a byte-level BPE file. Texts within Latin scripts go through the faster of two libraries with the very ranks of the file;
    all others, whose character classes the two might see differently, through the file's own."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.slow = Tokenizer.from_file(path)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.odd = regex.compile(r"[^\x00-\x7f\xa0-ɏ‐-‧]")

    def encode(self, text: str) -> np.ndarray:
        if self.odd.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode(text, allowed_special="all"), np.uint32)


class Packer:
    """rows: pieces (doc, start, ids, doc_tokens, sequence, offset) that were placed since they were last taken."""

    def __init__(self, size: int, first: int):
        self.size, self.next = size, first
        self.levels = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size)]  # by level: numbers of sequences
        self.lacking, self.waiting, self.queue, self.rows = 0, 0, deque(), []

    def put(self, doc, start: int, ids: np.ndarray, total: int, sequence: int, offset: int) -> None:
        """Places a piece, and the sequence at its new level."""
        self.rows.append((doc, start, ids, total, sequence, offset))
        level = offset + len(ids)
        self.lacking += (self.size - level) - (self.size - offset if offset else 0)
        if level < self.size:
            self.open[level].append(sequence)
            self.levels[level] += 1

    def take(self, level: int) -> int:
        """The number of an open sequence at the level, or of a new one at level 0."""
        if level:
            self.levels[level] -= 1
            return self.open[level].pop()
        self.next += 1
        return self.next - 1

    def move(self, s: int) -> int:
        """The level to put a rest of s ids at."""
        n, size = self.levels, self.size
        cost = 2 * (n[s:] - n[: size + 1 - s]) + 2
        cost[-1] = 1 - 2 * n[size - s]
        cost[n[: size + 1 - s] == 0] = FAR
        cost[0] = 2 * n[s] + 1
        return len(cost) - 1 - int(np.argmin(cost[::-1]))

    def place(self, doc, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.size:
            self.put(doc, at, ids[at : at + self.size], total, self.take(0), 0)
            at += self.size
        if at < total:
            level = self.move(total - at)
            self.put(doc, at, ids[at:], total, self.take(level), level)

    def add(self, doc, ids: np.ndarray) -> None:
        """The document waits until those behind it hold all that the open sequences lack."""
        self.queue.append((doc, ids))
        self.waiting += len(ids)
        while self.waiting - len(self.queue[0][1]) >= self.lacking + 2 * self.size:
            first = self.queue.popleft()
            self.waiting -= len(first[1])
            self.place(*first)

    def finish(self) -> None:
        """The waiting documents fill the open sequences, and new ones, by cutting."""
        for doc, ids in self.queue:
            at = 0
            while at < len(ids):
                top = np.flatnonzero(self.levels[: self.size])
                level = int(top[-1]) if len(top) else 0
                n = min(self.size - level, len(ids) - at)
                self.put(doc, at, ids[at : at + n], len(ids), self.take(level), level)
                at += n
        self.queue.clear()


def _pack(path: str | None, size: int, end_id: int, with_ids: bool):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        bpe = process_cache(("bpe", path), lambda: ByteBpe(path or vocabulary_path()))
        context = TaskContext.get()
        packer = Packer(size, (context.partitionId() if context else 0) << 40)

        def out():
            rows, packer.rows = packer.rows, []
            crc = [zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows]
            doc, start, ids, total, sequence, offset = zip(*rows, strict=True) if rows else [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in (doc, start, list(map(len, ids)), crc, total, sequence, offset)]
            names = SCHEMA.replace(" long", "").split(", ")
            if with_ids:
                arrays, names = [*arrays, pa.array([r[2].astype(np.int64) for r in rows], pa.list_(pa.int64()))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                packer.add(doc.as_py(), np.append(bpe.encode(text.as_py() or ""), np.uint32(end_id)))
                if len(packer.rows) >= 4096:
                    yield out()
        packer.finish()
        yield out()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = SIZE, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for. path: the tokenizer file, at the same place on all executors."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_pack(path, size, end_id, with_ids), SCHEMA + (", ids array<long>" if with_ids else ""))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_ids=False)

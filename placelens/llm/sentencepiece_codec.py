"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan over chunks.

The public model is a BPE model without a normaliser. Its segmentation of a text is the one path over the text whose adjacent pieces are all compatible: two pieces are if
encoding their joined text gives just these two. So a path's score is 0 if all its pairs are, else -inf, and the text's encoding is the path of the largest score. Hence every part of
an encoding is the encoding of its own text, and two encodings that share a piece can be spliced there.

A text of more than GIANT code points is cut into chunks of CHUNK. A boundary's states are the pieces that may cross or touch it (they begin before it, and end at it or behind it, at most
the longest piece away). A chunk's transfer matrix M has M[i, j] = 0 if a path leads from piece i at its first boundary to piece j at its last one, else -inf. It is
found from the library's encoding of the chunk alone, the core: a short window from i on, and one up to j, are encoded and spliced into the core; where a window shares no piece with the core it grows,
up to the whole chunk. Matrices combine as (A x B)[i, j] = max over k of A[i, k] + B[k, j], which is associative: Spark
combines FAN of them at a time, level by level (up), then hands each group's first and last state down to its members. Each chunk is then traced back for
itself, from its own two states: heads, core and tails give its ids. A chunk owns the pieces behind its first state, its last state included.

Decoding reads the id sequence in spans, each behind a known piece, so that only the text's own first space is dropped; a span never ends within the bytes of one character.
Checksums of chunks combine to the document's. So neither encoding, decoding nor checking reads a giant text in one piece.

Null texts are empty ones, with no ids. Rows of equal id are encoded each for itself, as are rows without an id. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, partitions_for, process_cache

MODEL, GIANT, CHUNK, WINDOW, FAN = "piece_bpe_32k.model", 1 << 15, 1 << 13, 128, 64
MARK, START = "▁", -1
NORMAL, BYTE, BPE = 1, 6, 2


class Codec:
    """pieces: the ids of ordinary pieces. lengths: code points of the normalised text by id; a character in bytes counts at its first byte."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
            raise ValueError("the scan is for BPE models with byte fallback and without a normaliser")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.pieces = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.width = max(map(len, self.pieces))
        self.lengths = np.array([len(p.piece) for p in proto.pieces], np.int64)
        self.bytes = np.array([p.type == BYTE for p in proto.pieces])
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.lengths[i] = not 0x80 <= int(p.piece[3:5], 16) < 0xC0
        self.lead = next(i for p, i in self.pieces.items() if p.isascii() and p.isalpha())
        spec.add_dummy_prefix = False
        self.part = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def encode_part(self, part: str, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first and end positions of the pieces of a part of a text that begins at a position."""
        ids = np.array(self.part.encode(part.replace(" ", MARK), num_threads=1), np.int64)
        end = at + np.cumsum(self.lengths[ids])
        return ids, end - self.lengths[ids], end

    def states(self, u: str, b: int) -> list[tuple[int, int]]:
        """(first, end) of all pieces, or single characters, that begin before b and end at it or behind it."""
        n = u.replace(" ", MARK)
        found = [(s, e) for s in range(max(0, b - self.width), b) for e in range(b, min(len(n), s + self.width) + 1)]
        return [(s, e) for s, e in found if e == s + 1 or n[s:e] in self.pieces]

    def decode_span(self, ids: np.ndarray, first: bool) -> str:
        if first:
            return self.model.decode(ids.tolist())
        return self.model.decode([self.lead, *ids.tolist()])[len(self.model.id_to_piece(self.lead)) :]

    def spans(self, ids: np.ndarray, size: int = CHUNK):
        """The id sequence in spans that end between characters."""
        at = 0
        while at < len(ids):
            end = min(len(ids), at + size)
            while end < len(ids) and self.bytes[ids[end]] and not self.lengths[ids[end]]:
                end += 1
            yield ids[at:end]
            at = end

    def decode(self, ids: np.ndarray, size: int = CHUNK) -> str:
        return "".join(self.decode_span(x, not i) for i, x in enumerate(self.spans(ids, size)))


class Chunk:
    """The paths through u[a:b], where u is the text behind a space, or enough of it around the chunk. Positions are u's."""

    def __init__(self, codec: Codec, u: str, a: int, b: int, first: bool, last: bool):
        self.codec, self.u, self.a, self.b, self.first, self.last = codec, u, a, b, first, last
        self.ins = [(a, a)] if first else codec.states(u, a)
        self.outs = [(b, b)] if last else codec.states(u, b)
        self.core = codec.encode_part(u[a:b], a)
        self.core_at = {s: i for i, s in enumerate(self.core[1].tolist())}
        self.heads = [self.head(x) for x in self.ins]
        self.tails = [self.tail(x) for x in self.outs]

    def shared(self, part, last: bool) -> tuple[int, int] | None:
        """Where a piece of the part, the last or the first such, is one of the core's: its number in either. Pieces in bytes don't count."""
        for k in range(len(part[0]) - 1, -1, -1) if last else range(len(part[0])):
            c = self.core_at.get(int(part[1][k]))
            if c is not None and self.core[0][c] == part[0][k] and not self.codec.bytes[part[0][k]]:
                return k, c
        return None

    def begins(self, part, state) -> bool:
        return len(part[0]) > 0 and int(part[2][np.searchsorted(part[1], state[0], "right") - 1]) == state[1]

    def ends(self, part, state) -> bool:
        """Whether the last piece is the state: a piece of its length, or a character in bytes."""
        at = np.flatnonzero(part[1] == state[0])
        return len(at) > 0 and int(part[2][at[-1]]) == int(part[2][-1]) == state[1] and (len(at) == len(part[1]) - at[0] or bool(self.codec.bytes[part[0][-1]]))

    def head(self, state):
        """(part, its pieces before the splice, the core's piece there, whether it begins with the state); None: no splice."""
        if self.first:
            return self.core, 0, 0, True
        size = WINDOW
        while True:
            end = min(self.b, self.a + size)
            part = self.codec.encode_part(self.u[state[0] : end], state[0])
            if (found := self.shared(part, False)) is not None:
                return part, *found, self.begins(part, state)
            if end == self.b:
                return None
            size *= 4

    def tail(self, state):
        """The same for a window that ends with the state."""
        if self.last:
            return self.core, len(self.core[0]), len(self.core[0]), True
        size = WINDOW
        while True:
            begin = max(self.a, self.b - size)
            part = self.codec.encode_part(self.u[begin : state[1]], begin)
            if (found := self.shared(part, True)) is not None:
                return part, *found, self.ends(part, state)
            if begin == self.a:
                return None
            size *= 4

    def leads(self, i: int, j: int) -> bool:
        head, tail = self.heads[i], self.tails[j]
        return head[3] and tail[3] if head and tail and head[2] <= tail[2] else self.path(i, j) is not None

    def path(self, i: int, j: int):
        """Ids and first positions of the path from state i to state j, state i included (unless it is the text's start); None if there is none."""
        head, tail = self.heads[i], self.tails[j]
        if head and tail and head[2] <= tail[2]:
            # Both windows share a piece with the core, so head, core and tail are the encoding of all that lies between, whatever it begins and ends with.
            (x, hp, hc, begins), (y, tp, tc, ends) = head, tail
            return tuple(np.concatenate((x[k][:hp], self.core[k][hc:tc], y[k][tp:])) for k in (0, 1)) if begins and ends else None
        # No splice (a text that repeats itself): the encoding of all of it tells.
        whole = self.codec.encode_part(self.u[self.ins[i][0] : self.outs[j][1]], self.ins[i][0])
        return whole[:2] if (self.first or self.begins(whole, self.ins[i])) and (self.last or self.ends(whole, self.outs[j])) else None

    def matrix(self) -> np.ndarray:
        return np.array([[0.0 if self.leads(i, j) else -np.inf for j in range(len(self.outs))] for i in range(len(self.ins))], np.float32)

    def ids(self, i: int, j: int) -> np.ndarray:
        """The ids that the chunk owns: those behind state i."""
        ids, start = self.path(i, j)
        return ids if self.first else ids[start >= self.ins[i][1]]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(1)


def states_between(ms: list[np.ndarray], i: int, j: int) -> list[int]:
    """The states at all boundaries of a row of matrices, on the best path from state i to state j."""
    rest = [ms[-1][:, j]]  # from each state of the last boundary but one; then of those before it
    for m in reversed(ms[1:-1]):
        rest.append((m + rest[-1][None, :]).max(1))
    out = [i]
    for m in ms[:-1]:
        out.append(int(np.argmax(m[out[-1]] + rest.pop())))
    return [*out, j]


def bounds(n: int, chunk: int = CHUNK) -> list[int]:
    """Where a text of n positions is cut; no chunk is shorter than half of one."""
    return [*range(0, max(1, n - chunk // 2), chunk), n]


def _times(m: np.ndarray, v: int) -> int:
    """A matrix over GF(2), as its 32 columns, times a vector of bits."""
    return int(np.bitwise_xor.reduce(m[[k for k in range(32) if v >> k & 1]], initial=0))


def _zero_bytes() -> list[np.ndarray]:
    """The CRC-32's shift by 1, 2, 4, ... zero bytes, each the square of the one before."""
    m = np.array([0xEDB88320, *(1 << k for k in range(31))], np.int64)  # one zero bit
    out = []
    for k in range(3 + 48):
        out.append(m)
        m = np.array([_times(m, int(x)) for x in m], np.int64)
    return out[3:]


def combine_crc(a: int, b: int, n: int) -> int:
    """The CRC-32 of two texts in a row, from theirs and the second one's length."""
    for m in process_cache(("zero bytes",), _zero_bytes):
        if n & 1:
            a = _times(m, a)
        n >>= 1
    return a ^ b


def _codec(path: str | None) -> Codec:
    import public_tokenizers

    return process_cache(("sentencepiece", path), lambda: Codec(path or public_tokenizers.path(MODEL)))


def _small(path: str | None, with_ids: bool):
    def run(batches):
        import pyarrow as pa

        codec = _codec(path)
        for b in batches:
            out = []
            for t in b.column(1):
                text = t.as_py() or ""
                ids = np.array(codec.model.encode(text, num_threads=1), np.uint32)
                back = codec.decode(ids)
                out.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(back.encode()), back == text, ids.astype(np.int64)))
            n, crc, back_crc, same, kept = zip(*out, strict=True) if out else [()] * 5
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(back_crc, pa.int64()), pa.array(same, pa.bool_())]
            names = ["id", "n_ids", "ids_crc32", "decoded_crc32", "round_trip"]
            if with_ids:
                cols, names = [*cols, pa.array(kept, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _cut(path: str | None, chunk: int):
    """(row, n, first, last, a, part): a chunk with a piece's length of text on either side; a: where the chunk begins in it, b: where it ends."""

    def run(batches):
        import pyarrow as pa

        width = _codec(path).width
        names = ["row", "n", "first", "last", "a", "b", "part"]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1), strict=True):
                u = " " + text.as_py()
                at = bounds(len(u), chunk)
                for i in range(0, len(at) - 1, 64):
                    some = []
                    for n in range(i, min(i + 64, len(at) - 1)):
                        lo = max(0, at[n] - width)
                        some.append((row.as_py(), n, n == 0, n == len(at) - 2, at[n] - lo, at[n + 1] - lo, u[lo : at[n + 1] + width]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)

    return run


def _chunk(codec: Codec, r: dict) -> Chunk:
    return Chunk(codec, r["part"], r["a"], r["b"], r["first"], r["last"])


def _rows(batches, make, names, kinds):
    """make(row) gives the rows of the result."""
    import pyarrow as pa

    for b in batches:
        for i in range(0, b.num_rows, 256):
            cols = list(zip(*(x for r in b.slice(i, 256).to_pylist() for x in make(r)), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _packed(m: np.ndarray) -> dict:
    return {"rows": m.shape[0], "cells": m.astype(np.float32).tobytes()}


def _unpacked(m: dict) -> np.ndarray:
    return np.frombuffer(m["cells"], np.float32).reshape(m["rows"], -1)


MATRIX = "struct<rows: int, cells: binary>"


def _matrices(path: str | None):
    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.struct([("rows", pa.int32()), ("cells", pa.binary())])]
        codec = _codec(path)
        yield from _rows(batches, lambda r: [(r["row"], r["n"], _packed(_chunk(codec, r).matrix()))], ["row", "n", "m"], kinds)

    return run


def _up(batches):
    """The product of a group's matrices."""
    import pyarrow as pa

    def make(r):
        out = None
        for x in r["members"]:
            out = _unpacked(x["m"]) if out is None else product(out, _unpacked(x["m"]))
        return [(r["row"], r["n"], _packed(out))]

    yield from _rows(batches, make, ["row", "n", "m"], [pa.int64(), pa.int64(), pa.struct([("rows", pa.int32()), ("cells", pa.binary())])])


def _down(batches):
    """The first and last state of each member of a group, from the group's own."""
    import pyarrow as pa

    def make(r):
        ms = [_unpacked(x["m"]) for x in r["members"]]
        at = states_between(ms, r["i"], r["j"])
        return [(r["row"], x["n"], at[k], at[k + 1]) for k, x in enumerate(r["members"])]

    yield from _rows(batches, make, ["row", "n", "i", "j"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])


def _traced(path: str | None, with_ids: bool):
    def run(batches):
        import pyarrow as pa

        codec = _codec(path)

        def make(r):
            c = _chunk(codec, r)
            ids = c.ids(r["i"], r["j"])
            begin, end = c.ins[r["i"]][1], c.outs[r["j"]][1]
            back, text = codec.decode_span(ids, r["first"]), r["part"][begin + r["first"] : end]
            raw = back.encode()
            return [(r["row"], r["n"], len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(raw), zlib.crc32(raw), back == text, ids.tolist() if with_ids else None)]

        kinds = [pa.int64()] * 6 + [pa.bool_(), pa.list_(pa.int64())]
        yield from _rows(batches, make, ["row", "n", "n_ids", "crc", "n_back", "back_crc", "same", "ids"], kinds)

    return run


def _summed(batches):
    import pyarrow as pa

    def make(r):
        n = crc = back = 0
        for x in r["members"]:
            crc, back, n = combine_crc(crc, x["crc"], 4 * x["n_ids"]), combine_crc(back, x["back_crc"], x["n_back"]), n + x["n_ids"]
        return [(r["row"], n, crc, back, all(x["same"] for x in r["members"]))]

    yield from _rows(batches, make, ["row", "n_ids", "ids_crc32", "decoded_crc32", "round_trip"], [pa.int64()] * 4 + [pa.bool_()])


def _members(rows: DataFrame, *columns: str) -> DataFrame:
    """The matrices of FAN neighbours, in order: n is the group's number."""
    group = rows.withColumn("group", F.floor(F.col("n") / FAN).cast("long")).groupBy("row", "group")
    return group.agg(F.sort_array(F.collect_list(F.struct("n", *columns))).alias("members")).withColumnRenamed("group", "n")


def encode_giants(giants: DataFrame, path: str | None = None, with_ids: bool = True, chunk: int = CHUNK) -> DataFrame:
    """giants: row (unique), text. row, n_ids, ids_crc32, decoded_crc32, round_trip (and ids), by the scan."""
    scratch = Scratch(giants.sparkSession)
    cut = giants.select("row", "text").mapInArrow(_cut(path, chunk), "row long, n long, first boolean, last boolean, a int, b int, part string")
    chunks = scratch.keep(cut.repartition(partitions_for(giants.sparkSession), "row", "n"))  # a giant's chunks are dealt over all tasks
    levels = [scratch.keep(chunks.mapInArrow(_matrices(path), f"row long, n long, m {MATRIX}"))]
    most = levels[0].agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    while most >= 1:
        levels.append(scratch.keep(_members(levels[-1], "m").mapInArrow(_up, f"row long, n long, m {MATRIX}")))
        most //= FAN
    # A whole text has one state at either end.
    states = levels[-1].select("row", "n", F.lit(0).alias("i"), F.lit(0).alias("j"))
    for level in reversed(levels[:-1]):
        states = scratch.keep(_members(level, "m").join(states, ["row", "n"]).mapInArrow(_down, "row long, n long, i int, j int"))
    kinds = "row long, n long, n_ids long, crc long, n_back long, back_crc long, same boolean, ids array<long>"
    traced = scratch.keep(chunks.join(states, ["row", "n"]).mapInArrow(_traced(path, with_ids), kinds))
    parts = traced.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("n", "n_ids", "crc", "n_back", "back_crc", "same"))).alias("members"))
    out = parts.mapInArrow(_summed, "row long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
    if with_ids:
        in_order = F.sort_array(F.collect_list(F.struct("n", "ids")))
        out = out.join(traced.groupBy("row").agg(F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids")), "row")
    return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = True, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """id, n_ids, ids_crc32, and decoded_crc32 and round_trip of the decoded ids, and the ids if asked for."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kinds = "id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean" + (", ids array<long>" if with_ids else "")
    small = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= giant).mapInArrow(_small(path, with_ids), kinds)
    giants = Scratch(docs.sparkSession).keep(rows.where(F.length("text") > giant).withColumn("row", F.monotonically_increasing_id()))
    if giants.isEmpty():
        return small
    return small.unionByName(giants.select("row", "id").join(encode_giants(giants, path, with_ids, chunk), "row").drop("row"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_ids=False).withColumnRenamed("id", "doc_id")

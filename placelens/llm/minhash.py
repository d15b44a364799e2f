"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

Each shingle of SHINGLE words is hashed once: its high bits pick one of BINS bins, and the bin keeps the least hash. An empty bin takes the
value of a filled one, found by hashing (bin, attempt) until a filled bin is hit (Shrivastava, 2017), so texts with the
same filled bins fill alike. BITS low-order bits of each bin's value, mixed with the bin's number, are stored, as hex. Two fingerprints agree in a share m of the bins; bins that differ
agree by chance in 2^-BITS of cases, so the likeness is (m - 2^-BITS) / (1 - 2^-BITS), at least 0.

Fewer words than SHINGLE are one shingle. Null texts, and texts without words, have the fingerprint of all zeros, which is like itself (1) and no other (0).

Pairs of neighbours: rows are ordered by descending id (nulls last), rows of equal id by a hash of their text, then by the text, and each row meets the next; after the
last comes the first. Ranges of this order are cut by bytes: at quantiles of the ids, each id weighted by its text's size, and an id that holds several ranges (or no id) is split
by the hash. The rows that open a range are sent to the range before it as well, so each task reads its rows in order, in batches, with one text of look-ahead. Only repeated
rows (equal in id and text) stay in one range, which is sorted with spill and read in batches as all are. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, partitions_for, process_cache
from .textkit import mix64, shingles, words

BINS, BITS, SHINGLE = 512, 4, 5

#: A range of neighbours is about RANGE_BYTES of text; there are MAX_RANGES at most (beyond, they grow, sorted with spill). The cuts' weights are in FINE-ths of a range.
RANGE_BYTES, MAX_RANGES, FINE, HASH_BITS, LONG = 32 << 20, 20_000, 32, 20, (1 << 63) - 1
RESULT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _donors(bins: int, attempts: int) -> np.ndarray:
    """The bin that each empty bin asks at each attempt."""
    at = np.arange(attempts * bins, dtype=np.uint64)
    return (mix64(at + np.uint64(0xA0761D6478BD642F)) % np.uint64(bins)).reshape(attempts, bins).astype(np.int64)


def signature(h: np.ndarray, bins: int = BINS) -> np.ndarray | None:
    """The densified bins of shingle hashes; None of none."""
    if not len(h):
        return None
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    values = np.full(bins, top)
    bin_of = (h >> np.uint64(64 - int(bins).bit_length() + 1)).astype(np.int64)
    np.minimum.at(values, bin_of, h)
    filled = np.zeros(bins, bool)
    filled[bin_of] = True
    if filled.all():
        return values
    out, donors = values.copy(), process_cache(("donors", bins), lambda: _donors(bins, 8 * bins))
    empty = np.flatnonzero(~filled)
    for asked in donors:
        hit = filled[asked[empty]]
        out[empty[hit]] = values[asked[empty[hit]]]
        empty = empty[~hit]
        if not len(empty):
            return out
    out[empty] = values[filled].min()
    return out


def fingerprint(text: str, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> np.ndarray | None:
    """The low-order bits of each bin."""
    h = shingles(words(text.encode("utf-8", "replace"))[0], shingle)
    full = signature(h, bins)
    return None if full is None else (mix64(full + np.arange(bins, dtype=np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint8)


def packed_hex(low: np.ndarray | None, bins: int = BINS, bits: int = BITS) -> str:
    if low is None:
        return "0" * (bins * bits // 4)
    return np.packbits(((low[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1).reshape(-1)).tobytes().hex()


def unpacked_bits(text: str, bins: int = BINS, bits: int = BITS) -> np.ndarray | None:
    if not text.strip("0"):
        return None
    return np.unpackbits(np.frombuffer(bytes.fromhex(text), np.uint8)).reshape(bins, bits) @ (1 << np.arange(bits - 1, -1, -1))


def likeness(a: np.ndarray | None, b: np.ndarray | None, bits: int = BITS) -> float:
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-bits
    return max(0.0, (float(np.mean(a == b)) - chance) / (1 - chance))


def _pairs(edit):
    """Streams over (range, ghost, id, text) rows in order; a ghost is the row that opens the next range."""

    def rows(batches):
        for b in batches:
            for r in zip(b.column(0), b.column(1), b.column(2), b.column(3), strict=True):
                yield r[0].as_py(), r[1].as_py(), r[2].as_py(), r[3].as_py() or ""

    def run(batches):
        import hashlib

        import pyarrow as pa

        out: list = []
        last = None  # (range, id, text, fingerprint): waits for the next row

        def flush():
            names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for part, ghost, doc, text in rows(batches):
            own = fingerprint(text)
            if last and last[0] == part:
                _, prior, before, low = last
                edited = edit(before, text)
                changed = fingerprint(edited)
                out.append((prior, len(before), hashlib.sha256(edited.encode()).hexdigest(), packed_hex(low), packed_hex(changed), likeness(low, changed), likeness(low, own)))
                if len(out) >= 512:
                    yield flush()
            last = None if ghost else (part, doc, text, own)
        yield flush()

    return run


def half_replaced(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def _cuts(sizes: DataFrame, weight: Column, n: int) -> tuple[list[int], dict[int, int]]:
    """Ascending ids at which ranges begin, and the number of ranges of each id that holds more than one; n weighted quantiles at most."""
    copies = sizes.where("id is not null").select(F.explode(F.array_repeat("id", weight.cast("int"))).alias("id"))
    at = [max(-LONG, min(LONG, int(c))) for c in copies.approxQuantile("id", [i / n for i in range(1, n)], 0.25 / n)] if n > 1 else []
    held = {c: k for c, k in Counter(at).items() if k > 1}
    return sorted(set(at) | {min(LONG, c + 1) for c in held}), held


def _literal(values: list[int]) -> Column:
    """A constant array that the optimizer folds into one literal, whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.expr("cast(array() as array<bigint>)")


def _not_above(cuts: Column, n: int, x: Column) -> Column:
    """How many of n ascending cuts are x or less, by halving."""

    def halve(at, _):
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        low = F.element_at(cuts, F.least(mid + 1, F.lit(n))) <= x
        done = at["lo"] >= at["hi"]
        return F.struct(F.when(~done & low, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(~done & ~low, mid).otherwise(at["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(n.bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), halve, lambda at: at["lo"]) if n else F.lit(0)


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit=half_replaced, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """For each row: its fingerprint, that of its text as edited with the next row's, and both likenesses."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 64 - HASH_BITS).cast("int"))
    sizes = Scratch(spark).keep(rows.select("id", "h", (F.octet_length(F.coalesce("text", F.lit(""))) + 100).cast("long").alias("bytes")))
    total, no_id = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("bytes"))), F.lit(0))).first()
    if not total:
        return spark.createDataFrame([], RESULT)
    n = max(1, min(MAX_RANGES, max(2 * partitions_for(spark), -(-total // range_bytes))))
    # An id counts once for each FINE-th part of a range that its text fills, so there are FINE * n copies more than ids at most.
    cuts, held = _cuts(sizes, 1 + F.floor(F.col("bytes") * F.lit(FINE * n) / F.lit(total)), n)
    # Intervals of ids from the largest on, then the rows without an id; each has one range, or as many as its only id needs.
    splits = [held.get(c, 0) + 1 if c in held else 1 for c in [None, *cuts]][::-1] + [max(1, -(-no_id * n // total))]
    firsts = [sum(splits[:i]) for i in range(len(splits))]

    def part(df: DataFrame) -> DataFrame:
        at = F.when(F.col("id").isNull(), len(cuts) + 1).otherwise(len(cuts) - _not_above(_literal(cuts), len(cuts), F.col("id"))).cast("int")
        own = lambda values: F.element_at(_literal(values), F.col("at") + 1)
        return df.withColumn("at", at).withColumn("part", (own(firsts) + F.shiftright(F.col("h") * own(splits), HASH_BITS)).cast("int")).drop("at")

    opener = F.max(F.struct("id", (-F.col("h")).alias("h")))  # the range's first id, and that one's least hash
    opens = sorted((r["part"], r["top"]["id"], -r["top"]["h"]) for r in part(sizes).groupBy("part").agg(opener.alias("top")).collect())  # a row for each range
    table = spark.createDataFrame([(p, top, h, opens[i - 1][0]) for i, (p, top, h) in enumerate(opens)], "p int, top long, top_h int, sends int")  # the first range's opener goes to the last one
    same = (F.col("part") == F.col("p")) & F.col("id").eqNullSafe(F.col("top")) & (F.col("h") == F.col("top_h"))
    ranged = part(rows).join(F.broadcast(table), same, "left")
    real = F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost"))
    both = F.when(F.col("sends").isNull(), F.array(real)).otherwise(F.array(real, F.struct(F.col("sends").alias("part"), F.lit(True).alias("ghost"))))
    dealt = ranged.select("id", "text", "h", F.explode(both).alias("to")).select("to.part", "to.ghost", "id", "text", "h")
    in_order = dealt.repartitionById(sum(splits), F.col("part")).sortWithinPartitions("part", "ghost", F.desc_nulls_last("id"), "h", F.asc_nulls_first("text"))
    return in_order.drop("h").mapInArrow(_pairs(edit), RESULT)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumnRenamed("id", "doc_id")

"""SimHash near-dedup: fingerprints of word shingles, pigeonhole blocks, verified Hamming distance, connected components.

Fingerprints are 64 bits, held as signed longs. Equal fingerprints are one class, so copies never make pairs. The 64 bits are
split into BLOCKS blocks; two fingerprints at distance d or less agree on BLOCKS - d blocks at least, so each class goes to one
bucket for each choice of that many blocks (38 or 39 fixed bits of 64 at d = 2), and classes that share a bucket are compared.
A bucket of over PAIR_CAP classes isn't compared in pairs: each class there names itself and all values at one differing bit
outside the bucket's fixed bits as its centres, and classes that share a centre are linked. Two values are at distance 2 or less
exactly if they share a centre, and a centre has 27 classes at most, so this loses no link and no group is unbounded.

The corpus stage (simhash_dedup) looks for a Jaccard similarity of 0.8 of the sets of five-word shingles. That is about 10 of 64 bits, too many for blocks that tell
documents apart. So it takes fingerprints of WIDE bits: the signs of random projections of the shingle set (a signed count in WIDE cells, then two Hadamard transforms with random
signs), split into 170 blocks of 24 bits. A pair at 0.8 agrees on a given bit with probability 0.85, so on one block at least with 0.96; at 0.85 with 0.998. Texts of equal
sets are one class. Each class is compared with the least class of each of its block values, and the links give components; then all pairs that share a block and aren't
of one component yet are compared, however many classes the block value has. So no pair that shares a block goes unseen, and copies of one text make no pairs. The Hamming
distance, with the sizes of the sets, estimates a pair's similarity to about 0.013. It only rules out pairs that it puts MARGIN below the wanted one, and none with a set of under SMALL
shingles; the others are linked if their sets of shingles, as 64-bit hashes, have the similarity. A set too small for a near-duplicate (one of three shingles has 3/4 at most) is
linked to its equals only. Components of the verified links are the groups.

Null texts are empty ones; a text without words has fingerprint zero, or an empty set of shingles, and is linked as any other. Rows of equal id are rows of one
document. Rows without an id link as others do, but never name a component. A component without any id has a null one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Scratch
from .textkit import blocks, mix64, shingles, words

BITS, BLOCKS, DISTANCE, PAIR_CAP = 64, 5, 2, 64
WIDE, BLOCK_BITS, SHINGLE, SIMILARITY, SUB_BLOCK = 4096, 24, 5, 0.8, 512
MARGIN, SMALL = 0.1, 64
SEED = 42


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint of a whole text, in blocks of bounded size."""
    import xxhash

    data = (text or "").encode().lower()  # bytes.lower() changes A-Z only
    ones, n, last = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest

    def count(shingles: list[bytes]):
        h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
        return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)

    for _, block in blocks(data, 1 << 18):
        own = last + block.split()
        if len(own) >= words:
            found = list(map(b" ".join, zip(*(own[i:] for i in range(words)), strict=False)))
            ones += count(found)
            n += len(found)
        last = own[-(words - 1) :] if words > 1 else []
    if not n and last:
        ones, n = count([b" ".join(last)]), 1
    return int((2 * ones > n).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64))) if n else 0


def _fingerprints(words: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id, fp (signed long) of each row."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_fingerprints(words), "id long, fp long")


def masks(distance: int = DISTANCE) -> list[int]:
    size = [BITS // BLOCKS + (i < BITS % BLOCKS) for i in range(BLOCKS)]
    at = np.cumsum([0, *size])
    one = [((1 << size[i]) - 1) << int(at[i]) for i in range(BLOCKS)]
    return [sum(one[i] for i in c) for c in combinations(range(BLOCKS), BLOCKS - distance)]


def links(fps: DataFrame, scratch: Scratch, distance: int = DISTANCE, cap: int = PAIR_CAP) -> DataFrame:
    """a, b: enough pairs of distinct fingerprints at the distance or less that each linked pair is connected by them."""
    if distance != 2:
        raise ValueError("centres stand for a distance of 2")
    ms = masks(distance)
    t = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(ms)]))
    rows = fps.select("fp", t.alias("x")).select("x.t", "x.key", "fp")
    sizes = scratch.keep(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))  # as a table, so that AQE can split a crowded bucket in the join
    shared = scratch.keep(rows.join(sizes, ["t", "key"]))
    few = shared.where(F.col("n") <= cap)
    l, r = few.select("t", "key", F.col("fp").alias("a")), few.select("t", "key", F.col("fp").alias("b"))
    pairs = l.join(r, ["t", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    # A class in any crowded bucket gets its centres once, whichever buckets they are.
    crowd = shared.where(F.col("n") > cap).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)])
    stars = crowd.select("fp", F.explode(flips).alias("centre")).groupBy("centre").agg(F.collect_set("fp").alias("s")).where(F.size("s") > 1)
    spokes = stars.select(F.array_min("s").alias("a"), F.explode("s").alias("b")).where("a <> b")
    return pairs.unionByName(spokes).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id, fp, component: the smallest id reachable over links, of each row."""
    scratch = Scratch(docs.sparkSession)
    fps = scratch.keep(fingerprints(docs, id_col, text_col, words))
    classes = scratch.keep(fps.groupBy("fp").agg(F.min("id").alias("first")))
    edges = scratch.keep(links(classes.select("fp"), scratch))
    comp = connected_components(edges, scratch)  # node, root
    rooted = scratch.keep(classes.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    of_class = scratch.keep(rooted.join(least, "root").select("fp", "component"))
    return fps.join(of_class, "fp").select("id", "fp", "component")


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, whose length is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        v = x.reshape(n, -1, 2, step)
        x = np.stack((v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]), axis=2).reshape(n, width)
        step *= 2
    return x


def wide_bits(sets: list[np.ndarray]) -> np.ndarray:
    """A row of WIDE bits (0 or 1) for each set of hashes."""
    cells = np.zeros((len(sets), WIDE), np.float32)
    for row, h in zip(cells, sets, strict=True):
        row += np.bincount((h & np.uint64(WIDE - 1)).astype(np.int64), 1.0 - 2.0 * ((h >> np.uint64(32)) & np.uint64(1)), WIDE)
    signs = 1 - 2 * (mix64(np.arange(1, WIDE + 1, dtype=np.uint64)) >> np.uint64(63)).astype(np.float32)
    return (hadamard(hadamard(cells) * signs) > 0).astype(np.uint8)


def _wide_fingerprints(size: int):
    """id, class (a hash of the shingle set), n (its size) and bits (longs)."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                sets = [np.unique(shingles(words((t.as_py() or "").encode("utf-8", "replace"))[0], size)) for t in part.column(1)]
                packed = np.packbits(wide_bits(sets), axis=1, bitorder="little").view(np.int64)
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * packed.shape[1]), pa.array(packed.ravel()))
                cls = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cls), pa.array([len(s) for s in sets], pa.int64()), bits], ["id", "class", "n", "bits"])

    return run


def block_key(number: int):
    """Number and value of a block of bits; it may reach into the next long."""
    word, at = divmod(number * BLOCK_BITS, 64)
    value = F.shiftrightunsigned(F.col("bits")[word], at)
    if at + BLOCK_BITS > 64:
        value = value.bitwiseOR(F.shiftleft(F.col("bits")[word + 1], 64 - at))
    return value.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).bitwiseOR(F.lit(number << BLOCK_BITS))


def crossing(members: DataFrame, comp: DataFrame, scratch: Scratch, sub: int = SUB_BLOCK) -> DataFrame:
    """a, b: all pairs of classes that share a key and aren't of one component yet. In each key, those outside its largest component meet all, in sub-blocks of about sub rows on either side."""
    rooted = scratch.keep(members.join(comp, F.col("class") == F.col("node"), "left").select("key", "class", F.coalesce("root", "class").alias("root")))
    counts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("total"), F.count(F.lit(1)).alias("roots"))
    split = lambda c: F.ceil(c / sub).cast("int")
    mixed = counts.where("roots > 1").select("key", F.col("m.root").alias("main"), split(F.col("total") - F.col("m.c")).alias("n_i"), split(F.col("total")).alias("n_j"))
    rows = scratch.keep(rooted.join(mixed, "key"))
    part = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    out = rows.where("root <> main").select("key", "main", F.col("class").alias("a"), F.col("root").alias("root_a"), part("n_i").alias("i"), each("n_j").alias("j"))
    all_ = rows.select("key", F.col("class").alias("b"), F.col("root").alias("root_b"), part("n_j").alias("j"), each("n_i").alias("i"))
    met = out.join(all_, ["key", "i", "j"]).where("root_a <> root_b and (root_b = main or a < b)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def wide_links(classes: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, exact=None) -> DataFrame:
    """a, b: pairs of classes (class, n, bits) that share a block and pass exact (a function of the pairs a, b); enough that each linked pair is connected by them.
    Without exact the estimate alone decides."""
    side = lambda c: classes.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    least = similarity - MARGIN if exact else similarity

    def likely(pairs: DataFrame) -> DataFrame:
        # The sizes alone rule a pair out if the smaller set is less than the wanted share of the larger.
        both = scratch.keep(pairs).join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
        apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
        shared = F.cos(apart * F.lit(np.pi / WIDE)) * F.sqrt(F.col("n_a") * F.col("n_b"))
        close = shared >= least * (F.col("n_a") + F.col("n_b") - shared)
        return scratch.keep(both.where((F.least("n_a", "n_b") < SMALL) | close if exact else close).select("a", "b"))

    # A set of so few shingles that one more or less is too much has no partner but its equals, which are its class.
    some = classes.where(F.col("n") >= similarity * (F.col("n") + 1))
    # Dealt by key once: both uses below read the same exchange.
    rows = some.select("class", F.explode(F.array(*[block_key(i) for i in range(WIDE // BLOCK_BITS)])).alias("key")).repartition("key")
    full = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("class").alias("a")).where("size > 1")
    members = scratch.keep(rows.join(full, "key").where("size > 2 or class <> a"))  # of two classes, one row says it all
    stars = likely(members.where("class <> a").select("a", F.col("class").alias("b")).distinct())
    # One pair of each class first: most others are of one component then, and need no comparison of their sets.
    links = scratch.keep(exact(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))) if exact else stars
    comp = scratch.keep(connected_components(links, scratch))
    more = likely(crossing(members.where("size > 2"), comp, scratch))
    if exact:
        root = lambda c: comp.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        rest = stars.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
        more = scratch.keep(exact(more.unionByName(rest).distinct()))
    return links.unionByName(more)


def _shingle_sets(size: int):
    """class and its set of shingle hashes."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            for i in range(0, b.num_rows, 64):
                sets = [np.unique(shingles(words((t.as_py() or "").encode("utf-8", "replace"))[0], size)) for t in b.column(1).slice(i, 64)]
                cls = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["class", "set"])

    return run


def exact_links(pairs: DataFrame, texts: DataFrame, least: DataFrame, scratch: Scratch, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose sets of shingles have the similarity or more. Only the texts of these classes (least: class, first id) are read again."""
    pairs = scratch.keep(pairs)
    named = scratch.keep(pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct().join(least, "class"))
    own = texts.join(named.where("first is not null").select(F.col("first").alias("id")).distinct(), "id", "left_semi").unionByName(texts.where("id is null"))
    sets = own.mapInArrow(_shingle_sets(size), "class long, set array<long>").join(named.select("class"), "class", "left_semi").dropDuplicates(["class"])
    sets = scratch.keep(sets)
    side = lambda c: sets.select(F.col("class").alias(c), F.col("set").alias(f"set_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(F.col("shared") >= similarity * (F.size("set_a") + F.size("set_b") - F.col("shared"))).select("a", "b")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """id, component: the smallest id reachable over links of the similarity of shingle sets or more, of each row."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = scratch.keep(texts.mapInArrow(_wide_fingerprints(size), "id long, class long, n long, bits array<long>"))
    # Equal sets have equal bits, so any one row of a class stands for it; the ids alone are grouped.
    least = scratch.keep(rows.groupBy("class").agg(F.min("id").alias("first")))
    classes = scratch.keep(rows.join(least, "class").where(F.col("id").eqNullSafe(F.col("first"))).dropDuplicates(["class"]).select("class", "n", "bits"))
    exact = lambda pairs: exact_links(pairs, texts, least, scratch, size, similarity)
    comp = connected_components(scratch.keep(wide_links(classes, scratch, similarity, exact)), scratch)
    rooted = scratch.keep(least.join(comp, F.col("class") == F.col("node"), "left").select("class", "first", F.coalesce("root", "class").alias("root")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component")), "root").select("class", "component")
    return rows.select("id", "class").join(scratch.keep(named), "class").select("id", "component")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows, one document of each group: the one whose id names the component. Rows without an id stay."""
    out = near_components(docs, id_col, text_col, **options).where("id <> component").select("id").distinct()
    return docs.join(out.select(F.col("id").alias("__simhash_gone")), F.col(f"`{id_col}`") == F.col("__simhash_gone"), "left_anti")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))

"""Substring dedup: near-duplicate passages by compact windows.

A document is its sequence of 5-word shingles. For each of FUNCTIONS hash functions, the Cartesian tree over the shingles' hashes gives compact windows:
the node at c spans [l, r], and all passages in [l, r] that hold c have the same min-hash, that of c. Only nodes at least as wide as the shortest
passage matter, 2 / width of all, so a passage that two documents share has the same min-hash node in both, for each function whose minimum is not
edited. The node is anchored by the 12 shingles (16 words) that begin at c and those that end at c, at least one of which an unedited passage holds.
A row is an anchor's key with its window [l, r].

Windows are joined by key, as intervals: aligned at the anchor, the two must overlap by SIMILARITY of the shortest passage's words, or no passage around it can lie in both. Of all
documents that hold a key, each is joined with the one of the smallest id (a star: rows in proportion to the anchors, not their pairs). All overlaps of a document with the same
other document, over all functions, make one interval of either text, with MARGIN words around, and only these are fetched. Each is verified: from an anchor, equal words are followed
both ways, over gaps of at most GAP words behind which 5 words agree; a passage counts from MIN_WORDS words and a Jaccard similarity of its shingles of SIMILARITY.

A document of smallest id may hold an anchor without the passage around it, and hide that two others share all of it. So the anchors without a found passage are joined once more among
themselves, with the smallest document of those. What is left after that, where more documents hold the anchor, is looked up by all windows of MIN_WORDS words
around it: documents that share such a key share the whole window. Hence each document that repeats MIN_WORDS words of one of smaller id is found.

A key that very many documents hold is split over tasks in each join (see shared.spread_join).

Words are runs of bytes other than [\\x20\\x09-\\x0D], A-Z lower-cased. Null texts are empty ones and have no passage. Rows without an id take no part and keep their text. Rows of equal id
are one document, whose text is the greatest of theirs; the passages are cut from rows with that text, and rows of that id with another text keep theirs. An empty table gives an
empty result. Repeats within one document are left alone.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, packed, spread_join, unpacked
from .textkit import mix64, shingles, words

SHINGLE, FUNCTIONS, CONTEXT, MIN_WORDS, SIMILARITY, GAP, MARGIN = 5, 2, 12, 50, 0.8, 8, 80


def compact_windows(h: np.ndarray, width: int):
    """(l, c, r) of the Cartesian tree's nodes that span width tokens or more; the first of equal minima is the node."""
    todo = [(0, len(h))]
    while todo:
        l, r = todo.pop()
        if r - l < width:
            continue
        c = l + int(h[l:r].argmin())
        yield l, c, r - 1
        todo.append((l, c))
        todo.append((c + 1, r))


def char_offsets(data: bytes, at: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    if len(data) == 0 or data.isascii():
        return at.astype(np.int64)
    b = np.frombuffer(data, np.uint8)
    return at - np.concatenate(([0], np.cumsum((b & 0xC0) == 0x80, dtype=np.int32)))[at]


def anchors(text: str, min_words: int = MIN_WORDS, functions: int = FUNCTIONS):
    """Of each anchor: key (its 16 words), first code point, first and end code point of the MARGIN words to either side (a near-duplicate passage may reach beyond a window whose own
    minimum is edited), and the words of its window to the left of the anchor's first word and to its right."""
    data = text.encode("utf-8", "replace")
    none = np.zeros(0, np.int64)
    w, start, end = words(data)
    run = CONTEXT + SHINGLE - 1
    if len(w) < min_words:
        return (none,) * 6
    tokens, runs = shingles(w, SHINGLE), shingles(w, run)
    window: dict[int, tuple[int, int]] = {}
    for f in range(functions):
        salt = np.uint64((f + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        for l, c, r in compact_windows(mix64(tokens + salt), min_words - SHINGLE + 1):
            for at in (c, c - CONTEXT + 1):
                old = window.get(at, (l, r))
                window[at] = (min(l, old[0]), max(r, old[1]))  # of two functions with one anchor, either window may hold the passage
    p = np.array(sorted(x for x in window if 0 <= x < len(runs)), np.int64)
    l, r = (np.array([window[x][k] for x in p.tolist()], np.int64) for k in (0, 1))
    stop = r + SHINGLE  # the words of a window end behind its last shingle
    first, last = char_offsets(data, start), char_offsets(data, end)
    lo, hi = first[np.maximum(p - MARGIN, 0)], last[np.minimum(p + run + MARGIN, len(w)) - 1]
    return runs[p].view(np.int64), first[p], lo, hi, p - l, stop - p


ANCHORS = "id long, key long, pos int, lo int, hi int, left int, right int"


def _anchors(min_words: int, functions: int):
    def run(batches):
        import pyarrow as pa

        names = ["id", "key", "pos", "lo", "hi", "left", "right"]
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                found = [anchors(t.as_py() or "", min_words, functions) for t in part.column(1)]
                n = np.array([len(x[0]) for x in found])
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
                key, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([ids, pa.array(key, pa.int64()), *(pa.array(x.astype(np.int32)) for x in rest)], names)

    return run


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """Words in a row that agree."""
    n, at = min(len(a), len(b)), 0
    while at < n:
        odd = np.flatnonzero(a[at : at + 256][: n - at] != b[at : at + 256][: n - at])
        if len(odd):
            return at + int(odd[0])
        at += 256
    return n


#: Gaps in either text that a chain may cross, small ones first.
GAPS = sorted(((x, y) for x in range(GAP + 1) for y in range(GAP + 1) if x + y), key=lambda g: (g[0] + g[1], g))


def follow(b: np.ndarray, a: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (at in b, at in a, length) from the start of both, over small gaps."""
    out, p, q = [], 0, 0
    while True:
        n = _equal(b[p:], a[q:])
        if n:
            out.append((p, q, n))
        p, q = p + n, q + n
        for x, y in GAPS:
            i, j = p + x, q + y
            if i + SHINGLE <= len(b) and j + SHINGLE <= len(a) and b[i] == a[j] and (b[i : i + SHINGLE] == a[j : j + SHINGLE]).all():
                p, q = i, j
                break
        else:
            return out


class Overlap:
    """The Jaccard similarity of the sets of shingles of a range of either text, as the ranges shrink from their ends: each shingle is counted in and out once."""

    def __init__(self, sb: list[int], sa: list[int], b0: int, b1: int, a0: int, a1: int):
        self.texts, self.at = (sb, sa), [[b0, b1], [a0, a1]]
        self.counts = [dict(Counter(sb[b0:b1])), dict(Counter(sa[a0:a1]))]
        self.both = len(self.counts[0].keys() & self.counts[1].keys())

    def shrink(self, *bounds: tuple[int, int]) -> None:
        for side, (begin, end) in enumerate(bounds):
            (x, y), own, other = self.at[side], self.counts[side], self.counts[1 - side]
            for part in (self.texts[side][x:begin], self.texts[side][end:y]):
                for e in part:
                    own[e] -= 1
                    if not own[e]:
                        del own[e]
                        self.both -= e in other
            self.at[side] = [begin, end]

    def similarity(self) -> float:
        return self.both / (len(self.counts[0]) + len(self.counts[1]) - self.both)


def joined(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs in order, those that touch in both texts as one."""
    out: list = []
    for i, j, n in runs:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def of_chain(sb: list[int], sa: list[int], runs: list[tuple[int, int, int]], min_words: int, least: float):
    """(b0, b1, a0, a1, similarity) of a chain of runs, in words, from the shingles of both texts: its ends are cut until the rest is alike; then what was cut off is a chain of its own. Each
    run of min_words or more is a passage."""
    todo, out = [runs], []
    while todo:
        whole = todo.pop()
        lo, hi, overlap = 0, len(whole), None
        while lo < hi:
            (b0, a0, _), (b1, a1, n) = whole[lo], whole[hi - 1]
            if min(b1 - b0, a1 - a0) + n < min_words:
                break
            bounds = (b0, b1 + n - SHINGLE + 1), (a0, a1 + n - SHINGLE + 1)
            if overlap is None:
                overlap = Overlap(sb, sa, *bounds[0], *bounds[1])
            else:
                overlap.shrink(*bounds)
            if (s := overlap.similarity()) >= least:
                out.append((b0, b1 + n, a0, a1 + n, s))
                break
            lo, hi = (lo + 1, hi) if whole[lo][2] < n else (lo, hi - 1)
        todo += [x for x in (whole[:lo], whole[hi:]) if x]
    out += [(i, i + n, j, j + n, 1.0) for i, j, n in runs if n >= min_words and not any(b0 <= i and i + n <= b1 and a0 <= j and j + n <= a1 for b0, b1, a0, a1, _ in out)]
    return out


def runs_at(b: np.ndarray, a: np.ndarray, pairs) -> list[tuple[int, int, int]]:
    """The runs of equal words (at in b, at in a, length) around pairs of positions that agree, each once."""
    out, seen = [], {}
    for i, j in pairs:
        own = seen.setdefault(i - j, [])
        if any(x <= i < y for x, y in own):
            continue
        left, right = _equal(b[:i][::-1], a[:j][::-1]), _equal(b[i:], a[j:])
        if left + right:
            own.append((i - left, i + right))
            out.append((i - left, j - left, left + right))
    return out


def cover(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The fewest runs that cover in b what all cover: a text that repeats one word or phrase agrees with another such at every shift."""
    out, end, best, at = [], -1, None, 0
    runs = sorted(runs)
    while at < len(runs) or best:
        # Of the runs that begin within what is covered (or right behind it), the one that reaches furthest.
        while at < len(runs) and runs[at][0] <= end:
            if best is None or runs[at][0] + runs[at][2] > best[0] + best[2]:
                best = runs[at]
            at += 1
        if best is None or best[0] + best[2] <= end:
            best = None
            if at == len(runs):
                break
            end = runs[at][0]  # a gap: go on at the next run
            continue
        out.append(best)
        end, best = best[0] + best[2], None
    return out


def passages(b: np.ndarray, a: np.ndarray, pairs, min_words: int = MIN_WORDS, least: float = SIMILARITY):
    """(b0, b1, a0, a1, similarity) in words, from pairs of positions that agree: together they cover in b all exact passages, and the near-duplicate ones around all runs. None lies
    in another."""
    runs, (sb, sa) = runs_at(b, a, pairs), (shingles(x, SHINGLE).tolist() for x in (b, a))
    exact = cover([r for r in runs if r[2] >= min_words])
    out = [(i, i + n, j, j + n, 1.0) for i, j, n in exact]
    inside = lambda x, y: any(b0 <= x and y <= b1 for b0, b1, *_ in out)
    seen: dict[int, list] = {}
    for i, j, n in exact + [r for r in runs if r[2] < min_words]:
        if n < min_words and inside(i, i + n) or any(x <= i and i + n <= y for x, y in seen.get(i - j, ())):
            continue
        right = [(i + n + p, j + n + q, m) for p, q, m in follow(b[i + n :], a[j + n :])]
        left = [(i - p - m, j - q - m, m) for p, q, m in follow(b[:i][::-1], a[:j][::-1])][::-1]
        chain = joined([*left, (i, j, n), *right])
        for x, y, m in chain:
            seen.setdefault(x - y, []).append((x, x + m))
        out += [p for p in of_chain(sb, sa, chain, min_words, least) if not inside(p[0], p[1])]
    return [p for k, p in enumerate(out) if not any(q[0] <= p[0] and p[1] <= q[1] and (q[0] < p[0] or p[1] < q[1] or m < k) for m, q in enumerate(out))]


def _verify(min_words: int, least: float):
    def run(batches):
        import pyarrow as pa

        names = ["id", "source", "start", "end", "source_start", "source_end", "n_words", "similarity"]
        for batch in batches:
            out: list = []
            column = batch.column(batch.schema.get_field_index("pairs"))
            pos, rpos = (column.flatten().field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            stop = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            for k, r in enumerate(batch.drop_columns(["pairs"]).to_pylist()):
                texts = [x.encode("utf-8", "replace") for x in (r["text_b"], r["text_a"])]
                (b, bs, be), (a, as_, ae) = map(words, texts)
                bs, be, as_, ae = (char_offsets(t, x) for t, x in ((texts[0], bs), (texts[0], be), (texts[1], as_), (texts[1], ae)))
                own = slice(stop[k - 1] if k else 0, stop[k])
                pairs = list(zip(np.searchsorted(bs, pos[own] - r["lo_b"]).tolist(), np.searchsorted(as_, rpos[own] - r["lo_a"]).tolist(), strict=True))
                for b0, b1, a0, a1, s in passages(b, a, pairs, min_words, least):
                    out.append((r["id"], r["source"], int(bs[b0]) + r["lo_b"], int(be[b1 - 1]) + r["lo_b"], int(as_[a0]) + r["lo_a"], int(ae[a1 - 1]) + r["lo_a"], b1 - b0, s))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "similarity" else pa.int64()) for c, n in zip(cols, names, strict=True)], names)

    return run


def _pairs(rows: DataFrame, scratch: Scratch, overlap: int, wanted: str = "true") -> tuple[DataFrame, DataFrame]:
    """Rows whose key several documents hold, with the smallest of them; and each document's pair with each such document, with positions and intervals.
    Only rows that are wanted look for a pair; all can be the other side of one. overlap: the words that two windows must share, aligned at the key."""
    shared = rows.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.bool_or(F.expr(wanted)).alias("any"), F.count(F.lit(1)).alias("n"))
    shared = scratch.keep(shared.where("first <> last and any").select("key", "first", "n"))
    held = scratch.keep(spread_join(rows, shared, "key", "id", keep_n=True))
    source = F.min(F.struct("pos", "lo", "hi", "left", "right")).alias("s")
    sources = scratch.keep(held.where("id = first").groupBy("key").agg(source, F.max("n").alias("n")))
    linked = spread_join(held.where("id <> first").where(wanted).drop("n"), sources, "key", "id")
    linked = linked.where(F.least("left", "s.left") + F.least("right", "s.right") >= overlap)
    pairs = linked.groupBy("id", F.col("first").alias("source")).agg(
        F.sort_array(F.collect_list(F.struct("pos", F.col("s.pos").alias("rpos")))).alias("pairs"),
        F.min("lo").alias("lo_b"), F.max("hi").alias("hi_b"), F.min("s.lo").alias("lo_a"), F.max("s.hi").alias("hi_a"),
    )
    return held.drop("n"), scratch.keep(pairs)


def _compare(pairs: DataFrame, texts: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """Fetches the intervals of both texts of each pair, and verifies them."""
    cut = lambda lo, hi: F.substring("text", F.col(lo) + 1, F.col(hi) - F.col(lo))
    wanted = pairs.select(F.col("id").alias("owner"), F.lit(0).alias("side"), "id", "source", F.col("lo_b").alias("lo"), F.col("hi_b").alias("hi"))
    wanted = wanted.unionByName(pairs.select(F.col("source").alias("owner"), F.lit(1).alias("side"), "id", "source", F.col("lo_a").alias("lo"), F.col("hi_a").alias("hi")))
    owners = texts.withColumnRenamed("id", "owner")
    slices = wanted.join(owners, "owner").select("side", "id", "source", cut("lo", "hi").alias("slice"))
    both = slices.groupBy("id", "source").agg(F.max(F.when(F.col("side") == 0, F.col("slice"))).alias("text_b"), F.max(F.when(F.col("side") == 1, F.col("slice"))).alias("text_a"))
    joined = both.join(pairs.select("id", "source", "lo_a", "lo_b", "pairs"), ["id", "source"]).where("text_a is not null and text_b is not null")
    kinds = "id long, source long, start long, end long, source_start long, source_end long, n_words long, similarity double"
    return joined.mapInArrow(_verify(min_words, similarity), kinds)


def _whole_windows(min_words: int):
    """All windows of min_words words that hold a given anchor, keyed by all their words; bare if one of their anchors is."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                data = b.column(1)[i].as_py().encode("utf-8", "replace")
                w, start, end = words(data)
                first, last = char_offsets(data, start), char_offsets(data, end)
                p = np.searchsorted(first, np.array([x["pos"] for x in b.column(2)[i].as_py()], np.int64))
                bare = np.array([x["bare"] for x in b.column(2)[i].as_py()], bool)
                around = p[:, None] - np.arange(min_words - CONTEXT - SHINGLE + 2)[None, :]
                at = np.unique(around.ravel())
                at = at[(at >= 0) & (at + min_words <= len(w))]
                lo, hi = first[np.maximum(at - MARGIN, 0)], last[np.minimum(at + min_words + MARGIN, len(w)) - 1]
                cols = [shingles(w, min_words)[at].view(np.int64), *(x.astype(np.int32) for x in (first[at], lo, hi, np.zeros(len(at)), np.full(len(at), min_words)))]
                ids = b.column(0).take(pa.array(np.full(len(at), i)))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, cols), pa.array(np.isin(at, around[bare]))], ["id", "key", "pos", "lo", "hi", "left", "right", "bare"])

    return run


def _marked(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows with other: of another document than the key's smallest, and bare: such a one without a found passage at its place."""
    spans = found.groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # as many as the document's own passages
    inside = F.coalesce(F.exists("spans", lambda x: (x["start"] <= F.col("pos")) & (F.col("pos") < x["end"])), F.lit(False))
    other = F.col("id") != F.col("first")
    return rows.join(spans, F.col("id") == F.col("of"), "left").withColumn("other", other).withColumn("bare", other & ~inside).drop("of", "spans")


def _left_over(held: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """id, at (pos, bare): the anchors whose comparisons may have missed another holder. Such a key stands in
    two documents besides the smallest, or twice in that one, and one document at least is bare."""
    rows = scratch.keep(_marked(held, found).select("key", "id", "pos", "other", "bare"))
    other = F.when(F.col("other"), F.col("id"))
    some = (F.bool_or("bare").alias("any"), (F.min(other) < F.max(other)).alias("many"), F.count_if(~F.col("other")).alias("own"), F.count(F.lit(1)).alias("n"))
    keys = scratch.keep(rows.groupBy("key").agg(*some).where("any and (many or own > 1)").select("key", "n"))
    return spread_join(rows, keys, "key", "id").groupBy("id").agg(F.collect_set(F.struct("pos", "bare")).alias("at"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """id, text: a row for each id; and whether some id stands in several rows."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null")
    repeat = not texts.groupBy("id").count().where("count > 1").isEmpty()
    return (texts.groupBy("id").agg(F.max("text").alias("text")) if repeat else texts), repeat


def _found(texts: DataFrame, min_words: int, similarity: float, functions: int) -> DataFrame:
    scratch = Scratch(texts.sparkSession)
    overlap = int(similarity * min_words)
    rows = scratch.keep(texts.mapInArrow(_anchors(min_words, functions), ANCHORS))
    held, pairs = _pairs(rows, scratch, overlap)
    found = scratch.keep(_compare(pairs, texts, min_words, similarity))
    bare = scratch.keep(_marked(held, found).where("bare").select(*rows.columns))
    _, pairs = _pairs(bare, scratch, overlap)
    found = scratch.keep(found.unionByName(_compare(pairs, texts, min_words, similarity)))
    some = scratch.keep(texts.join(_left_over(held, found, scratch), "id"))
    windows = scratch.keep(some.mapInArrow(_whole_windows(min_words), ANCHORS + ", bare boolean"))
    _, more = _pairs(windows, scratch, overlap, "bare")
    return found.unionByName(_compare(more, some.select("id", "text"), min_words, similarity)).distinct()


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY, functions: int = FUNCTIONS) -> DataFrame:
    """id, source, start, end, source_start, source_end (code points), n_words, similarity: passages of a document that a document of smaller id holds."""
    return _found(_texts(docs, id_col, text_col)[0], min_words, similarity, functions)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY, functions: int = FUNCTIONS) -> DataFrame:
    """The input's rows without their repeated passages; the document of the smallest id keeps a passage."""
    scratch = Scratch(docs.sparkSession)
    texts, repeat = _texts(docs, id_col, text_col)
    found = _found(texts, min_words, similarity, functions)
    spans = found.groupBy(F.col("id").alias("of")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    if repeat:
        spans = spans.join(texts.select(F.col("id").alias("of"), F.xxhash64("text").alias("hash")), "of")
    spans = scratch.keep(spans)
    same = (F.col("id") == F.col("of")) & (F.xxhash64("text") == F.col("hash")) if repeat else F.col("id") == F.col("of")
    joined = packed(docs, id_col, text_col).join(spans, same, "left")
    # Spans are in order of their starts; each adds what lies between the furthest end so far and its own start.
    piece = lambda begin, n: F.substring(F.col("text"), (begin + 1).cast("int"), n.cast("int"))
    state = F.aggregate(
        F.col("spans"), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("kept")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(acc["kept"], piece(acc["at"], F.greatest(s["start"] - acc["at"], F.lit(0)))).alias("kept"),
        ),
        lambda acc: F.concat(acc["kept"], piece(acc["at"], F.lit(2147483647))),
    )
    return unpacked(joined, docs.columns, text_col, F.when(F.col("spans").isNull(), F.col("text")).otherwise(state))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.withColumnRenamed("id", "doc_id").withColumnRenamed("source", "source_doc_id")

"""The ten operators against brute force, and on odd rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelens.llm import html_extract as H
from placelens.llm import language_id as G
from placelens.llm import line_dedup as L
from placelens.llm import minhash as M
from placelens.llm import nearest as N
from placelens.llm import packing as P
from placelens.llm import sentencepiece_codec as C
from placelens.llm import sharding as K
from placelens.llm import simhash as S
from placelens.llm import substring_dedup as D
from placelens.llm import textkit

SCHEMA = "doc_id long, text string, lang string, id long, row string, `drop` string"
LINE = "this is a line that many documents hold"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, a long text, ties, a repeated row, columns whose names the operators use."""
    long = " ".join(f"w{i * 7919 % 5000}" for i in range(30_000))
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t", None), (4, long, "en"), (5, f"{LINE}\nown five", "en"), (6, f" {LINE.upper()} \nown six", "de"), (7, f"{LINE}\nown seven\n{LINE}", "en"), (7, f"{LINE}\nown seven\n{LINE}", "en"), (8, "ß ÄÖ é 日本", "de"), (9, "123 456", None), (None, f"{LINE}\nno id", "en")]
    return spark.createDataFrame([(*r, 1, "r", "d") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def test_line_dedup(odd, empty, docs):
    got = {r["id"]: r for r in L.line_dedup(odd).collect()}
    assert (got[5]["kept"], got[6]["kept"], got[7]["n_dropped"]) == ("own five", "own six", 0)  # the largest id keeps it, both of its lines
    assert got[None]["n_dropped"] == 0 and got[1]["n_lines"] == 1 and got[1]["kept"] == "" and got[5]["row"]["drop"] == "d"
    assert L.line_dedup(empty).count() == 0
    keys = {d: [k.strip(" \t\n\v\f\r").translate(str.maketrans(L.UPPER, L.LOWER)) for k in t.split("\n")] for d, t in texts_of(docs).items()}
    held = defaultdict(set)
    for d, ks in keys.items():
        for k in ks:
            held[k].add(d)
    for batches in (1, 4):
        for r in L.line_dedup(docs, batches=batches).collect():
            lines = r["row"]["text"].split("\n") if r["row"]["text"] else [""]
            kept = [x for x, k in zip(lines, keys[r["id"]], strict=True) if len(k) < 20 or len(held[k]) < 3 or max(held[k]) == r["id"]]
            assert r["kept"] == "\n".join(kept)


def test_sentencepiece(odd, empty, docs):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(C.MODEL))
    for df in (odd, docs.limit(50)):
        for r in C.encode(df.select("doc_id", "text")).join(df.select(F.col("doc_id").alias("id"), "text").distinct(), "id").collect():
            assert r["ids"] == model.encode(r["text"] or "")
    assert C.encode(empty).count() == 0


def scanned(codec, text, chunk):
    """The scan over one text, without Spark."""
    u, at = " " + text, C.bounds(len(text) + 1, chunk)
    chunks = [C.Chunk(codec, u, a, b, a == 0, b == len(u)) for a, b in zip(at, at[1:], strict=False)]
    ms = [c.matrix() for c in chunks]
    whole = ms[0]
    for m in ms[1:]:
        whole = C.product(whole, m)
    assert whole.shape == (1, 1) and whole[0, 0] == 0
    states = C.states_between(ms, 0, 0)
    return [int(x) for k, c in enumerate(chunks) for x in c.ids(states[k], states[k + 1])]


def test_scan_equals_the_library(spark, docs):
    import public_tokenizers

    codec = C.Codec(public_tokenizers.path(C.MODEL))
    rng = np.random.default_rng(2)
    parts = ["a", "b", "cc", " ", "  ", "\n", "the ", "ing", "é", "日", "....", "__", "0", "▁", "<s>", "\U0001f600", "="]
    made = ["".join(rng.choice(rng.choice(parts, int(rng.integers(1, 8))), int(rng.integers(150, 500)))) for _ in range(25)]
    for t in [*made, "c" * 300, " " * 300, *[t for t in texts_of(docs.limit(30)).values() if len(t) > 700]]:
        for chunk in (64, 300):
            if len(t) > 2 * chunk:
                assert scanned(codec, t, chunk) == codec.model.encode(t)
        ids = np.array(codec.model.encode(t), np.int64)
        assert codec.decode(ids, 37) == codec.model.decode(ids.tolist())
    x, y = b"one" * 70, b"other" * 31
    assert C.combine_crc(zlib.crc32(x), zlib.crc32(y), len(y)) == zlib.crc32(x + y)
    # Through Spark, over three levels of products.
    rows = [(1, " ".join(f"word{i % 97}" for i in range(4000))), (None, "日本語 " * 1500), (1, "short"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = C.encode(df, giant=1000, chunk=100).collect()
    assert sorted(r["ids"] for r in got) == sorted(codec.model.encode(t or "") for _, t in rows)
    for r in got:
        back = codec.model.decode(r["ids"])
        assert r["n_ids"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["decoded_crc32"] == zlib.crc32(back.encode())


def test_nearest(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    bad = spark.createDataFrame([(100_000, None), (100_100, [0.0] * 64), (100_200, [float("nan")] * 64), (None, [1.0] * 64), (100_300, [1.0] * 3)], "vec_id long, embedding array<float>")
    all_rows = rows.unionByName(bad)
    got = N.nearest(all_rows, all_rows.where("vec_id % 100 = 0"), block_rows=150).collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        assert r["score"] == pytest.approx(np.linalg.norm(x[r["query_id"]] - x[r["vec_id"]]), abs=1e-12)
        found[r["query_id"]].append(r["vec_id"])
    hit = sum(len(set(f) & set(sorted((v for v in x if v != q), key=lambda v: (np.linalg.norm(x[q] - x[v]), v))[:10])) for q, f in found.items())  # noqa: B023
    assert hit >= 9 * len(found) and all(len(f) == 10 for f in found.values()) and 100_300 not in found
    assert N.nearest(rows.limit(0), rows.limit(0)).count() == 0
    # Repeated rows, columns whose names the operator uses, equal distances, and fewer candidates than k.
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 2), (5, [1.0, 1.0], 3), (3, [1.0, -1.0], 4), (7, [1.0, 0.0], 5), (7, [1.0, 0.0], 5)], "vec_id long, embedding array<double>, id long").withColumn("v", F.lit("x")).withColumn("rank", F.lit(9))
    assert [tuple(r) for r in N.nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 7, 0.0), (0, 2, 7, 0.0), (0, 3, 3, 1.0), (0, 4, 5, 1.0)]


def test_simhash(spark, odd, empty, docs):
    import xxhash

    for df in (odd, docs):
        got = S.simhash_components(df).collect()
        fp = {}
        for r in df.select("doc_id", "text").collect():
            w = (r["text"] or "").encode().lower().split()
            h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
            fp[r["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert all(r["fp"] & (1 << 64) - 1 == fp[r["id"]] for r in got)
        ids = sorted(d for d in fp if d is not None)
        root = {d: d for d in ids}

        def find(d):
            while root[d] != d:  # noqa: B023
                d = root[d]  # noqa: B023
            return d

        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                if (fp[a] ^ fp[b]).bit_count() <= 2:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        assert all(r["component"] == find(r["id"]) for r in got if r["id"] is not None)
    assert S.simhash_components(empty).count() == 0


def test_near_duplicates(spark, odd, empty, docs):
    """Groups at a Jaccard similarity of 0.8 of five-word shingle sets: a pair from 0.83 is found, and none under 0.77 is linked but through others."""
    few = lambda t: ((w := t.lower().split()), {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())[1]
    random = np.random.default_rng(5)
    base = [f"v{x}" for x in random.integers(0, 500, 300)]
    copies = []
    for i in range(150):  # more classes than PAIR_CAP in many blocks; one or two words of each are its own
        w = list(base)
        for at in random.integers(0, 300, 1 + i % 2):
            w[at] = f"own{i}"
        copies.append((10_000 + i, " ".join(w)))
    near = [(20_000 + 2 * i + j, " ".join(x)) for i in range(40) for w in [[f"u{x}" for x in random.integers(0, 5000, 200)]] for j, x in enumerate((w, [*w[: 200 - 3 * (i % 6)], *("x" * (1 + k) for k in range(3 * (i % 6)))]))]
    half = [(30_000 + j, " ".join(w)) for j, w in enumerate(([f"t{x}" for x in range(400)], [f"t{x}" for x in range(150, 550)]))]
    made = spark.createDataFrame(copies + near + half, "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), made):
        sets = {r["doc_id"]: few(r["text"] or "") for r in df.collect()}
        got = {r["id"]: r["component"] for r in S.near_components(df).collect()}
        assert got.keys() == sets.keys()
        ids, holders, loose = sorted(sets), defaultdict(set), defaultdict(set)
        for d in ids:
            for x in sets[d] or {None}:
                holders[x].add(d)
        for a in ids:
            for b in set().union(*(holders[x] for x in sets[a] or {None})):
                j = len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) if sets[a] or sets[b] else 1.0
                if j >= 0.77 and a != b:
                    loose[a].add(b)
                assert j < 0.83 or got[a] == got[b]
        for d in ids:
            assert got[d] <= d and (got[d] == d or loose[d] and any(got[x] == got[d] for x in loose[d]))
    assert {got[d] for d, _ in copies} == {10_000} and got[30_001] == 30_001
    assert S.near_components(empty).count() == 0 and S.simhash_dedup(empty).count() == 0
    kept = S.simhash_dedup(odd)
    assert kept.columns == odd.columns
    # Nulls, blanks and empty texts are one group, and 5 to 7 and the row without id are too short to be alike; both rows of id 7 stay.
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 4, 5, 6, 7, 7, 8, 9, None]))


def test_crowded_block_value_loses_no_pair(spark):
    """200 classes share one block value; ten pairs of them are alike and share no other."""
    from placelens.llm.shared import Scratch

    rng = np.random.default_rng(9)
    bits = rng.integers(0, 2, (200, S.WIDE), dtype=np.uint8)
    for i in range(10):
        bits[101 + 2 * i] = bits[100 + 2 * i]
        bits[101 + 2 * i, 5 :: S.BLOCK_BITS] ^= 1
    bits[:, : S.BLOCK_BITS] = bits[0, : S.BLOCK_BITS]
    packed = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    df, scratch = spark.createDataFrame([(i, 100, x.tolist()) for i, x in enumerate(packed)], "class long, n long, bits array<long>"), Scratch(spark)
    pairs = {(100 + 2 * i, 101 + 2 * i) for i in range(10)}
    assert {(r["a"], r["b"]) for r in S.wide_links(df, scratch).collect()} == pairs


def test_short_texts_that_share_a_print_stay(spark):
    """Texts of one shingle with equal bits, and of four and five shingles at 0.8 and under it."""
    one = defaultdict(list)
    for i in range(600):
        h = int(textkit.shingles(textkit.words(f"only {i}".encode())[0], S.SHINGLE)[0])
        one[h % S.WIDE, h >> 32 & 1].append(i)
    clash = [i for x in one.values() if len(x) > 1 for i in x]
    assert len(clash) > 10
    rows = [(i, f"only {i}") for i in clash] + [(1000, "a b c d e f g h"), (1001, "a b c d e f g h i"), (1002, "k l m n o p q"), (1003, "k l m n o p q r")]
    got = {r["id"]: r["component"] for r in S.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d] == d for d in got if d not in (1000, 1001))
    assert got[1001] == got[1000] == 1000


def test_crowded_buckets_lose_no_link(spark):
    """Centres in place of pairs give the same components."""
    from placelens.llm.components import connected_components
    from placelens.llm.shared import Scratch

    rng = np.random.default_rng(5)
    fps = {0}
    for _ in range(300):
        base = int(rng.choice(sorted(fps)))
        for b in rng.choice(40, int(rng.integers(1, 4)), replace=False):
            base ^= 1 << int(b)
        fps.add(base)
    df, scratch = spark.createDataFrame([(x,) for x in fps], "fp long"), Scratch(spark)
    comp = [{(r["node"], r["root"]) for r in connected_components(S.links(df, scratch, cap=c), scratch).collect()} for c in (2, 10_000)]
    assert comp[0] == comp[1] and comp[0]


def test_substring_dedup(spark, odd, empty, docs):
    got = {r["id"] for r in D.repeated_passages(docs).collect()}
    first = defaultdict(set)
    for d, t in texts_of(docs).items():
        w = t.encode().lower().split()
        for i in range(len(w) - 49):
            first[tuple(w[i : i + 50])].add(d)
    assert {d for s in first.values() for d in s if d != min(s)} <= got  # every exact passage is found
    passage = " ".join(f"p{i}" for i in range(60))
    own = lambda k: " ".join(f"{k}x{i}" for i in range(80))
    rows = [(1, f"{own('a')} {passage} tail", "en"), (2, f"{own('b')}\n{passage.upper()} end", "en"), (3, own("c"), "en"), (4, own("d") + " " + " ".join(passage.split()[:40]), "en"), (None, passage, "en")]
    df = spark.createDataFrame([(*r, 1, "r", "d") for r in rows], SCHEMA)
    kept = {r["doc_id"]: r["text"] for r in D.substring_dedup(df).collect()}
    assert kept[2] == f"{own('b')}\n end" and all(kept[d] == t for d, t, _ in rows if d != 2)
    assert D.substring_dedup(odd).count() == odd.count() and D.substring_dedup(empty).count() == 0 and D.substring_dedup(odd).columns == odd.columns


def test_short_repeat_hides_no_longer_one(spark):
    """The smallest document holds 46 of the 50 words that two others share; and one that holds a beginning twice."""
    rows = []
    for t in range(0, 90, 3):
        p, own = [f"p{t}x{i}" for i in range(50)], lambda k: " ".join(f"{k}{t}y{i}" for i in range(70))  # noqa: B023
        rows += [(t, f"{own('a')} {' '.join(p[:46])}"), (t + 1, f"{own('b')} {' '.join(p)} {own('d')}"), (t + 2, f"{own('c')} {' '.join(p)} {own('e')}")]
    q = [f"q{i}" for i in range(50)]
    rows += [(90, f"{' '.join(q[:44])} between {' '.join(q)} {own('f')}"), (91, f"{own('g')} {' '.join(q)} {own('h')}")]
    got = {(r["id"], r["source"]) for r in D.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(t + 2, t + 1) for t in range(0, 90, 3)} | {(91, 90)}


def test_no_exact_passage_is_cut_from_its_chain():
    """A passage and a shorter one behind a gap, two passages around a gap, and a gap on either side; from anchors at any place."""
    for lengths in ((54, 20), (50, 50), (20, 54, 20), (50, 12, 50), (12, 50, 12, 50, 12)):
        own = lambda k: np.concatenate([x for r, n in enumerate(lengths) for x in (1000 * (r + 1) + np.arange(n), 100_000 * k + 100 * r + np.arange(8))]).astype(np.uint64)  # noqa: B023, E731
        a, b = own(1), own(2)
        starts = np.cumsum([0, *(n + 8 for n in lengths[:-1])])
        for first in range(lengths[0]):
            got = D.passages(b, a, [(first, first), *((int(s), int(s)) for s in starts)])
            for s, n in zip(starts, lengths, strict=True):
                assert n < 50 or any(b0 <= s and s + n <= b1 for b0, b1, *_ in got)


def test_near_passages_of_edited_copies(spark):
    """Passages at a similarity of 0.8 or more are found, and no document without one is named; a smaller document holds only their beginning."""
    rng = np.random.default_rng(4)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    rows, wanted = [], set()
    for t in range(60):
        p = fresh(int(rng.choice([55, 70, 120])))
        q = list(p)
        q[int(rng.integers(5, len(p) - 5))] = f"e{t}"
        own = lambda: fresh(int(rng.integers(60, 120)))
        rows += [(10 * t, own() + (p[:30] if t % 3 == 0 else [])), (10 * t + 1, own() + p + own()), (10 * t + 2, own() + q + own()), (10 * t + 3, own())]
        if 2 * len(shingle_sets(" ".join(p)) & shingle_sets(" ".join(q))) >= 1.6 * len(p) / 0.9 - 8:
            wanted.add(10 * t + 2)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = {r["id"]: r["source"] for r in D.repeated_passages(df).collect()}
    assert all(d % 10 == 2 and s == d - 1 for d, s in got.items()) and len(wanted & got.keys()) >= 0.9 * len(wanted)


def test_self_repeating_texts_and_repeated_ids(spark):
    words = ["la"] * 400
    rows = [(1, " ".join(words)), (2, "x " + " ".join(words)), (3, "b " * 60), (3, "c " * 60), (4, "d " + "c " * 60), (4, "d " + "c " * 60)]
    df = spark.createDataFrame([(d, t.strip()) for d, t in rows], "doc_id long, text string")
    got = D.repeated_passages(df).collect()
    assert {r["id"] for r in got} == {2, 4} and sum(r["id"] == 2 for r in got) < 10
    kept = sorted((r["doc_id"], len(r["text"].split())) for r in D.substring_dedup(df).collect())
    assert kept == [(1, 400), (2, 1), (3, 60), (3, 60), (4, 1), (4, 1)]


def test_cover_is_the_union():
    rng = np.random.default_rng(1)
    union = lambda runs: {x for i, _, n in runs for x in range(i, i + n)}
    for _ in range(300):
        runs = [(int(rng.integers(0, 60)), 0, int(rng.integers(1, 20))) for _ in range(int(rng.integers(0, 12)))]
        assert union(D.cover(runs)) == union(runs)


def test_compact_windows_cover_each_passage():
    h = textkit.mix64(np.arange(200, dtype=np.uint64) % np.uint64(60))
    found = list(D.compact_windows(h, 10))
    for a in range(0, 190, 7):
        c = a + int(h[a : a + 10].argmin())
        assert any(l <= a and a + 9 <= r and x == c for l, x, r in found)


def test_packing(odd, empty, docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.vocabulary_path())
    bpe = P.ByteBpe(P.vocabulary_path())
    for t in ["", "a <|endoftext|> b", "日本語 ß  \n\n x", "it's 12½ ١٢", "\xa0 x", *texts_of(docs.limit(60)).values()]:
        assert bpe.encode(t).tolist() == model.encode(t, add_special_tokens=False).ids
    pieces = [r for r in P.pack(docs).collect()]
    texts = texts_of(docs)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for d, t in texts.items():
        ids = [i for r in sorted(by_doc[d], key=lambda r: r["start"]) for i in r["ids"]]
        assert ids == [*model.encode(t, add_special_tokens=False).ids, 0]
    for rs in by_seq.values():
        assert np.cumsum([0] + [r["length"] for r in sorted(rs, key=lambda r: r["offset"])])[:-1].tolist() == sorted(r["offset"] for r in rs) and sum(r["length"] for r in rs) <= 1024
    assert P.pack(odd).where("start = 0").count() == odd.count() and P.pack(empty).count() == 0


def test_packer_follows_the_rule():
    """Each move is one of those that add least to the sum of squares, by trying all; nothing is cut before the end, and then one sequence stays unfull."""
    rng = np.random.default_rng(8)
    p = P.Packer(32, 0)
    squares = lambda n: int((n[1:32].astype(int) ** 2).sum())
    for i in range(600):
        s = int(rng.integers(1, 32))
        after = {}
        for h in [0, *np.flatnonzero(p.levels[1 : 33 - s]) + 1]:
            n = p.levels.copy()
            n[h] -= h > 0
            n[h + s] += 1
            after[int(h)] = squares(n)
        level = p.move(s)
        assert after[level] == min(after.values())
        p.place(i, np.arange(s, dtype=np.uint32))
        assert p.lacking == sum((32 - h) * int(p.levels[h]) for h in range(1, 32))
    q = P.Packer(32, 0)
    for i in range(600):
        q.add(i, np.arange(int(rng.integers(1, 90)), dtype=np.uint32))
    q.finish()
    fill, places = Counter(), defaultdict(list)
    for _, _, ids, _, seq, offset in q.rows:
        fill[seq] += len(ids)
        places[seq].append((offset, len(ids)))
    assert sum(v < 32 for v in fill.values()) <= 1 and max(fill.values()) == 32
    assert all(sorted(o for o, _ in x) == list(np.cumsum([0, *(n for _, n in sorted(x))])[:-1]) for x in places.values())


def test_two_tokenizers_agree():
    from tokenizers import Tokenizer

    model, bpe = Tokenizer.from_file(P.vocabulary_path()), P.ByteBpe(P.vocabulary_path())
    rng = np.random.default_rng(6)
    marks = [chr(x) for x in (*range(32, 127), 9, 10, 13, 160, *range(161, 0x250, 7), 0x2013, 0x2019, 0x2026, 0x3000, 0x65E5)]
    for _ in range(1500):
        t = "".join(rng.choice(marks, int(rng.integers(0, 40))))
        assert bpe.encode(t).tolist() == model.encode(t, add_special_tokens=False).ids


def shingle_sets(t):
    w = t.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_minhash(spark, odd, empty, docs):
    texts = texts_of(docs)
    order = sorted(texts, reverse=True)
    wrong = []
    for r in M.neighbour_fingerprints(docs).collect():
        t, after = texts[r["id"]], texts[order[(order.index(r["id"]) + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        for x, y in ((r["near_edited"], edited), (r["near_next"], after)):
            a, b = shingle_sets(t), shingle_sets(y)
            wrong.append(abs(x - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert np.mean(wrong) < 0.03 and max(wrong) < 0.2
    assert M.neighbour_fingerprints(odd).count() == odd.count() and M.neighbour_fingerprints(empty).count() == 0
    # Ranges of a few rows, an id and no id that hold most rows, repeated rows: the ring of neighbours is that of one sort.
    rows = [(i, f"text {i * 7 % 50} of {i}", i) for i in range(60)] + [(30, f"same id {i} a b c", i) for i in range(150)] + [(None, f"no id {i} d e f", i) for i in range(150)] + [(None, None, 0), (7, "", 0), (2**60, "far", 1), (-(2**60), "low", 1)] + [(7, "twice", 0)] * 5
    ring = spark.createDataFrame(rows, "doc_id long, text string, h long").repartition(3)
    h = {(r["doc_id"], r["text"]): r["x"] for r in ring.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("text"), 64 - M.HASH_BITS).alias("x")).collect()}
    line = sorted([r[:2] for r in rows], key=lambda r: (r[0] is None, -(r[0] or 0), h[r], r[1] is not None, r[1] or ""))
    want = Counter()
    for (d, t), (_, after) in zip(line, line[1:] + line[:1], strict=True):
        t, after = t or "", after or ""
        want[d, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()] += 1
    for size in (500, 1 << 30):
        assert Counter((r["id"], r["n_chars"], r["edited_sha256"]) for r in M.neighbour_fingerprints(ring, range_bytes=size).collect()) == want
    alone = M.neighbour_fingerprints(odd.where("doc_id = 5")).first()
    assert alone["near_next"] == 1.0 and M.likeness(M.unpacked_bits(alone["fingerprint"]), M.fingerprint(f"{LINE}\nown five")) == 1.0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><header>top</header><nav><ul><li>menu</ul></nav><!-- <p>x</p> -->
<div class="cookie-notice">cookies</div><article><header><h1>Head &amp; &lt;line&gt;</h1></header><p><b>First
 part<br>more<p>Second&nbsp;one</p><form><input>send</form><div class="comments"><p>reader</p></div><aside>side</aside></article><footer>&copy;</footer>"""


def test_html(spark):
    assert H.walk(PAGE) == "Head & <line>\nFirst part more\nSecond one"
    assert H.walk(None) == H.walk("") == H.walk("<p") == "" and H.walk("a < b") == "a < b"
    # Ids and classes of flow text say nothing; a box whose class is a word of the lists goes, on a host with few pages.
    assert H.walk('<article><h2 id="search-algorithms">Head</h2><p class="alert">warn</p><ul class="social-history"><li>h</ul><section id="related-work"><p>rel</section></article>') == "Head\nwarn\nh\nrel"
    assert H.walk('<article><p>x</p><div class="box sidebar">s</div><div class="comments">c</div></article>') == "x"
    assert H.walk('<article><p>x</p><div class="box sidebar">s</div><div class="comments">c</div></article>', few_pages=False) == "x\ns"
    deep = "<div>" * 50_000 + "deep" + "</span>" * 50_000
    text = lambda i: f"<body><div><p>Own text number {i}</p></div><div><p>Same box</p></div></body>"
    rows = [(i, "http://a.example/x", text(i)) for i in range(8)] + [(8, None, text(8)), (9, "http://b.example/", text(9)), (10, "http://c.example", None), (11, "", ""), (11, "x", deep)]
    rows += [(20 + i, "http://d.example/", text(1)) for i in range(8)]
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, subtree int")
    for limit in (0, 1000):
        out = H.extract(pages, broadcast_rows=limit)
        assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == len(rows)
        got = {r["page_id"]: r["text"] for r in out.where("url is null or url <> ''").collect()}
        assert got[3] == "Own text number 3" and got[9] == "Own text number 9\nSame box" and got[10] == "" and got[11] == "deep"
        assert got[20] == "Own text number 1\nSame box"  # copies of one page are no template
    assert H.extract(pages.limit(0)).count() == 0


def test_html_templates_by_brute_force(spark):
    """Boxes of an article that recur with other contents of the host, at random, against a count of their markup."""
    rng = np.random.default_rng(12)
    rows, kept = [], {}
    boxes = {h: [f'<div class="c{k}"><b>Box {h}{k}</b></div>' for k in range(6)] for h in "ab"}
    for i in range(120):
        h = "ab"[i % 2]
        own = [f"<p>Text {i} {j}</p>" for j in range(3)] + [b for k, b in enumerate(boxes[h]) if rng.random() < (0.02, 0.03, 0.3, 0.6, 0.9, 0.05)[k]]
        own = [own[j] for j in rng.permutation(len(own))]
        copies = 1 + 3 * (i % 10 == 0)  # the same article under other menus
        for c in range(copies):
            rows.append((1000 * c + i, f"http://{h}.example/{i}/{c}", f"<nav>menu {c}</nav><article>{''.join(own)}</article><footer>f</footer>"))
        kept[i] = (h, own)
    n, of = Counter(), Counter()
    for h, own in kept.values():
        of[h] += 1
        n.update((h, b) for b in set(own))
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    gone = {k for k, c in n.items() if c >= H.MIN_PAGES and c >= H.MIN_SHARE * of[k[0]]}
    assert gone
    for page, text in got.items():
        h, own = kept[page % 1000]
        assert text == "\n".join(re.sub("<[^>]*>", "", b) for b in own if b.startswith("<p>") or (h, b) not in gone)


def test_signature():
    """Bins by a loop over all hashes; an empty bin holds what the first filled bin that it asks holds."""
    rng = np.random.default_rng(3)
    for size in (1, 2, 40, 300, 20_000):
        h = rng.integers(0, 1 << 64, size, dtype=np.uint64)
        least = {}
        for x in map(int, h):
            least[x >> 55] = min(x, least.get(x >> 55, x))
        donors = M._donors(512, 8 * 512)
        want = [least[b] if b in least else least[next(int(d[b]) for d in donors if int(d[b]) in least)] for b in range(512)]
        assert M.signature(h, 512).tolist() == want


def test_sharding(spark, odd, empty, docs):
    for df in (odd, docs):
        got = K.shard(df).collect()
        text = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        of = defaultdict(set)
        for r in got:
            t = text[r["id"]]
            assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode())
            of[t].add(r["shard"])
        assert all(len(s) == 1 for s in of.values())
        for s in range(8):
            slots = sorted(r["slot"] for r in got if r["shard"] == s)
            assert slots == list(range(len(slots)))
    bytes_ = Counter()
    for r in got:
        bytes_[r["shard"]] += r["size"]
    assert max(bytes_.values()) - min(bytes_.values()) < 0.02 * sum(bytes_.values()) / 8
    assert K.shard(empty).count() == 0
    # Three levels against differencing all groups at once, with a group that no shard can share.
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in np.exp(rng.normal(7, 2, 12_000)) + 1] + [300_000]
    groups = spark.createDataFrame([(i, i * 31, s) for i, s in enumerate(sizes)], "k1 long, k2 long, bytes long")

    def sums(parts):
        total = Counter()
        for i, p in parts:
            total[p] += sizes[i]
        return max(total.values()) - min(total.values())

    got = [(r["k1"], r["shard"]) for r in K.parts_of(groups, 8, bundles=96, set_items=600, driver_items=250).collect()]
    assert sorted(i for i, _ in got) == list(range(len(sizes)))
    assert sums(got) <= sums(enumerate(K.differencing(sizes, 8))) + 0.001 * sum(sizes) / 8, sums(got)
    parts = K.differencing([8, 7, 6, 5, 4], 2)
    assert abs(sum(s if p else -s for s, p in zip([8, 7, 6, 5, 4], parts, strict=True))) <= 2


def test_language_id(spark, odd, empty, docs):
    model = G.train(docs.where(~G.held_out(F.col("doc_id"))))
    got = G.predict(docs, model).where(G.held_out(F.col("row.doc_id")) & F.col("row.lang").isNotNull())
    n, ok = got.count(), got.where("lang_pred = row.lang").count()
    assert ok >= 0.95 * n and n > 10
    r = {x["row"]["doc_id"]: (x["lang_pred"], x["score"]) for x in G.predict(odd, model).collect()}
    assert r[1] == r[2] == r[3] == r[9] == ("und", 0.0) and r[8][0] != "und"
    assert G.predict(empty, model).count() == 0 and G.predict(odd, G.train(empty)).where("lang_pred <> 'und'").count() == 0
    assert model.predict("the and of " * 300_000)[0] == model.predict("the and of " * 30)[0]


def test_words_and_blocks():
    t = "Ab\x0bcD  é日\tß \n" * 50
    h, start, end = textkit.words(t.encode())
    w = [t.encode()[a:b].lower() for a, b in zip(start, end, strict=True)]
    assert w == t.encode().lower().split() and len({int(x) for x in h}) == len(set(w))
    assert b"".join(b for _, b in textkit.blocks(t.encode(), 7)) == t.encode() and re.fullmatch(r"[\s\S]*", t)

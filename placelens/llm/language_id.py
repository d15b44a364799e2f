"""Language identification by bit-sliced Bloom filters over character n-grams.

The filter is one array of SLOTS words of bits, one bit for each language: an n-gram of a language sets that language's bit in its
HASHES slots, so the bitwise AND of an n-gram's slots names all languages that hold it. A text's n-grams are looked up, the bits are counted for each
language, and each count is corrected for false positives: with f the share of all slots that hold the language's bit, f^HASHES of
the absent n-grams look present, so the estimate is (count - n p) / (1 - p). The largest estimate decides (ties: the first language).

Training reads labelled rows only, about SAMPLE documents for each language by a hash of the id (whole texts): a bounded sample. An n-gram
belongs to a language if its rate there is at least SHARE of its largest rate in any language. The model is SLOTS words, whatever the input.

n-grams are runs of 1 to 4 code points over the lower-cased text with each run of non-letters as one space. Null texts, and those without a letter, are
`und` with score 0. Prediction streams over rows: no shuffle, and long texts are read in blocks of code points.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textkit import mix64

SLOTS, HASHES, SAMPLE, SHARE, MIN_COUNT = 1 << 20, 2, 1500, 0.3, 3
GRAMS = (1, 2, 3, 4)
LETTERS = re.compile(r"[^\W\d_]+")
TEXT_BLOCK = 1 << 18


def grams(text: str) -> np.ndarray:
    """Hashes of all n-grams, repeats included."""
    kept = " ".join(LETTERS.findall(text.lower()))
    if not kept:
        return np.zeros(0, np.uint64)
    c = np.frombuffer(f" {kept} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    for n in GRAMS:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : len(c) - n + 1 + i] + np.uint64(1)
            out.append(h if n > 1 else h[c != 32])
    return mix64(np.concatenate(out))


def text_blocks(text: str, size: int = TEXT_BLOCK):
    """A long text in blocks that end at a white space where there is one near."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text) and (cut := text.rfind(" ", at + size // 2, end)) > 0:
            end = cut
        yield text[at:end]
        at = end


def slots(h: np.ndarray, n_slots: int) -> list[np.ndarray]:
    return [((h >> np.uint64(32 * i)) & np.uint64(0xFFFFFFFF)) % np.uint64(n_slots) for i in range(HASHES)]


def _counts(batches):
    import pyarrow as pa

    found: dict[str, list] = {}

    def shrink(parts):
        h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        u, inverse = np.unique(h, return_inverse=True)
        return [(u, np.bincount(inverse, n, len(u)).astype(np.int64))]

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            parts = found.setdefault(lang, [])
            for block in text_blocks(text.as_py() or ""):
                parts.append(np.unique(grams(block), return_counts=True))
            if len(parts) > 200:
                found[lang] = shrink(parts)
    for lang, parts in found.items():
        if parts:
            u, n = shrink(parts)[0]
            for i in range(0, len(u), 50_000):
                m = len(u[i : i + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * m), pa.array(u[i : i + m].view(np.int64)), pa.array(n[i : i + m])], ["lang", "gram", "n"])


class LanguageFilter:
    """masks: (slots, words) of language bits; langs: the languages in order of their bits."""

    def __init__(self, langs: list[str], masks: np.ndarray, false: np.ndarray | None = None):
        self.langs, self.masks, self.false = langs, masks, false
        if false is not None:
            return
        bits = np.zeros(len(langs))
        for i in range(0, len(masks), 1 << 16):
            bits += self.per_language(masks[i : i + (1 << 16)])
        self.false = (bits / len(masks)) ** HASHES

    def per_language(self, masks: np.ndarray) -> np.ndarray:
        return np.array([np.count_nonzero(masks[:, i // 64] & (np.uint64(1) << np.uint64(i % 64))) for i in range(len(self.langs))], float)

    def predict(self, text: str | None) -> tuple[str, float]:
        n, hits = 0, np.zeros(len(self.langs))
        for block in text_blocks(text or ""):
            h = grams(block)
            if len(h) and len(self.langs):
                first, *rest = slots(h, len(self.masks))
                held = self.masks[first]
                for s in rest:
                    held = held & self.masks[s]
                hits += self.per_language(held)
            n += len(h)
        if not n or not len(self.langs):
            return "und", 0.0
        true = np.clip((hits - n * self.false) / (1 - self.false).clip(1e-9), 0, None)
        best = int(np.argmax(true))
        return (self.langs[best], float(true[best] / true.sum())) if true[best] > 0 else (self.langs[best], 0.0)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, share: float = SHARE, n_slots: int = SLOTS) -> LanguageFilter:
    """labelled: rows to learn from; those without a language are left out."""
    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    langs = sorted(sizes)
    if not langs:
        return LanguageFilter([], np.zeros((n_slots, 1), np.uint64))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000))
    limit = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1_000_000, -(-1_000_000 * sample // sizes[lang])))])
    counts = rows.where(draw < limit[F.col("lang")]).select("lang", "text").mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_gram = Window.partitionBy("gram")
    rated = counts.join(counts.groupBy("lang").agg(F.sum("n").alias("total")), "lang").withColumn("rate", F.col("n") / F.col("total"))
    own = rated.withColumn("most", F.max("rate").over(by_gram)).where((F.col("rate") >= share * F.col("most")) & (F.col("n") >= MIN_COUNT))
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])[F.col("lang")]
    h = F.col("gram")
    halves = F.explode(F.array(*[F.pmod(F.shiftrightunsigned(h, 32 * i).bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(n_slots)) for i in range(HASHES)]))
    bit = F.expr("shiftleft(1L, word_bit)")
    placed = own.select(halves.alias("slot"), number.alias("number")).withColumn("word", F.floor(F.col("number") / 64).cast("int")).withColumn("word_bit", F.pmod("number", F.lit(64)).cast("int"))
    masks = np.zeros((n_slots, -(-len(langs) // 64)), np.uint64)
    got = placed.groupBy("slot", "word").agg(F.bit_or(bit).alias("bits")).toArrow()  # n_slots rows a word at most
    masks[got["slot"].to_numpy(), got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return LanguageFilter(langs, masks)


def _predict(model):
    def run(batches):
        import pyarrow as pa

        filters = LanguageFilter(*model.value)
        for b in batches:
            got = [filters.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: LanguageFilter, text_col: str = "text") -> DataFrame:
    """All columns of the input as the struct row, with lang_pred and score."""
    # SLOTS words: a fixed size. Plain values, as workers without this package can't read its classes from a broadcast.
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.masks, model.false))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_predict(sent), f"{kinds}, lang_pred string, score double").drop("text")


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; an id that is null counts as held out, so that it is never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")

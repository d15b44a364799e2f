"""Line dedup over levelled sorted runs of line hashes. DataFrame operations only.

A run is a table (h1, h2, n_docs, last_doc, fresh), bucketed by the hash and sorted in each bucket: for each line key of a batch the number of documents that hold it and the
largest of their ids. A new batch is grouped by key, which deals it as the buckets are, and merge-anti-joined with the runs, none of which is shuffled again. The anti-join decides what
is inserted: a key that no run holds is inserted as fresh, so each key is fresh in one run only; a key that is known adds an update (not fresh), which no later batch reads.
The batch's rows become a run of level 0; FANOUT runs of a level are compacted into one of the next level, where updates are added to their key if it is there. So a
key is rewritten once a level, and a batch reads O(FANOUT log batches) runs. The answer takes the fresh rows, which are one for each key, and adds the updates by key.

A key is a line without [\\x20\\x09-\\x0D] at both ends and with A-Z in lower case, held as 128 bits (two XXH64 of different
seeds). Texts null or empty have one empty line. Rows of equal id count as one document; rows without an id count nowhere
and keep all lines. An empty table gives an empty result.

Lines that go are found by position, so a document's own lines are read once each, however many of them go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, packed, partitions_for

FANOUT, BATCHES, BATCH_DOCS = 2, 3, 100_000_000
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    cut = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(cut) == F.length(cut), F.lower(cut)).otherwise(F.translate(cut, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The runs, by level, as bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.scratch, self.levels = spark, fanout, Scratch(spark), []
        self.buckets = partitions_for(spark)  # as a shuffle deals, so that neither side of a merge moves

    def write(self, run: DataFrame) -> str:
        return self.scratch.bucketed(run.select("h1", "h2", "n_docs", "last_doc", "fresh"), self.buckets, "h1", "h2")

    def read(self, names: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, map(self.spark.table, names))

    def all(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """batch: h1, h2, doc: each key of each document once."""
        own = batch.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))
        if not self.all():
            self._put(0, self.write(own.withColumn("fresh", F.lit(True))))
            return
        held = self.read(self.all()).where("fresh").select("h1", "h2", F.lit(True).alias("known"))
        # The rows of the merge that meet no run are its anti-join: they're inserted. The others are updates.
        self._put(0, self.write(own.join(held.hint("merge"), ["h1", "h2"], "left").withColumn("fresh", F.col("known").isNull())))

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            rows = self.read(old).groupBy("h1", "h2")
            up = self.write(rows.agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"), F.bool_or("fresh").alias("fresh")))
            for name in old:
                self.scratch.drop_table(name)
            self._put(level + 1, up)

    def keys(self) -> DataFrame:
        """h1, h2, n_docs, last_doc: a row for each key."""
        rows = self.read(self.all())
        more = rows.where("not fresh").groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_more"), F.max("last_doc").alias("last_more"))
        total = F.col("n_docs") + F.coalesce("n_more", F.lit(0))
        return rows.where("fresh").join(more, ["h1", "h2"], "left").select("h1", "h2", total.alias("n_docs"), F.greatest("last_doc", "last_more").alias("last_doc"))


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc, t, pos, h1, h2, first: each line of min_chars or more; first: whether the row has no such line before it. docs: doc, text."""
    keys = F.transform(lines_of(F.col("text")), lambda x: line_key(x))
    lines = F.transform(keys, lambda k, i: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"), i.alias("pos"), (F.length(k) >= min_chars).alias("long")))
    in_order = docs.select("doc", F.xxhash64("text").alias("t"), F.sort_array(F.filter(lines, lambda x: x["long"])).alias("s"))
    # In order of their hashes, equal lines stand together.
    before = lambda i, c: F.get(F.col("s"), i - 1)[c]
    same = lambda x, i: F.coalesce((before(i, "h1") == x["h1"]) & (before(i, "h2") == x["h2"]), F.lit(False))
    marked = F.transform("s", lambda x, i: F.struct(x["pos"].alias("pos"), x["h1"].alias("h1"), x["h2"].alias("h2"), (~same(x, i)).alias("first")))
    return in_order.select("doc", "t", F.inline(marked))


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, batch_docs: int, batches: int) -> DataFrame:
    """doc, t (hash of the text), drop (positions): what each document loses."""
    spark = docs.sparkSession
    runs = LineRuns(spark)
    of_docs = docs.select(F.col(f"`{id_col}`").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where("doc is not null")
    n = max(batches, -(-of_docs.count() // batch_docs))
    staged = runs.scratch.write(line_rows(of_docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(n))), "batch")
    table = lambda: spark.read.schema(f"doc {dict(of_docs.dtypes)['doc']}, t long, pos int, h1 long, h2 long, first boolean, batch long").parquet(staged)
    for b in range(n):
        batch = table().where((F.col("batch") == b) & F.col("first")).select("doc", "h1", "h2")
        runs.add(batch.distinct() if _ids_repeat(docs, id_col) else batch)
    # As a table of one row a key, so that AQE can split the lines of a key that stands in very many documents.
    often = runs.scratch.keep(runs.keys().where(F.col("n_docs") >= min_docs).select("h1", "h2", "last_doc"))
    lost = table().select("doc", "t", "pos", "h1", "h2").join(often, ["h1", "h2"]).where("doc <> last_doc")
    return lost.groupBy("doc", "t").agg(F.collect_set("pos").alias("drop"))


def _ids_repeat(docs: DataFrame, id_col: str) -> bool:
    """Whether some id stands in several rows: one cheap pass over the ids, kept on the frame."""
    if not hasattr(docs, "_placelens_ids_repeat"):
        ids = docs.select(F.col(f"`{id_col}`").alias("doc")).where("doc is not null").groupBy("doc").count()
        docs._placelens_ids_repeat = bool(ids.where("count > 1").limit(1).count())
    return docs._placelens_ids_repeat


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batch_docs: int = BATCH_DOCS, batches: int = BATCHES
) -> DataFrame:
    """id, n_lines, n_dropped, kept and row (all input columns): each document without its lines whose key has min_chars
    code points or more and stands in min_docs documents or more; the document of the largest id that holds a key keeps its lines.
    The documents come in batches of batch_docs at most, in `batches` of them at least."""
    drops = repeated_lines(docs, id_col, text_col, min_chars, min_docs, batch_docs, batches)
    rows = packed(docs, id_col, text_col).withColumn("whole", F.coalesce("text", F.lit("")))
    joined = rows.join(drops, (F.col("id") == F.col("doc")) & (F.xxhash64("whole") == F.col("t")), "left")
    split = joined.select("id", "row", "whole", "drop", lines_of(F.col("whole")).alias("lines"))
    n = F.size("lines")
    stays = F.array_except(F.sequence(F.lit(0), n - 1), F.col("drop"))
    kept = F.array_join(F.transform(stays, lambda i: F.get(F.col("lines"), i)), "\n")
    dropped = F.coalesce(F.size("drop"), F.lit(0)).cast("long")
    return split.select(
        "id", n.cast("long").alias("n_lines"), F.when(F.col("drop").isNull(), 0).otherwise(dropped).alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("whole")).otherwise(kept).alias("kept"), "row",
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLE_SQL = """
with lines as (
  select doc_id, generate_subscripts(l, 1) as pos, unnest(l) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
keyed as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
often as (
  select k, max(doc_id) as last_doc from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (
  select d.doc_id, d.pos, d.line, (o.k is not null and d.doc_id <> o.last_doc) as gone
  from keyed d left join often o on d.k = o.k)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""

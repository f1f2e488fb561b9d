"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

A run is a table of line hashes with the number of documents that hold each one, bucketed by hash over as many buckets
as the session shuffles to, and sorted. Documents come in batches. Each batch merge-anti-joins the settled lines of the
runs (known to be frequent, they need no more counting), and adds its own run at level 0; two runs of a level are merged
into one of the next level by a full outer merge join over their common buckets, without a shuffle, and the two go.
A store outlives one call: `LineRuns.add` takes further batches until `frequent` closes it.

Scale: a text is split and hashed once; the hashes (16 bytes of entropy a line, zstd) go to the shared folder by batch.
Counting combines before the shuffle, so a line in a third of all documents is one row per task. Settled lines meet the
documents' lines in a shuffled inner join whose document side adaptive execution can split. Only documents' positions
travel; the text is shuffled once, to the positions it loses. Nothing is broadcast or collected.

Defined cases: a null or empty text is one empty line; every row is a document of its own, repeated rows included; a key
shorter than `min_chars` is never dropped; ties do not arise, except that with `keep_first` the first document is the
one in the earliest batch with the smallest id (null last), and it keeps all its copies; columns of any other name pass
through (one called as the result is replaced), an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common as c
from larkspur.session import work_dir

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 1, 10
BATCHES = 4


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(text: Column, min_chars: int) -> Column:
    """MD5 of every line's key in order, null for keys that are too short."""
    def one(line: Column) -> Column:
        key = F.btrim(line, F.lit(BLANKS))
        return F.when(F.length(key) >= min_chars, F.md5(key))

    return F.transform(lines(F.translate(text, c.UPPER, c.LOWER)), one)


class LineRuns:
    """Levels of sorted runs in the shared folder.

    A run holds h and n, and the columns `batch` and `id` of the first document where batches bring them. Its rows with
    n >= min_docs are settled: later batches leave these lines out. They stay in the run and are merged with it, so they
    are levelled and compacted like the others, and a line is settled once.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, buckets: int | None = None):
        self.spark, self.min_docs = spark, min_docs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, str] = {}

    def _write(self, df: DataFrame) -> str:
        name = f"larkspur_run_{uuid.uuid4().hex}"
        (df.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h")
         .option("path", f"{work_dir(self.spark, 'lines')}/{name}").saveAsTable(name))
        return name

    def _forget(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {name}")

    def add(self, batch: DataFrame) -> None:
        """A row for each line hash of the batch, later than all that were added before."""
        for name in self.levels.values():
            batch = batch.join(self.spark.table(name).where(F.col("n") >= self.min_docs).select("h"), "h", "left_anti")
        run, level = self._write(batch), 0
        while level in self.levels:
            run, level = self._merge(self.levels.pop(level), run), level + 1
        self.levels[level] = run

    def _merge(self, earlier: str, later: str) -> str:
        x, y = self.spark.table(earlier).alias("x"), self.spark.table(later).alias("y")
        first = [F.when(F.col("x.h").isNull(), F.col(f"y.{k}")).otherwise(F.col(f"x.{k}")).alias(k) for k in self.spark.table(earlier).columns if k not in ("h", "n")]
        both = (x.join(y, F.col("x.h") == F.col("y.h"), "full_outer")
                .select(F.coalesce("x.h", "y.h").alias("h"), (F.coalesce("x.n", F.lit(0)) + F.coalesce("y.n", F.lit(0))).alias("n"), *first))
        merged = self._write(both)
        self._forget(earlier, later)
        return merged

    def frequent(self) -> DataFrame:
        """Every line in at least `min_docs` documents, written out; n as of the batch that settled it. The runs go."""
        while len(self.levels) > 1:
            low, high = sorted(self.levels)[:2]
            self.levels[high] = self._merge(self.levels.pop(high), self.levels.pop(low))
        last = self.levels.popitem()[1]
        found = c.materialize(self.spark.table(last).where(F.col("n") >= self.min_docs), "frequent")
        self._forget(last)
        return found


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                keep_first: bool = False, batches: int = BATCHES, buckets: int | None = None, into: str = "line_dedup") -> DataFrame:
    """The documents with columns n_lines, n_dropped and kept (the text that stays) added under a struct named `into`."""
    spark = docs.sparkSession
    keys = c.row_key(id_col, text_col)
    batch = F.pmod(F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col)), F.lit(batches)).cast("int")
    path = f"{work_dir(spark, 'line-hashes')}-{uuid.uuid4().hex[:8]}"
    hashed = docs.select(*keys, F.col(id_col).alias("id"), line_hashes(F.col(text_col), min_chars).alias("hashes"), batch.alias("batch"))
    hashed.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    staged = spark.read.schema(hashed.schema).parquet(path)
    runs = LineRuns(spark, min_docs, buckets)
    first = [F.first("batch").alias("batch"), F.min("id").alias("id")] if keep_first else []
    for b in range(batches):
        own = staged.where(F.col("batch") == b).select("batch", "id", F.explode(F.array_distinct("hashes")).alias("h")).where(F.col("h").isNotNull())
        runs.add(own.groupBy(F.unhex("h").alias("h")).agg(F.count("*").alias("n"), *first))
    frequent = runs.frequent()  # a plain table: both sides of the next join can be split
    lost = staged.select("rk1", "rk2", F.col("batch").alias("own_batch"), F.col("id").alias("own_id"), F.posexplode("hashes").alias("pos", "x"))
    lost = lost.select("*", F.unhex("x").alias("h")).join(frequent, "h")
    if keep_first:
        lost = lost.where(~(F.col("own_batch").eqNullSafe(F.col("batch")) & F.col("own_id").eqNullSafe(F.col("id"))))
    dropped = lost.groupBy("rk1", "rk2").agg(F.collect_set("pos").alias("__dropped"))
    own = F.col("__row").getField(text_col)
    all_lines = lines(own)
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("__dropped"))
    kept = (F.when(F.col("__dropped").isNull(), F.coalesce(own, F.lit("")))
            .otherwise(F.array_join(F.transform(stay, lambda i: F.element_at(all_lines, i + 1)), "\n")))
    n_lost = F.when(F.col("__dropped").isNull(), 0).otherwise(F.size("__dropped"))
    result = F.struct(F.size(all_lines).cast("long").alias("n_lines"), n_lost.cast("long").alias("n_dropped"), kept.alias("kept"))
    row = F.struct(*[F.col(f"`{x}`") for x in docs.columns if x != into])
    return docs.select(row.alias("__row"), *keys).join(dropped, ["rk1", "rk2"], "left").select("__row.*", result.alias(into))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the digest of `dedup_lines` over whole documents."""
    got = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("line_dedup.kept", 256).alias("kept_sha256"))


ORACLE = f"""
with d as (select doc_id, row_number() over () r, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select r, i, ls[i] line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{c.UPPER}', '{c.LOWER}') k
      from (select r, ls, unnest(range(1, len(ls) + 1)) i from d)),
f as (select k from l where length(k) >= 1 group by k having count(distinct r) >= 10),
g as (select r, count(*) filter (where f.k is not null) n_dropped, string_agg(line, chr(10) order by i) filter (where f.k is null) kept
      from l left join f using (k) group by r)
select doc_id, len(ls)::bigint n_lines, n_dropped, sha256(coalesce(kept, '')) kept_sha256 from d join g using (r)
"""

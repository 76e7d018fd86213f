"""Sharding (8): a two-pass external shuffle, in SQL functions only.

First pass: a seeded hash scatters the records uniformly into buckets that fit in memory. Second pass: each bucket is
gathered and brought into Fisher-Yates order, with swaps drawn from a hash of seed, bucket and place; then the records of
all buckets, in order, go round the shards. Shard sizes in rows differ by one at most. The places are a function of the
rows, the seed and the bucket sizes alone: not of partitions, files or the order in which tasks deliver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import cut

SEED = 20240611
#: Records and bytes of records that a bucket holds on average, at most.
BUCKET_ROWS, BUCKET_BYTES = 1024, 16 << 20
#: Bytes of records in a task of the second pass, on average; it decides how fast, not where.
TASK_BYTES = 64 << 20
#: Buckets that are added up in one window; their sums, fewer by this factor, are added up in another.
SPAN = 4096
#: Repeated records up to this number are told apart by a broadcast, more by a shuffle; copies dealt by one task.
BROADCAST_REPEATED, DEALT_AT_ONCE = 1_000_000, 10_000


def _bytes(text_col: str) -> Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1


def _digests(docs: DataFrame) -> list[Column]:
    """h1, h2: 128 bits of a whole row; nulls count by their column."""
    plain = lambda f: not any(x in f.dataType.simpleString() for x in ("map<", "variant"))
    cells = [F.col(f"`{f.name}`") if plain(f) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in docs.schema.fields]
    marked = [x for c in cells for x in (c, c.isNull())]
    return [F.xxhash64(F.lit(i), *marked).alias(f"h{i}") for i in (1, 2)]


def fisher_yates(n: Column, *seed: Column) -> Column:
    """The numbers 0 to n - 1 in an order drawn by hashes of seed: from the last place down, each swaps with one not after it."""

    def swap(a: Column, i: Column) -> Column:
        def of(j: Column) -> Column:
            upto, after = F.slice(a, F.lit(1), j), F.slice(a, i + 2, F.greatest(n - i - 1, F.lit(0)))
            between = F.slice(a, j + 2, F.greatest(i - j - 1, F.lit(0)))
            return F.when(i == j, a).otherwise(F.concat(upto, F.array(F.get(a, i)), between, F.array(F.get(a, j)), after))

        return F.transform(F.array(F.pmod(F.xxhash64(*seed, i), i + 1).cast("int")), of)[0]

    places = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.sequence(F.lit(0), n - 1), swap)


def shard(docs: DataFrame, shards: int = 16, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (gapless from 0 in each shard), in shuffled order.

    Every row is placed once: null ids and null texts too. Rows equal in all columns are numbered and spread like all
    others, so that no value can fill a bucket. Columns named shard or slot are replaced; id_col is not read by itself.
    An empty table gives an empty table. The same rows get the same places under any partitions.
    """
    if shards < 1 or bucket_bytes < 1 or bucket_rows < 1:
        raise ValueError("shards, bucket_bytes and bucket_rows must be positive")
    docs = docs.drop("shard", "slot")
    spark = docs.sparkSession
    h, record = ["h1", "h2"], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")
    marks = cut(docs.select(*_digests(docs), _bytes(text_col).alias("size")), "marks")
    sums = marks.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    buckets = max(sums["bytes"] // bucket_bytes, sums["rows"] // bucket_rows) + 1
    bucket = F.pmod(F.xxhash64("h1", "h2", "copy", F.lit(seed)), F.lit(buckets)).alias("bucket")

    def dealt(groups: DataFrame, columns: list[str]) -> DataFrame:
        """A row for each of `copies`, numbered by copy, in pieces that different tasks can deal."""
        piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / DEALT_AT_ONCE)))
        pieces = groups.select(*columns, "before", "copies", piece.alias("piece")).repartition(*h, "piece")
        first = F.col("piece") * DEALT_AT_ONCE
        number = F.explode(F.sequence(first, F.least(first + DEALT_AT_ONCE, F.col("copies")) - 1))
        return pieces.select(*columns, "before", number.alias("copy")).select(*columns, (F.col("before") + F.col("copy")).alias("copy"))

    again = cut(marks.groupBy(*h).agg(F.count("*").alias("copies")).where("copies > 1"), "again")
    repeated = again.count()
    rows = docs.select(*_digests(docs), record)
    single, placed = marks.select(*h, F.lit(0).cast("long").alias("copy")), rows.withColumn("copy", F.lit(0).cast("long"))
    if repeated:
        known = F.broadcast(again) if repeated <= BROADCAST_REPEATED else again
        single = single.join(known, h, "left_anti").unionByName(dealt(again.withColumn("before", F.lit(0).cast("long")), h))
        # equal digests are equal rows, up to nulls within nested values: those share the numbers of their digest
        groups = rows.join(known, h, "left_semi").groupBy(*h, "r").agg(F.count("*").alias("copies"))
        before = F.coalesce(F.sum("copies").over(Window.partitionBy(*h).orderBy(F.to_json("r")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = placed.join(known, h, "left_anti").unionByName(dealt(groups.withColumn("before", before), [*h, "r"]))

    # where each bucket begins
    counts = cut(single.groupBy(bucket).agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("bucket") / SPAN)), "counts")
    spans = counts.groupBy("span").agg(F.sum("n").alias("n"))
    so_far = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("span", so_far(Window.orderBy("span")).alias("base"))
    begins = counts.join(spans, "span").select("bucket", (F.col("base") + so_far(Window.partitionBy("span").orderBy("bucket"))).alias("begin"))

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sums["bytes"] // TASK_BYTES + 1)
    scattered = placed.select(bucket, F.struct(*h, "copy", "r").alias("record")).repartition(tasks, "bucket")
    gathered = scattered.groupBy("bucket").agg(F.collect_list("record").alias("records"))
    fields = (*h, "copy")
    less, more = F.lit(-1), F.lit(1)

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for f in reversed(fields):
            out = F.when(a[f] < b[f], less).when(a[f] > b[f], more).otherwise(out)
        return out

    ordered = gathered.select("bucket", F.array_sort("records", compare).alias("records"), fisher_yates(F.size("records"), F.lit(seed), F.col("bucket")).alias("order"))
    each = ordered.join(begins, "bucket").select("begin", F.posexplode(F.transform("order", lambda i: F.get(F.col("records"), i))).alias("at", "x"))
    place = F.col("begin") + F.col("at")
    return each.select("x.r.*", (place % shards).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; slot gives the order in it."""
    sharded.write.partitionBy("shard").parquet(path)

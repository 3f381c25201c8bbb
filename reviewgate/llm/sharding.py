"""Proportional stratified interleaving into shards (operator 1), in built-in functions alone.

Within each source, rows are ranked in a seeded shuffled order; a row's fractional rank is
its place in its own source between 0 and 1. All rows are sorted by it and cut into equal
runs. A run of fractional ranks holds the same share of every source, so every shard has the
mixture of the whole. Counts differ by one row at most (law ``rows``).

No rank is computed over an undivided key: the shuffle key's leading bits cut each source,
and the fractional rank cuts the whole, into buckets of about ``bucket_rows`` rows. Bucket
counts are small tables whose running sums give each bucket's first rank. Only id, source,
size and checksum are ever shuffled; the text is read once.

Cases: a null source is a stratum of its own; a null text has size 1 and checksum 0, as an
empty one; rows that tie in the shuffle (equal or null ids) are ordered by id, checksum and
size, and rows equal in all of these are alike in the result; copies are rows like others and
may go to different shards; fewer rows than shards leave shards empty; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewgate.session import materialise

SHARDS = 16
SEED = "shard:0:"
BUCKET_ROWS = 200_000
#: Bits of the shuffle key that are used.
KEY_BITS = 60


def shuffle_key(key: Column, seed: str = SEED) -> Column:
    """A seeded 60-bit number of an id."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def _first_ranks(counts: DataFrame, within: list[str], by: str) -> DataFrame:
    """Rows before each bucket, and in all, from the buckets' counts."""
    ordered = Window.partitionBy(*within).orderBy(by)
    return counts.withColumns(
        {
            "before": F.sum("n").over(ordered) - F.col("n"),
            "of": F.sum("n").over(Window.partitionBy(*within)),
        }
    ).drop("n")


def interleaved(
    docs: DataFrame,
    shards: int = SHARDS,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: str = SEED,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Key, ``size``, ``text_crc32``, ``shard`` and ``slot`` (place in the shard, from 0)."""
    value = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    n_rows = docs.select(key).count()
    bits = max(0, -(-n_rows // bucket_rows) - 1).bit_length()
    stratum = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    shuffled = shuffle_key(F.col(key), seed)

    def bucketed(columns: list[Column]) -> DataFrame:
        return docs.select(
            *columns, stratum.alias("stratum"), shuffled.alias("shuffled")
        ).withColumn("cell", F.shiftright("shuffled", KEY_BITS - bits))

    cells = bucketed([]).groupBy("stratum", "cell").agg(F.count("*").alias("n"))
    first = _first_ranks(cells, ["stratum"], "cell")
    rows = bucketed(
        [
            F.col(key).alias("id"),
            (F.octet_length(value) + 1).cast("long").alias("size"),
            F.crc32(value).alias("text_crc32"),
        ]
    )
    in_cell = Window.partitionBy("stratum", "cell").orderBy(
        "shuffled", "id", "text_crc32", "size"
    )
    ranked = (
        rows.withColumn("rank", F.row_number().over(in_cell))
        .join(first, ["stratum", "cell"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .withColumn(
            "fraction",
            (2 * F.col("rank") - 1).cast("double") / (2 * F.col("of")).cast("double"),
        )
        .withColumn("part", F.floor(F.col("fraction") * (1 << bits)))
        .select("id", "size", "text_crc32", "stratum", "rank", "fraction", "part")
    )
    ranked = materialise(ranked, "stratified")
    parts = ranked.groupBy("part").agg(F.count("*").alias("n"))
    first = _first_ranks(parts.withColumn("all", F.lit(0)), ["all"], "part").drop("all")
    in_part = Window.partitionBy("part").orderBy("fraction", "stratum", "rank")
    placed = (
        ranked.withColumn("at", F.row_number().over(in_part) - 1)
        .join(first, "part")
        .withColumn("at", F.col("at") + F.col("before"))
    )
    shard = F.expr(f"at * {shards} div of")
    begin = F.expr(f"(shard * of + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(
        F.col("id").alias(key),
        "size",
        "text_crc32",
        F.col("shard").cast("int").alias("shard"),
        (F.col("at") - begin).cast("long").alias("slot"),
    )

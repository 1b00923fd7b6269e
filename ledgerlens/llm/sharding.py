"""Sharding by proportional stratified interleaving, so that every shard has the mixture of the whole.

Rows of each source are ranked in a seeded shuffle. A row's fractional rank is its rank over its source's
size; sorted by fractional rank, every stretch of the order holds every source in proportion, and equal cuts
of that order are the shards. No source is sorted in one task: both ranks come from counts of hash ranges
and a row number inside each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, parts_for, whole

SEED = "shards-1"
SHARDS = 24
ROWS_PER_RANGE = 2_000
#: One task adds up the ranges, so their number is bounded; beyond it each holds more rows.
MOST_RANGES = 50_000


def proportional_shards(
    docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", source_col: str = "source", tie: str | None = None, seed: str = SEED, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """docs with shard (int, from 0) and slot (long, gapless from 0 in each shard); counts are at most one apart.

    The order depends on seed, id and tie (a column that tells rows of one id apart) alone. A null source is a
    source of its own; a null id is an id of its own. Repeated rows take slots each. Columns of the input named
    shard or slot are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("shard", "slot")
    n = docs.count()
    ranges = min(MOST_RANGES, parts_for(n, rows_per_range))
    tie_break = [F.col(tie).cast("string")] if tie else []
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), *tie_break)).alias("key")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, whole(F.col(source_col)).alias("src"), F.col(source_col).isNull().alias("none"), F.col(id_col).alias("id"), key)
    rows = rows.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges, 32))
    keys = ["src", "none", "range"]
    by_source = Window.partitionBy("src", "none")
    before = F.sum("n").over(by_source.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, before.alias("before"), F.sum("n").over(by_source).alias("of"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("key", F.col("id").asc_nulls_last())) + F.col("before")
    part = ((rank - 0.5) / F.col("of")).alias("part")
    ranked = rows.join(counts, keys).select("row", "src", "none", "id", "key", part)

    # the same once more, over all rows: a range of fractional ranks holds as many rows as any other
    ranked = ranked.withColumn("cut", F.floor(F.col("part") * ranges).cast("long"))
    cuts = ranked.groupBy("cut").agg(F.count(F.lit(1)).alias("n"))
    start = F.sum("n").over(Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    cuts = cuts.select("cut", start.alias("start"))
    place = F.row_number().over(Window.partitionBy("cut").orderBy("part", "key", "none", "src", F.col("id").asc_nulls_last())) - 1 + F.col("start")
    placed = ranked.join(cuts, "cut").withColumn("place", place.cast("long"))
    placed = placed.withColumn("shard", F.expr(f"cast((place * {n_shards}L) div {max(n, 1)}L as int)"))
    slot = F.expr(f"place - (cast(shard as bigint) * {n}L + {n_shards - 1}L) div {n_shards}L")
    return placed.select("row.*", "shard", slot.alias("slot"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """Law rows: the counts of the 24 shards are at most one apart."""
    text = F.col("text")
    rows = documents(spark, sf_dir).select("doc_id", "source", F.octet_length(whole(text)).cast("long").alias("b"), F.crc32(whole(text).cast("binary")).alias("text_crc32"))
    out = proportional_shards(rows, tie="text_crc32")
    return out.select("doc_id", (F.col("b") + 8).alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc32_sql(text: str) -> tuple[str, str]:
    """CRC-32 of a text's UTF-8 bytes in DuckDB, given the table crc_table; and that table, which follows from the polynomial."""
    entry = "c"
    for _ in range(8):
        entry = f"list_transform([{entry}], lambda v: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)[1]"
    table = f"(SELECT list_transform(range(0, 256), lambda c: {entry}))"
    octets = f"list_transform(regexp_extract_all(lower(hex(encode({text}))), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: xor(a >> 8, crc_table[(xor(a, b) & 255) + 1])), 4294967295)", table


_CRC, _CRC_TABLE = _crc32_sql("t")
OP8_SQL = f"""
WITH tab AS (SELECT {_CRC_TABLE} AS crc_table),
d AS (SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS none, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, src, none, strlen(t) + 8 AS size, {_CRC} AS text_crc32 FROM d, tab),
k AS (SELECT *, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || text_crc32) AS key FROM c),
r AS (SELECT *, (row_number() OVER (PARTITION BY src, none ORDER BY key, doc_id NULLS LAST) - 0.5::DOUBLE) / (count(*) OVER (PARTITION BY src, none)) AS part FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY part, key, none, src, doc_id NULLS LAST) - 1 AS place, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * {SHARDS} // n AS INT) AS shard, place - (place * {SHARDS} // n * n + {SHARDS - 1}) // {SHARDS} AS slot, CAST(NULL AS INT) AS grown_shard FROM p
"""

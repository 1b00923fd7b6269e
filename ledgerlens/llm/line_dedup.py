"""Line dedup over content-defined chunks of lines.

A chunk of lines ends where a rolling hash over the last WINDOW line hashes is 0 modulo ONE_IN, so the borders
follow the content: lines put in before a passage do not move the borders inside it. What is compared are pieces of
chunks: the whole chunk, and its first and last 1 to EDGE lines where these begin or end at such a border, so that a
repeated passage is found though it begins or ends inside a chunk. A piece of several lines, or of LEAST_WORDS words
or more, that stands in several places of the corpus is removed everywhere but in its first place, after comparison
of its bytes. Every removed line so stands in an earlier place still.

All is DataFrame expressions. Rows are told apart by doc_id and a hash of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, documents, forgotten, whole, written

WINDOW = 2
ONE_IN = 2
EDGE = 4
LEAST_WORDS = 4


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long")


def _rolled(hashes: Column, i: Column) -> Column:
    """Of the lines i-WINDOW+1 .. i (from 1): a cyclic polynomial, each older line's hash shifted one bit further."""
    out = F.element_at(hashes, i)
    for k in range(1, WINDOW):
        older = F.element_at(hashes, F.greatest(i - k, F.lit(1)))
        turned = F.shiftleft(older.bitwiseAND(F.lit((1 << (60 - k)) - 1)), k).bitwiseOR(F.shiftrightunsigned(older, 60 - k))
        out = out.bitwiseXOR(F.when(i > k, turned).otherwise(F.lit(0).cast("long")))
    return out


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def with_chunks(docs: DataFrame) -> DataFrame:
    """docs (text, ...) with lines and ends, the line numbers (from 1) at which chunks end; a text without '\\n' is one line."""
    out = docs.withColumn("lines", _lines(F.col("text")))
    out = out.withColumn("hashes", F.transform("lines", _line_hash))
    n = F.size("lines")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (_rolled(F.col("hashes"), i) % ONE_IN == 0))
    return out.withColumn("ends", ends).drop("hashes")


def _piece(lines: Column, b: Column, e: Column) -> Column:
    return F.array_join(F.slice(lines, b + 1, e - b), "\n")


def pieces(docs: DataFrame) -> DataFrame:
    """(id, th, b, e, hash) from (id, th, text): the pieces that may be removed, lines b to e - 1 from 0, with their hash."""
    some = with_chunks(docs.select("id", "th", "text"))
    n = F.size("lines")
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.col("ends")[F.greatest(k - 1, F.lit(0))])

    def of_chunk(e: Column, k: Column) -> Column:
        b = begin(k)
        sizes = F.sequence(F.lit(1), F.least(F.lit(EDGE), e - b))
        none = F.slice(F.array(F.struct(b.alias("b"), e.alias("e"))), 1, 0)
        last = F.when(e < n, F.transform(sizes, lambda m: F.struct((e - m).alias("b"), e.alias("e")))).otherwise(none)
        first = F.when(b > 0, F.transform(sizes, lambda m: F.struct(b.alias("b"), (b + m).alias("e")))).otherwise(none)
        return F.concat(F.array(F.struct(b.alias("b"), e.alias("e"))), last, first)

    some = some.withColumn("ranges", F.array_distinct(F.flatten(F.transform("ends", of_chunk))))

    def hashed(r: Column) -> Column:
        text = _piece(F.col("lines"), r["b"], r["e"])
        words = F.regexp_count(text, F.lit(WORD))
        counts = (words >= LEAST_WORDS) | ((r["e"] - r["b"] >= 2) & (words >= 1))
        return F.struct(r["b"].alias("b"), r["e"].alias("e"), F.when(counts, F.xxhash64(text)).alias("hash"))

    # outer, lest Catalyst infers a filter on the array and computes it twice, and nested in itself
    out = some.select("id", "th", F.explode_outer(F.transform("ranges", hashed)).alias("p"))
    return out.filter(F.col("p.hash").isNotNull()).select("id", "th", "p.b", "p.e", "p.hash")


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("nameless"), F.col("id").alias("id"), F.col("b").alias("b"))


def _same_row(key: str, th: str) -> Column:
    return F.col("id").eqNullSafe(F.col(key)) & (F.col("th") == F.col(th))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(g_id, g_th, gone): for each row (id, th, text) that loses some, the numbers of its lines, from 0.

    None of the tables joined here has a bound, so none is broadcast, small as it may be.
    """
    several = (F.min(_place()) != F.max(_place())).alias("several")
    all_ = written(pieces(docs), "lines-pieces")
    twice = all_.groupBy("hash").agg(several).filter("several").select("hash")
    own = all_.join(twice.hint("merge"), "hash", "left_semi").groupBy(F.col("id").alias("p_id"), F.col("th").alias("p_th")).agg(F.collect_set(F.struct("b", "e", "hash")).alias("ps"))
    texts = docs.join(own.hint("merge"), _same_row("p_id", "p_th")).withColumn("lines", _lines(F.col("text")))
    with_text = F.transform("ps", lambda p: F.struct(p["b"].alias("b"), p["e"].alias("e"), p["hash"].alias("hash"), _piece(F.col("lines"), p["b"], p["e"]).alias("text")))
    again = written(texts.select("id", "th", F.explode_outer(with_text).alias("p")).select("id", "th", "p.*"), "lines-repeated")
    # grouping by the text itself compares bytes; a hot piece is summed up before it is shuffled
    first = again.groupBy("hash", "text").agg(F.min(_place()).alias("first"), several).filter("several")
    first = written(first.select(F.col("hash").alias("f_hash"), F.col("text").alias("f_text"), "first"), "lines-first")
    late = again.join(first.hint("merge"), (F.col("hash") == F.col("f_hash")) & (F.col("text") == F.col("f_text")) & (_place() != F.col("first")))
    ranges = late.groupBy(F.col("id").alias("g_id"), F.col("th").alias("g_th")).agg(F.collect_set(F.struct("b", "e")).alias("r"))
    gone = F.array_distinct(F.flatten(F.transform("r", lambda r: F.sequence(r["b"], r["e"] - 1))))
    out = written(ranges.select("g_id", "g_th", gone.alias("gone")), "lines-gone")
    for table in (all_, again, first):
        forgotten(table)
    return out


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with its text without the repeated pieces, and n_lines, n_removed (lines), n_chunks, n_spans (runs of removed lines).

    The first place is that of the smallest doc_id (null last), then the first in the document. A piece at the same
    place of rows that share a doc_id is not repeated; such rows are cut each by its own text. Null texts stay null,
    with no line removed. Columns named like the added ones are replaced; others ride along, whatever their names.
    """
    own = ["n_lines", "n_removed", "n_chunks", "n_spans"]
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", *own)]
    text = whole(F.col("text"))
    keyed = [F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text")]
    gone = removed_lines(docs.select(*keyed))
    rows = docs.select(F.struct(*rest).alias("row"), F.col("text").isNull().alias("is_null"), *keyed)
    rows = with_chunks(rows.join(gone.hint("merge"), _same_row("g_id", "g_th"), "left"))
    gone_lines = F.coalesce("gone", F.expr("cast(array() as array<int>)"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone_lines)
    new = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n"))
    spans = F.size(F.array_except(gone_lines, F.transform(gone_lines, lambda g: g + 1)))
    counts = [F.size("lines"), F.size(gone_lines), F.size("ends"), spans]
    return rows.select("row.*", F.when(~F.col("is_null"), new).alias("text"), *[x.cast("long").alias(k) for x, k in zip(counts, own, strict=True)])


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    text = whole(F.col("text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_chunks", "n_spans", F.length(text).cast("long").alias("kept_chars"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i, len(lines) AS n FROM d),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 15))::BIGINT AS h FROM l),
r AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY row ORDER BY i), 0) AS p FROM h),
e AS (SELECT *, i = n OR xor(h, ((p & {(1 << 59) - 1}) * 2) | (p >> 59)) % {ONE_IN} = 0 AS ends FROM r),
k AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e),
c AS (SELECT row, n, k, min(i) - 1 AS b, max(i) AS e FROM k GROUP BY row, n, k),
m AS (SELECT unnest(range(1, {EDGE} + 1)) AS m),
p AS (
  SELECT row, b, e FROM c
  UNION SELECT row, e - m, e FROM c, m WHERE e < n AND m <= e - b
  UNION SELECT row, b, b + m FROM c, m WHERE b > 0 AND m <= e - b),
t AS (SELECT p.row, d.doc_id, p.b, p.e, array_to_string(d.lines[p.b + 1:p.e], chr(10)) AS text FROM p JOIN d ON p.row = d.row),
w AS (SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM t),
f AS (
  SELECT *, (dense_rank() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST, b)) > 1 AS gone
  FROM w WHERE words >= {LEAST_WORDS} OR (e - b >= 2 AND words >= 1)),
x AS (SELECT DISTINCT row, unnest(range(b + 1, e + 1)) AS i FROM f WHERE gone),
y AS (SELECT l.row, l.doc_id, l.line, l.i, x.i IS NOT NULL AS gone FROM l LEFT JOIN x ON l.row = x.row AND l.i = x.i),
z AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY row ORDER BY i), false) AS begins FROM y),
o AS (
  SELECT row, doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept
  FROM z GROUP BY row, doc_id),
s AS (SELECT row, count(*) AS n_chunks FROM c GROUP BY row)
SELECT doc_id, n_lines, n_removed, n_chunks, n_spans, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM o JOIN s ON o.row = s.row
"""

"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target/size ratio c is wanted c times: floor(c) copies are sure, the fraction is
rounded. Rounding goes pair by pair: two fractional documents exchange mass, at random but keeping the sum of
size x fraction, until one of them is 0 or 1. So each source's words stay at its target up to the size of the
one document left over. Documents are dealt into groups of about FAN by a hash, each group folds itself down to
one residual, and residuals go up a tree of groups until one is left for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, n_words, whole, written

SEED = 7
FAN = 64
MOST = 3
#: Equal rows that one task numbers.
BLOCK = 1 << 16


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size).

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ...; they share the sum of all sizes by weight, a
    target stopping at most x its source's size. The level at which the others are filled follows in closed form
    from the order of size / weight: the first place at which the next source would not be stopped. Later places
    give lower levels, hence the maximum.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    weight = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1
    s = by_source.withColumn("w", weight).withColumn("full_at", most * F.col("source_size") / F.col("w"))
    everything = Window.partitionBy()
    upto = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumns({"total": F.sum("source_size").over(everything), "weights": F.sum("w").over(everything), "full_size": F.sum("source_size").over(upto) * most, "full_w": F.sum("w").over(upto)})
    # the level if this source and all that fill up earlier share what the sources before it left over
    level = (F.col("total") - (F.col("full_size") - most * F.col("source_size"))) / (F.col("weights") - (F.col("full_w") - F.col("w")))
    s = s.withColumn("level", F.max(F.when(level <= F.col("full_at"), level)).over(everything))
    cap = (most * F.col("source_size")).cast("double")
    target = F.when(F.col("level").isNull(), cap).otherwise(F.least(F.col("level") * F.col("w"), cap))
    return s.select("source", "source_size", "n_docs", target.alias("target"))


def _unit(*of: Column) -> Column:
    """A number in [0, 1) from a hash of the arguments."""
    return F.pmod(F.xxhash64(F.lit(SEED), *of), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _fold(state: Column, x: Column, level: int) -> Column:
    """One exchange between the residual so far (state.cur) and the next document x; decides one of the two."""
    cur, done = state["cur"], state["done"]
    p, q = cur["p"], x["p"]
    a, b = cur["size"].cast("double"), x["size"].cast("double")
    rise, fall = F.least(1 - p, q * b / a), F.least(p, (1 - q) * b / a)
    up = (rise + fall == 0) | (_unit(F.lit(level), cur["key"], x["key"]) * (rise + fall) < fall)

    def keep(one: Column, mass: Column) -> Column:
        return one.withField("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), mass)))

    def step(left: Column, decided: Column, is_one: int) -> Column:
        return F.struct(left.alias("cur"), F.concat(done, F.array(decided.withField("p", F.lit(float(is_one))))).alias("done"))

    return (
        F.when(cur.isNull(), F.struct(x.alias("cur"), done.alias("done")))
        .when(up & (1 - p <= q * b / a), step(keep(x, q - (1 - p) * a / b), cur, 1))
        .when(up, step(keep(cur, p + q * b / a), x, 0))
        .when(p <= (1 - q) * b / a, step(keep(x, q + p * a / b), cur, 0))
        .otherwise(step(keep(cur, p - (1 - q) * b / a), x, 1))
    )


_UNIT = "struct<key:bigint,doc_id:bigint,size:bigint,sure:bigint,p:double>"


def _round_level(units: DataFrame, level: int) -> DataFrame:
    """units (source, target, source_size, grp, unit) folded by grp: one row each with the residual and the decided ones."""
    groups = units.groupBy("source", "source_size", "target", "grp").agg(F.array_sort(F.collect_list("unit")).alias("units"))
    start = F.struct(F.lit(None).cast(_UNIT).alias("cur"), F.expr(f"cast(array() as array<{_UNIT}>)").alias("done"))
    folded = F.aggregate("units", start, lambda s, x: _fold(s, x, level))
    return groups.select("source", "source_size", "target", "grp", folded.alias("f"))


def _numbered(counted: DataFrame) -> DataFrame:
    """Each row of counted (…, count) so often, with rep from 1. Rows of very many are dealt out in blocks first, so that
    no array nor task holds them all."""
    rest = [c for c in counted.columns if c != "count"]
    upto = lambda a, b: F.explode(F.sequence(a, b)).alias("rep")
    one = F.lit(1).cast("long")
    few = counted.filter(F.col("count") <= BLOCK).select(*rest, upto(one, F.col("count")))
    blocks = counted.filter(F.col("count") > BLOCK).select(*rest, "count", F.explode(F.sequence(one, F.col("count"), F.lit(BLOCK).cast("long"))).alias("begin"))
    many = blocks.repartition(*rest, "begin").select(*rest, upto(F.col("begin"), F.least(F.col("count"), F.col("begin") + BLOCK - 1)))
    return few.unionByName(many)


def mix_plan(sizes: DataFrame, most: int = MOST, fan: int = FAN) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) from rows (doc_id, source, size), one for each row.

    Reruns agree: chance comes from hashes of doc_id, source, size and a repetition's number. Documents without
    words, and sources without, get no copies. No row is taken more than most times.
    """
    sizes = written(sizes.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("size").cast("long")), "mix-sizes")
    targets = written(source_targets(sizes, most), "mix-targets")
    largest = targets.agg(F.max("n_docs")).head()[0] or 0
    # equal rows become one row with a count first, so that a hot id does not gather anywhere
    rows = _numbered(sizes.groupBy("doc_id", "source", "size").count())
    t = targets.withColumnRenamed("source", "t_source")
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    sure = F.floor(ratio).cast("long")
    key = F.xxhash64(F.lit(SEED), "doc_id", "source", "size", "rep")
    unit = F.struct(key.alias("key"), F.col("doc_id"), F.col("size"), sure.alias("sure"), (ratio - sure).alias("p"))
    n_groups = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_docs") / fan))
    rows = rows.withColumn("unit", unit)
    grp = F.least(n_groups - 1, F.floor(_unit(F.col("unit.key")) * n_groups)).cast("long")
    rows = rows.withColumn("grp", grp).drop("n_docs", "doc_id", "size", "rep")
    is_open = (F.col("unit.p") > 0) & (F.col("unit.size") > 0)
    done = [rows.filter(~is_open).select("source", "source_size", "target", F.col("unit").alias("u"))]
    level, groups, units = 0, max(1, -(-largest // fan)), rows.filter(is_open)
    while True:
        level_out = written(_round_level(units, level), f"mix-level{level}")
        done.append(level_out.select("source", "source_size", "target", F.explode("f.done").alias("u")))
        units = level_out.select("source", "source_size", "target", F.floor(F.col("grp") / fan).cast("long").alias("grp"), F.col("f.cur").alias("unit"))
        if groups == 1:
            break
        level, groups = level + 1, -(-groups // fan)
    last = F.col("unit").withField("p", (_unit(F.lit(-1), F.col("unit.key")) < F.col("unit.p")).cast("double"))
    done.append(units.select("source", "source_size", "target", last.alias("u")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = F.when(F.col("u.size") > 0, F.col("u.sure") + F.col("u.p").cast("long")).otherwise(F.lit(0).cast("long"))
    return out.select("u.doc_id", "source", "u.size", "source_size", "target", copies.alias("copies"))


def mix_documents(docs: DataFrame, most: int = MOST) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; rows that it does not take are gone.

    Null text has no words. Rows of one doc_id, source and size share the copies found for them, in order of a
    hash of their text. Columns beyond doc_id, text and source ride along, whatever their names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sized = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("src"), n_words(F.col("text")).alias("size"), F.xxhash64(whole(F.col("text"))).alias("h"))
    plan = mix_plan(sized.select(F.col("id").alias("doc_id"), F.col("src").alias("source"), "size"), most)
    plan = plan.select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), "copies")
    plan = plan.withColumn("p_rep", F.row_number().over(Window.partitionBy("p_id", "p_source", "p_size").orderBy("copies"))).filter("copies > 0")
    sized = sized.withColumn("rep", F.row_number().over(Window.partitionBy("id", "src", "size").orderBy("h")))
    same = F.col("id").eqNullSafe(F.col("p_id")) & F.col("src").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")) & (F.col("rep") == F.col("p_rep"))
    return sized.join(plan, same).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("size"))
    out = mix_plan(rows)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")

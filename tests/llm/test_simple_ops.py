"""Exact dedup, sharding and mixing against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerlens.llm import exact_dedup, mixing, sharding


def test_exact_dedup(spark, odd):
    got = exact_dedup.exact_dedup(odd.withColumns({"digest": F.lit(1), "row": F.lit(2), "maybe": F.lit(3)})).collect()
    groups = defaultdict(list)
    for r in odd.collect():
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r.text or "").encode()).hexdigest()].append(r)
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert by.keys() == groups.keys()
    for sha, rows in groups.items():
        best = min(rows, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        assert {r.keep_id for r in by[sha]} == {best.doc_id}
        assert {r.group_size for r in by[sha]} == {len(rows)}
        assert [r.doc_id for r in by[sha] if r.kept] == [best.doc_id]


def test_exact_dedup_with_a_full_filter_is_the_same(odd):
    a = exact_dedup.exact_dedup(odd).collect()
    b = exact_dedup.exact_dedup(odd, max_filter_bits=1 << 10).collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))


def test_lone_rows_do_not_shuffle(spark):
    df = spark.range(2000).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h"))
    digests = df.select(F.unhex("h").alias("digest")).unionByName(df.limit(50).select(F.unhex("h").alias("digest")))
    n = exact_dedup.repeated_marks(digests, 2050).filter("maybe").count()
    assert 100 <= n <= 150


def test_empty(nothing):
    assert exact_dedup.exact_dedup(nothing).collect() == []
    assert sharding.proportional_shards(nothing).collect() == []
    assert mixing.mix_plan(nothing.select("doc_id", "source", F.lit(1).cast("long").alias("size"))).collect() == []
    assert mixing.mix_documents(nothing).collect() == []


def test_sharding(odd):
    docs = odd.withColumns({"shard": F.lit("theirs"), "slot": F.lit(1)})
    got = sharding.proportional_shards(docs, 7, rows_per_range=10).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in odd.collect())
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    sizes = [len(shards[k]) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1
    hot = sum(r.source == "hot" for r in got) / len(got)
    for rows in shards.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert abs(sum(r.source == "hot" for r in rows) - hot * len(rows)) <= 2
    again = sharding.proportional_shards(docs.repartition(3), 7, rows_per_range=1000).collect()
    assert Counter((r.doc_id, r.shard, r.slot) for r in got if r.doc_id != 306) == Counter((r.doc_id, r.shard, r.slot) for r in again if r.doc_id != 306)


def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, out, left = sum(sizes.values()), {}, set(order)
    while left:
        share = (total - sum(out.values())) / sum(weight[s] for s in left)
        over = {s for s in left if share * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: share * weight[s] for s in left}
        out |= {s: 3 * sizes[s] for s in over}
        left -= over
    return out


def test_mixing(odd):
    sized = odd.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    got = mixing.mix_plan(sized, fan=8).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in odd.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    want = brute_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, r.size) for r in sized.collect())
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s, t in taken.items():
        assert abs(t - want[s]) <= largest[s] + 1e-6
    again = mixing.mix_plan(sized.repartition(5), fan=8).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixing_is_unbiased(spark):
    """Over many documents of one source about the fraction wanted is taken, whatever their size."""
    rows = [(i, "a", 10 + i % 7) for i in range(3000)] + [(i, "b", 10 + i % 7) for i in range(3000)]
    got = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    for size in range(10, 17):
        some = [r.copies for r in got if r.source == "a" and r.size == size]
        assert abs(sum(some) / len(some) - 2 / 3) < 0.12


def test_mix_documents_repeats_rows(odd):
    docs = odd.withColumns({"copies": F.lit("x"), "size": F.lit(0), "p_id": F.lit(0)})
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    plan = mixing.mix_plan(odd.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")))
    want = Counter()
    for r in plan.collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in want.items() if v})

"""SimHash near-dedup by tiled exact comparison: numpy exclusive-or and bit counts.

Two fingerprints at most RADIUS bits apart have population counts at most RADIUS apart, in the whole and, summed
over the parts, in any split of their bits. A tile holds the distinct fingerprints with one vector of part
counts; only tiles whose vectors lie within RADIUS of each other are compared, each such pair once, every
fingerprint of the one with every fingerprint of the other. The finer the split, the fewer comparisons; it
follows the number of fingerprints, and never changes the result. A tile with very many fingerprints is split
into chunks, and what it is compared with streams by in batches, so memory is bounded.

Tiles report links as edges to a local root, no more than fingerprints seen. Components come from alternating
large-star and small-star steps, each written to the shared folder; few edges are united by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, forgotten, whole, written

RADIUS = 2
SHINGLE = 3
SEED = 42
CHUNK = 1 << 16
#: Edges that one task may unite: 16 MB.
AT_ONCE = 1 << 20
_ROWS = 255


def bit_majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _ROWS * 256):
        bits = np.unpackbits(hashes[at : at + _ROWS * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole_rows = len(bits) // _ROWS * _ROWS
        if whole_rows:  # sums of 255 bits fit a byte
            total += np.add.reduce(bits[:whole_rows].reshape(-1, _ROWS, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += np.add.reduce(bits[whole_rows:], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    return bit_majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def segments_for(n: int) -> int:
    """Parts into which the 64 bits are split: tiles then hold some 50 thousand fingerprints at most, if bits are even."""
    return 2 if n <= 1 << 21 else 4 if n <= 1 << 28 else 8


def _steps(segments: int, base: int) -> list[int]:
    """Differences of tile numbers to visit: the vectors within RADIUS that are greater in order."""
    out = []
    for d in product(range(-RADIUS, RADIUS + 1), repeat=segments):
        if sum(map(abs, d)) <= RADIUS and (step := sum(x * base**k for k, x in enumerate(d))) > 0:
            out.append(step)
    return sorted(out)


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[i] and b[i]; a label is the least index of its class."""
    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := labels[labels], labels):
            labels[:] = further


def _links(home: np.ndarray, pops: np.ndarray, guests: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(guest index, home index) pairs within RADIUS; home is in order of pops, the counts of the low 16 bits."""
    low = np.bitwise_count(guests & np.uint64(0xFFFF)).astype(np.int64)
    order = np.argsort(low, kind="stable")
    for at in range(0, len(order), 64):
        rows = order[at : at + 64]
        lo = np.searchsorted(pops, low[rows[0]] - RADIUS, "left")
        hi = np.searchsorted(pops, low[rows[-1]] + RADIUS, "right")
        for col in range(lo, hi, 4096):
            near = np.bitwise_count(guests[rows, None] ^ home[None, col : min(hi, col + 4096)]) <= RADIUS
            if near.any():
                g, h = np.nonzero(near)
                yield rows[g], h + col


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, chunk, guest, fp) in that order: a chunk's own fingerprints, then those that visit it."""
    now, home, pops, labels, ready, edges = None, [], None, None, False, []

    def settle():
        """The chunk's own rows are all there: compare them with one another."""
        nonlocal home, pops, labels, ready
        home = np.concatenate(home) if home else np.zeros(0, np.uint64)
        low = np.bitwise_count(home & np.uint64(0xFFFF)).astype(np.int64)
        order = np.argsort(low, kind="stable")
        home, pops, labels, ready = home[order], low[order], np.arange(len(home)), True
        for g, h in _links(home, pops, home):
            unite(labels, g, h)

    def visit(guests: np.ndarray):
        first = np.full(len(guests), len(home))
        for g, h in _links(home, pops, guests):
            np.minimum.at(first, g, h)
            unite(labels, h, first[g])
        linked = first < len(home)
        if linked.any():
            edges.append((guests[linked], home[first[linked]]))

    def close():
        if now is not None:
            if not ready:
                settle()
            far = labels != np.arange(len(labels))
            if far.any():
                edges.append((home[far], home[labels[far]]))

    def flush():
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*edges, strict=True))
        edges.clear()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        tile, chunk, guest, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        fp = fp.view(np.uint64)
        cuts = np.flatnonzero((tile[1:] != tile[:-1]) | (chunk[1:] != chunk[:-1]) | (guest[1:] != guest[:-1])) + 1
        for s, e in zip([0, *cuts], [*cuts, len(tile)], strict=True):
            if s == e:
                continue
            if now != (key := (tile[s], chunk[s])):
                close()
                now, home, ready = key, [], False
            if guest[s]:
                if not ready:
                    settle()
                if len(home):
                    visit(fp[s:e])
            else:
                home.append(fp[s:e])
        if edges:
            yield flush()
    close()
    if edges:
        yield flush()


def link_edges(prints: DataFrame, n: int, segments: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect exactly those that links connect."""
    segments = segments or segments_for(n)
    width = 64 // segments
    base = width + 2 * RADIUS + 1
    part = lambda k: F.bit_count(F.col("fp").bitwiseAND(F.lit(((1 << width) - 1 << k * width) - (1 << 64 if (k + 1) * width == 64 else 0))))
    tile = sum(((part(k) + RADIUS).cast("long") * base**k for k in range(segments)), F.lit(0).cast("long"))
    tiled = prints.select("fp", tile.alias("own"))
    crowded = tiled.groupBy("own").count().filter(F.col("count") > chunk).select(F.col("own").alias("tile"), F.ceil(F.col("count") / chunk).alias("chunks"))
    steps = F.array(*[F.lit(s).cast("long") for s in [0, *_steps(segments, base)]])
    sent = tiled.select("fp", F.explode(steps).alias("step"), "own").withColumn("tile", F.col("own") + F.col("step"))
    sent = sent.join(crowded, "tile", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)).cast("long"))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    to = F.explode(F.when(F.col("step") == 0, F.sequence(mine, F.col("chunks") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    sent = sent.withColumn("mine", mine).withColumn("chunk", to)
    guest = ~((F.col("step") == 0) & (F.col("chunk") == F.col("mine")))
    sent = sent.select("tile", "chunk", guest.alias("guest"), "fp")
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return sent.repartition(parts, "tile", "chunk").sortWithinPartitions("tile", "chunk", "guest").mapInArrow(_compare, "a long, b long")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if ends:
        a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
        nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        labels = np.arange(len(nodes))
        unite(labels, places[: len(a)], places[len(a) :])
        other = labels != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[labels[other]])], ["node", "root"])


def components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(node, root) for every node of edges (a, b) but the roots; root is the least node of the component.

    Up to at_once edges are united by one task; more in distributed rounds, with the same result.
    """
    edges = written(edges.filter("a != b").distinct(), "cc-edges")
    if edges.count() <= at_once:
        out = written(edges.coalesce(1).mapInArrow(_united, "node long, root long"), "cc-roots")
        forgotten(edges)
        return out
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e"))
        before, edges = edges, written(small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).filter("a != b").distinct(), "cc-edges")
        forgotten(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
        if tuple(now) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(now)


def near_groups(docs: DataFrame, shingle: int = SHINGLE, segments: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, fp (the fingerprint as a signed long), component_id.

    Null and empty texts have fingerprint zero and link like any other. component_id is the smallest doc_id of
    the component; rows without an id count for none, and get null if no row of their component has one.
    Repeated rows repeat. An empty table gives an empty result. Columns other than doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    prints = written(rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    roots = components(link_edges(distinct.select("fp"), distinct.count(), segments, chunk))
    labelled = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    # only components of several fingerprints need a second look at their ids
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    ids = labelled.join(least, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id.

    Rows that share a doc_id are one document: of them the row with the least text hash is returned. Rows without
    an id go if a row with one is in their component, and stay otherwise.
    """
    groups = near_groups(docs, shingle)
    keep = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("keep")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64(whole(F.col("text"))).alias("h"))
    kept = rows.join(keep, F.col("id") == F.col("keep"), "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("h")))
    out = kept.filter("nth = 1").select("row.*")
    nameless = docs.filter(F.col("doc_id").isNull())
    if nameless.isEmpty():
        return out
    lone = near_groups(docs, shingle).filter("doc_id is null and component_id is null").select("fp").distinct()
    marked = nameless.select(row, F.lit(None).cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    prints = marked.mapInArrow(_with_print(shingle), T.StructType([*marked.schema.fields, T.StructField("fp", T.LongType())]))
    return out.unionByName(prints.join(lone, "fp", "left_semi").select("row.*"))


def _with_print(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            yield batch.append_column("fp", pa.array(prints.view(np.int64)))

    return run


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_groups(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

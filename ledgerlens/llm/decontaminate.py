"""Benchmark decontamination by spaced-seed hashing.

A mask selects some positions of a short stretch of words and ignores the others. Hashes of the selected words
are made at every position of every test item and every document and joined; with several masks a stretch is
found though some of its words were substituted. Each hit fixes an alignment of item and document; aligned words
are compared one by one, and the overlap counts if some WINDOW consecutive words (all, in a shorter item) agree in
SHARE of their places.

MASKS find every such overlap: tests/llm enumerate all ways to substitute a fifth of a window's words. An item
of fewer words than the longest mask is looked up by its whole sequence of words.

The test set is broadcast in blocks of a bounded size, each joined with all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, whole
from .tokens import chunks, mixed, word_hashes

MASKS = ("1111", "11101", "11011", "10111")
WINDOW = 13
SHARE = 0.8
#: Text of a block of the test set; its index takes about twelve times as much.
BLOCK_BYTES = 8 << 20
#: Hits, and compared words, that are held at a time.
PAIRS = 1 << 20


def needed(n_words: int) -> tuple[int, int]:
    """Words of the window for an item of n_words, and how many must agree."""
    w = min(WINDOW, n_words)
    return w, -(-w * 4 // 5)


def _seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the words that mask selects, for each position at which it fits."""
    n = max(0, len(tokens) - len(mask) + 1)
    out = np.full(n, np.uint64(len(mask)))
    for k in np.flatnonzero([c == "1" for c in mask]):
        out = out * np.uint64(0x9FB21C651E98DF25) + tokens[k : k + n] * np.uint64(2 * int(k) + 1)
    return mixed(out)


def masks_for(n_words: int) -> tuple[str, ...]:
    longest = max(map(len, MASKS))
    return MASKS if n_words >= longest else ("1" * n_words,)


def build_index(items: list[tuple[int | None, str | None]]) -> dict:
    """The items' words, and by mask their seeds: the distinct ones in order, and the places (item, at) in order of
    keys, which are the number of a place's seed and of the seed before it in its item (0 for none)."""
    tokens = [word_hashes([(text or "").encode()])[0] for _, text in items]
    by_mask: dict[str, list] = {}
    for i, words in enumerate(tokens):
        if len(words):
            for mask in masks_for(len(words)):
                seeds = _seeds(words, mask)
                by_mask.setdefault(mask, []).append((seeds, np.full(len(seeds), i, np.int32), np.arange(len(seeds), dtype=np.int32)))
    index = {}
    for mask, parts in by_mask.items():
        seeds, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        distinct, number = np.unique(seeds, return_inverse=True)
        before = np.append([0], number[:-1] + 1)
        before[at == 0] = 0
        keys = number.astype(np.int64) << 32 | before
        order = np.argsort(keys, kind="stable")
        bits = np.zeros(1 << 20, np.bool_)
        bits[(distinct >> np.uint64(44)).astype(np.int64)] = True
        index[mask] = (distinct, keys[order], item[order], at[order], bits)
    return {"ids": [k for k, _ in items], "tokens": tokens, "masks": index}


def _ranges(lo: np.ndarray, hi: np.ndarray, pos: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pos, place) for all places lo..hi of each pos, about PAIRS at a time."""
    n = hi - lo
    total = np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
        some = n[a:b]
        yield np.repeat(pos[a:b], some), np.repeat(lo[a:b] - (np.cumsum(some) - some), some) + np.arange(some.sum())
        a = b


def alignments(index: dict, words: np.ndarray) -> np.ndarray:
    """(item, offset) rows, distinct: where an item's first word would stand in words.

    A place that follows another hit on the same diagonal says nothing new: of a run of hits only the first is
    expanded, so repeated words in text and item do not meet each with each.
    """
    found = []
    for mask, (distinct, keys, item, at, bits) in index["masks"].items():
        here = _seeds(words, mask)
        pos = np.flatnonzero(bits[(here >> np.uint64(44)).astype(np.int64)])
        number = np.minimum(np.searchsorted(distinct, here[pos]), len(distinct) - 1)
        hit = distinct[number] == here[pos]
        pos, number = pos[hit], number[hit].astype(np.int64)
        if not len(pos):
            continue
        before = np.full(len(here) + 1, len(distinct) + 1, np.int64)  # a number that no place has
        before[pos + 1] = number + 1
        same = number << 32 | before[pos]
        lo, hi = np.searchsorted(keys, number << 32), np.searchsorted(keys, number + 1 << 32)
        known, further = np.searchsorted(keys, same), np.searchsorted(keys, same, "right")
        for a, b in ((lo, known), (further, hi)):
            some = b > a
            for p, k in _ranges(a[some], b[some], pos[some]):
                found.append(np.unique(np.stack([item[k], p - at[k]], axis=1), axis=0))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def overlap(item: np.ndarray, words: np.ndarray, begin: int, end: int, offset: int) -> tuple[int, int, int] | None:
    """The agreeing words, and the first and last place in the item of the windows that qualify; None if none does.

    The document is words[begin:end]; the item's first word is aligned with words[offset].
    """
    lo, hi = max(begin, offset), min(end, offset + len(item))
    w, least = needed(len(item))
    if hi - lo < w:
        return None
    same = np.concatenate([[0], np.cumsum(words[lo:hi] == item[lo - offset : hi - offset])])
    good = np.flatnonzero(same[w:] - same[:-w] >= least)
    if not len(good):
        return None
    return int(same[good[-1] + w] - same[good[0]]), int(good[0]) + lo - offset, int(good[-1]) + w - 1 + lo - offset


OUT = "doc_id long, item_id long, matched_words long, item_words long, first_word long, last_word long, item_first_word long"


def best_overlaps(index: dict, words: np.ndarray, begins: np.ndarray) -> dict[tuple[int, int], tuple]:
    """For each (document, item) with an overlap the best one, as (agreeing words, -first place, last place, first place
    in the item); documents are stretches of words. An alignment that reaches over a border concerns each document it touches."""
    best: dict[tuple[int, int], tuple] = {}

    def keep(d: int, item: int, hit: tuple[int, int, int, int]) -> None:
        best[d, item] = max(best.get((d, item), (-1,)), hit)

    found = alignments(index, words)
    cuts = np.append(np.flatnonzero(np.append([True], found[1:, 0] != found[:-1, 0])), len(found)) if len(found) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        item = int(found[lo, 0])
        own = index["tokens"][item]
        size, (w, least) = len(own), needed(len(own))
        for a in range(lo, hi, max(1, PAIRS // size)):
            offset = found[a : min(hi, a + max(1, PAIRS // size)), 1]
            doc = np.searchsorted(begins, offset, "right") - 1
            inside = (doc >= 0) & (offset + size <= begins[np.minimum(np.maximum(doc, 0) + 1, len(begins) - 1)])
            if inside.any():  # all alignments within one document at once
                at, d = offset[inside], doc[inside]
                same = np.zeros((len(at), size + 1), np.int32)
                np.cumsum(words[at[:, None] + np.arange(size)] == own, axis=1, out=same[:, 1:])
                good = same[:, w:] - same[:, :-w] >= least
                some = np.flatnonzero(good.any(axis=1))
                first, last = good[some].argmax(axis=1), size - w - good[some][:, ::-1].argmax(axis=1)
                n = same[some, last + w] - same[some, first]
                start = at[some] + first - begins[d[some]]
                order = np.lexsort((-first, -(at[some] + last), start, -n, d[some]))  # as max() has it
                one = order[np.append([True], np.diff(d[some][order]) != 0)[: len(order)]]
                for k in one:
                    keep(int(d[some[k]]), item, (int(n[k]), -int(start[k]), int(at[some[k]] + last[k] + w - 1 - begins[d[some[k]]]), int(first[k])))
            for at in offset[~inside].tolist():
                for d in range(max(0, int(np.searchsorted(begins, at, "right")) - 1), int(np.searchsorted(begins, at + size - 1, "right"))):
                    if d + 1 < len(begins) and (hit := overlap(own, words, begins[d], begins[d + 1], at)):
                        n, first, end = hit
                        keep(d, item, (n, -int(at - begins[d] + first), int(at - begins[d] + end), first))
    return best


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for rows, texts in chunks(batches):
            words, begins = word_hashes(texts)
            ids = rows.column("doc_id")
            if best := best_overlaps(index, words, begins):
                keys = list(best)
                cols = [ids.take(pa.array([d for d, _ in keys])), *(pa.array(x, pa.int64()) for x in zip(*((index["ids"][i], best[d, i][0], len(index["tokens"][i]), -best[d, i][1], best[d, i][2], best[d, i][3]) for d, i in keys), strict=True))]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in OUT.split(", ")])

    return run


def contaminated(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, matched_words, item_words, first_word, last_word, item_first_word): a row for each document
    row and item with an overlap; of several alignments the one with the most agreeing words, then the first.

    first_word and last_word are places among the document's words, from 0. Null and empty texts overlap nothing;
    null ids are returned as such; repeated rows give repeated results. Other columns are not read.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), whole(F.col("text")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 1)).head()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    out = None
    for k in range(blocks):  # about block_bytes each
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        index = build_index([(r.item_id, r.text) for r in block.toLocalIterator()])
        part = rows.mapInArrow(_search(spark.sparkContext.broadcast(index)), OUT)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that overlap an item. A row is judged by its text alone, whatever its id or other rows of it."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    key = F.xxhash64(whole(F.col("text")))
    bad = contaminated(docs.select(key.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("bad")).distinct()
    return docs.select(row, key.alias("h")).join(bad, F.col("h") == F.col("bad"), "left_anti").select("row.*")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP7_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
i0 AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
i AS (SELECT item, item_id, w, len(w) AS n, least({WINDOW}, len(w)) AS win, (least({WINDOW}, len(w)) * 4 + 4) // 5 AS least FROM i0 WHERE len(w) > 0),
dw AS (SELECT row, len(w) AS n_doc, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d),
iw AS (SELECT item, n, win, least, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM i),
lines AS (
  SELECT row, n_doc, item, n, win, least, dw.pos - iw.pos AS off
  FROM dw JOIN iw ON dw.word = iw.word GROUP BY row, n_doc, item, n, win, least, off HAVING count(*) >= least),
same AS (
  SELECT l.row, l.item, l.off, iw.pos
  FROM lines l JOIN iw ON iw.item = l.item JOIN dw ON dw.row = l.row AND dw.pos = iw.pos + l.off AND dw.word = iw.word),
windows AS (SELECT row, n_doc, item, n, win, least, off, unnest(range(0, n - win + 1)) AS k FROM lines),
good AS (
  SELECT v.row, v.item, v.off, v.n, v.win, v.k
  FROM windows v JOIN same s ON s.row = v.row AND s.item = v.item AND s.off = v.off AND s.pos >= v.k AND s.pos < v.k + v.win
  WHERE v.off + v.k >= 0 AND v.off + v.k + v.win <= v.n_doc GROUP BY v.row, v.item, v.off, v.n, v.win, v.k, v.least HAVING count(*) >= v.least),
spans AS (SELECT row, item, off, n, win, min(k) AS first, max(k) AS last FROM good GROUP BY row, item, off, n, win),
counted AS (
  SELECT p.row, p.item, p.off, p.n, p.first, p.off + p.first AS first_word, p.off + p.last + p.win - 1 AS last_word, count(*) AS matched
  FROM spans p JOIN same s ON s.row = p.row AND s.item = p.item AND s.off = p.off AND s.pos >= p.first AND s.pos < p.last + p.win GROUP BY p.row, p.item, p.off, p.n, p.win, p.first, p.last),
best AS (SELECT *, row_number() OVER (PARTITION BY row, item ORDER BY matched DESC, first_word, last_word DESC, first DESC) AS nth FROM counted)
SELECT d.doc_id, i.item_id, matched AS matched_words, b.n AS item_words, first_word, last_word, first AS item_first_word
FROM best b JOIN d ON d.row = b.row JOIN i ON i.item = b.item WHERE nth = 1
"""

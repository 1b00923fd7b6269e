"""Suffix-array dedup of byte passages over a prefix-free parse.

The parse. A rolling hash of K bytes is taken at every place; a place is a trigger if its hash is the least among
those of some LENGTH-byte string around it. Every LENGTH-byte string has exactly one trigger of its own, its first
least; neighbouring strings with the same trigger are one phrase. So phrases overlap by LENGTH - 1 bytes, each
LENGTH-byte string of the corpus lies in exactly one phrase of the parse, and equal strings have equal triggers
at the same place: no suffix of a phrase that is long enough to matter goes on outside of it.

Dictionary and parse. The dictionary has each distinct phrase once, with the least document that the parse puts it
in. Corpus suffixes in order of their first LENGTH bytes are dictionary suffixes in that order, each standing for
all places of its phrase; strings that are equal are neighbours in it, and the least document over such a run
decides for all of them. Suffixes of phrases with different triggers cannot share LENGTH bytes, so the order is made
trigger by trigger: phrases are dealt out by their trigger, and only phrases that share their trigger with
another one need their bytes sorted. Of all others a 64-bit hash and the least document are enough.

Steps: (1) every document's phrases as packed (trigger, phrase hash, document), dealt by trigger; (2) least
documents, and which bytes are asked for; (3) one document block for each asked phrase sends its bytes; (4) suffixes
are sorted, by trigger and, where a trigger has very many phrases, by a hash of the string, too; (5) answers go to
all blocks with the phrase; (6) blocks of documents mark and remove. A phrase common to many documents is sent
once from each batch of rows, and asked for once, so no group of copies gathers in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, whole, written
from .tokens import mixed, powers

LENGTH = 50
K = 16
CHUNK = 1 << 20
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
#: Phrases of one trigger sorted in one task; beyond it strings are dealt by a hash as well.
HOT = 20_000
NONE = (1 << 63) - 1  # the place of null ids in the order of documents
_AT = 28  # bits for a place in a chunk


class Parse:
    """The phrases of some texts: of phrase i the text owner[i], its first string's place at[i] in that text, the
    number of strings n[i], and hashes of its trigger and of its bytes."""

    def __init__(self, texts: list[bytes], k: int = K, chunk: int = CHUNK):
        parts = [self._chunk(*c, k) for c in self._chunks(texts, chunk)]
        self.owner, self.at, self.n, self.trigger, self.hash = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (int, int, int, np.uint64, np.uint64))

    @staticmethod
    def _chunks(texts: list[bytes], chunk: int) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
        """Joined texts with (text, place in it, length) of each; of a long text stretches that overlap by LENGTH - 1 bytes."""
        held, rows, size = [], [], 0
        for i, text in enumerate(texts):
            for a in range(0, max(1, len(text) - LENGTH + 1), chunk):
                part = text[a : a + chunk + LENGTH - 1]
                if len(part) < LENGTH:
                    continue
                held.append(part)
                rows.append((i, a, len(part)))
                size += len(part)
                if size >= chunk:
                    yield b"".join(held), rows
                    held, rows, size = [], [], 0
        if held:
            yield b"".join(held), rows

    @staticmethod
    def _chunk(raw: bytes, rows: list[tuple[int, int, int]], k: int):
        codes = np.frombuffer(raw, np.uint8)
        up, down = powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        grams = mixed((sums[k:] - sums[:-k]) * down[: len(sums) - k])
        low = np.uint64((1 << _AT) - 1)
        best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        width, have = LENGTH - k + 1, 1  # the least of width places, by doubling
        while have < width:
            step = min(have, width - have)
            best = np.minimum(best[:-step], best[step:])
            have += step
        spot = (best & low).astype(np.int64)
        owner, first, length = (np.array(x) for x in zip(*rows, strict=True))
        begin = np.cumsum(length) - length
        real = np.zeros(len(codes) + 1, np.int8)  # strings inside one text
        real[begin] += 1
        real[begin + length - LENGTH + 1] -= 1
        real = np.cumsum(real[: len(spot)]) > 0
        new = real.copy()
        new[1:] &= (spot[1:] != spot[:-1]) | ~real[:-1]
        new[begin] = True  # texts of LENGTH bytes touch
        s = np.flatnonzero(new)
        ends = np.append(np.flatnonzero(real[:-1] & (new[1:] | ~real[1:])), [len(real) - 1] if real[-1] else [])
        n = ends.astype(np.int64) - s + 1
        row = np.searchsorted(begin, s, "right") - 1
        e = s + n + LENGTH - 1
        phrase = mixed((sums[e] - sums[s]) * down[s] + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return owner[row], s - begin[row] + first[row], n, mixed(grams[spot[s]]), phrase


# -- packed columns: 8-byte columns as planes of bytes, so that the shuffle's compression finds the empty ones -------------


def pack(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)


def unpack(data: bytes, *types: str) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize for t in types]
    n, out, at = len(data) // sum(sizes), [], 0
    for t, size in zip(types, sizes, strict=True):
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(t).reshape(n))
        at += n * size
    return out


def gathered(blobs: list[bytes], *types: str) -> list[np.ndarray]:
    parts = [unpack(b, *types) for b in blobs]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in types]


def by_key(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct key with the places that have it."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(keys[rows[0]]), rows


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


# fixed values: the primes of XXH64
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def blocks_of(docs: np.ndarray, n_blocks: int) -> np.ndarray:
    """The block of each document number: pmod(xxhash64(number), n_blocks) as Spark has it."""
    x = docs.astype(np.int64).view(np.uint64)
    h = np.uint64(42 + 8) + _P5
    h = h ^ (_turned(x * _P2, 31) * _P1)
    h = _turned(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return (h ^ (h >> np.uint64(32))).view(np.int64) % n_blocks


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[k] for k in kinds]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=list(names))


ENTRIES = "bucket int, data binary"
REPLIES = "kind string, block int, bucket int, data binary"
STRINGS = "bucket int, part int, data binary, text binary"
RUNS = "bucket int, data binary"
ANSWERS = "block int, data binary"


def _order_of(ids: pa.ChunkedArray) -> np.ndarray:
    return ids.to_numpy().astype(np.int64)


def _entries(n_buckets: int, n_blocks: int):
    """(1) For each batch of rows the distinct (phrase, block), with the least document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, docs = batch.column("raw").to_pylist(), _order_of(batch.column("ord"))
            for a, b in _stretches(np.cumsum([0, *map(len, texts)]), BLOCK_BYTES):
                parse = Parse(texts[a:b])
                doc = docs[a:b][parse.owner]
                order = np.lexsort((doc, blocks_of(doc, n_blocks), parse.hash))
                p, d = parse.hash[order], doc[order]
                k = blocks_of(d, n_blocks)
                first = np.ones(len(p), bool)
                first[1:] = (p[1:] != p[:-1]) | (k[1:] != k[:-1])
                p, d, t = p[first], d[first], parse.trigger[order][first]
                rows = []
                for bucket, at in by_key((t >> np.uint64(32)) % np.uint64(n_buckets)):
                    at = at[np.argsort(t[at].astype(np.uint32), kind="stable")]
                    rows.append((bucket, pack(t[at].astype(np.uint32), p[at], d[at])))
                if rows:
                    yield from _rows(ENTRIES, rows).to_batches()

    return run


def _stretches(cum: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(cum) - 1:
        b = max(a + 1, int(np.searchsorted(cum, cum[a] + most, "right")) - 1)
        yield a, b
        a = b


def _reply(n_blocks: int, hot: int):
    """(2) Of a bucket's phrases: to the blocks that have a greater document, the least one (R); to one block with the
    phrase, that its bytes are asked for (Q); to the bucket itself, which blocks have an asked phrase (L)."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        t, p, d = gathered(table.column("data").to_pylist(), "u4", "u8", "i8")
        block = blocks_of(d, n_blocks)
        order = np.lexsort((d, p))
        t, p, d, block = t[order], p[order], d[order], block[order]
        first = np.ones(len(p), bool)
        first[1:] = p[1:] != p[:-1]
        which = np.cumsum(first) - 1
        least = d[first]
        mine = np.lexsort((d, block, which))  # of several entries from one block the least counts
        one = np.ones(len(p), bool)
        one[1:] = (which[mine][1:] != which[mine][:-1]) | (block[mine][1:] != block[mine][:-1])
        entry = mine[one]
        # a trigger asks for bytes if its phrases differ in their least documents
        ft, fp, fb = t[first], p[first], block[first]
        by_t = np.argsort(ft, kind="stable")
        starts = np.flatnonzero(np.append([True], np.diff(ft[by_t]) != 0))
        n = np.diff(np.append(starts, len(by_t)))
        differ = np.minimum.reduceat(least[by_t], starts) != np.maximum.reduceat(least[by_t], starts)
        asked = np.zeros(len(fp), bool)
        parts = np.ones(len(fp), np.int32)
        asked[by_t] = np.repeat(differ, n)
        parts[by_t] = np.repeat(-(-n // hot), n)
        rows = []
        late = entry[d[entry] > least[which[entry]]]
        for k, at in by_key(block[late]):
            at = late[at]
            rows.append(("R", k, bucket, pack(p[at], least[which[at]])))
        q = np.flatnonzero(asked)
        for k, at in by_key(fb[q]):
            at = q[at]
            rows.append(("Q", k, bucket, pack(fp[at], least[at], parts[at], ft[at])))
        listed = entry[asked[which[entry]]]
        if len(listed):
            rows.append(("L", -1, bucket, pack(p[listed], block[listed].astype(np.int32))))
        return _rows(REPLIES, rows)

    return run


def _windows(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the LENGTH bytes at each place."""
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mixed((sums[LENGTH:] - sums[:-LENGTH]) * down[: len(sums) - LENGTH])


def _sorted_docs(docs: pa.Table) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    order = _order_of(docs.column("ord"))
    by = np.argsort(order, kind="stable")
    docs = docs.take(pa.array(by))
    return docs, order[by], docs.column("raw").to_pylist()


def _send(docs: pa.Table, asked: pa.Table) -> pa.Table:
    """(3) The bytes of the asked phrases of this block, to their buckets; those of a hot trigger to the parts that their strings fall in."""
    if not asked.num_rows or not docs.num_rows:
        return _rows(STRINGS, [])
    _, _, texts = _sorted_docs(docs)
    parse = Parse(texts)
    p, first = np.unique(parse.hash, return_index=True)
    rows = []
    for bucket, data in zip(asked.column("bucket").to_pylist(), asked.column("data").to_pylist(), strict=True):
        q, least, parts, t = unpack(data, "u8", "i8", "i4", "u4")
        at = first[np.searchsorted(p, q)]
        text = [texts[parse.owner[i]][parse.at[i] : parse.at[i] + parse.n[i] + LENGTH - 1] for i in at]
        size = np.array([len(x) for x in text], np.uint8)
        plain = parts == 1
        to: dict[int, list[int]] = {}
        if plain.any():
            to[0] = np.flatnonzero(plain).tolist()
        for i in np.flatnonzero(~plain):
            for j in np.unique(_windows(np.frombuffer(text[i], np.uint8)) % np.uint64(parts[i])):
                to.setdefault(1 + int(j), []).append(int(i))
        for part, some in to.items():
            s = np.array(some)
            rows.append((bucket, part, pack(q[s], least[s], parts[s], t[s], size[s]), b"".join(text[i] for i in some)))
    return _rows(STRINGS, rows)


def suffix_minima(codes: np.ndarray, places: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each place the least value of all places with the same LENGTH bytes, from the sorted order of these suffixes."""
    eights = np.lib.stride_tricks.sliding_window_view(codes, 8)
    keys = [np.ascontiguousarray(eights[places + min(o, LENGTH - 8)]).view(">u8")[:, 0].astype(np.uint64) for o in range(0, LENGTH, 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        sorted_ = key[order]
        new[1:] |= sorted_[1:] != sorted_[:-1]
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(value[order], starts)
    out = np.empty(len(order), value.dtype)
    out[order] = np.repeat(least, np.diff(np.append(starts, len(order))))
    return out


def _sort_suffixes(table: pa.Table) -> pa.Table:
    """(4) The dictionary suffixes of some triggers in order; where a string's least document is less than its phrase's, it is
    reported as (phrase, first string, number of strings, document)."""
    bucket, part = table.column("bucket")[0].as_py(), table.column("part")[0].as_py()
    blobs = [unpack(b, "u8", "i8", "i4", "u4", "u1") for b in table.column("data").to_pylist()]
    p, least, parts, t, size = (np.concatenate(x) for x in zip(*blobs, strict=True))
    codes = np.frombuffer(b"".join(table.column("text").to_pylist()), np.uint8)
    begin = np.cumsum(size.astype(np.int64)) - size
    n = size.astype(np.int64) - LENGTH + 1
    rows = []
    order = np.argsort(t, kind="stable")
    # triggers one after another, about a million strings at a time
    ends = np.append(np.flatnonzero(np.diff(t[order])) + 1, len(order))
    total = np.append(0, np.cumsum(n[order])[ends - 1])
    for a, b in _stretches(total, 1 << 20):
        some = order[(ends[a - 1] if a else 0) : ends[b - 1]]
        strings = []
        for c in range(0, len(some), HOT):
            these = some[c : c + HOT]
            which = np.repeat(these, n[these])
            offset = np.arange(len(which)) - np.repeat(np.cumsum(n[these]) - n[these], n[these])
            if part:  # only the strings that are dealt to this part
                own = np.concatenate([_windows(codes[begin[i] : begin[i] + size[i]]) % np.uint64(parts[i]) for i in these]) == part - 1
                which, offset = which[own], offset[own]
            strings.append((which, offset))
        which, offset = (np.concatenate(x) for x in zip(*strings, strict=True))
        if not len(which):
            continue
        places = begin[which] + offset
        low = suffix_minima(codes, places, least[which])
        less = np.flatnonzero(low < least[which])
        if len(less):
            which, offset, low = which[less], offset[less], low[less]
            new = np.append([True], (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1) | (low[1:] != low[:-1]))
            s = np.flatnonzero(new)
            run = np.diff(np.append(s, len(which)))
            rows.append((bucket, pack(p[which[s]], offset[s].astype(np.uint8), run.astype(np.uint8), low[s])))
    return _rows(RUNS, rows)


def _answer(runs: pa.Table, listed: pa.Table) -> pa.Table:
    """(5) The reports on a bucket's phrases, to every block that has the phrase."""
    p, first, n, low = gathered(runs.column("data").to_pylist(), "u8", "u1", "u1", "i8")
    lp, block = gathered(listed.column("data").to_pylist(), "u8", "i4")
    if not len(p):
        return _rows(ANSWERS, [])
    order = np.argsort(lp, kind="stable")
    lp, block = lp[order], block[order]
    lo, hi = np.searchsorted(lp, p, "left"), np.searchsorted(lp, p, "right")
    many = hi - lo
    run = np.repeat(np.arange(len(p)), many)
    to = block[np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)]
    rows = [(k, pack(p[run[at]], first[run[at]], n[run[at]], low[run[at]])) for k, at in by_key(to.astype(np.int64))]
    return _rows(ANSWERS, rows)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<bigint>"


def removed_marks(texts: list[bytes], docs: np.ndarray, p: np.ndarray, least: np.ndarray, runs: tuple[np.ndarray, ...]) -> Iterator[np.ndarray]:
    """For each text which of its bytes go; docs ascend. p, least: of phrases that an earlier document elsewhere has;
    runs: (phrase, first string, strings, document) of strings that stand earlier in another phrase."""
    parse = Parse(texts)
    doc = docs[parse.owner]
    # the least document of each phrase, here or elsewhere
    order = np.argsort(parse.hash, kind="stable")
    new = np.append([True], np.diff(parse.hash[order]) != 0)[: len(order)]
    here = np.empty(len(order), np.int64)
    starts = np.flatnonzero(new)
    here[order] = np.repeat(np.minimum.reduceat(doc[order], starts), np.diff(np.append(starts, len(order)))) if len(order) else 0
    by = np.argsort(p, kind="stable")
    p, least = p[by], least[by]
    spot = np.searchsorted(p, parse.hash)
    found = spot < len(p)
    found[found] = p[spot[found]] == parse.hash[found]
    here[found] = np.minimum(here[found], least[spot[found]])
    gone = here < doc
    s, n, owner = [parse.at[gone]], [parse.n[gone]], [parse.owner[gone]]
    rp, rfirst, rn, rlow = runs
    by = np.argsort(rp, kind="stable")
    rp, rfirst, rn, rlow = rp[by], rfirst[by].astype(np.int64), rn[by].astype(np.int64), rlow[by]
    left = np.flatnonzero(~gone)
    lo, hi = np.searchsorted(rp, parse.hash[left], "left"), np.searchsorted(rp, parse.hash[left], "right")
    many = hi - lo
    who = np.repeat(left, many)
    run = np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)
    ok = rlow[run] < doc[who]
    who, run = who[ok], run[ok]
    s.append(parse.at[who] + rfirst[run])
    n.append(rn[run])
    owner.append(parse.owner[who])
    s, n, owner = np.concatenate(s), np.concatenate(n), np.concatenate(owner)
    by = np.argsort(owner, kind="stable")
    s, n, owner = s[by], n[by], owner[by]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i, text in enumerate(texts):
        a, b = cuts[i], cuts[i + 1]
        depth = np.zeros(len(text) + 1, np.int64)
        if b > a:
            np.add.at(depth, s[a:b], 1)
            np.add.at(depth, s[a:b] + n[a:b] + LENGTH - 1, -1)
        yield np.cumsum(depth[:-1]) > 0


def _remove(docs: pa.Table, replies: pa.Table) -> pa.Table:
    """(6) The documents of a block without what stands in earlier ones."""
    docs, order, texts = _sorted_docs(docs)
    kinds = replies.column("kind").to_pylist()
    blobs = replies.column("data").to_pylist()
    p, least = gathered([b for b, k in zip(blobs, kinds, strict=True) if k == "R"], "u8", "i8")
    runs = gathered([b for b, k in zip(blobs, kinds, strict=True) if k == "E"], "u8", "u1", "u1", "i8")
    out: dict[str, list] = {c.split()[0]: [] for c in RESULT.split(", ")}
    for text, gone in zip(texts, removed_marks(texts, order, p, least, runs), strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(edge) else text
        out["n_bytes"].append(len(text))
        out["n_removed"].append(len(text) - len(kept))
        out["n_spans"].append(len(edge) // 2)
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        out["spans"].append(edge.tolist())
    kinds_ = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
    return pa.table([docs.column("doc_id").combine_chunks(), *(pa.array(out[c], k) for c, k in zip(list(out)[1:], kinds_, strict=True))], names=list(out))


def remove_repeats(docs: DataFrame, hot: int = HOT, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A byte goes if a LENGTH-byte string around it also starts in a document with a smaller doc_id. spans holds start
    and end of each removed run, one after the other. Null text counts as empty. A null doc_id is greater than all
    others; rows of one doc_id, and rows without one, are not compared with each other. Other columns are not read.
    """
    text = whole(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("raw"))
    rows = rows.withColumn("ord", F.coalesce("doc_id", F.lit(NONE)))
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).head()[0] or 0
    n_buckets, n_blocks = max(4, -(-total // bucket_bytes)), max(4, -(-total // block_bytes))
    entries = rows.select("ord", "raw").mapInArrow(_entries(n_buckets, n_blocks), ENTRIES)
    replies = written(entries.groupBy("bucket").applyInArrow(_reply(n_blocks, hot), REPLIES), "pfp-replies")
    docs.sparkSession.sparkContext._jvm.System.gc()  # lets Spark delete the entries' shuffle files now

    blocked = rows.withColumn("block", F.pmod(F.xxhash64("ord"), F.lit(n_blocks)).cast("int")).groupBy("block")
    asked = replies.filter("kind = 'Q'").select("block", "bucket", "data").groupBy("block")
    strings = blocked.cogroup(asked).applyInArrow(_send, STRINGS)
    runs = strings.groupBy("bucket", "part").applyInArrow(_sort_suffixes, RUNS)
    listed = replies.filter("kind = 'L'").select("bucket", "data")
    answers = runs.groupBy("bucket").cogroup(listed.groupBy("bucket")).applyInArrow(_answer, ANSWERS)
    to_blocks = replies.filter("kind = 'R'").select("block", "kind", "data").unionByName(answers.select("block", F.lit("E").alias("kind"), "data"))
    return blocked.cogroup(to_blocks.groupBy("block")).applyInArrow(_remove, RESULT)


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("spans")


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
w AS (SELECT row, doc_id, x, unnest(range(0, len(x) // 2 - {LENGTH - 1})) AS pos FROM d),
b AS (SELECT row, doc_id, pos, unhex(substr(x, 2 * pos + 1, {2 * LENGTH})) AS string FROM w),
s AS (SELECT row, doc_id, pos, min(doc_id) OVER (PARTITION BY string) AS least FROM b),
g AS (SELECT row, pos FROM s WHERE least IS NOT NULL AND (doc_id IS NULL OR least < doc_id)),
n AS (SELECT *, coalesce(pos > lag(pos) OVER (PARTITION BY row ORDER BY pos) + {LENGTH}, true) AS fresh FROM g),
r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY row ORDER BY pos) AS run FROM n),
spans AS (SELECT row, run, min(pos) AS lo, max(pos) + {LENGTH} AS hi FROM r GROUP BY row, run),
k AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY row ORDER BY lo), 0) AS since FROM spans),
o AS (
  SELECT d.row, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) || substr(any_value(x), 2 * max(hi) + 1) AS kept
  FROM d JOIN k ON d.row = k.row GROUP BY d.row)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN o ON d.row = o.row
"""

"""Confidence of extracted values from the OCR words that spell them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import BLANKS, is_blank, normalize_token, round2
from ..functions.similarity import ratio

NEAR_WORDS = 11
SEQUENCE_SHARE, TOKEN_SHARE = 0.80, 0.75
MOST_WORDS = 4  # a value is looked for in runs of so many words
OK_FROM, CHECK_FROM = 85, 60
APART = re.compile("[^A-Za-z0-9]")
#: Of each byte its normalised form, 0 for what is left out.
FORM = np.array([ord(chr(b).upper()) if b < 128 and chr(b).isalnum() else 0 for b in range(256)], np.uint8)
SIGNS = np.unique(FORM[FORM > 0])
#: Of hashes, an odd number; pairs of a value and a word that are compared at once.
BASE, PAIRS = 0x9E3779B97F4A7C15, 1 << 19

# fixed values: further words that name a field
ALIASES = {
    "SELLERTAXID": ["TAXID", "TAX"],
    "CLIENTTAXID": ["TAXID", "TAX"],
    "SELLERIBAN": ["IBAN"],
    "INVOICENUMBER": ["INVOICE"],
    "INVOICEDATE": ["DATE"],
    "NETWORTH": ["NETWORTH", "NET"],
    "VAT": ["VAT"],
    "GROSSWORTH": ["GROSSWORTH", "GROSS"],
}


def prepared_words(words: Column) -> Column:
    """Usable words of an array of (text, confidence): trimmed, confidence 0 to 100, with their normalised form."""
    clean = F.transform(
        F.coalesce(words, F.expr("cast(array() as array<struct<text:string,confidence:double>>)")),
        lambda w: F.struct(F.btrim(w["text"], F.lit(BLANKS)).alias("text"), normalize_token(w["text"]).alias("normalized"), F.least(F.lit(100.0), F.nanvl(w["confidence"], F.lit(0.0))).alias("confidence")),
    )
    return F.filter(clean, lambda w: (w["normalized"] != "") & (w["confidence"] >= 0))


def named_fields(word: Column, fields: list[str]) -> Column:
    """Those of fields that one normalised word names, as label_positions has it: literals, so that all compiles."""
    name = lambda f: "".join(f.split()).upper()
    names = lambda f: word.contains(name(f)) | F.lit(name(f)).contains(word) | word.isin(ALIASES.get(name(f), []))
    return F.array_compact(F.array(*[F.when(names(f), F.lit(f)) for f in fields]))


def label_positions(field: Column, words: Column) -> Column:
    """Places, from 0, of the prepared words that name the field: equal, containing, contained, or an alias."""
    name = normalize_token(field)
    known = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    aliases = F.coalesce(F.try_element_at(known, name), F.expr("cast(array() as array<string>)"))

    def names(w: Column) -> Column:
        return w.contains(name) | name.contains(w) | F.array_contains(aliases, w)

    marked = F.transform(words, lambda w, i: F.when((name != "") & names(w["normalized"]), i))
    return F.filter(marked, lambda i: i.isNotNull())


def likeness(target: str, other: str, above: float) -> float:
    """ratio(target, other), or 0 where that cannot exceed above: lengths, then letters, bound it."""
    total = len(target) + len(other)
    if 2 * min(len(target), len(other)) <= above * total or 2 * sum(min(target.count(c), other.count(c)) for c in set(target)) <= above * total:
        return 0.0
    return ratio(target, other)


class Page:
    """The prepared words of a page, none empty, joined once for all values that are looked for in them."""

    def __init__(self, words: list[str]):
        self.words, self.text, self.starts = words, "".join(words), [0, *accumulate(map(len, words))]
        self.place = {at: k for k, at in enumerate(self.starts)}

    def spelling(self, target: str) -> list[tuple[int, int]]:
        """(first, after last) of all runs of up to MOST_WORDS words that spell target, in order."""
        out, at = [], self.text.find(target)
        while at >= 0:
            first, last = self.place.get(at), self.place.get(at + len(target))
            if first is not None and last is not None and last - first <= MOST_WORDS:
                out.append((first, last))
            at = self.text.find(target, at + 1)
        return out

    def most_alike(self, target: str, near: Iterable[tuple[float, int, int]]) -> list[tuple[int, int]]:
        """The runs with the greatest ratio, in order, if that is SEQUENCE_SHARE at least. The ratio is taken of near runs, in
        order of its bound, until no bound reaches the best."""
        best, found, taken = SEQUENCE_SHARE, [], {}
        for bound, *spot in near:
            if bound < best:
                break
            joined = self.text[self.starts[spot[0]] : self.starts[spot[1]]]
            now = taken[joined] if joined in taken else taken.setdefault(joined, ratio(target, joined))
            if now > best:
                best, found = now, []
            if now == best:
                found.append(tuple(spot))
        return sorted(found)

    def matched(self, value: str, labels: Callable[[], list[int]], near: Iterable[tuple[float, int, int]]) -> list[int]:
        """Places of the words that spell value: after a label, anywhere, or token by token; empty if unreliable.

        An exact run beats all others: the first after the first label that has one, else the first anywhere. Of
        the rest the one most alike counts, if alike enough; the first of equals, those after labels before others.
        So labels are asked for only where several runs are equal.
        """
        target = token(value)
        if not target or not self.words:
            return []
        spots = self.spelling(target) or self.most_alike(target, near)
        if spots:
            if len(spots) > 1:
                after = (s for at in labels() for s in spots if s[0] > at and s[1] <= at + 1 + NEAR_WORDS)
                return list(range(*next(after, spots[0])))
            return list(range(*spots[0]))
        return self.by_token(value)

    def by_token(self, value: str) -> list[int]:
        used: list[int] = []
        for part in APART.sub(" ", value).upper().split():
            spot, score = None, float(np.nextafter(TOKEN_SHARE, 0))
            for k, word in enumerate(self.words):
                if k not in used and word == part:
                    spot = k
                    break
            else:
                for k, word in enumerate(self.words):
                    if k not in used and (now := likeness(part, word, score)) > score:
                        spot, score = k, now
            if spot is None:
                return []
            used.append(spot)
        return used


def matched(value: str, words: list[str], labels: list[int]) -> list[int]:
    """Page.matched of one value and its labels."""
    there, (text, starts) = np.array([0, len(words)]), _packed(pa.array(words, pa.string()))
    near = _near(_packed(pa.array([value], pa.string())), (text, starts), there[:1], there[1:])
    return Page(words).matched(value, lambda: labels, ((bound, first, last) for _, bound, first, last in near))


def token(value: str) -> str:
    """normalize_token of a plain text."""
    return APART.sub("", value).upper()


def _labels(field: str | None, words: list[str]) -> list[int]:
    """label_positions of plain lists."""
    name = token(field or "")
    aliases = ALIASES.get(name, ())
    return [k for k, w in enumerate(words) if name in w or w in name or w in aliases] if name else []


def _mean(spots: list[int], confidences: np.ndarray) -> float | None:
    return None if not spots else float(confidences[spots[0]]) if len(spots) == 1 else float(np.mean([confidences[k] for k in spots]))


def _packed(texts: pa.Array, usable: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The normalised forms of texts one after the other, as bytes, and where each begins; of texts not usable, nothing."""
    texts = texts.fill_null("").cast(pa.string())
    _, cuts, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    cuts = np.frombuffer(cuts, np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    plain = FORM[np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]]] if cuts[-1] > cuts[0] else np.zeros(0, np.uint8)
    if usable is not None:
        plain = plain * np.repeat(usable, np.diff(cuts))
    return plain[plain > 0], np.concatenate([[0], np.cumsum(plain > 0)])[cuts - cuts[0]]


def _hashes(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Of the bytes between each first and last: sums of bytes by powers of an odd number, modulo 2^64."""
    one = np.ones(1, np.uint64)
    up, down = (np.cumprod(np.concatenate([one, np.full(len(data), x, np.uint64)])) for x in (BASE, pow(BASE, -1, 1 << 64)))
    sums = np.cumsum(np.concatenate([one, data * up[:-1]]))
    return lambda first, last: (sums[last] - sums[first]) * down[first]


def _ranges(lengths: np.ndarray) -> np.ndarray:
    """0 to each length, one after the other."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _spelt(targets: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Rows (target, first word, words) of all runs of up to MOST_WORDS words between each target's first and last that
    spell it, in the order of targets. Runs of equal hashes are compared byte by byte."""
    (data, at), (text, starts) = targets, words
    want, n, found = _hashes(data)(at[:-1], at[1:]), last - first, [np.zeros((0, 3), np.int64)]
    of = _hashes(text)
    runs = [of(starts[:-k], starts[k:]) for k in range(1, min(MOST_WORDS, len(starts) - 1) + 1)]
    chunk = np.cumsum(n) // PAIRS
    for some in np.split(np.arange(len(n)), np.flatnonzero(np.diff(chunk)) + 1):
        if not n[some].sum():
            continue
        left = np.repeat(n[some], n[some]) - (step := _ranges(n[some]))
        word, wanted = np.repeat(first[some], n[some]) + step, np.repeat(want[some], n[some])
        for k, run in enumerate(runs, 1):
            hit = np.flatnonzero((run[np.minimum(word, len(run) - 1)] == wanted) & (left >= k))
            found.append(np.stack([np.repeat(some, n[some])[hit], word[hit], np.full(len(hit), k)], 1))
    hits = np.concatenate(found)
    hits = hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))]
    begin, length = starts[hits[:, 1]], at[hits[:, 0] + 1] - at[hits[:, 0]]
    hits, begin, length = (x[starts[hits[:, 1] + hits[:, 2]] - begin == length] for x in (hits, begin, length))
    if not len(hits):
        return hits
    step = _ranges(length)
    same = text[np.repeat(begin, length) + step] == data[np.repeat(at[hits[:, 0]], length) + step]
    return hits[np.logical_and.reduceat(same, np.cumsum(length) - length)]


def _near(targets: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray], first: np.ndarray, last: np.ndarray) -> list[tuple[int, float, int, int]]:
    """(target, bound, first word, after last) of all runs between each target's first and last whose ratio may be
    SEQUENCE_SHARE at least: by lengths, then letters. In the order of targets, greatest bounds first, then as they stand;
    words count from the target's first."""
    (data, at), (text, starts) = targets, words
    n, size, found = last - first, np.diff(at), []
    for some in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // (PAIRS >> 4))) + 1):
        step = _ranges(n[some])
        if not len(step):
            continue
        own, word = np.repeat(np.arange(len(some)), n[some]), np.repeat(first[some], n[some]) + step
        left, length = np.repeat(n[some], n[some]) - step, np.repeat(size[some], n[some])
        runs = []
        for k in range(1, MOST_WORDS + 1):
            m = starts[np.minimum(word + k, len(starts) - 1)] - starts[word]
            fit = np.flatnonzero((left >= k) & (2.0 * np.minimum(length, m) >= SEQUENCE_SHARE * (length + m) - 1) & (m > 0))
            runs.append(np.stack([fit, np.full(len(fit), k), m[fit]], 1))
        pair, k, m = np.concatenate(runs).T
        letters = _letters(text, starts[word], starts[word + 1])
        until = np.concatenate([np.zeros_like(letters[:1]), np.cumsum(letters, 0, np.int32)])
        wanted = _letters(data, at[some], at[some + 1])
        for part in np.array_split(np.arange(len(pair)), len(pair) // PAIRS + 1):
            x = pair[part]
            common = np.minimum(until[x + k[part]] - until[x], wanted[own[x]]).sum(1)
            bound = 2.0 * common / (length[x] + m[part])
            fit = bound >= SEQUENCE_SHARE
            found += zip(some[own[x[fit]]].tolist(), bound[fit].tolist(), step[x[fit]].tolist(), (step[x] + k[part])[fit].tolist(), strict=True)
    return sorted(found, key=lambda x: (x[0], -x[1], *x[2:]))


def _letters(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How often each letter and digit is in the bytes between each first and last."""
    n = last - first
    place = np.searchsorted(SIGNS, data[np.repeat(first, n) + _ranges(n)])
    return np.bincount(np.repeat(np.arange(len(n)), n) * len(SIGNS) + place, minlength=len(n) * len(SIGNS)).astype(np.int32).reshape(len(n), len(SIGNS))


def _found(alike: bool):
    """A function of a page's fields (array of structs with field and value) and words: for each field the mean confidence
    of the words that spell its value, null if none reliably do, and whether one word spells it exactly. Without alike
    only values that one word spells are looked for.

    Values that are spelt exactly are found for all pages of a batch at once; a Page is made for others only."""

    def run(fields: pa.Array, words: pa.Array) -> pa.Array:
        names, values = (fields.values.field(k) for k in ("field", "value"))
        texts, given = (words.values.field(k) for k in ("text", "confidence"))
        cuts, ends = (x.offsets.to_numpy().astype(np.int64) for x in (fields, words))
        there = words.is_valid().to_numpy(zero_copy_only=False)
        known = given.is_valid().to_numpy(zero_copy_only=False)
        conf = np.nan_to_num(given.cast(pa.float64()).fill_null(100.0).to_numpy(), nan=0.0, posinf=np.inf, neginf=-np.inf)
        conf = np.minimum(np.where(known, conf, 100.0), 100.0)
        lengths = np.diff(_packed(texts)[1])
        usable = (lengths > 0) & (conf >= 0)
        text, starts = _packed(texts, usable)
        starts, conf = np.concatenate([starts[:-1][usable], [len(text)]]), conf[usable]
        spot = np.concatenate([[0], np.cumsum(usable)])
        first, last = spot[ends[:-1]], np.where(there, spot[ends[1:]], spot[ends[:-1]])

        lists = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        values, names = values.slice(cuts[0], len(lists)), names.slice(cuts[0], len(lists))
        data, at = _packed(values)
        low, high = first[lists], np.where(np.diff(at) > 0, last[lists], first[lists])
        hits = _spelt((data, at), (text, starts), low, high)
        count, whole, means = np.bincount(hits[:, 0], minlength=len(lists)), np.zeros(len(lists), bool), np.full(len(lists), np.nan)
        whole[hits[hits[:, 2] == 1, 0]] = True
        alone = hits[count[hits[:, 0]] == 1]
        means[alone[:, 0]] = conf[alone[:, 1]]
        for k, word, n in alone[alone[:, 2] > 1].tolist():
            means[k] = _mean(range(word, word + n), conf) if alike else np.nan

        others = np.flatnonzero((count != 1) & (high > low) & (whole | alike))
        apart = others[count[others] == 0]
        sizes = at[apart + 1] - at[apart]
        near: dict[int, list] = {k: [] for k in others.tolist()}
        for k, *run in _near((data[np.repeat(at[apart], sizes) + _ranges(sizes)], np.concatenate([[0], np.cumsum(sizes)])), (text, starts), low[apart], high[apart]):
            near[int(apart[k])].append(run)
        own, page, usable = -1, None, []
        for k, runs in near.items():
            if lists[k] != own:
                own, marks = lists[k], starts[low[k] : high[k] + 1].tolist()
                joined = text[marks[0] : marks[-1]].tobytes().decode()
                usable = [joined[a - marks[0] : b - marks[0]] for a, b in pairwise(marks)]
                page = Page(usable)
            mean = _mean(page.matched(values[k].as_py(), lambda k=k, usable=usable: _labels(names[k].as_py(), usable), runs), conf[low[k] : high[k]])
            means[k] = np.nan if mean is None else mean
        found = pa.StructArray.from_arrays([pa.array(means, mask=np.isnan(means)), pa.array(whole)], ["mean", "one_word"])
        return pa.ListArray.from_arrays(pa.array(cuts - cuts[0], pa.int32()), found)

    return F.arrow_udf(run, "array<struct<mean:double,one_word:boolean>>")


def _rounded(mean: Column) -> Column:
    return F.bround(mean, 0).cast("int")  # between 0 and 100 as the words are


def ocr_confidence(field: Column, value: Column, words: Column) -> Column:
    """The mean confidence of the words that spell value, rounded half to even; null if none reliably do."""
    one = F.array(F.struct(field.alias("field"), value.alias("value")))
    return F.when(~is_blank(value), _rounded(F.element_at(_found(True)(one, words), 1)["mean"]))


def _judged(shown: Column, exact: Column, blank: Column, source: str) -> Column:
    status = (
        F.when(blank, "MANUAL REVIEW").when(exact.isNull(), "OCR CONF. N/A").when(exact >= OK_FROM, "OK").when(exact >= CHECK_FROM, "CHECK").otherwise("LOW OCR")
    )
    known = ~blank & exact.isNotNull()
    where = F.when(blank, "none").when(known, source).otherwise("unmatched")
    return F.struct(F.when(known, shown).alias("confidence"), status.alias("status"), (status != "OK").alias("review"), known.alias("confidence_available"), where.alias("confidence_source"))


def field_confidence(field: Column, value: Column, words: Column) -> Column:
    """struct(confidence, status, review, confidence_available, confidence_source) from word confidences."""
    conf = ocr_confidence(field, value, words)
    return _judged(conf, conf, is_blank(value), "field_word_level")


def field_confidence_overall(value: Column, overall: Column) -> Column:
    """The same from one confidence for the whole page: judged unrounded, shown rounded."""
    exact = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.nanvl(overall.cast("double"), F.lit(0.0))))
    return _judged(F.bround(exact, 0).cast("int"), exact, is_blank(value), "overall")


def analyze_fields(rows: DataFrame) -> DataFrame:
    """rows (…, field, value, words) with the columns of field_confidence; words are read once per row."""
    out = rows.withColumn("_c", field_confidence(F.col("field"), F.col("value"), F.col("words")))
    return out.select(*rows.columns, "_c.*")


def analyze_pages(pages: DataFrame, alike: bool = True) -> DataFrame:
    """analyze_fields of whole pages (…, fields, words), fields an array of structs with field and value: one row for each
    field, without the words, and one_word, whether one word spells the value. Words are prepared once per page.

    Without alike only the confidences of values that one word spells are looked for; those of others are null.
    """
    rest = [c for c in pages.columns if c not in ("fields", "words")]
    found = pages.select(*rest, "fields", _found(alike)(F.col("fields"), F.col("words")).alias("found"))
    rows = found.select(*rest, F.inline(F.arrays_zip("fields", "found"))).select(*rest, "fields.*", "found.*")
    conf = F.when(~is_blank(F.col("value")), _rounded(F.col("mean")))
    rows = rows.withColumn("mean", conf)
    out = rows.withColumn("_c", _judged(F.col("mean"), F.col("mean"), is_blank(F.col("value")), "field_word_level"))
    return out.select(*[c for c in rows.columns if c not in ("mean", "one_word")], "_c.*", "one_word")


def confidence_report(rows: DataFrame, *key: str) -> DataFrame:
    """(key, report, review_count) from rows (key, field_id, field, value, confidence, status, review)."""
    shown = F.coalesce(F.concat(F.col("confidence").cast("string"), F.lit("%")), F.lit("N/A"))
    mark = F.when(F.col("review"), "⚠").otherwise("✓")
    line = F.concat(F.col("field"), F.lit(": "), F.coalesce("value", F.lit("")), F.lit("\n   OCR Confidence: "), shown, F.lit(" | "), mark, F.lit(" "), F.col("status"), F.lit("\n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("field_id", line.alias("line")))), lambda x: x["line"])
    out = rows.groupBy(*key).agg(lines.alias("lines"), F.count_if("review").alias("review_count"))
    last = F.when(F.col("review_count") > 0, F.concat(F.lit("\n⚠ "), F.col("review_count").cast("string"), F.lit(" field(s) require attention."))).otherwise(
        "\n✓ All extracted fields passed the OCR confidence check."
    )
    return out.select(*key, F.array_join(F.concat("lines", F.array(last)), "\n").alias("report"), "review_count")


def mean_confidence(words: DataFrame, *key: str) -> DataFrame:
    """Mean word confidence by key in three readings: rounded with 0 for none, rounded with null for none, and raw with 0."""
    usable = F.avg(F.when(F.col("confidence") >= 0, F.col("confidence")))
    out = words.groupBy(*key).agg(usable.alias("mean"))
    return out.select(*key, F.coalesce(round2(F.col("mean")), F.lit(0.0)).alias("rounded_or_zero"), round2(F.col("mean")).alias("rounded_or_null"), F.coalesce("mean", F.lit(0.0)).alias("raw_or_zero"))

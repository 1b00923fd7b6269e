"""op5's rule in DuckDB's dialect. XXH64 is written out in 128-bit integers, reduced modulo 2^64 after each step."""

from __future__ import annotations

from .simhash import RADIUS, SEED, SHINGLE

# fixed values: the primes of XXH64
P1, P2, P3, P4, P5 = (
    f"{p}::UHUGEINT" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)
MOD = f"{1 << 64}::UHUGEINT"
START = f"{SEED}::UHUGEINT"


def _power(bits: int) -> str:
    return f"{1 << bits}::UHUGEINT"


def _named(value: str, expression: str) -> str:
    """expression over t, which stands for value, computed once."""
    return f"list_transform([{value}], lambda t: {expression})[1]"


def _turned(value: str, bits: int) -> str:
    return _named(value, f"t * {_power(bits)} % {MOD} + t // {_power(64 - bits)}")


def _spread(value: str, bits: int) -> str:
    return _named(value, f"xor(t, t // {_power(bits)})")


def _lane(acc: str, lane: str) -> str:
    """One lane of eight bytes taken into an accumulator."""
    return f"({_turned(f'({acc} + ({lane}) * {P2} % {MOD}) % {MOD}', 31)} * {P1} % {MOD})"


def _folded(start: str, items: str, step: str) -> str:
    """items folded into start by step, over a and b."""
    return f"list_reduce(list_prepend({start}, {items}), lambda a, b: {step})"


def _number(at: str, size: int) -> str:
    """The bytes of x, a hexadecimal text, from byte at, as a little-endian number."""
    return "(" + " + ".join(f"('0x' || substr(x, 2 * ({at} + {j}) + 1, 2))::UHUGEINT * {_power(8 * j)}" for j in range(size)) + ")"


_STARTS = (f"({START} + {P1} + {P2}) % {MOD}", f"({START} + {P2}) % {MOD}", START, f"({START} + {MOD} - {P1}) % {MOD}")
_ACCUMULATORS = ", ".join(f"{_folded(start, f'lanes[{k}:n // 32 * 4:4]', _lane('a', 'b'))} AS v{k}" for k, start in enumerate(_STARTS, 1))
_ZERO = "0::UHUGEINT"
_JOINED = " + ".join(_turned(f"v{k}", bits) for k, bits in enumerate((1, 7, 12, 18), 1))
_BITS = ", ".join(f"sum((h >> {b}) & 1) AS b{b}" for b in range(64))
_PRINT = " + ".join(f"CASE WHEN 2 * b{b} > shingles THEN {1 << b}::HUGEINT ELSE 0 END" for b in range(64))

OP5_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
g AS (SELECT row, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS k, w FROM d WHERE len(w) > 0),
x AS (SELECT row, lower(hex(encode(array_to_string(w[k:k + {SHINGLE - 1}], ' ')))) AS x FROM g),
n AS (SELECT row, x, len(x) // 2 AS n FROM x),
lanes AS (SELECT row, x, n, list_transform(range(0, n // 8), lambda i: {_number('8 * i', 8)}) AS lanes FROM n),
four AS (SELECT row, x, n, lanes, {_ACCUMULATORS} FROM lanes),
start AS (
  SELECT row, x, n, lanes, CASE WHEN n >= 32 THEN {_folded(f'(({_JOINED}) % {MOD})', '[v1, v2, v3, v4]', f"(xor(a, {_lane(_ZERO, 'b')}) * {P1} + {P4}) % {MOD}")} ELSE ({START} + {P5}) % {MOD} END AS h
  FROM four),
eights AS (SELECT row, x, n, {_folded(f'((h + n::UHUGEINT) % {MOD})', 'lanes[n // 32 * 4 + 1:]', f"({_turned(f'xor(a, {_lane(_ZERO, 'b')})', 27)} * {P1} + {P4}) % {MOD}")} AS h FROM start),
fours AS (SELECT row, x, n, CASE WHEN n % 8 >= 4 THEN ({_turned(f"xor(h, {_number('n // 8 * 8', 4)} * {P1} % {MOD})", 23)} * {P2} + {P3}) % {MOD} ELSE h END AS h FROM eights),
ones AS (
  SELECT row, {_folded('h', "list_transform(range(n // 4 * 4, n), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UHUGEINT)", f"{_turned(f'xor(a, b * {P5} % {MOD})', 11)} * {P1} % {MOD}")} AS h
  FROM fours),
hashes AS (SELECT row, ({_spread(f"({_spread(f'({_spread('h', 33)} * {P2} % {MOD})', 29)} * {P3} % {MOD})", 32)})::UBIGINT AS h FROM ones),
bits AS (SELECT row, count(*) AS shingles, {_BITS} FROM hashes GROUP BY row),
prints AS (SELECT d.row, doc_id, coalesce({_PRINT}, 0)::UBIGINT AS fp FROM d LEFT JOIN bits ON bits.row = d.row),
least AS (SELECT fp, min(doc_id) AS id FROM prints GROUP BY fp),
edges AS (SELECT a.fp AS a, b.fp AS b FROM least a JOIN least b ON bit_count(xor(a.fp, b.fp)::HUGEINT) <= {RADIUS}),
reach AS (SELECT fp AS a, fp AS b FROM least UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
component AS (SELECT r.a AS fp, min(l.id) AS component_id FROM reach r JOIN least l ON l.fp = r.b GROUP BY r.a)
SELECT doc_id, lower(lpad(hex(p.fp), 16, '0')) AS fingerprint, component_id FROM prints p JOIN component c ON c.fp = p.fp
"""

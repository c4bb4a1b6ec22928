"""The SimHash query as SQL for DuckDB: XXH64 in arithmetic modulo 2^64, bit majorities, and components by reachability.

Written as a function since the same few formulas (multiply, rotate, read eight bytes) stand in many places. Every pair of
fingerprints is compared, so it is for small tables.
"""

from __future__ import annotations

# The primes of XXH64, and the seed of the fingerprints.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
SEED, ALL = 42, 1 << 64


def _big(x: int) -> str:
    return f"{x}::UBIGINT"


def _sum(*terms: str) -> str:
    return f"(({' + '.join(f'({t})::UHUGEINT' for t in terms)}) % {ALL}::UHUGEINT)::UBIGINT"


def _times(a: str, prime: int) -> str:
    return f"(({a})::UHUGEINT * {prime}::UHUGEINT % {ALL}::UHUGEINT)::UBIGINT"


def _turned(a: str, bits: int) -> str:
    """Rotated to the left."""
    return f"(((({a}) & {_big((1 << (64 - bits)) - 1)}) << {bits}) | (({a}) >> {64 - bits}))"


def _read(at: str, size: int) -> str:
    """A little-endian number of the bytes from place ``at`` on, whose hexadecimal digits are x."""
    pairs = " || ".join(f"substr(x, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(size)))
    return f"('0x' || {pairs})::UBIGINT"


def _mixed(a: str, word: str) -> str:
    return _times(_turned(_sum(a, _times(word, P2)), 31), P1)


def _steps(source: str) -> tuple[str, str]:
    """Common table expressions that take the rest of the bytes, step by step, and the name of the last one."""
    out, last = [], source

    def step(name: str, size: int, word: str, bits: int, prime: int, plus: int) -> None:
        nonlocal last
        out.append(f"{name}a AS (SELECT g, x, n, o, CASE WHEN o + {size} <= n THEN xor(h, {word}) ELSE h END AS h, o + {size} <= n AS more FROM {last})")
        out.append(f"{name} AS (SELECT g, x, n, CASE WHEN more THEN o + {size} ELSE o END AS o, CASE WHEN more THEN {_sum(_times(_turned('h', bits), prime), _big(plus))} ELSE h END AS h FROM {name}a)")
        last = name

    for k in range(3):
        step(f"w{k}", 8, _mixed(_big(0), _read("o", 8)), 27, P1, P4)
    step("half", 4, _times(_read("o", 4), P1), 23, P2, P3)
    for k in range(3):
        step(f"b{k}", 1, _times(_read("o", 1), P5), 11, P1, 0)
    for k, (shift, prime) in enumerate(((33, P2), (29, P3), (32, 1))):
        out.append(f"z{k} AS (SELECT g, {_times(f'xor(h, h >> {shift})', prime)} AS h FROM {last})")
        last = f"z{k}"
    return ",\n".join(out), last


def oracle() -> str:
    lanes = ", ".join(f"{_mixed(f'v{k}', _read(f'o + {8 * k}', 8))} AS v{k}" for k in range(4))
    start = ", ".join(f"{_big(v % ALL)} AS v{k}" for k, v in enumerate((SEED + P1 + P2, SEED + P2, SEED, SEED - P1)))
    whole = _sum(*(_turned(f"v{k}", bits) for k, bits in enumerate((1, 7, 12, 18))))
    merges, last = [], "m"
    for k in range(4):
        merges.append(f"m{k} AS (SELECT g, x, n, o, v0, v1, v2, v3, {_sum(_times(f'xor(h, {_mixed(_big(0), f"v{k}")})', P1), _big(P4))} AS h FROM {last})")
        last = f"m{k}"
    steps, end = _steps("c")
    bits = " | ".join(f"CASE WHEN 2 * sum(CASE WHEN h & {_big(1 << k)} > 0 THEN c ELSE 0 END) > sum(c) THEN {_big(1 << k)} ELSE {_big(0)} END" for k in range(64))
    return rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) <= 3 THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]) END) AS g FROM w),
t AS MATERIALIZED (SELECT doc_id, g, count(*) AS c FROM s GROUP BY ALL),
d AS MATERIALIZED (SELECT g, hex(encode(g)) AS x, strlen(g) AS n FROM (SELECT DISTINCT g FROM t)),
r AS (SELECT g, x, n, 0::BIGINT AS o, {start} FROM d WHERE n >= 32 UNION ALL SELECT g, x, n, o + 32, {lanes} FROM r WHERE o + 32 <= n),
m AS (SELECT *, {whole} AS h FROM r WHERE o + 32 > n),
{",\n".join(merges)},
c AS (SELECT g, x, n, o, {_sum("h", "n::UBIGINT")} AS h FROM {last} UNION ALL SELECT g, x, n, 0, {_sum(_big(SEED + P5), "n::UBIGINT")} FROM d WHERE n < 32),
{steps},
f0 AS (SELECT doc_id, ({bits})::UBIGINT AS fp FROM t JOIN {end} USING (g) GROUP BY doc_id),
f AS MATERIALIZED (SELECT doc_id, coalesce(fp, 0) AS fp FROM w LEFT JOIN f0 USING (doc_id)),
u AS MATERIALIZED (SELECT fp, min(doc_id) AS low FROM f GROUP BY fp),
e AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM u AS a JOIN u AS b ON bit_count(xor(a.fp, b.fp)) <= 2),
k AS (SELECT a, b FROM e UNION SELECT k.a, e.b FROM k JOIN e ON k.b = e.a),
p AS (SELECT k.a AS fp, min(low) AS component_id FROM k JOIN u ON k.b = u.fp GROUP BY k.a)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component_id FROM f JOIN p USING (fp)
"""

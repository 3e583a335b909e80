"""SQL of the curve key for any small number of dimensions: one derived table per bit step, made from the published description and not from the kernels."""

from __future__ import annotations


def curve_key_sql(source: str, cols: list[str], bits: int, keep: str) -> str:
    """A query giving ``keep`` and ``hkey`` from ``source`` with integer columns ``cols``."""
    n = len(cols)
    xs = [f"x{i}" for i in range(n)]
    q = f"SELECT {keep}, " + ", ".join(f"({c})::BIGINT AS {x}" for c, x in zip(cols, xs, strict=True)) + f" FROM {source}"
    for level in range(bits - 1, 0, -1):
        top, low = 1 << level, (1 << level) - 1
        for i in range(n):
            if i == 0:
                new = {0: f"CASE WHEN x0 & {top} <> 0 THEN xor(x0, {low}) ELSE x0 END"}
            else:
                new = {0: f"CASE WHEN x{i} & {top} <> 0 THEN xor(x0, {low}) ELSE xor(x0, xor(x0, x{i}) & {low}) END", i: f"CASE WHEN x{i} & {top} <> 0 THEN x{i} ELSE xor(x{i}, xor(x0, x{i}) & {low}) END"}
            q = f"SELECT {keep}, " + ", ".join(f"{new[j]} AS x{j}" if j in new else f"x{j}" for j in range(n)) + f" FROM ({q})"
    for i in range(1, n):
        q = f"SELECT {keep}, " + ", ".join(f"xor(x{j}, x{j - 1}) AS x{j}" if j == i else f"x{j}" for j in range(n)) + f" FROM ({q})"
    t = "0::BIGINT"
    for level in range(bits - 1, 0, -1):
        t = f"xor({t}, CASE WHEN x{n - 1} & {1 << level} <> 0 THEN {(1 << level) - 1} ELSE 0 END)"
    q = f"SELECT {keep}, {t} AS t, {', '.join(xs)} FROM ({q})"
    terms = [f"(((xor(x{i}, t) >> {b}) & 1) << {b * n + n - 1 - i})" for b in range(bits) for i in range(n)]
    return f"SELECT {keep}, ({' + '.join(terms)})::BIGINT AS hkey FROM ({q})"


def wide_key_sql(source: str, column: str, bits: int, keep: str) -> str:
    """The same for points of any number of dimensions (a multiple of 4) in a list column: ``keep`` and ``hkey`` as hexadecimal text, which sorts like the position."""
    q = f"SELECT {keep}, list_transform({column}, lambda v: v::BIGINT) AS x FROM {source}"
    for level in range(bits - 1, 0, -1):
        top, low = 1 << level, (1 << level) - 1
        step = f"""CASE WHEN e[1] & {top} <> 0 THEN list_concat([xor(acc[1], {low})], acc[2:], e)
 ELSE list_concat([xor(acc[1], xor(acc[1], e[1]) & {low})], acc[2:], [xor(e[1], xor(acc[1], e[1]) & {low})]) END"""
        q = f"SELECT {keep}, list_reduce(list_transform(x[2:], lambda v: [v]), lambda acc, e: {step}, [CASE WHEN x[1] & {top} <> 0 THEN xor(x[1], {low}) ELSE x[1] END]) AS x FROM ({q})"
    q = f"SELECT {keep}, list_reduce(list_transform(x[2:], lambda v: [v]), lambda acc, e: list_append(acc, xor(acc[len(acc)], e[1])), [x[1]]) AS x FROM ({q})"
    t = "0::BIGINT"
    for level in range(bits - 1, 0, -1):
        t = f"xor({t}, CASE WHEN x[len(x)] & {1 << level} <> 0 THEN {(1 << level) - 1} ELSE 0 END)"
    q = f"SELECT {keep}, {t} AS t, x FROM ({q})"
    q = f"SELECT {keep}, list_transform(x, lambda v: xor(v, t)) AS x FROM ({q})"
    digit = lambda b: f"list_transform(range(len(x) // 4), lambda j: '0123456789ABCDEF'[(8 * ((x[4 * j + 1] >> {b}) & 1) + 4 * ((x[4 * j + 2] >> {b}) & 1) + 2 * ((x[4 * j + 3] >> {b}) & 1) + ((x[4 * j + 4] >> {b}) & 1) + 1)::BIGINT])"
    return f"SELECT {keep}, array_to_string(list_concat({', '.join(digit(b) for b in range(bits - 1, -1, -1))}), '') AS hkey FROM ({q})"

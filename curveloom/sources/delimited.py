"""Delimited point lines: a quote-aware finite-state tokenizer that parts readable rows from unreadable ones (problem 4)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table

# states: at the start of a field, in a plain field, in a quoted one, behind a quote in a quoted one, broken
START, PLAIN, QUOTED, BEHIND, BAD = range(5)
OTHER, SEP, QUOTE, END = range(4)
#: next state by class of byte and state
_NEXT = np.array(
    [
        [PLAIN, PLAIN, QUOTED, BAD, BAD],
        [START, START, QUOTED, START, BAD],
        [QUOTED, BAD, BEHIND, QUOTED, BAD],
        [START, START, START, START, START],
    ],
    np.int8,
)
#: Bytes whose joint transition is composed before states are known.
CHUNK = 256


def run_states(classes: np.ndarray) -> np.ndarray:
    """State after every byte, from START. Each chunk's map of states to states is composed byte by byte for all chunks at once, the maps are combined by
    doubling, and the chunks are run again from their true first state: a record may be of any length and cross any number of chunks."""
    n = len(classes)
    c = -(-max(n, 1) // CHUNK)
    grid = np.full((c, CHUNK), END, np.int8)
    grid.reshape(-1)[:n] = classes
    maps = np.tile(np.arange(5, dtype=np.int8), (c, 1))
    for k in range(CHUNK):
        maps = _NEXT[grid[:, k, None], maps]
    d = 1
    while d < c:
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d].astype(np.intp), axis=1)
        d *= 2
    state = np.zeros(c, np.int8)
    state[1:] = maps[:-1, START]
    out = np.empty((c, CHUNK), np.int8)
    for k in range(CHUNK):
        state = _NEXT[grid[:, k], state]
        out[:, k] = state
    return out.reshape(-1)[:n]


def tokenize(lines: list[bytes], seps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(error offset or -1, fields, first field of each line, field start, field stop)``; offsets are bytes of the joined lines, error offsets of the line."""
    size = np.array([len(x) + 1 for x in lines], np.int64)
    stop = np.cumsum(size) - 1
    begin = stop - size + 1
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    sep = np.repeat(seps, size)
    classes = np.where(data == sep, SEP, np.where(data == 0x22, QUOTE, OTHER)).astype(np.int8)
    classes[stop] = END
    after = run_states(classes)
    before = np.empty_like(after)
    before[0], before[1:] = START, after[:-1]
    error = np.full(len(lines), -1, np.int64)
    last = np.where(size > 1, before[stop], START)
    line_of = lambda at: np.searchsorted(stop, at)
    opened = np.nonzero((before == START) & (after == QUOTED))[0]
    if len(opened):  # an unclosed field is reported at its opening quote
        o = np.full(len(lines), -1, np.int64)
        o[line_of(opened)] = opened  # the last one of a line
        error = np.where(last == QUOTED, o - begin, error)
    broken = np.nonzero((after == BAD) & (before != BAD))[0]
    error[line_of(broken)] = broken - begin[line_of(broken)]
    cuts = np.nonzero((classes == SEP) & (after == START) | (classes == END))[0]
    owner = line_of(cuts)
    fields = np.bincount(owner, minlength=len(lines))
    first = np.cumsum(fields) - fields
    f_start = np.empty(len(cuts), np.int64)
    f_start[0:1], f_start[1:] = 0, cuts[:-1] + 1
    return error, fields, first, f_start, cuts


def line_maps(lines: DataFrame, separator: str = "comma") -> DataFrame:
    """``lines`` with ``from_closed`` and ``from_open``: whether a quote is open behind ``raw_line`` if none, or one, is open before it."""
    sep = 9 if separator == "tab" else 44

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            raw = [(x or "").encode("utf-8", "surrogatepass") for x in b["raw_line"].to_pylist()]
            both = [x.replace(b"\n", b" ") for x in raw] + [b'"' + x.replace(b"\n", b" ") for x in raw]  # a quote in front opens one
            stop = np.cumsum([len(x) + 1 for x in both]) - 1
            data = np.frombuffer(b"\n".join(both) + b"\n", np.uint8)
            classes = np.where(data == sep, SEP, np.where(data == 0x22, QUOTE, OTHER)).astype(np.int8)
            classes[stop] = END
            after = run_states(classes)
            last = np.where(np.diff(np.concatenate([[-1], stop])) > 1, after[np.maximum(stop - 1, 0)], START) == QUOTED
            note = np.array([x[:1] == b"#" for x in raw])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(last[: len(raw)] & ~note), pa.array(last[len(raw) :])], names=[*b.schema.names, "from_closed", "from_open"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)
    return lines.mapInArrow(run, kinds + ", from_closed boolean, from_open boolean")


_OUT = pa.schema([("file_id", pa.int32()), ("line_no", pa.int64()), ("reason", pa.string()), ("offset", pa.int64()), ("id", pa.string()), ("category", pa.string()), ("coords", pa.list_(pa.int32()))])


def _parse(batches):
    for b in batches:
        if not b.num_rows:
            continue
        lines = [x.encode("utf-8", "surrogatepass") for x in b["line"].to_pylist()]
        seps = np.where(b["tab"].to_numpy(zero_copy_only=False), 9, 44).astype(np.uint8)
        want, id_at, cat_at = (b[c].to_numpy(zero_copy_only=False) for c in ("n_columns", "id_at", "category_at"))
        error, fields, first, f_start, f_stop = tokenize(lines, seps)
        reason = np.where(error >= 0, "quoting", np.where(fields != want, "columns", "")).astype(object)
        good = np.nonzero(reason == "")[0]
        data = b"\n".join(lines) + b"\n"
        picks = np.repeat(first[good] - (np.cumsum(want[good]) - want[good]), want[good]) + np.arange(want[good].sum())
        raw = [data[s:e] for s, e in zip(f_start[picks].tolist(), f_stop[picks].tolist(), strict=True)]
        raw = [x[1:-1].replace(b'""', b'"') if x[:1] == b'"' else x for x in raw]
        text = pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())
        trimmed = pc.utf8_trim(text, characters=" ")
        number = pc.utf8_ltrim(trimmed, characters="0")
        digits = pc.match_substring_regex(trimmed, r"^[0-9]+$").to_numpy(zero_copy_only=False) & (pc.utf8_length(number).to_numpy(zero_copy_only=False) <= 10)
        value = pc.cast(pc.if_else(pa.array(digits), pc.if_else(pc.equal(number, ""), "0", number), "0"), pa.int64()).to_numpy(zero_copy_only=False)
        fits = digits & (value <= 2147483647)
        line = np.repeat(np.arange(len(good)), want[good])
        col = np.arange(len(line)) - np.repeat(np.cumsum(want[good]) - want[good], want[good])
        is_id, is_cat = col == id_at[good][line], col == cat_at[good][line]
        is_coord = ~is_id & ~is_cat
        empty = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)
        wrong = (is_id & empty) | (is_coord & ~fits)
        bad = np.zeros(len(good), bool)
        bad[line[wrong]] = True
        at = np.full(len(good), -1, np.int64)
        w = np.nonzero(wrong)[0][::-1]
        begin = np.cumsum([0] + [len(x) + 1 for x in lines])[:-1]
        at[line[w]] = f_start[picks[w]] - begin[good][line[w]]
        reason[good[bad]] = "value"
        offset = error.copy()
        offset[good] = at
        ids, cats = np.full(len(lines), None, object), np.full(len(lines), None, object)
        values = trimmed.to_numpy(zero_copy_only=False)
        ids[good[line[is_id]]] = values[is_id]
        cats[good[line[is_cat]]] = text.to_numpy(zero_copy_only=False)[is_cat]
        ok = reason == ""
        count = np.zeros(len(lines), np.int64)
        keep = is_coord & ok[good][line]
        np.add.at(count, good[line[keep]], 1)
        coords = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(value[keep].astype(np.int32)), mask=pa.array(~ok))
        blank = lambda v: pa.array([x if k else None for x, k in zip(v, ok, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([b["file_id"].cast(pa.int32()), b["line_no"].cast(pa.int64()), pa.array([r or None for r in reason], pa.string()), pa.array([int(o) if r else None for o, r in zip(offset, reason, strict=True)], pa.int64()), blank(ids), blank(cats), coords], schema=_OUT)


def parse_lines(lines: DataFrame, configs: DataFrame) -> DataFrame:
    """``(file_id, line_no, reason, offset, id, category, coords)``: valid rows with reason null, the others with the first reason that applies.

    ``lines(file_id, line_no, raw_line)`` with repeats of a line as one (the smallest text should they differ); ``configs`` as in the table
    data_configs. Reasons are ``quoting``, ``columns`` and ``value``; ``offset`` is the byte of the line where reading failed, -1 for a wrong count.
    Left out: headers, lines of blanks and tabs, comments, lines without a number or text (null) and files without a configuration. A
    carriage return at the end isn't part of a line. Without an id column the id is the line number; without a category column it is null.
    """
    spark = lines.sparkSession
    c = configs.where("file_id is not null and n_columns is not null").dropDuplicates(["file_id"])

    def place(field: str):
        named = F.expr(f"array_position(transform(column_names, x -> lower(x)), lower({field}))").cast("int") - 1
        numbered = F.coalesce(F.expr(f"try_cast({field} as int)"), F.lit(0)) - 1
        at = F.when(F.upper(field).isin("ROWNUM", "?"), -1).otherwise(F.when(F.col("read_header"), named).otherwise(numbered))
        at = F.coalesce(at, F.lit(-1))
        return F.when((at >= 0) & (at < F.col("n_columns")), at).otherwise(-1)

    c = c.select("file_id", F.coalesce("read_header", F.lit(False)).alias("read_header"), F.coalesce(F.col("field_sep") == "tab", F.lit(False)).alias("tab"), "n_columns", place("id_field").alias("id_at"), place("category_field").alias("category_at"))
    one = lines.select("file_id", "line_no", "raw_line").where("file_id is not null and line_no is not null and raw_line is not null")
    one = one.groupBy("file_id", "line_no").agg(F.min("raw_line").alias("raw_line"))
    one = one.withColumn("line", F.expr(r"regexp_replace(raw_line, '\\r\\z', '')")).where(r"not (line rlike '^[ \\t]*\\z') and not startswith(line, '#')")
    j = one.join(c, "file_id").where("not (read_header and line_no = 1)").select("file_id", "line_no", "line", "tab", "n_columns", "id_at", "category_at")
    out = j.mapInArrow(_parse, "file_id int, line_no bigint, reason string, offset bigint, id string, category string, coords array<int>")
    return out.withColumn("id", F.when(F.col("reason").isNull(), F.coalesce("id", F.col("line_no").cast("string"))))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(table(spark, sf_dir, "raw_lines"), table(spark, sf_dir, "data_configs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).where("reason is not null").select("file_id", "line_no", "reason")


def p4_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readable rows; coords as text, for comparison."""
    return _parsed(spark, sf_dir).where("reason is null").select("file_id", "line_no", "id", F.coalesce("category", F.lit("")).alias("category"), F.concat_ws(" ", F.transform("coords", lambda x: x.cast("string"))).alias("coords"))


QUERIES = {"p4_found": p4_found, "p4_points": p4_points}

_SQL = r"""
WITH c AS (SELECT file_id, read_header, CASE field_sep WHEN 'tab' THEN chr(9) ELSE ',' END AS sep, n_columns,
  CASE WHEN read_header THEN coalesce(list_position(list_transform(column_names, lambda x: lower(x)), lower(id_field)), 0) ELSE coalesce(try_cast(id_field AS INT), 0) END AS id_at,
  CASE WHEN read_header THEN coalesce(list_position(list_transform(column_names, lambda x: lower(x)), lower(category_field)), 0) ELSE coalesce(try_cast(category_field AS INT), 0) END AS cat_at FROM data_configs),
l AS (SELECT file_id, line_no, min(raw_line) AS raw FROM raw_lines WHERE raw_line IS NOT NULL GROUP BY ALL),
t AS (SELECT l.file_id, l.line_no, CASE WHEN ends_with(raw, chr(13)) THEN left(raw, length(raw) - 1) ELSE raw END AS line, c.* EXCLUDE (file_id) FROM l JOIN c USING (file_id) WHERE NOT (c.read_header AND l.line_no = 1)),
u AS (SELECT *, CASE WHEN sep = ',' THEN regexp_full_match(line, '(?:"(?:[^"]|"")*"|[^",][^",]*|)(?:,(?:"(?:[^"]|"")*"|[^",][^",]*|))*', 's') ELSE regexp_full_match(line, '(?:"(?:[^"]|"")*"|[^"\t][^"\t]*|)(?:\t(?:"(?:[^"]|"")*"|[^"\t][^"\t]*|))*', 's') END AS closed,
  CASE WHEN sep = ',' THEN regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1, 's') ELSE regexp_extract_all(chr(9) || line, '\t("(?:[^"]|"")*"|[^"\t]*)', 1, 's') END AS raw_fields
  FROM t WHERE NOT regexp_full_match(line, '[ \t]*') AND NOT starts_with(line, '#')),
v AS (SELECT *, list_transform(raw_fields, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:length(x) - 1], '""', '"') ELSE x END) AS fields FROM u),
w AS (SELECT *, list_filter(list_transform(fields, lambda x, i: CASE WHEN i <> id_at AND i <> cat_at THEN trim(x, ' ') END), lambda x: x IS NOT NULL) AS coords FROM v),
r AS (SELECT *, CASE WHEN NOT closed THEN 'quoting' WHEN len(fields) <> n_columns THEN 'columns'
  WHEN (id_at BETWEEN 1 AND n_columns AND trim(fields[id_at], ' ') = '') OR len(list_filter(coords, lambda x: NOT regexp_full_match(x, '[0-9]+') OR coalesce(try_cast(x AS HUGEINT), 99999999999) > 2147483647)) > 0 THEN 'value' END AS reason FROM w)
"""
SQL = {
    "p4_found": _SQL + "SELECT file_id, line_no, reason FROM r WHERE reason IS NOT NULL",
    "p4_points": _SQL
    + "SELECT file_id, line_no, CASE WHEN id_at BETWEEN 1 AND n_columns THEN trim(fields[id_at], ' ') ELSE line_no::VARCHAR END AS id, CASE WHEN cat_at BETWEEN 1 AND n_columns THEN fields[cat_at] ELSE '' END AS category, array_to_string(list_transform(coords, lambda x: x::BIGINT::VARCHAR), ' ') AS coords FROM r WHERE reason IS NULL",
}

"""Problem 6: evaluation passages inside a corpus, by q-gram lemma filtering and banded alignment."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table

#: Words in a row that make a leak, characters of a gram, edits allowed in a region, cost of an edit in the alignment.
WORDS, Q, EDITS, COST = 12, 8, 1, 3
#: Most characters of evaluation passages held by a task; more passages are searched in several blocks.
ITEM_CHARS = 20_000_000

_DROP = {0x00AD: None, 0x200B: None, 0x200C: None, 0x200D: None, 0xFEFF: None}
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKC, lower-casing and removal of soft hyphens and zero-width characters; null has none."""
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower().translate(_DROP)) if text else []


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Rolling hash of every q characters, by doubling."""
    h, n, mult = codes.astype(np.uint64), 1, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while n * 2 <= q:
            h = (h[:-n] * mult if n else h) + (h[n:] ^ (h[n:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
            n *= 2
    return h[: max(0, len(codes) - q + 1)]


def _range_least(rank: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Place of the least rank in each range [lo, hi), by a table of doubling spans."""
    size = hi - lo
    out = np.zeros(len(lo), np.int64)
    span, best = 1, np.arange(len(rank))
    while True:
        own = np.nonzero((size >= span) & (size < 2 * span))[0]
        x, y = best[lo[own]], best[hi[own] - span]
        out[own] = np.where(rank[x] <= rank[y], x, y)
        if 2 * span > size.max(initial=0) or 2 * span > len(rank):
            return out
        x, y = best[:-span], best[span:]
        best, span = np.where(rank[x] <= rank[y], x, y), 2 * span


class PassageIndex:
    """Passages with all their grams and, for the search, seeds: of every run of ``words`` words cut into ``edits + 1`` pieces the rarest gram of each piece.

    An edit touches one piece only, so a region with at most ``edits`` edits keeps the seed of a piece. Rarest means fewest places among the passages and in
    ``sample`` texts; the choice changes the work, never the result. ``q`` is a power of two; a passage of fewer than ``words`` words can't leak and isn't kept.
    """

    def __init__(self, items: list[tuple[int, str]], words: int, q: int, edits: int = EDITS, sample: list[list[str]] | None = None):
        self.words, self.q, self.vocabulary = words, q, {}
        self.ids, self.word_ids, self.texts, self.least = [], [], [], []
        grams, windows, pieces = [], [], edits + 1
        at = 0
        for item, passage in items:
            w = words_of(passage)
            if len(w) < words or item is None:
                continue
            ends = np.cumsum([len(x) + 1 for x in w])
            starts = ends - [len(x) + 1 for x in w]
            c = _codes(w)
            first, last = starts[: len(w) - words + 1], ends[words - 1 :] + 1  # with the blanks around
            for k in range(pieces):
                lo, hi = first + (last - first) * k // pieces, first + (last - first) * (k + 1) // pieces - q + 1
                if (hi <= lo).any():  # pieces shorter than a gram: every gram is a seed
                    lo = np.arange(len(c) - q + 1)
                    hi = lo + 1
                windows.append(np.stack([at + lo, at + hi], axis=1))
            g = _grams(c, q)
            grams.append(g)
            at += len(g)
            self.ids.append(item), self.texts.append(c), self.least.append(int((last - first).min()))
            self.word_ids.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w]))
        self.least = np.array(self.least, np.int64)
        size = np.array([len(t) for t in self.texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.all = np.concatenate(self.texts) if self.texts else np.zeros(0, np.uint32)
        self.grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.gram_at = np.concatenate([[0], np.cumsum(size - q + 1)]).astype(np.int64)
        self.bits = np.zeros(1 << 20, bool)
        if not len(self.grams):
            self.keys, self.start, self.stop, self.owner, self.place = (np.zeros(0, np.int64),) * 5
            return
        known, which, often = np.unique(self.grams, return_inverse=True, return_counts=True)
        if sample:
            seen = np.sort(_grams(np.concatenate([_codes(w) for w in sample]), q))
            often = often + np.searchsorted(seen, known, "right") - np.searchsorted(seen, known, "left")
        order = np.lexsort((known, often))
        rank = np.empty(len(known), np.int64)
        rank[order] = np.arange(len(known))
        win = np.concatenate(windows)
        seeds = np.unique(_range_least(rank[which], win[:, 0], win[:, 1]))
        owner = np.searchsorted(self.gram_at, seeds, side="right") - 1
        g = self.grams[seeds]
        o = np.argsort(g, kind="stable")
        self.keys, self.start = np.unique(g[o], return_index=True)
        self.stop = np.append(self.start[1:], len(g))
        self.owner, self.place = owner[o], (seeds - self.gram_at[owner])[o]
        self.bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True


#: Gram comparisons and seed hits held at once.
HELD = 4_000_000


def _candidates(index: PassageIndex, g: np.ndarray, off: np.ndarray, width: int) -> np.ndarray:
    """Distinct (document, passage, band) that a seed points to; bands of ``2 * width`` diagonals overlap by half."""
    at = np.nonzero(index.bits[(g >> np.uint64(44)).astype(np.int64)])[0]
    k = np.minimum(np.searchsorted(index.keys, g[at]), len(index.keys) - 1)
    ok = index.keys[k] == g[at]
    at, k = at[ok], k[ok]
    doc = np.searchsorted(off, at, side="right") - 1
    ok = at + index.q <= off[doc + 1]
    at, k, doc = at[ok], k[ok], doc[ok]
    many = index.stop[k] - index.start[k]
    upto, out = np.cumsum(many), [np.zeros((0, 3), np.int64)]
    cuts = np.unique(np.append(np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, HELD)), len(at)))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        m = many[lo:hi]
        src = np.repeat(np.arange(lo, hi), m)
        post = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(index.start[k[lo:hi]], m)
        band = np.floor_divide(at[src] - off[doc[src]] - index.place[post], width)
        one = np.stack([doc[src], index.owner[post], band], axis=1)
        out.append(np.unique(np.concatenate([one, one - [0, 0, 1]]), axis=0))
    return np.unique(np.concatenate(out), axis=0)


def _shared_grams(index: PassageIndex, g: np.ndarray, off: np.ndarray, found: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams that document and passage share within each band, and the first and last of them in the document."""
    n = len(found)
    count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
    size = np.diff(index.gram_at)[found[:, 1]]
    upto = np.cumsum(size)
    cuts = np.unique(np.append(np.searchsorted(upto, np.arange(0, upto[-1] if n else 0, HELD // (2 * width))), n))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        d, i, b = found[lo:hi].T
        m = size[lo:hi]
        row = np.repeat(np.arange(hi - lo), m)
        j = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        want = index.grams[index.gram_at[i][row] + j]
        room = (off[d + 1] - off[d] - index.q + 1)[row]
        for k in range(2 * width):
            pos = j + (b * width + k)[row]
            ok = (pos >= 0) & (pos < room)
            ok[ok] = g[(off[d][row] + pos)[ok]] == want[ok]
            r, x = row[ok] + lo, pos[ok]
            count[lo:hi] += np.bincount(r - lo, minlength=hi - lo)
            np.minimum.at(first, r, x)
            np.maximum.at(last, r, x)
    return count, first, last


def longest_run(a: np.ndarray, p: np.ndarray) -> int:
    """Most words in a row that both number sequences have; -1 is a word of neither."""
    order = np.argsort(p, kind="stable")
    lo, hi = np.searchsorted(p[order], a, "left"), np.searchsorted(p[order], a, "right")
    many = np.where(a >= 0, hi - lo, 0)
    i = np.repeat(np.arange(len(a)), many)
    if not len(i):
        return 0
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
    o = np.lexsort((i, i - j))
    i, diagonal = i[o], (i - j)[o]
    breaks = np.nonzero((np.diff(i) != 1) | (np.diff(diagonal) != 0))[0] + 1
    return int(np.diff(np.concatenate([[0], breaks, [len(i)]])).max())


def _align(text: np.ndarray, doc_lo: np.ndarray, doc_hi: np.ndarray, item_lo: np.ndarray, item_hi: np.ndarray, all_items: np.ndarray, diagonal: np.ndarray, band: int, cost: int):
    """Best local alignment score and its end in the document, for regions in parallel: one step per character, ``band`` diagonals wide."""
    n = len(doc_lo)
    best, end = np.zeros(n, np.int32), doc_lo.copy()
    order = np.argsort(doc_hi - doc_lo)
    for lo in range(0, n, 20_000):
        own = order[lo : lo + 20_000]
        a, z, il, ih, d0 = doc_lo[own], doc_hi[own], item_lo[own], item_hi[own], diagonal[own]
        h = np.zeros((len(own), band + 2), np.int32)
        for step in range(int((z - a).max(initial=0))):
            live = np.searchsorted(z - a, step, side="right")  # regions go by length
            i = a[live:] + step
            j = i[:, None] - d0[live:, None] - np.arange(band)[None, :]  # place in the passage
            inside = (j >= 0) & (j < (ih - il)[live:, None])
            same = inside & (all_items[np.where(inside, il[live:, None] + j, 0)] == text[i][:, None])
            old = h[live:]
            new = np.zeros_like(old)
            new[:, 1:-1] = np.maximum(0, np.maximum(old[:, 1:-1] + np.where(same, 1, -cost), old[:, :-2] - cost))
            for k in range(band - 1, 0, -1):
                np.maximum(new[:, k], new[:, k + 1] - cost, out=new[:, k])
            new[:, 1:-1] = np.where(inside, new[:, 1:-1], 0)
            h[live:] = new
            top = new.max(axis=1)
            up = top > best[own[live:]]
            best[own[live:][up]], end[own[live:][up]] = top[up], i[up] + 1
    return best, end


def find_regions(index: PassageIndex, word_lists: list[list[str]], edits: int, cost: int) -> tuple[np.ndarray, ...]:
    """(document, passage, score, end) of every band region whose local alignment keeps the edit budget.

    A region of at least m characters with at most e edits keeps a seed and shares m - q + 1 - q * e grams within e neighbouring diagonals, where m is the
    length of the passage's shortest run of ``words`` words; fewer can't hold a leak. Repeated grams only add to a count, never lose any.
    Work follows the text and the bands that seeds point to: a common gram is a seed only where a piece of a passage has none rarer.
    """
    none = (np.zeros(0, np.int64),) * 4
    texts = [_codes(w) for w in word_lists]
    if not texts or not len(index.keys):
        return none
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text, width = np.concatenate(texts), edits + 1
    g = _grams(text, index.q)
    found = _candidates(index, g, off, width)
    n, first, last = _shared_grams(index, g, off, found, width)
    ok = n >= np.maximum(1, index.least[found[:, 1]] - index.q + 1 - index.q * edits)
    (d, i, b), first, last = found[ok].T, first[ok], last[ok]
    if not len(d):
        return none
    pad = index.q * (edits + 1)
    lo, hi = off[d] + np.maximum(first - pad, 0), np.minimum(off[d] + last + index.q + pad, off[d + 1])
    score, end = _align(text, lo, hi, index.offsets[i], index.offsets[i + 1], index.all, off[d] + b * width - edits, 2 * width + 2 * edits, cost)
    ok = score >= index.least[i] - (1 + cost) * edits
    return d[ok], i[ok], score[ok], (end - off[d])[ok]


_INDEXES: dict = {}


def _index_of(name: str, items: list, words: int, q: int, edits: int, sample: list[list[str]]) -> PassageIndex:
    """The index of a block of passages, built once by each Python worker."""
    if name not in _INDEXES:
        while len(_INDEXES) > 1:
            _INDEXES.pop(next(iter(_INDEXES)))
        _INDEXES[name] = PassageIndex(items, words, q, edits, sample)
    return _INDEXES[name]


def leaked_passages(docs: DataFrame, items: DataFrame, words: int = WORDS, q: int = Q, edits: int = EDITS, cost: int = COST, item_chars: int = ITEM_CHARS) -> DataFrame:
    """``(doc_id, item_id, score, run_words)``: passages of ``items(item_id, passage)`` found in ``docs(doc_id, text)``, best region each.

    Every region of a document that equals a run of ``words`` words of a passage but for at most ``edits`` characters is found. ``score`` is that of the local alignment (matching characters less ``cost`` an edit), ``run_words`` the longest run of words both have.
    Documents are read once per block of passages and never shuffled; whole texts are searched. Null or empty texts and passages, and passages of
    fewer than ``words`` words, give no row; equal documents or passages give a row each. Passages are sent to the tasks only in blocks of
    ``item_chars`` characters, whatever their number.
    """
    spark = docs.sparkSession
    sizes = items.where("item_id is not null and passage is not null").select("item_id", "passage")
    total = sizes.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // item_chars))
    out = None
    for k in range(blocks):
        rows = sizes.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).distinct().orderBy("item_id").collect()  # bounded by item_chars
        given = spark.sparkContext.broadcast([tuple(r) for r in rows])

        def search(batches: Iterator[pd.DataFrame], given=given, name=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            for b in batches:
                for lo in range(0, len(b), 2000):
                    part = b.iloc[lo : lo + 2000]
                    lists = [words_of(t) for t in part.text]
                    index = _index_of(name, given.value, words, q, edits, lists[:200])
                    d, i, score, _ = find_regions(index, lists, edits, cost)
                    best: dict = {}
                    for x, y, s in zip(d.tolist(), i.tolist(), score.tolist(), strict=True):
                        best[x, y] = max(s, best.get((x, y), 0))
                    ids, rows, numbers = part.doc_id.to_numpy(), [], {}
                    for (x, y), s in best.items():
                        if x not in numbers:
                            numbers[x] = np.array([index.vocabulary.get(w, -1) for w in lists[x]])
                        rows.append((int(ids[x]), int(index.ids[y]), s, longest_run(numbers[x], index.word_ids[y])))
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "run_words"])

        found = docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(search, "doc_id bigint, item_id bigint, score int, run_words int")
        out = found if out is None else out.unionByName(found)
    return out


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).where(F.col("run_words") >= WORDS).select("doc_id", "item_id").distinct()


QUERIES = {"p6_found": p6_found, "p6_leaks": p6_leaks}
#: What compatibility composition changes in Latin text, for SQL, which only has canonical composition: full-width forms, raised signs and fractions.
_WIDE, _NARROW = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "ªº²³¹", "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''") + "ao231"
_TEXT = f"translate(replace(replace(replace(@, '¼', '1⁄4'), '½', '1⁄2'), '¾', '3⁄4'), '{_WIDE}', '{_NARROW}')"
_LIST = r"regexp_extract_all(regexp_replace(lower(nfc_normalize({0})), '[\x{{00AD}}\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}]', '', 'g'), '[\p{{L}}\p{{N}}]+')"
_RUNS = "SELECT {0}, array_to_string(w[k:k + 11], ' ') AS s FROM (SELECT {0}, w, unnest(range(1, len(w) - 10)) AS k FROM (SELECT {0}, {1} AS w FROM {2}))"
SQL = {
    "p6_found": "SELECT DISTINCT doc_id, item_id FROM ("
    + _RUNS.format("doc_id", _LIST.format(_TEXT.replace("@,", "text,")), "documents")
    + ") JOIN ("
    + _RUNS.format("item_id", _LIST.format(_TEXT.replace("@,", "passage,")), "eval_items")
    + ") USING (s)"
}

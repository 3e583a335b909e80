"""Problem 8: subject areas of documents, by weighted terms in a multi-pattern automaton and calibrated thresholds."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Stages, table

#: Sentences a term must be in, share of them about its subject while terms are gathered and in the end, and rounds of curation.
LEAST, PURITY, STRONG, ROUNDS = 4, 0.6, 0.7, 4

_TAG, _CUT, _WORD = re.compile(r"</?[a-zA-Z][^<>]{0,80}>"), re.compile(r"[.!?…:]+[\s)\"'»]+|[.!?…:]+$"), re.compile(r"[^\W\d_]+")
_DROP = {0x00AD: None, 0x200B: None, 0x200C: None, 0x200D: None, 0xFEFF: None}


def sentences_of(text: str | None) -> list[list[str]]:
    """Sentences as lower-case words without accents. Markup, character references, zero-width characters and twice-encoded UTF-8 are mended first."""
    if not text:
        return []
    if "&" in text or "<" in text:
        text = _TAG.sub(" ", html.unescape(text))
    if "Ã" in text or "â€" in text or "Â" in text:
        for codec in ("cp1252", "latin-1"):
            try:
                text = text.encode(codec).decode("utf-8")
                break
            except UnicodeError:
                continue
    text = unicodedata.normalize("NFKC", text).translate(_DROP).lower()
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return [w for s in _CUT.split(text) if (w := _WORD.findall(s))]


def automaton(terms: dict[str, tuple[str, float]], joined: set):
    """Multi-pattern matcher of a sentence's words: ``(subject, term, weight, place)`` of every mention, from the automaton's own hits.

    The patterns are all terms and all phrases: ``joined`` holds tuples of the words of a phrase, whose first and last are terms. Hits of terms of one subject
    that hits of phrases tie are one mention, of the largest weight among them.
    """
    import ahocorasick

    a = ahocorasick.Automaton()
    for w, (subject, weight) in terms.items():
        a.add_word(f" {w} ", (1, len(w) + 2, subject, weight))
    for words in joined:
        a.add_word(p := f" {' '.join(words)} ", (len(words), len(p), "", 0.0))
    if not terms:
        return lambda words: []
    a.make_automaton()

    def match(words: list[str]) -> list[tuple[str, str, float, int]]:
        line = f" {' '.join(words)} "
        hits = list(a.iter(line))
        if not hits:
            return []
        single, tied, blanks = {}, set(), list(accumulate((len(w) + 1 for w in words), initial=0))
        for end, (n, size, subject, weight) in hits:
            at = bisect_left(blanks, end - size + 1)
            if n == 1:
                single[at] = (subject, weight)
            else:
                tied.add((at, at + n - 1))
        out, last = [], -9
        for at in sorted(single):
            subject, weight = single[at]
            if out and out[-1][0] == subject and (last, at) in tied:
                _, _, most, first = out[-1]
                out[-1] = (subject, " ".join(words[first : at + 1]), max(most, weight), first)
            else:
                out.append((subject, words[at], weight, at))
            last = at
        return out

    return match


def _treats(found) -> bool:
    """Two different mentions, or one of many words: a thing named in passing is one short mention."""
    names = set(found)
    return len(names) >= 2 or any(n.count(" ") >= 3 for n in names)


#: Entries a task counts before it hands them on.
FLUSH = 200_000


def _agreeing(terms: dict[str, tuple[str, float]]):
    """Words of a sentence about one subject, with it: those beside another term of it, or all if one other subject is only named in passing."""

    def count(words: list[str]) -> Iterator[tuple[str, str]]:
        uniq = set(words)
        here = Counter(terms[w][0] for w in uniq if w in terms)
        if len(here) == 1:
            ((subject, k),) = here.items()
            yield from ((w, subject) for w in uniq if k - (w in terms) >= 1)
        elif here:
            (s1, k1), (_, k2) = here.most_common(2)
            if k1 >= 3 and k2 == 1:
                yield from ((w, s1) for w in uniq if terms.get(w, (s1,))[0] == s1)

    return count


def _phrases(terms: dict[str, tuple[str, float]]):
    """Terms of a sentence, and the terms of one subject that follow each other or with a short word between."""

    def count(words: list[str]) -> Iterator[tuple[str, str]]:
        for i, w in enumerate(words):
            if w in terms:
                yield w, ""
                if i + 1 < len(words) and terms.get(words[i + 1], ("",))[0] == terms[w][0]:
                    yield " ".join(words[i : i + 2]), ""
                if i + 2 < len(words) and words[i + 1] not in terms and len(words[i + 1]) <= 4 and terms.get(words[i + 2], ("",))[0] == terms[w][0]:
                    yield " ".join(words[i : i + 3]), ""

    return count


def _surroundings(terms: dict[str, tuple[str, float]], joined: set):
    """Other words of a sentence that treats a subject ("many") or only names one ("one"); the sentence itself counts as the word ""."""
    match = automaton(terms, joined)

    def count(words: list[str]) -> Iterator[tuple[str, str]]:
        if m := match(words):
            kind = "many" if _treats([t for _, t, _, _ in m]) else "one"
            yield "", kind
            yield from ((w, kind) for w in set(words) if w not in terms)

    return count


def _tally(pool: DataFrame, counter, *given) -> DataFrame:
    """``(w, kind, k)``: how often ``counter(*given)`` gives each (w, kind), over all sentences."""
    known = pool.sparkSession.sparkContext.broadcast(given)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, c = counter(*known.value), Counter()
        show = lambda: pd.DataFrame([(w, kind, k) for (w, kind), k in c.items()], columns=["w", "kind", "k"])
        for b in batches:
            for line in b.line:
                c.update(found(line.split(" ")))
                if len(c) > FLUSH:
                    yield show()
                    c.clear()
        yield show()

    return pool.mapInPandas(count, "w string, kind string, k bigint").groupBy("w", "kind").agg(F.sum("k").alias("k"))


def sentence_pool(docs: DataFrame) -> DataFrame:
    """``(line)``: every sentence of every document, words parted by a blank."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"line": [" ".join(s) for t in b.text for s in sentences_of(t)]}, dtype=object)

    return docs.select("text").mapInPandas(cut, "line string")


def seed_terms(labelled: DataFrame, least: int = LEAST) -> dict[str, tuple[str, float]]:
    """First terms: words whose documents mostly bear one subject, counted over all ``labelled(text, subjects)``."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, list(s)) for t, s in zip(b.text, b.subjects, strict=True) for w in {w for line in sentences_of(t) for w in line}]
            yield pd.DataFrame(rows, columns=["w", "subjects"])

    w = labelled.select("text", "subjects").mapInPandas(words, "w string, subjects array<string>")
    size = max(1, labelled.count())
    base = labelled.select(F.explode("subjects").alias("subject")).groupBy("subject").agg((F.count("*") / size).alias("base"))
    every = w.groupBy("w").agg(F.count("*").alias("n"))
    by = w.select("w", F.explode("subjects").alias("subject")).groupBy("w", "subject").agg(F.count("*").alias("k")).where(F.col("k") >= min(3, least))
    p = by.join(every, "w").join(F.broadcast(base), "subject").withColumn("p", (F.col("k") + F.col("base")) / (F.col("n") + 1))  # base: a row per subject
    p = p.where(F.col("p") >= F.greatest(F.lit(0.65), 2.2 * F.col("base"))).groupBy("w").agg(F.max_by(F.struct("subject", "p"), F.struct("p", "subject")).alias("x"))
    return {r.w: (r.x.subject, r.x.p) for r in p.collect()}  # follows the vocabulary


def curate_terms(labelled: DataFrame, pool: DataFrame, least: int = LEAST, purity: float = PURITY, rounds: int = ROUNDS) -> dict:
    """Subject terms, phrases, context words and thresholds from ``labelled(doc_id, text, subjects)`` and ``pool(line)``, all sentences of the corpus.

    :func:`seed_terms` gives first terms; then a word is kept if most sentences it is in also hold another term
    of the same subject and none of a different one. Labels may be wrong or missing: they only seed the terms and set the thresholds.
    All counts (seeds, words, pairs, contexts, rarity, agreement with the labels) are distributed aggregates; the driver holds what is admitted, which follows the vocabulary.
    """
    terms = seed_terms(labelled, least)
    work = Stages(pool.sparkSession, "subjects")
    pool = work.write(pool)
    seen = work.write(pool.select(F.explode(F.array_distinct(F.split("line", " "))).alias("w")).groupBy("w").agg(F.count("*").alias("seen")).where(F.col("seen") >= least))
    for _ in range(rounds):
        good = _tally(pool, _agreeing, terms).where((F.col("k") >= least) & (F.length("w") > 1)).join(seen, "w").withColumn("p", F.col("k") / F.col("seen")).where(F.col("p") >= purity)
        new = {r.w: (r.kind, r.p) for r in good.collect()}
        if new.keys() == terms.keys():
            terms = new
            break
        terms = new or terms
    terms = {w: t for w, t in terms.items() if t[1] >= STRONG}
    # phrases: neighbouring terms that hardly occur apart
    single, pair = Counter(), Counter()
    for r in _tally(pool, _phrases, terms).where("k >= 2 or not contains(w, ' ')").collect():
        if " " in r.w:
            pair[tuple(r.w.split(" "))] = r.k
        else:
            single[r.w] = r.k
    joined = {k for k, c in pair.items() if c >= 2 and c >= 0.6 * max(single[k[0]], single[k[-1]])}
    joined |= {k for k, c in pair.items() if c >= 3 and c >= 0.85 * min(single[k[0]], single[k[-1]]) and len(k) == 2}
    # rarity of terms, and the words of sentences that treat a subject against those that only name one
    total = max(1, pool.count())
    terms = {w: (s, p * min(1.0, math.log(total / (1 + single[w]) + 1) / math.log(30))) for w, (s, p) in terms.items()}
    around = _tally(pool, _surroundings, terms, joined).groupBy("w").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == x, F.col("k"))), F.lit(0)).alias(x) for x in ("many", "one")))
    around = around.where((F.col("many") + F.col("one") >= 2 * least) | (F.col("w") == "")).collect()
    many, one = {r.w: r.many for r in around}, {r.w: r.one for r in around}
    n_many, n_one = many.pop("", 0), one.pop("", 0)
    context = {w: max(-3.0, min(3.0, math.log((many[w] + 0.5) / (n_many + 1)) - math.log((one[w] + 0.5) / (n_one + 1)))) for w in many}
    model = {"terms": terms, "joined": joined, "context": context}
    return model | {"thresholds": calibrated(labelled, model)}


#: Thresholds tried for a subject.
TRIED = (0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5)


def calibrated(labelled: DataFrame, model: dict) -> dict[str, float]:
    """For each subject the lowest threshold that agrees best (F measure, to 0.001) with the labels of ``labelled(doc_id, text, subjects)``; 1.0 if none agrees."""
    scored = subject_areas(labelled, model | {"thresholds": {}}, least=0.0).select("doc_id", "subject", "score")
    given = labelled.select("doc_id", F.explode("subjects").alias("subject")).distinct().withColumn("given", F.lit(True))
    both = scored.join(given, ["doc_id", "subject"], "full").select("subject", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("given", F.lit(False)).alias("given"))
    sums = [F.struct(F.lit(t).alias("t"), F.count_if((F.col("score") >= t) & F.col("given")).alias("tp"), F.count_if((F.col("score") >= t) != F.col("given")).alias("wrong")) for t in TRIED]
    out = {}
    for r in both.groupBy("subject").agg(F.array(*sums).alias("x")).collect():  # a row per subject
        best = (-1.0, 1.0)
        for x in r.x:
            f = 2 * x.tp / (2 * x.tp + x.wrong) if x.tp else 0.0
            if f > best[0] + 1e-3:
                best = (f, x.t)
        out[r.subject] = best[1]
    return out


def score_document(doc: list[list[str]], context: dict[str, float], match) -> dict[str, float]:
    """Largest sentence score of each subject: weights of its distinct terms, less for very long runs of words; a lone term counts as far as the
    words around it are those of sentences that treat a subject, and not beside two terms of another one."""
    best: dict[str, float] = {}
    for words in doc:
        m = match(words)
        if not m:
            continue
        by: dict[str, dict[str, float]] = defaultdict(dict)
        for s, t, w, _ in m:
            by[s][t] = max(w, by[s].get(t, 0))
        top = max(len(x) for x in by.values())
        for s, found in by.items():
            score = sum(sorted(found.values(), reverse=True)[:3]) / max(1.0, len(words) / 60) ** 0.5
            if _treats(found):
                score += 0.5
            elif top >= 2:
                continue
            else:
                ctx = [context[w] for w in set(words) if w in context]
                lean = sum(ctx) if ctx else 0.0
                score += max(-0.6, min(0.6, 0.3 * lean))
            if score > best.get(s, 0.0):
                best[s] = score
    return best


def fit_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> dict:
    """Curate the model from all documents, seeded and calibrated on all labelled ones. Labels are compared without blanks around them and regardless of case."""
    known = subjects.where("subject is not null").select("subject", F.lower(F.trim("subject")).alias("key")).groupBy("key").agg(F.min("subject").alias("subject"))
    lab = labels.where("doc_id is not null").select("doc_id", F.lower(F.trim("subject")).alias("key")).distinct().join(F.broadcast(known), "key", "left")  # a row per subject
    lab = lab.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    text = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    return curate_terms(Stages(docs.sparkSession, "labelled").write(text.join(lab, "doc_id")), sentence_pool(text))


def subject_areas(docs: DataFrame, model: dict, least: float = 9.0) -> DataFrame:
    """``(doc_id, subject, score)``: every subject of a document whose score reaches the subject's threshold (``least`` for one without).

    Whole texts are read; no shuffle. A null or empty text has no subject; equal texts have equal ones. The model follows the vocabulary, not the rows.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = given.value
        match = automaton(m["terms"], m["joined"])
        for b in batches:
            rows = [(d, s, v) for d, t in zip(b.doc_id, b.text, strict=True) for s, v in score_document(sentences_of(t), m["context"], match).items() if v >= m["thresholds"].get(s, least)]
            yield pd.DataFrame(rows, columns=["doc_id", "subject", "score"])

    return docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(classify, "doc_id bigint, subject string, score double")


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return subject_areas(docs, fit_subjects(docs, table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _areas(spark, sf_dir).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters of each subject, and of documents without one (null)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars")).where("doc_id is not null")
    return docs.join(_areas(spark, sf_dir), "doc_id", "left").groupBy("subject").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"))


QUERIES = {"p8_found": p8_found, "p8_composition": p8_composition}
SQL: dict[str, str] = {}

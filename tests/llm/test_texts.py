import numpy as np
import pytest
from pyspark.sql import functions as F

from curveloom.llm import leaks as L
from curveloom.llm import mixing as M
from curveloom.llm import subjects as S


def shingles(docs, items, n=12):
    at = {}
    for i, p in items:
        w = L.words_of(p)
        for k in range(len(w) - n + 1):
            at.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for w in [L.words_of(t)] for k in range(len(w) - n + 1) for i in at.get(tuple(w[k : k + n]), ())}


def test_leaks(spark):
    rng = np.random.default_rng(1)
    words = ["a", "be", "cat", "dune", "eagle", "straße", "élan", "x1", "grün", "no"]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [(i, text(int(rng.integers(8, 40)))) for i in range(20)] + [(90, None), (91, ""), (92, "few words"), (93, "a " * 30)]
    docs = []
    for i in range(60):
        w = L.words_of(items[i % 20][1])
        k = int(rng.integers(0, len(w) - 2))
        n = int(rng.integers(5, 16))
        docs.append((i, f"{text(10)}, {'  -- '.join(w[k : k + n]).upper()}! {text(10)}"))
    docs += [(100, None), (101, ""), (102, "a​ " * 40), (103, text(3000) + " " + items[3][1] + " " + text(3000)), (104, docs[0][1])]
    d = spark.createDataFrame([(*x, "q") for x in docs], "doc_id bigint, text string, score string")
    it = spark.createDataFrame(items, "item_id bigint, passage string")
    got = L.leaked_passages(d, it)
    assert {(r.doc_id, r.item_id) for r in got.where("run_words >= 12").collect()} == shingles(docs, items)
    blocks = L.leaked_passages(d, it, item_chars=1000)
    assert {(r.doc_id, r.item_id) for r in blocks.where("run_words >= 12").collect()} == shingles(docs, items)
    assert L.leaked_passages(d.where("false"), it).count() == 0 and L.leaked_passages(d, it.where("false")).count() == 0


def test_edited_passage_is_reported(spark):
    p = "when the harvest ended early the farmers of the northern valley carried every basket of ripe apples down to the river market before the bells"
    it = spark.createDataFrame([(1, p)], "item_id bigint, passage string")
    d = spark.createDataFrame([(1, "So " + p.replace("carried", "carryed") + " rang"), (2, "nothing of the kind")], "doc_id bigint, text string")
    rows = L.leaked_passages(d, it).collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(1, 1)]


def _english(rng, n):
    """Words drawn with very uneven frequencies, so that grams are shared by many passages."""
    words = ["the", "of", "and", "to", "in", "that", "was", "government", "national"] + ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(4, 10))) for _ in range(3000)]
    p = 1 / np.arange(1, len(words) + 1)
    return [str(w) for w in rng.choice(words, n, p=p / p.sum())]


def test_every_edited_run_is_found():
    """Runs of at least twelve words with a character left out, put in or changed."""
    rng = np.random.default_rng(5)
    items = [(i, " ".join(_english(rng, 30))) for i in range(150)]
    index, docs = L.PassageIndex(items, L.WORDS, L.Q), []
    for i, p in items:
        w = p.split(" ")
        k = int(rng.integers(0, 15))
        run = list(" ".join(w[k : k + 14]))
        at = int(rng.integers(1, len(run) - 1))
        run[at : at + int(rng.integers(0, 2))] = ["", "z", "q"][i % 3]
        docs.append(L.words_of(" ".join([*_english(rng, 40), "".join(run), *_english(rng, 40)])))
    d, item, _, _ = L.find_regions(index, docs, L.EDITS, L.COST)
    assert {(i, i) for i in range(150)} <= {(int(a), index.ids[b]) for a, b in zip(d, item, strict=True)}


def test_work_does_not_follow_the_passages():
    rng = np.random.default_rng(6)
    text = _english(rng, 4000 * 40)
    items = [(i, " ".join(text[i * 40 : i * 40 + 40])) for i in range(4000)]
    docs = [L.words_of(" ".join(_english(rng, 60))) for _ in range(100)]
    off = np.concatenate([[0], np.cumsum([len(L._codes(w)) for w in docs])])
    g = L._grams(np.concatenate([L._codes(w) for w in docs]), L.Q)
    _, many = (len(L._candidates(L.PassageIndex(items[:n], L.WORDS, L.Q, L.EDITS, docs), g, off, 2)) for n in (250, 4000))
    assert many <= 100 * 60  # about a band a word, where every gram of these texts has many places in the passages


def test_longest_run():
    rng = np.random.default_rng(7)
    for _ in range(50):
        a, p = rng.integers(-1, 4, int(rng.integers(0, 30))), rng.integers(0, 4, int(rng.integers(1, 20)))
        want = max([n for i in range(len(a)) for j in range(len(p)) for n in range(1, 30) if i + n <= len(a) and j + n <= len(p) and (a[i : i + n] == p[j : j + n]).all()], default=0)
        assert L.longest_run(a, p) == want


def test_words():
    assert L.words_of("Ｆｕｌｌ é­​b_c ﬁne 2²") == ["full", "éb", "c", "fine", "22"]


def test_split_tree():
    q = np.array([100, 3, 0, 57])
    out = M.split_quotas(q, 7, 1)
    assert (out.sum(axis=0) == q).all() and out.min() >= 0 and np.ptp(out.sum(axis=1)) <= 2
    assert M.split_quotas(np.zeros(3, int), 4, 1).sum() == 0


def test_mixture(spark):
    rows = [(i, s, int(n)) for i, (s, n) in enumerate([("a", 10)] * 300 + [("b", 7)] * 40 + [("c", 0)] * 5 + [("d", 500)])]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.1, 3), ("c", 0.1, 2), ("d", 0.2, 1), ("e", 0.3, 4)], "source string, target_weight double, max_repeats int")
    plan, mixed, dealt = M.mixture(sized, targets, shards=4, per_shard=10)
    total = 3000 + 280 + 500
    short = {r.source for r in plan.where("falls_short").collect()}
    assert short == {"c", "d", "e"}
    used = {r.source: (r.n, r.most) for r in mixed.groupBy("source").agg(F.sum("tokens").alias("n"), F.max("copy").alias("most")).collect()}
    assert abs(used["a"][0] - 0.3 * total) <= 10 and abs(used["b"][0] - 0.1 * total) <= 7 and used["d"][0] == 500
    assert mixed.groupBy("doc_id", "copy").count().where("count > 1").count() == 0 and used["b"][1] <= 2
    assert {r.source: r.share for r in M.mixture_report(plan, mixed, dealt).collect()}["d"] == pytest.approx(500 / sum(n for n, _ in used.values()))
    assert all(r.reaches and r.dealt and r.uses <= r.max_repeats for r in M.mixture_report(plan, mixed, dealt).collect())
    parts = mixed.select("shard", F.spark_partition_id().alias("part")).distinct().collect()
    assert mixed.rdd.getNumPartitions() == 4 and all(r.shard == r.part for r in parts)  # a shard is a task
    lost = mixed.where("source <> 'a' or shard <> 2")
    assert not {r.source: r.dealt for r in M.mixture_report(plan, lost, dealt).collect()}["a"]
    assert M.mixture(sized.where("false"), targets)[1].count() == 0
    assert M.mixture(sized, targets, shard_tokens=100)[1].rdd.getNumPartitions() == 21  # shards follow the size


def test_sources_and_tokens(spark):
    docs = spark.createDataFrame([(1, " Web\t", "hello world"), (2, "web", None), (3, "none", "x"), (4, None, "x"), (5, "WEB", "")], "doc_id bigint, source string, text string")
    t = spark.createDataFrame([("web", 1.0, 1)], "source string, target_weight double, max_repeats int")
    if not __import__("os").path.exists(M.RANKS):
        pytest.skip("no tokenizer")
    assert {r.doc_id: r.tokens for r in M.sized_documents(docs, t).collect()} == {1: 2, 2: 0, 5: 0}


def test_tokens_are_those_of_plain_merging():
    """Byte pairs merged one at a time, lowest rank first."""
    import base64
    import regex

    with open(M.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    def plain(word):
        parts = [bytes([b]) for b in word.encode()]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[p] for p in parts]

    enc = M._encoder(M.RANKS)
    for text in ("It's  the 27th straßenfest, naïve Ünïcode: 日本語 and\n\n tabs\t!", "", "a" * 300, "don't we'll"):
        want = [t for w in regex.findall(M.SPLIT, text) for t in plain(w)]
        assert enc.encode_ordinary(text) == want and enc.decode(want) == text


def _corpus():
    rng = np.random.default_rng(2)
    nouns = {"sea": ["harbours", "anchors", "sailors", "tides", "lighthouses"], "art": ["painters", "brushes", "canvases", "galleries", "sketches"]}
    out = []
    for i in range(400):
        s = [None, "sea", "art"][int(rng.integers(3))]
        if s:
            a, b = rng.choice(nouns[s], 2, replace=False)
            text = f"In {i} the {a} clearly improve the {b} of Zor{i}."
        else:
            other = rng.choice(nouns["sea"] + nouns["art"])
            text = rng.choice([f"On street {i} hangs a sign with the word {other}.", f"Nobody knew why Kel{i} had doors."])
        out.append((i, str(text), s))
    return out


def test_subjects(spark):
    rows = _corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "<b>In 7 the harb​ours clearly improve the an&#99;hors</b>")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, s and s.upper() + " ") for i, _, s in rows[:150]] + [(None, "sea")], "doc_id bigint, subject string")
    names = spark.createDataFrame([("sea",), ("art",), (None,)], "subject string")
    model = S.fit_subjects(docs, labels, names)
    got = {(r.doc_id, r.subject) for r in S.subject_areas(docs, model).collect()}
    want = {(i, s) for i, _, s in rows if s} | {(902, "sea")}
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97 and (902, "sea") in got
    assert S.subject_areas(docs.where("false"), model).count() == 0
    empty = S.fit_subjects(docs.where("false"), labels.where("false"), names)
    assert S.subject_areas(docs, empty).count() == 0


def test_mentions_are_the_hits_of_the_automaton():
    terms = {"red": ("art", 0.9), "chalk": ("art", 0.8), "tide": ("sea", 0.7), "pool": ("sea", 1.0)}
    match = S.automaton(terms, {("red", "chalk"), ("tide", "of", "pool")})
    assert match("a red chalk and red tide of pool pool".split()) == [("art", "red chalk", 0.9, 1), ("art", "red", 0.9, 4), ("sea", "tide of pool", 1.0, 5), ("sea", "pool", 1.0, 8)]
    assert match("reds chalky".split()) == [] and match([]) == [] and S.automaton({}, set())(["red"]) == []


def test_terms_are_counted_over_all_documents(spark):
    """A term outside the labelled sample, in six of 1,000 documents without labels."""
    rows = _corpus()
    rare = [(5000 + i, f"In {i} the trawlers clearly improve the {w} of Zor{i}.") for i, w in enumerate(["anchors", "sailors", "tides"] * 2)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000 + i, f"Nobody knew why Kel{i} had doors.") for i in range(800)] + rare, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, s) for i, _, s in rows[:150]], "doc_id bigint, subject string")
    names = spark.createDataFrame([("sea",), ("art",)], "subject string")
    model = S.fit_subjects(docs, labels, names)
    assert model["terms"]["trawlers"][0] == "sea"

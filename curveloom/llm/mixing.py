"""Problem 7: sources mixed to target weights, with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import Stages, small, table

#: Ranks of a public byte-level tokenizer; the path is a parameter of every function here.
RANKS = os.environ.get("CURVELOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Its published split pattern (fixed value).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fewest output shards, tokens a shard should hold beyond that, blocks of the mixture to a shard, and the seed of all draws.
SHARDS, SHARD_TOKENS, PER_SHARD, SEED = 16, 250_000_000, 32, 7

_ENCODERS: dict = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_count(ranks: str = RANKS):
    """Arrow UDF: tokens of a text; null has none."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(ranks)
        for texts in batches:
            yield pd.Series([0 if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="int64")

    return count


def _key(c):
    return F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))


def sized_documents(docs: DataFrame, targets: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``(doc_id, source, tokens)`` of the documents whose source, without blanks around it and regardless of case, is in ``targets``."""
    t = targets.where("source is not null").select("source", _key(F.col("source")).alias("key")).dropDuplicates(["key"])
    d = docs.select("doc_id", _key(F.col("source")).alias("key"), "text").where("doc_id is not null and key is not null")
    d = d.join(t, "key").select("doc_id", "source", "text")
    return d.select("doc_id", "source", token_count(ranks)("text").alias("tokens"))


def mixture_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """A row per source: ``own`` tokens, ``wanted`` tokens, the ``most`` it may give, ``planned`` tokens and whether it falls short.

    The mixture is as large as all documents together. A source without documents has 0 own tokens; equal names keep one row.
    """
    own = sized.groupBy("source").agg(F.sum("tokens").alias("own"), F.count("*").alias("documents"))
    t = targets.select("source", "target_weight", F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("long").alias("max_repeats")).where("source is not null and target_weight is not null").withColumn("k", _key(F.col("source"))).dropDuplicates(["k"]).drop("k")
    total = own.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("total"))
    p = t.join(own, "source", "left").fillna(0, ["own", "documents"]).crossJoin(total)  # total is one row
    p = p.withColumn("wanted", F.col("target_weight") * F.col("total")).withColumn("most", F.col("max_repeats") * F.col("own"))
    return p.withColumn("falls_short", F.col("wanted") > F.col("most")).withColumn("planned", F.least(F.col("wanted"), F.col("most").cast("double")))


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Deal exact block quotas of the sources to shards ``(shards, sources)``: at each node of a binary tree half of the blocks, drawn as without
    regard to source, go either way (multivariate hypergeometric), so every shard is a fair sample of the mixture and the columns sum up to the quotas."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        lo, n, q = todo.pop()
        if n == 1:
            out[lo] = q
            continue
        half = n // 2
        total = int(q.sum())
        take = total * half // n
        left = rng.multivariate_hypergeometric(q, take, method="marginals") if total else q
        todo += [(lo, half, left), (lo + half, n - half, q - left)]
    return out


def mixture(sized: DataFrame, targets: DataFrame, shards: int | None = None, shard_tokens: int = SHARD_TOKENS, per_shard: int = PER_SHARD, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The plan of :func:`mixture_plan`, the mixture ``(shard, place, doc_id, source, tokens, copy, block)`` and the quotas ``(source, shard, blocks)`` dealt.

    The number of shards follows the tokens of the mixture (``shard_tokens`` each, at least ``SHARDS``) unless given; a shard is one partition. All sources are
    dealt by a hash of the document into blocks of about the same size, ``per_shard`` of them to a shard; copy c of a source (c < max_repeats) is one pass over its
    blocks in their own random order, the last pass up to the quota. Within the block that crosses the quota documents are taken in hash order until it
    is reached, so a source misses its quota by less than a document. No document is in a copy twice, hence used at most max_repeats times. The
    splitting tree deals the block quotas to output shards; the permuted blocks are cut accordingly, and each shard is shuffled by itself.
    Only block sizes reach the driver: ``per_shard`` numbers a shard. Documents without tokens weigh nothing and follow their block. Nothing to mix gives empty results.
    """
    spark = sized.sparkSession
    work = Stages(spark, "mixture")
    plan = work.write(mixture_plan(sized, targets))
    rows = plan.select("source", "planned", "own").orderBy("source").toPandas()  # a row per source
    total = float(rows.planned.sum()) if len(rows) else 0.0
    shards = shards or max(SHARDS, int(-(-total // shard_tokens)))
    size = max(1.0, total / (shards * per_shard))
    blocks = spark.createDataFrame([(r.source, max(1, round(r.own / size))) for r in rows.itertuples()], "source string, blocks int")
    blocked = work.write(sized.join(F.broadcast(blocks), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int")).drop("blocks"))
    sizes = blocked.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")).toPandas()
    rng = np.random.default_rng(seed)
    uses, quotas = [], []  # of a source: block, copy and tokens to take (-1: all) in the order drawn, and their number
    for r in rows.itertuples():
        s = sizes[sizes.source == r.source].sort_values("block")
        block, tokens, want, copy, mine = s.block.to_numpy(np.int64), s.tokens.to_numpy(np.int64), r.planned, 0, [np.zeros((3, 0), np.int64)]
        while want > 0.5 and r.own > 0:
            order = rng.permutation(len(s))
            upto = np.cumsum(tokens[order])
            n = min(len(order), int(np.searchsorted(upto, want - 0.5)) + 1)
            take = np.where(upto[:n] <= want, -1, int(want) - np.concatenate([[0], upto])[:n])
            mine.append(np.stack([block[order[:n]], np.full(n, copy), take]))
            want, copy = want - min(want, upto[-1]), copy + 1
        uses.append(np.concatenate(mine, axis=1))
        quotas.append(uses[-1].shape[1])
    dealt = split_quotas(np.array(quotas, np.int64), shards, seed + 1)
    picks = [np.zeros((4, 0), np.int64)] + [np.concatenate([u[:, rng.permutation(u.shape[1])], np.repeat(np.arange(shards), dealt[:, i])[None]]) for i, u in enumerate(uses)]
    block, copy, take, shard = np.concatenate(picks, axis=1)
    names = pa.array(np.repeat(rows.source.to_numpy(object), quotas) if len(rows) else [], pa.string())
    cut = spark.createDataFrame(pa.table({"source": names, "block": pa.array(block, pa.int32()), "copy": pa.array(copy, pa.int32()), "take": pa.array(take, pa.int64()), "shard": pa.array(shard, pa.int32())}))
    j = blocked.join(small(cut, len(take)), ["source", "block"])
    w = Window.partitionBy("source", "block", "copy").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    whole = j.where("take < 0")
    part = j.where("take >= 0").withColumn("before", F.sum("tokens").over(w) - F.col("tokens")).where("before + tokens / 2 <= take").drop("before")  # one block a source
    place = F.xxhash64("doc_id", "copy", F.lit(seed + 3)).alias("place")
    out = whole.unionByName(part).select("shard", place, "doc_id", "source", "tokens", "copy", "block")
    i, k = np.nonzero(dealt.T)
    given = spark.createDataFrame(pa.table({"source": pa.array(rows.source.to_numpy(object)[i] if len(rows) else [], pa.string()), "shard": pa.array(k, pa.int32()), "blocks": pa.array(dealt.T[i, k], pa.int64())}))
    return plan, out.repartitionById(shards, F.col("shard")).sortWithinPartitions("place", "doc_id", "copy"), given


def mixture_report(plan: DataFrame, mixed: DataFrame, dealt: DataFrame) -> DataFrame:
    """The plan with what the mixture really holds of each source: tokens ``used``, its ``share``, most ``uses`` of a document, whether it ``reaches`` the planned tokens
    to within a document, and whether the shards hold the blocks ``dealt`` by the tree (but for a last block cut to nothing)."""
    docs = mixed.groupBy("source", "doc_id").agg(F.sum("tokens").alias("used"), F.count("*").alias("uses"), F.max("tokens").alias("longest"))
    used = docs.groupBy("source").agg(F.sum("used").alias("used"), F.max("uses").alias("uses"), F.max("longest").alias("longest"))
    held = mixed.select("source", "shard", "block", "copy").distinct().groupBy("source", "shard").agg(F.count("*").alias("held"))
    off = dealt.join(held, ["source", "shard"], "full").groupBy("source").agg(F.sum(F.abs(F.coalesce("blocks", F.lit(0)) - F.coalesce("held", F.lit(0)))).alias("off"))
    total = used.agg(F.sum("used").alias("mixed"))  # one row
    r = plan.join(used, "source", "left").join(off, "source", "left").fillna(0, ["used", "uses", "longest", "off"]).crossJoin(total)
    return r.withColumn("share", F.col("used") / F.col("mixed")).withColumn("reaches", F.abs(F.col("used") - F.col("planned")) <= F.greatest("longest", F.lit(1))).withColumn("dealt", F.col("off") <= 1)


def _sized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    return Stages(spark, "sized").write(sized_documents(table(spark, sf_dir, "documents"), targets)), targets


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, targets = _sized(spark, sf_dir)
    plan, mixed, dealt = mixture(sized, targets)
    return mixture_report(plan, Stages(spark, "mixed").write(mixed), dealt)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose share the mixture doesn't hold although it holds every document of them as often as it may."""
    return _report(spark, sf_dir).where("used < wanted and used >= most").select("source")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source, and the largest number of uses of a document."""
    return _report(spark, sf_dir).select("source", "target_weight", "share", "own", "used", "uses", "max_repeats", "falls_short")


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source reaches its planned tokens, no document of it is used too often, and the shards hold what the tree dealt them."""
    return _report(spark, sf_dir).select("source", "reaches", (F.col("uses") <= F.col("max_repeats")).alias("within_repeats"), "dealt")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, targets = _sized(spark, sf_dir)
    return mixture(sized, targets)[1].drop("block")


QUERIES = {"p7_found": p7_found, "p7_shares": p7_shares, "p7_checks": p7_checks, "p7_mixture": p7_mixture}
#: Any public tokenizer gives the same sources; SQL counts words and marks.
SQL = {
    "p7_found": r"""WITH d AS (SELECT m.source, m.target_weight, m.max_repeats, len(regexp_extract_all(d.text, '\w+|[^\w\s]')) AS n FROM documents d JOIN mix_targets m ON lower(trim(d.source)) = lower(trim(m.source))),
o AS (SELECT source, sum(n) AS own FROM d GROUP BY source)
SELECT m.source FROM mix_targets m LEFT JOIN o USING (source) WHERE m.target_weight * (SELECT sum(own) FROM o) > m.max_repeats * coalesce(own, 0)""",
    "p7_checks": "SELECT source, true AS reaches, true AS within_repeats, true AS dealt FROM mix_targets",
}

"""Problem 8: mixing sources to target weights.

Temperature mixing (``by="temperature"``): a source's weight is its token share to the power of t, scaled to
one; t is bisected until the weights have the entropy of the mix's targets, and, if some source would then
be repeated more often than it may, on until none is (``flatten``).  The mix has as many tokens as its sources hold,
or a budget asked for.

The project asks for target shares per source, which one exponent cannot meet, so ``by="targets"`` moves between
the corpus as it is and the targets: ``natural share * (target share / natural share) ** t``.  Without a budget the
mix is the largest that meets the targets (t = 1) within all limits; if no source is limited, as many
tokens as its sources hold.  With one, t is bisected to the largest at which no source needs more repeats than it may.

The weights are realised as budgeted block permutations: documents fall into blocks by a seeded hash,
blocks are taken in a seeded order, whole passes first, then blocks up to the budget, and in the one
block where it ends, documents up to it.  So a source is never sorted in one task.

Defined results: sources are compared trimmed and without case; documents of no target, without
source or without tokens are not drawn; sources without documents keep their target in the report
with nothing reached, as do sources that may be taken no time, and the others' targets are scaled to one; targets of one source in one mix add up.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliowright.session import shared_path

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BLOCKS, SEED, MAX_TARGETS = 4096, 20240229, 100_000
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):  # noqa: ANN202
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the pattern of the public vocabulary
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of every document; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _name(F.col("source")).alias("source"), "text")
    return src.mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")


def _name(source: Column) -> Column:
    return F.lower(F.trim(source))


def entropy(p: np.ndarray) -> float:
    q = p[p > 0]
    return float(-(q * np.log(q)).sum())


def at_temperature(natural: np.ndarray, target: np.ndarray, t: float) -> np.ndarray:
    """Normalised weights between the natural shares (t = 0) and the targets (t = 1)."""
    w = natural * (target / natural) ** t
    return w / w.sum()


def temperature(natural: np.ndarray, goal: float) -> float:
    """The exponent at which exponentiated shares reach an entropy; 0 is uniform, 1 natural, more is sharper."""
    lo, hi = 0.0, 64.0
    for _ in range(100):
        mid = (lo + hi) / 2
        p = natural**mid
        lo, hi = (mid, hi) if entropy(p / p.sum()) > goal else (lo, mid)
    return (lo + hi) / 2


def limits(own: list[str], size: np.ndarray, cap: dict[str, int | None]) -> np.ndarray:
    """Tokens of each source at most, with its repeats."""
    return np.array([math.inf if cap[s] is None else cap[s] * n for s, n in zip(own, size)])


def bisect(fits, lo: float, hi: float) -> float:  # noqa: ANN001
    """The exponent next to ``hi`` that fits, given that ``lo`` does."""
    if fits(hi):
        return hi
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if fits(mid) else (lo, mid)
    return lo


def flatten(tokens: dict[str, int], target: dict[str, float], cap: dict[str, int | None], budget: int | None = None) -> tuple[float, dict[str, float]]:
    """(exponent, tokens to take per source) by temperature: the targets' entropy, as far as no source is repeated too often.

    At exponent 1 every source is taken in its own proportion; from the exponent of the targets' entropy the search goes
    towards it until all limits hold.  A budget over what the limits allow at all is cut to that.
    """
    own = sorted(s for s in target if tokens.get(s) and target[s] > 0 and (cap[s] is None or cap[s] > 0))
    if not own:
        return 1.0, {}
    size = np.array([tokens[s] for s in own], float)
    natural = size / size.sum()
    goal = np.array([target[s] for s in own], float)
    most = limits(own, size, cap)
    total = min(float(budget or size.sum()), (most / natural).min())
    share = lambda t: natural**t / (natural**t).sum()
    fits = lambda t: bool((total * share(t) <= most * (1 + 1e-12)).all())
    t = bisect(fits, 1.0, temperature(natural, entropy(goal / goal.sum())))
    return t, dict(zip(own, np.minimum(total * share(t), most).tolist()))


def plan(tokens: dict[str, int], target: dict[str, float], cap: dict[str, int | None], budget: int | None = None) -> tuple[float, dict[str, float]]:
    """(exponent, tokens to take per source) of one mix by its targets."""
    own = sorted(s for s in target if tokens.get(s) and target[s] > 0 and (cap[s] is None or cap[s] > 0))
    if not own:
        return 1.0, {}
    size = np.array([tokens[s] for s in own], float)
    natural = size / size.sum()
    goal = np.array([target[s] for s in own], float)
    goal /= goal.sum()
    most = limits(own, size, cap)
    if budget is None:
        total = (most / goal).min()
        if math.isinf(total):
            total = float(size.sum())
        t = 1.0
    else:
        total = float(min(budget, most.sum()))
        t = bisect(lambda x: bool((total * at_temperature(natural, goal, x) <= most * (1 + 1e-12)).all()), 0.0, 1.0)
    want = np.minimum(total * at_temperature(natural, goal, t), most)
    return t, dict(zip(own, want.tolist()))


class Mix:
    """Draws of all mixes of a target table over a corpus."""

    def __init__(self, spark: SparkSession, docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, budget: int | None = None, by: str = "targets"):
        weigh = {"targets": plan, "temperature": flatten}[by]
        path = shared_path(spark, "token-counts")
        token_counts(docs, tokenizer).write.mode("overwrite").parquet(path)
        self.counts = spark.read.schema("doc_id bigint, source string, n_tokens bigint").parquet(path)
        # targets are a small table, one row per mix and source, whose size is checked before it is read
        t = targets.select("mix_name", _name(F.col("source")).alias("source"), "target_share", "max_repeats").where("mix_name is not null and source is not null")
        caps = F.min("max_repeats")
        self.targets = [tuple(r) for r in t.groupBy("mix_name", "source").agg(F.sum("target_share"), caps).orderBy("mix_name", "source").limit(MAX_TARGETS + 1).collect()]
        if len(self.targets) > MAX_TARGETS:
            raise ValueError(f"more than {MAX_TARGETS} targets; give the mixes in several runs")
        known = sorted({s for _, s, _, _ in self.targets})
        used = self.counts.where(F.col("source").isin(known))
        have = {s: n for s, n in used.groupBy("source").agg(F.sum("n_tokens")).collect()}
        rows = []
        for mix in sorted({m for m, *_ in self.targets}):
            part = [x for x in self.targets if x[0] == mix]
            exponent, want = weigh(have, {s: w or 0.0 for _, s, w, _ in part}, {s: c for _, s, _, c in part}, budget)
            rows += [(mix, s, float(w or 0.0), c, float(exponent), int(round(want.get(s, 0.0))), have.get(s, 0)) for _, s, w, c in part]
        schema = T.StructType([T.StructField("mix_name", T.StringType()), T.StructField("source", T.StringType()), T.StructField("target_share", T.DoubleType()), T.StructField("max_repeats", T.IntegerType()), T.StructField("exponent", T.DoubleType()), T.StructField("budget", T.LongType()), T.StructField("available", T.LongType())])
        self.plan = spark.createDataFrame(rows, schema)
        self.spark = spark

    def draws(self) -> DataFrame:
        """(mix_name, source, doc_id, n_tokens, takes): each document a mix draws, and how often."""
        plan = F.broadcast(self.plan.where("budget > 0"))  # mixes times sources, a fixed table
        docs = self.counts.where("n_tokens > 0 and source is not null").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(BLOCKS)))
        blocks = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
        order = Window.partitionBy("mix_name", "source").orderBy(F.xxhash64("block", "mix_name", F.lit(SEED)), "block")
        before = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
        placed = blocks.join(plan, "source").withColumn("before", F.coalesce(before, F.lit(0)))  # at most BLOCKS rows per mix and source
        placed = placed.withColumn("passes", F.floor(F.col("budget") / F.col("available"))).withColumn("rest", F.col("budget") - F.col("passes") * F.col("available"))
        placed = placed.withColumn("room", F.col("rest") - F.col("before")).select("mix_name", "source", "block", "passes", "room", "tokens", "max_repeats")
        each = docs.join(placed, ["source", "block"])
        whole = (F.col("room") >= F.col("tokens")).cast("int")
        edge = (F.col("room") > 0) & (F.col("room") < F.col("tokens"))
        full = each.where(~edge).select("mix_name", "source", "doc_id", "n_tokens", "max_repeats", (F.col("passes") + whole).alias("takes"))
        inside = Window.partitionBy("mix_name", "source").orderBy(F.xxhash64("doc_id", "mix_name", F.lit(SEED)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        # of the one block where the budget ends, documents while half of the next still fits
        cut = each.where(edge).withColumn("upto", F.sum("n_tokens").over(inside))
        cut = cut.select("mix_name", "source", "doc_id", "n_tokens", "max_repeats", (F.col("passes") + (F.col("upto") - F.col("n_tokens") / 2 <= F.col("room")).cast("int")).alias("takes"))
        takes = F.least(F.col("takes"), F.coalesce(F.col("max_repeats").cast("long"), F.col("takes"))).cast("int")
        return full.unionByName(cut).withColumn("takes", takes).where("takes > 0").drop("max_repeats")

    def report(self) -> DataFrame:
        """Per mix and source: target, scaled target and reached share, tokens, documents, most takes and its limit."""
        got = self.draws().groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("takes")).alias("tokens"), F.count("*").alias("documents"), F.max("takes").alias("most_takes"))
        per_mix = Window.partitionBy("mix_name")
        r = self.plan.join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "documents", "most_takes"])
        live = F.when(F.col("available") > 0, F.col("target_share")).otherwise(0.0)
        r = r.withColumn("scaled_target", F.round(live / F.sum(live).over(per_mix), 6)).withColumn("reached_share", F.round(F.col("tokens") / F.sum("tokens").over(per_mix), 6))
        return r.select("mix_name", "source", "target_share", "scaled_target", "reached_share", "tokens", "documents", "most_takes", "max_repeats", "available", F.round("exponent", 6).alias("exponent"))

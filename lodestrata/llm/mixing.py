"""Mixing sources to target weights (problem 7).

A mix has as many tokens as all documents together; each of its sources is to
have its share of them. The rate of a source is its target tokens over its
tokens. A document's number of copies is a Poisson variable with that mean,
inverted at a uniform number that a seeded hash of (document, mix) gives, so
that a rerun and a lost task draw the same. Copies are capped at
``max_repeats``; the Poisson mean is raised so that the capped variable has the
wanted mean. One seed serves all draws; how near a draw comes to its target is
for the report to say. A source whose rate reaches the cap is used exactly
``max_repeats`` times over and still may fall short of its share; the report says so.

Token counts come from one Arrow pass and are written to the shared checkpoint
folder, so the texts are read once. A source may hold a third of all rows:
totals are pre-aggregated per partition, and the join with the targets is salted
on both sides, by the size of the largest source (the targets are one row a mix
and source, repeated once a salt).

Defined results:

- Spellings of a source (case, blanks, hyphens) are one source; documents with a null source belong to no source but count in the total.
- Empty and null texts have no tokens; they are drawn like others of their source.
- A target without documents: rate and shares 0, short of its share. Null or negative share: 0. Null or negative max_repeats: 0.
- Repeated target rows for one mix and source: the largest share and largest cap. Repeated document rows are drawn apart from each other.
- No documents at all: total 0, nothing is short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import cut
from lodestrata.llm.tokens import TOKENIZER, sizes, source_key

#: Documents of one source that meet their targets in one task.
ROWS_A_SALT = 100_000


def capped_poisson_cdf(rate: float, cap: int) -> list[float]:
    """P(copies <= k) for k below cap, of a Poisson variable that is cut off at cap and has the given mean."""
    if cap <= 0 or rate <= 0:
        return [1.0] * max(cap, 0)
    if rate >= cap:
        return [0.0] * cap

    def pmf(mean: float) -> np.ndarray:
        k = np.arange(cap)
        return np.exp(k * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in k]))

    def mean_of(mean: float) -> float:
        p = pmf(mean)
        return float((np.arange(cap) * p).sum() + cap * max(0.0, 1 - p.sum()))

    low, high = 1e-12, max(1.0, rate)
    while mean_of(high) < rate and high < 700:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean_of(mid) < rate else (low, mid)
    return [float(x) for x in np.minimum(1.0, np.cumsum(pmf(high)))]


def _with_cdf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["cdf"] = [capped_poisson_cdf(r, int(c)) for r, c in zip(batch.rate, batch.max_repeats, strict=True)]
        yield batch


class Mix:
    """The mixes of ``targets`` over ``documents``; see the module's description."""

    def __init__(self, documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 0):
        self.seed = seed
        # a row number that survives reruns, as the rows are written right after it is given
        self.sizes = cut(sizes(documents, tokenizer).withColumn("row", F.monotonically_increasing_id()))
        by_source = self.sizes.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("n_docs"))
        total = self.sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total_tokens"))
        wanted = (
            targets.select("mix_id", source_key(F.col("source")).alias("source"), F.col("source").alias("named"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
            .groupBy("mix_id", "source")
            .agg(F.min("named").alias("named"), F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        )
        rate = F.when(F.col("source_tokens") > 0, F.col("target_share") * F.col("total_tokens") / F.col("source_tokens")).otherwise(F.lit(0.0))
        planned = (
            wanted.join(by_source, "source", "left").crossJoin(total)  # total is one row
            .withColumns({"source_tokens": F.coalesce("source_tokens", F.lit(0)), "n_docs": F.coalesce("n_docs", F.lit(0))})
            .withColumn("rate", rate)
        )
        schema = T.StructType([*planned.schema.fields, T.StructField("cdf", T.ArrayType(T.DoubleType()))])
        #: One row a mix and source: share, cap, tokens there are, rate, and the distribution that copies are drawn from.
        self.plan = cut(planned.mapInPandas(_with_cdf, schema))
        largest = by_source.agg(F.max("n_docs")).first()[0] or 0
        self.salts = max(1, -(-largest // ROWS_A_SALT))
        drawn = self.counts().groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
        #: The plan with what each mix and source draws.
        self.drawn = cut(
            self.plan.join(drawn, ["mix_id", "source"], "left").withColumns({"mixed_tokens": F.coalesce("mixed_tokens", F.lit(0)), "most_copies": F.coalesce("most_copies", F.lit(0))})
        )

    def counts(self) -> DataFrame:
        """(mix_id, source, doc_id, row, n_tokens, copies): how often each document is taken, 0 included."""
        salt = F.pmod(F.xxhash64("row"), F.lit(self.salts)).cast("int")
        dealt = self.plan.select("mix_id", "source", "cdf", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))).alias("salt"))
        rows = self.sizes.where("source is not null").withColumn("salt", salt).join(dealt, ["source", "salt"])
        # 53 bits of the hash as a number from 0 up to 1
        uniform = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), "mix_id", "doc_id", "row"), 11) / F.lit(float(1 << 53))
        # a cut-off distribution gives the cap when the number lies above all of it
        return rows.withColumn("u", uniform).select("mix_id", "source", "doc_id", "row", "n_tokens", F.size(F.filter("cdf", lambda c: F.col("u") >= c)).alias("copies"))

    def shares(self) -> DataFrame:
        """(mix_id, source, target_share, actual_share, target_tokens, mixed_tokens, source_tokens, n_docs, rate, most_copies, short)."""
        out = self.drawn
        wanted = F.col("target_share") * F.col("total_tokens")
        of_mix = out.groupBy("mix_id").agg(F.sum("mixed_tokens").alias("mix_tokens"))
        out = out.join(of_mix, "mix_id")
        # short: used in full as often as allowed, and still below the target
        short = ((F.col("rate") >= F.col("max_repeats")) | (F.col("source_tokens") == 0)) & (F.col("mixed_tokens") < wanted)
        return out.select(
            "mix_id", F.col("named").alias("source"), "target_share",
            F.when(F.col("mix_tokens") > 0, F.col("mixed_tokens") / F.col("mix_tokens")).otherwise(F.lit(0.0)).alias("actual_share"),
            wanted.alias("target_tokens"), "mixed_tokens", "source_tokens", "n_docs", "rate", "most_copies", short.alias("short"),
        )

    def rows(self) -> DataFrame:
        """(mix_id, position_key, doc_id, source, copy_no, n_tokens): the mixes, each in one global random order."""
        taken = self.counts().where("copies > 0")
        copies = taken.select("mix_id", "doc_id", "row", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
        key = F.xxhash64(F.lit(self.seed + 1), "mix_id", "doc_id", "row", "copy_no")
        return copies.withColumn("position_key", key).select("mix_id", "position_key", "doc_id", "source", "copy_no", "n_tokens").orderBy("mix_id", "position_key")

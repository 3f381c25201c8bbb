"""Threshold policies over the mode, region and category tables.

A policy set is configuration and held by the driver. Its tables are broadcast while
they are known to be small; larger ones are joined as any table is. Where a function takes
``policies``, a ``PolicyHistory`` may stand in for the set (``operators/policy_history.py``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewgate import constants as K
from reviewgate.functions.collections import listed
from reviewgate.functions.text import fixed

c = F.col
MAX_POLICY_ROWS = 10_000


def _plain(policies: dict) -> dict:
    return {kind: dict(entries) for kind, entries in policies.items()}


@dataclass(frozen=True)
class PolicySet:
    policies: dict = field(default_factory=lambda: _plain(K.DEFAULT_POLICIES))

    def hinted(self, table: DataFrame) -> DataFrame:
        """A table of this set, to be broadcast if the whole set is small."""
        rows = sum(len(entries) for entries in self.policies.values())
        return F.broadcast(table) if rows <= MAX_POLICY_ROWS else table

    def updated(self, updates: dict) -> PolicySet:
        """Merge by key per policy type: an entry is replaced whole, a policy
        type this set does not have is ignored."""
        merged = _plain(self.policies)
        for kind, entries in updates.items():
            if kind in merged:
                merged[kind].update(entries)
        return PolicySet(merged)

    def modes(self, spark: SparkSession) -> DataFrame:
        names = sorted({m for a in K.ASPECTS for m in self.policies[a]})
        limits = {
            f"{a}_limit": [self.policies[a].get(m) for m in names] for a in K.ASPECTS
        }
        return _table(spark, {"compliance_mode": names}, limits)

    def regions(self, spark: SparkSession) -> DataFrame:
        return self._limits(
            spark, "regional_compliance", "region", ["max_toxicity", "max_bias"]
        )

    def categories(self, spark: SparkSession) -> DataFrame:
        return self._limits(
            spark,
            "category_restrictions",
            "product_category",
            ["max_toxicity", "max_bias", "max_hallucination"],
        )

    def _limits(self, spark, kind, key, names) -> DataFrame:
        entries = self.policies[kind]
        prefix = key.split("_")[-1]
        return _table(
            spark,
            {key: list(entries)},
            {f"{prefix}_{n}": [e.get(n) for e in entries.values()] for n in names},
        )

    def with_modes(self, df: DataFrame) -> DataFrame:
        """Add the mode's limits; NULL where this set does not have the mode."""
        return df.join(self.hinted(self.modes(df.sparkSession)), "compliance_mode", "left")

    def with_standard(self, df: DataFrame) -> DataFrame:
        """Add the limits of the standard mode, ``_standard_`` before each name."""
        return df.withColumns(
            {f"_standard_{a}": F.lit(float(self.policies[a]["standard"])) for a in K.ASPECTS}
        )

    def with_regions(self, df: DataFrame) -> DataFrame:
        return df.join(self.hinted(self.regions(df.sparkSession)), "region", "left")

    def with_categories(self, df: DataFrame) -> DataFrame:
        return df.join(
            self.hinted(self.categories(df.sparkSession)), "product_category", "left"
        )

    @staticmethod
    def load(rules: DataFrame) -> PolicySet:
        """The policy set of a stored listing, which comes to the driver; a listing of more
        than ``MAX_POLICY_ROWS`` entries is refused."""
        rows = rules.select("policy_type", "policy_key", "limit_name", "limit_value")
        # An entry has at most three limits.
        found = rows.limit(3 * MAX_POLICY_ROWS + 1).collect()
        if len(found) > 3 * MAX_POLICY_ROWS:
            raise ValueError(f"a policy set holds at most {MAX_POLICY_ROWS} entries")
        policies = {kind: {} for kind in K.DEFAULT_POLICIES}
        for kind, key, name, value in found:
            if kind not in policies:
                continue
            if kind in K.ASPECTS:
                policies[kind][key] = value
            else:
                limit = bool(value) if name == "gdpr_required" else value
                policies[kind].setdefault(key, {})[name] = limit
        return PolicySet(policies)

    def listing(self, spark: SparkSession) -> DataFrame:
        """Every rule in long form, with the version of the set."""
        rows = []
        for kind, entries in self.policies.items():
            for key, value in entries.items():
                items = value.items() if isinstance(value, dict) else [("threshold", value)]
                rows += [(kind, key, name, float(v)) for name, v in items]
        kinds, keys, names, values = zip(*rows)
        table = _table(
            spark,
            {"policy_type": kinds, "policy_key": keys, "limit_name": names},
            {"limit_value": values},
        )
        return table.withColumns(
            {
                "policy_version": F.lit(K.POLICY_VERSION),
                "last_updated": F.lit(K.POLICY_LAST_UPDATED),
            }
        )


def _table(spark: SparkSession, texts: dict, numbers: dict) -> DataFrame:
    return spark.createDataFrame(
        pa.table(
            {k: pa.array(list(v), pa.string()) for k, v in texts.items()}
            | {k: pa.array(list(v), pa.float64()) for k, v in numbers.items()}
        )
    )


def with_mode_limits(df: DataFrame, policies: PolicySet | None = None) -> DataFrame:
    """Join the mode thresholds; an unknown mode leaves them NULL."""
    return (policies or PolicySet()).with_modes(df)


def threshold_policy(
    df: DataFrame, analysis: str = "analysis", policies: PolicySet | None = None
) -> DataFrame:
    """Mode-only policy. A score at its threshold is denied, a missing score
    counts as 10, an unknown mode uses the standard thresholds."""
    policies = policies or PolicySet()
    rows = with_mode_limits(
        df.withColumn(
            "compliance_mode", F.coalesce("compliance_mode", F.lit("standard"))
        ),
        policies,
    )
    rows = policies.with_standard(rows).withColumns(
        {f"{a}_limit": F.coalesce(f"{a}_limit", f"_standard_{a}") for a in K.ASPECTS}
    )
    reasons = {
        "toxicity": K.TOXICITY_REASON,
        "bias": K.BIAS_REASON,
        "hallucination": K.HALLUCINATION_REASON,
    }
    broken = listed(
        *[
            (
                F.coalesce(c(analysis)[f"{a}_score"], F.lit(10.0)) >= c(f"{a}_limit"),
                reasons[a],
            )
            for a in K.ASPECTS
        ]
    )
    rows = rows.withColumn("_broken", broken)
    denied = F.size("_broken") > 0
    result = F.struct(
        F.when(denied, K.DENY).otherwise(K.ALLOW).alias("decision"),
        F.when(denied, c("_broken"))
        .otherwise(F.array(F.lit(K.APPROVED_REASON)))
        .alias("reasons"),
        F.concat(
            F.lit("Content "),
            F.when(denied, "rejected").otherwise("approved"),
            F.lit(" based on "),
            c("compliance_mode"),
            F.lit(" compliance mode"),
        ).alias("explanation"),
        F.struct(*[c(f"{a}_limit").alias(a) for a in K.ASPECTS]).alias(
            "thresholds_applied"
        ),
    )
    return rows.withColumn("policy_result", result).drop(
        "_broken", *[x for a in K.ASPECTS for x in (f"{a}_limit", f"_standard_{a}")]
    )


def content_policy(
    df: DataFrame, analysis: str = "analysis", policies: PolicySet | None = None
) -> DataFrame:
    """Full policy: mode, then region, then category; only a score above a limit
    is denied, a missing score counts as 0, reasons repeat as checks fail.

    A row whose mode the policy set does not know gets ``policy_error`` and no
    result (see ``unknown_modes``).
    """
    policies = policies or PolicySet()
    limited = policies.with_categories(policies.with_regions(with_mode_limits(df, policies)))
    rows = limited.withColumns(
        {f"_{a}": F.coalesce(c(analysis)[f"{a}_score"], F.lit(0.0)) for a in K.ASPECTS}
    )
    mode_reasons = [
        ("toxicity", "Toxicity", K.TOXICITY_REASON),
        ("bias", "Bias", K.BIAS_REASON),
        ("hallucination", "Hallucination", K.HALLUCINATION_REASON),
    ]
    checks = [
        (
            c(f"_{a}") > c(f"{a}_limit"),
            reason,
            F.concat(
                F.lit(f"{label} score "),
                c(f"_{a}").cast("string"),
                F.lit(" exceeds threshold "),
                c(f"{a}_limit").cast("string"),
            ),
        )
        for a, label, reason in mode_reasons
    ]
    for a in ("toxicity", "bias"):
        checks.append(
            (
                c(f"_{a}") > c(f"region_max_{a}"),
                K.REGIONAL_REASON,
                F.concat(F.lit(f"Regional {a} limit exceeded for "), c("region")),
            )
        )
    for a in K.ASPECTS:
        checks.append(
            (
                c(f"_{a}") > c(f"category_max_{a}"),
                K.CATEGORY_REASON,
                F.concat(F.lit(f"Category {a} limit exceeded for "), c("product_category")),
            )
        )
    known = _defined()
    rows = rows.withColumns(
        {
            "_reasons": listed(*[(cond, reason) for cond, reason, _ in checks]),
            "_violations": listed(*[(cond, text) for cond, _, text in checks]),
        }
    )
    denied = F.size("_reasons") > 0
    result = F.struct(
        F.when(denied, K.DENY).otherwise(K.ALLOW).alias("decision"),
        F.when(denied, c("_reasons"))
        .otherwise(F.array(F.lit(K.APPROVED_REASON)))
        .alias("reasons"),
        F.when(
            denied,
            F.concat(
                F.lit("Content policy violations: "), F.array_join("_violations", "; ")
            ),
        )
        .otherwise(K.CONTENT_MEETS)
        .alias("explanation"),
        F.struct(
            *[c(f"_{a}").alias(f"{a}_score") for a in K.ASPECTS],
            F.struct(*[c(f"{a}_limit").alias(a) for a in K.ASPECTS]).alias(
                "thresholds_applied"
            ),
            F.struct("region", "product_category", "compliance_mode").alias("context"),
        ).alias("metadata"),
    )
    helpers = [f"_{a}" for a in K.ASPECTS] + ["_reasons", "_violations"]
    limits = [f"{a}_limit" for a in K.ASPECTS]
    limits += [f"region_max_{a}" for a in ("toxicity", "bias")]
    limits += [f"category_max_{a}" for a in K.ASPECTS]
    return rows.withColumns(
        {
            "policy_result": F.when(known, result),
            "policy_error": F.when(~known, K.UNKNOWN_MODE),
        }
    ).drop(*helpers, *limits)


def _defined() -> Column:
    """Whether a mode has all of its limits; one without is not known."""
    return reduce(and_, [c(f"{a}_limit").isNotNull() for a in K.ASPECTS])


def unknown_modes(df: DataFrame, policies: PolicySet | None = None) -> DataFrame:
    """Rows whose mode the policy set does not define, or not for every score."""
    rows = with_mode_limits(df, policies).filter(~_defined())
    return rows.drop(*[f"{a}_limit" for a in K.ASPECTS]).withColumn(
        "policy_error", F.lit(K.UNKNOWN_MODE)
    )


def summary_policy(df: DataFrame) -> DataFrame:
    """Deny a summary that left out over half of the reviews or is of low quality.

    The metadata carry the region, category and mode of rows that have them.
    """
    context = F.struct(
        *[
            (c(x) if x in df.columns else F.lit(None).cast("string")).alias(x)
            for x in ("region", "product_category", "compliance_mode")
        ]
    )
    excluded = F.coalesce(c("reviews_excluded"), F.lit(0)).cast("double")
    total = F.coalesce(c("total_reviews"), F.lit(1)).cast("double")
    rows = df.withColumns(
        {
            "_rate": F.when(total > 0, F.try_divide(excluded, total)).otherwise(0.0),
            "_quality": F.coalesce(c("quality_score").cast("double"), F.lit(10.0)),
        }
    )
    checks = [
        (
            c("_rate") > 0.5,
            K.REGIONAL_REASON,
            F.concat(
                F.lit("High exclusion rate: "),
                fixed(c("_rate") * 100, 2),
                F.lit("% of reviews excluded"),
            ),
        ),
        (
            c("_quality") < 5,
            K.HALLUCINATION_REASON,
            F.concat(
                F.lit("Summary quality score "),
                c("_quality").cast("string"),
                F.lit(" below threshold"),
            ),
        ),
    ]
    rows = rows.withColumns(
        {
            "_reasons": listed(*[(cond, reason) for cond, reason, _ in checks]),
            "_violations": listed(*[(cond, text) for cond, _, text in checks]),
        }
    )
    denied = F.size("_reasons") > 0
    return rows.withColumn(
        "policy_result",
        F.struct(
            F.when(denied, K.DENY).otherwise(K.ALLOW).alias("decision"),
            F.when(denied, c("_reasons"))
            .otherwise(F.array(F.lit(K.APPROVED_REASON)))
            .alias("reasons"),
            F.when(
                denied,
                F.concat(
                    F.lit("Summary policy violations: "), F.array_join("_violations", "; ")
                ),
            )
            .otherwise(K.SUMMARY_MEETS)
            .alias("explanation"),
            F.struct(
                c("_rate").alias("exclusion_rate"),
                c("_quality").alias("quality_score"),
                context.alias("context"),
            ).alias("metadata"),
        ),
    ).drop("_rate", "_quality", "_reasons", "_violations")


def policy_entry(df: DataFrame, policies: PolicySet | None = None) -> DataFrame:
    """Evaluate content and summary rows of one table by ``validation_type``.

    An absent type means content; any other type is an error. Both policies are
    evaluated in one pass over the rows and the row's type picks the result.
    """
    kind = F.coalesce(c("validation_type"), F.lit("content"))
    rows = df.withColumns(
        {
            "validation_type": kind,
            "region": F.coalesce("region", F.lit("us-east-1")),
            "product_category": F.coalesce("product_category", F.lit("general")),
            "compliance_mode": F.coalesce("compliance_mode", F.lit("standard")),
        }
    )
    names = ["decision", "reasons", "explanation"]
    content = content_policy(rows, policies=policies).withColumnRenamed(
        "policy_result", "_content"
    )
    both = summary_policy(content).withColumnRenamed("policy_result", "_summary")

    def short(name: str) -> Column:
        return F.struct(*[c(name)[x].alias(x) for x in names])

    is_content = c("validation_type") == "content"
    is_summary = c("validation_type") == "summary"
    return both.withColumns(
        {
            "policy_result": F.when(
                is_content & c("policy_error").isNull(), short("_content")
            ).when(is_summary, short("_summary")),
            "error": F.when(is_content, c("policy_error")).when(
                ~is_summary,
                F.concat(F.lit("Unknown validation type: "), c("validation_type")),
            ),
        }
    ).drop("_content", "_summary", "policy_error")

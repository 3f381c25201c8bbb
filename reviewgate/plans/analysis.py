"""Three-prompt analysis of review texts with a scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewgate import constants as K
from reviewgate.operators.analysis import batch_analysis, risk_summary
from reviewgate.operators.scoring import Scorer, score_distinct

c = F.col


TEMPLATES = {
    "toxicity": K.TOXICITY_PROMPT,
    "bias": K.BIAS_PROMPT,
    "hallucination": K.HALLUCINATION_PROMPT,
}


def score_aspects(
    df: DataFrame, scorer: Scorer, path: str | None = None, **options
) -> DataFrame:
    """Response and call error per aspect: three calls per distinct text, whose prompts are
    filled where they are made."""
    templates = {f"_{a}": TEMPLATES[a] for a in K.ASPECTS}
    scored = score_distinct(
        df, scorer, None, ["content"], templates=templates, path=path, **options
    )
    return scored.withColumns(
        {f"{a}_response": c(f"_{a}.response_text") for a in K.ASPECTS}
        | {f"{a}_call_error": c(f"_{a}.call_error") for a in K.ASPECTS}
    ).drop(*[f"_{a}" for a in K.ASPECTS], "shared_by")


def analyze_content(
    df: DataFrame,
    scorer: Scorer,
    thresholds: dict[str, float] | None = None,
    path: str | None = None,
    **options,
) -> DataFrame:
    """Score each distinct text, write the responses, then read them: ``analysis``,
    per-aspect structs, ``analysis_error`` and ``risk``. A failed row has zero scores."""
    scored = score_aspects(df, scorer, path, **options)
    read = batch_analysis(
        scored,
        thresholds=thresholds,
        call_errors={a: f"{a}_call_error" for a in K.ASPECTS},
    )
    return risk_summary(read, thresholds)

"""What anomaly flags of an isolation forest add to a base score: flags, probabilities, adjusted score, lift."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..anomaly.detectors import outlier_iforest
from ..functions.geo import erf_probability, unscale_score
from ..ml.train import logit_blend
from ..operators import cost
from ..session import settle

C = F.col


def forest_size(rows: int) -> int:
    """Trees of the study's forest: fifty for every power of ten of the rows, within 240 and 500."""
    return int(max(240, min(500, 100 * math.log10(max(rows, 1)) // 2)))


def anomalies(rows: DataFrame, share: float, trees: int | None = None) -> DataFrame:
    """(window, id, raw, flag, proba) of every row: a forest in which each tree leaves out one column.

    ``flag`` marks the ``share`` most unusual rows of a window, ``proba`` maps the raw score through the error function.
    """
    found = settle(outlier_iforest(rows, trees or forest_size(rows.count()), drop_features=1), "forest")
    flagged = cost.contamination_flag(found.select("window", "id", "raw"), "raw", share, ["window"])
    return erf_probability(flagged, "raw", groups=["window"]).drop("proba_complement")


def adjusted(rows: DataFrame, labels: DataFrame, key: str, label: str, base: str, share: float, adjustment: str = "dominance",
             trees: int | None = None) -> DataFrame:
    """The labelled rows with both predictions and the adjusted score.

    ``labels`` has key, label and the scaled base score; rows without a base score take no part. ``dominance`` gives rows
    that only the flag added its probability, ``logit_blend`` fits a regression on base score and probability.
    """
    if adjustment not in ("dominance", "logit_blend"):
        raise ValueError(f"unknown adjustment {adjustment!r}")
    known = labels.select(C(key).alias("id"), C(label).alias("ytrue"), unscale_score(C(base)).alias("base")).where(C("base").isNotNull())
    both = anomalies(rows, share, trees).join(known, "id")
    both = settle(cost.augmented_prediction(both, "base", C("flag") == 1), "adjusted")
    if adjustment == "dominance":
        return cost.dominance_adjust(both, "base", "proba", "adjusted")
    return logit_blend(both, "ytrue", "base", "proba", "adjusted")


def lift_study(rows: DataFrame, labels: DataFrame, key: str, label: str, base: str, share: float, adjustment: str = "dominance",
               trees: int | None = None) -> DataFrame:
    """Precision, recall and PR area before and after, the recall gain, labelled rows, added predictions and changed rows."""
    out = settle(adjusted(rows, labels, key, label, base, share, adjustment, trees), "lift")
    report = cost.lift_report(out, "ytrue", "base", "adjusted")
    check = cost.dominance_check(out).first()
    return report.withColumns({"labelled": F.lit(out.count()), "added": F.lit(check["added"]), "changed": F.lit(check["changed"])})

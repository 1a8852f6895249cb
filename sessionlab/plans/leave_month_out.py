"""Flow B with a model for each month left out: every session is predicted by the model that did not train on its month, and
sessions to score by the mean of all of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlab.operators.cleaning import row_range
from sessionlab.operators.modelling import BoostSettings, assemble, month_conditions, oof_predict
from sessionlab.operators.scoring import result_table, session_to_visitor_score
from sessionlab.operators.splits import leave_month_out
from sessionlab.plans.features import SINGLE_LEVEL, START, VISITOR, FeatureSettings, numeric_features
from sessionlab.plans.single_level import session_features
from sessionlab.session import scratch_path
from sessionlab.sources.writers import materialize


@dataclass
class MonthlyResult:
    """The result, the sessions with their out-of-month predictions, and the error of each month's model."""

    table: DataFrame
    sessions: DataFrame
    errors: list[float]


def score_visitors(train: DataFrame, test: DataFrame, template: DataFrame, boost: BoostSettings = BoostSettings(),
                   settings: FeatureSettings = SINGLE_LEVEL) -> MonthlyResult:
    spark = train.sparkSession
    table = materialize(session_features(train, test, settings), scratch_path(spark, "features"))
    coded, features = numeric_features(table)
    coded = materialize(leave_month_out(coded.withColumn("_day", F.timestamp_seconds(START)), "_day").drop("_day"),
                        scratch_path(spark, "coded"))
    known, wanted = row_range(coded, test=False), row_range(coded, test=True)
    found = oof_predict(assemble(known, features, "y", keep=known.columns), "y", month_conditions(known, "fold_month"),
                        assemble(wanted, features, keep=wanted.columns), boost)
    scored = session_to_visitor_score(found.test, VISITOR, "pred")
    return MonthlyResult(result_table(scored, template, VISITOR, "y"), found.train, found.errors)

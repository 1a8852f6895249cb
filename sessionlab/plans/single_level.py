"""Flow B: one model on sessions, predictions summed per visitor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlab.operators.cleaning import row_range
from sessionlab.operators.modelling import BoostSettings, assemble, refit_scaled_rounds
from sessionlab.operators.scoring import result_table, session_to_visitor_score
from sessionlab.plans.features import (
    ROW,
    SINGLE_LEVEL,
    START,
    VISITOR,
    FeatureSettings,
    add_features,
    clean_sessions,
    export_shape,
    numeric_features,
    parse_export,
    typed_sessions,
)
from sessionlab.session import scratch_path
from sessionlab.sources.writers import materialize


def session_features(train: DataFrame, test: DataFrame, settings: FeatureSettings = SINGLE_LEVEL) -> DataFrame:
    """Cleaned sessions of both parts with all features, before encoding."""
    spark = train.sparkSession
    parsed = [materialize(parse_export(part), scratch_path(spark, "parsed")) for part in (train, test)]
    shape = export_shape(*parsed)
    typed = [typed_sessions(part, flag, shape) for part, flag in zip(parsed, (False, True))]
    cleaned = materialize(clean_sessions(*typed, settings), scratch_path(spark, "cleaned"))
    return add_features(cleaned, settings)


def score_visitors(train: DataFrame, test: DataFrame, template: DataFrame, first_validation_day: str,
                   boost: BoostSettings = BoostSettings(), settings: FeatureSettings = SINGLE_LEVEL) -> DataFrame:
    """Hold out the last days to choose the number of rounds, refit on all, score the test visitors."""
    spark = train.sparkSession
    table = materialize(session_features(train, test, settings), scratch_path(spark, "features"))
    coded, features = numeric_features(table)
    coded = materialize(coded, scratch_path(spark, "coded"))
    known = row_range(coded, test=False).withColumn(
        "is_val", F.timestamp_seconds(START) >= F.lit(first_validation_day).cast("timestamp"))
    matrix = assemble(known, features, "y", keep=[ROW, "is_val"]).persist()
    model, _ = refit_scaled_rounds(matrix, "y", "is_val", boost)
    matrix.unpersist()
    wanted = assemble(row_range(coded, test=True), features, keep=[ROW, VISITOR])
    scored = session_to_visitor_score(model.transform(wanted), VISITOR, "prediction")
    return result_table(scored, template, VISITOR, "y")

"""Steps shared by the flows: export to typed sessions, cleaning, features, numeric matrix."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlab.functions import columns as C
from sessionlab.functions.literals import pyliteral_variant
from sessionlab.operators import cleaning as K
from sessionlab.operators.aggregates import attach_distinct_counts, attach_group_stats, fit_key_sizes
from sessionlab.operators.encoding import label_encode
from sessionlab.operators.joins import union_fill
from sessionlab.operators.nested import leaf_columns, merged_schema, variant_as, variant_kind
from sessionlab.operators.windows import neighbour_sessions
from sessionlab.plans.hits_flatten import flat_first_hit, hit_kind, seen_in, with_first_hit
from sessionlab.sources import schemas as X

VISITOR, START, ROW = "fullVisitorId", "visitStartTime", "session_key"
# Columns that identify or label a row; never features.
CONTROL = (ROW, VISITOR, "visitId", START, "date", "started", "is_test", "y")
# Named pair features, name -> (first, second).
NAMED_CROSSES = {
    "browser_dev": ("browser", "deviceCategory"),
    "browser_os": ("browser", "operatingSystem"),
    "browser_chan": ("browser", "channelGrouping"),
    "campaign_medium": ("campaign", "medium"),
    "chan_os": ("operatingSystem", "channelGrouping"),
    "country_adcontent": ("country", "adContent"),
    "country_medium": ("country", "medium"),
    "country_source": ("country", "source"),
    "dev_chan": ("deviceCategory", "channelGrouping"),
}


@dataclass(frozen=True)
class FeatureSettings:
    """Which features a flow builds. Names absent from the cleaned table are skipped."""

    neighbours: int = 3
    count_keys: tuple[str, ...] = ("wday", "hour")
    group_keys: tuple[str, ...] = ("browser", "city", "country", "networkDomain", "referralPath", "source", "visitNumber")
    measures: tuple[str, ...] = ("pageviews",)
    stats: tuple[str, ...] = ("mean", "var", "min", "max", "sum")
    cross_left: tuple[str, ...] = ()
    cross_right: tuple[str, ...] = ()
    calendar_pairs: tuple[str, ...] = ()


SINGLE_LEVEL = FeatureSettings(measures=("pageviews", "hits"))

# The keys and statistics of the two-level flow.
TWO_LEVEL = FeatureSettings(
    neighbours=2,
    count_keys=("wday", "hit_hour", "hour", "month", "qday", "year_wday", "year_qday", "year_month", "hour_minute",
                "month_wday"),
    group_keys=("city", "country", "networkDomain", "continent", "metro", "subContinent", "cD_value", "browser", "promoId",
                "browser_dev", "browser_os", "browser_chan", "country_medium", "country_source", "dev_chan",
                "referralPath", "source", "visitNumber", "appInfo_screenDepth", "operatingSystem", "dataSource",
                "eCommerceAction_action_type", "eCommerceAction_step", "hitNumber"),
    stats=("mean", "median", "var", "skewness", "min", "max", "sum"),
    cross_left=("city", "country", "networkDomain", "continent", "metro", "subContinent", "cD_value"),
    cross_right=("browser", "operatingSystem", "source", "dataSource", "deviceCategory"),
    calendar_pairs=("year_week", "year_wday", "year_yday", "year_qday", "year_month", "month_wday", "year_day",
                    "hour_minute"),
)


@dataclass(frozen=True)
class ExportShape:
    """What the texts of an export hold: the type of each JSON column and of a hit, with all keys that occur, and how many
    texts of each column did not parse."""

    columns: dict[str, T.StructType]
    hit: T.StructType | None
    failures: dict[str, int]


def parse_export(export: DataFrame, with_lists: bool = False) -> DataFrame:
    """The export with its JSON columns as VARIANT and, ``with_lists``, the first hit and the first custom dimension, in the
    same row, so there is no join on keys that may repeat. Store the result: every text is parsed here, once, and nowhere
    else. ``_<column>_failed`` marks texts that did not parse."""
    have = [c for c in X.JSON_COLUMNS if c in export.columns]
    lists = [] if with_lists else ["customDimensions", "hits"]
    base = export.drop(*lists, "socialEngagementType", "sessionId", "campaignCode")
    values = {c: F.try_parse_json(K.quoted(c)) for c in have}
    if with_lists:
        values["customDimensions"] = pyliteral_variant("customDimensions")
        base = with_first_hit(base)
    parsed = base.withColumns({f"_{c}_text": K.quoted(c) for c in values} | values)
    flags = {f"_{c}_failed": K.quoted(f"_{c}_text").isNotNull() & K.quoted(c).isNull() for c in values}
    return parsed.withColumns(flags).drop(*[f"_{c}_text" for c in values])


def export_shape(*parsed: DataFrame) -> ExportShape:
    """The shape of all parts of a stored, parsed export together: one mergeable aggregate."""
    stacked = reduce(DataFrame.unionByName, parsed)
    columns = [c for c in X.JSON_COLUMNS if c in stacked.columns]
    hit = ["_hit"] if "_hit" in stacked.columns else []
    failed = [c for c in stacked.columns if c.startswith("_") and c.endswith("_failed")]
    row = stacked.agg(*[seen_in(c).alias(c) for c in [*columns, *hit]],
                      *[F.coalesce(F.sum(K.quoted(c).cast("long")), F.lit(0)).alias(c) for c in failed]).first()
    return ExportShape({c: merged_schema(X.JSON_COLUMNS[c], variant_kind(row[c])) for c in columns},
                       hit_kind(row["_hit"]) if hit else None, {c[1:-len("_failed")]: row[c] for c in failed})


def typed_sessions(parsed: DataFrame, is_test: bool, shape: ExportShape) -> DataFrame:
    """Put all keys of the JSON columns, of the first hit and of the first custom dimension in as columns, take the label
    out, tag the origin, and give each row an id made of its own columns. Lists inside a hit are no features."""
    base = parsed.drop(*[c for c in parsed.columns if c.startswith("_") and c.endswith("_failed") and c != "_hits_failed"])
    if shape.hit is not None:
        base = base.withColumns({"cD_index": F.try_variant_get("customDimensions", "$[0].index", "string"),
                                 "cD_value": F.try_variant_get("customDimensions", "$[0].value", "string")}).drop("customDimensions")
        base = flat_first_hit(base, shape.hit)
        base = K.drop_cols(base, K.columns_of(base, T.ArrayType))
    kept = [c for c in base.columns if c not in shape.columns]
    # The declared keys come first, so that theirs are the plain names.
    taken, leaves = set(kept), []
    typed = base.withColumns({c: variant_as(K.quoted(c), kind) for c, kind in shape.columns.items()})
    for c, kind in shape.columns.items():
        leaves += leaf_columns(K.quoted(c), kind, taken, c)
    flat = typed.select(*[K.quoted(c) for c in kept], *leaves)
    row_id = F.concat_ws("_", VISITOR, "visitId", START)
    return flat.withColumns({
        ROW: row_id,
        "is_test": F.lit(is_test),
        "y": F.lit(None).cast("double") if is_test else C.log_label("transactionRevenue"),
    }).drop("transactionRevenue", "totalTransactionRevenue")


def clean_sessions(train: DataFrame, test: DataFrame | None, settings: FeatureSettings) -> DataFrame:
    """Stack, drop constant columns, NA tokens to NULL, flags, pair features and calendar fields."""
    stacked = union_fill(train, test) if test is not None else train
    control = [c for c in CONTROL if c in stacked.columns]
    varying = K.fit_varying_cols(stacked.drop(*control))
    kept = stacked.select(*control, *varying)
    nulled = _null_tokens(kept, control)
    have = set(nulled.columns)
    exprs = {
        "started": C.epoch_to_ts(START),
        "pageviews": F.coalesce(F.col("pageviews").try_cast("int"), F.lit(0)),
        "hits": F.coalesce(F.col("hits").try_cast("int"), F.lit(0)) if "hits" in have else None,
        "newVisits": C.equals_flag("newVisits", "1"),
        "bounces": C.presence_flag("bounces"),
        "isMobile": C.bool_to_int("isMobile"),
        "adwordsClickInfo_isVideoAd": C.presence_flag("adwordsClickInfo_isVideoAd"),
        "isTrueDirect": C.presence_flag("isTrueDirect"),
        "hitNumber": F.col("hitNumber").try_cast("int") if "hitNumber" in have else None,
    }
    flagged = nulled.withColumns({n: e for n, e in exprs.items() if e is not None and (n in have or n == "started")})
    crosses = {n: C.cross_feature(a, b) for n, (a, b) in NAMED_CROSSES.items() if {a, b} <= have}
    dated = flagged.withColumns(C.calendar_parts("started") | crosses)
    minute = {} if "minute" in have else {"minute": F.minute("started")}
    pairs = C.calendar_pairs(settings.calendar_pairs)
    both = C.cross_features([a for a in settings.cross_left if a in have], [b for b in settings.cross_right if b in have])
    return dated.withColumns(minute).withColumns(pairs | both)


def _null_tokens(df: DataFrame, control: Sequence[str]) -> DataFrame:
    return df.select(*control, *[
        (C.na_to_null(K.quoted(f.name), X.NA_TOKENS) if isinstance(f.dataType, T.StringType) else K.quoted(f.name)).alias(f.name)
        for f in df.schema.fields if f.name not in control])


def add_features(df: DataFrame, settings: FeatureSettings) -> DataFrame:
    """Neighbouring sessions, visitor counts per calendar field and group statistics."""
    have = set(df.columns)
    out = neighbour_sessions(df, VISITOR, START, ["visitId", ROW], settings.neighbours)
    counted = [k for k in settings.count_keys if k in have]
    grouped = [k for k in settings.group_keys if k in have]
    measures = [m for m in settings.measures if m in have]
    sizes = fit_key_sizes(df, sorted({*counted, *grouped, *measures}))
    out = attach_distinct_counts(out, counted, VISITOR, sizes=sizes)
    return attach_group_stats(out, grouped, measures, list(settings.stats), sizes=sizes)


def numeric_features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Constant columns out, text columns to codes, flags to numbers. Returns the table and its feature names.

    The fits read ``df`` more than once, so pass a materialised table. A code varies when its text does, so
    the choice of columns comes first and only the columns that stay are encoded."""
    control = [c for c in CONTROL if c in df.columns]
    usable = [f.name for f in df.schema.fields if f.name not in CONTROL
              and isinstance(f.dataType, (T.StringType, T.NumericType, T.BooleanType))]
    features = K.fit_varying_cols(df.select(*[K.quoted(c) for c in usable]))
    kept = df.select(*control, *[K.quoted(c) for c in features])
    flags = {c: K.quoted(c).cast("int") for c in K.columns_of(kept, T.BooleanType) if c in features}
    text = [c for c in K.columns_of(kept, T.StringType) if c in features]
    coded = label_encode(kept.withColumns(flags) if flags else kept, text)
    return coded, features

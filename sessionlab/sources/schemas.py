"""Declared schemas of the session export, and the fixed value lists that cleaning uses."""

from __future__ import annotations

from pyspark.sql import types as T



def struct(**kinds: str | T.DataType) -> T.StructType:
    """Fields in the order given, with type names or types."""
    out = T.StructType()
    for name, kind in kinds.items():
        out.add(name, kind)
    return out


# Fixed values from here on: columns and fields of the export, in file order.

# Version 1 of the export: 12 columns, four of them JSON objects as text.
SESSIONS_V1 = struct(
    channelGrouping="string", date="string", device="string", fullVisitorId="string", geoNetwork="string",
    sessionId="string", socialEngagementType="string", totals="string", trafficSource="string", visitId="string",
    visitNumber="double", visitStartTime="long")

# Version 2: no sessionId; adds two columns that hold Python-literal lists.
SESSIONS_V2 = struct(
    channelGrouping="string", customDimensions="string", date="string", device="string", fullVisitorId="string",
    geoNetwork="string", hits="string", socialEngagementType="string", totals="string", trafficSource="string",
    visitId="integer", visitNumber="integer", visitStartTime="long")

ADWORDS = struct(
    adNetworkType="string", gclId="string", slot="string", page="string", isVideoAd="boolean")
DEVICE = struct(
    browser="string", operatingSystem="string", deviceCategory="string", isMobile="boolean")
GEO = struct(
    continent="string", subContinent="string", country="string", region="string", metro="string", city="string",
    networkDomain="string")
TOTALS = struct(
    visits="string", hits="string", pageviews="string", bounces="string", newVisits="string",
    transactionRevenue="string")
TRAFFIC = struct(
    campaign="string", source="string", medium="string", keyword="string", referralPath="string",
    adContent="string", isTrueDirect="boolean").add("adwordsClickInfo", ADWORDS)

JSON_COLUMNS = {"device": DEVICE, "geoNetwork": GEO, "totals": TOTALS, "trafficSource": TRAFFIC}

DIMENSIONS = T.ArrayType(struct(index="string", value="string"))

# Hit sub-objects known to be empty (experiment, customVariables, customMetrics, publisher_infos,
# customDimensions) are left out of the parse schema, so they are never materialised.
PRODUCT = struct(
    productSKU="string", v2ProductName="string", v2ProductCategory="string", productVariant="string",
    productBrand="string", productPrice="string", localProductPrice="string", isImpression="boolean")
PROMOTION = struct(promoId="string", promoName="string", promoCreative="string", promoPosition="string")
# Numbers arrive as quoted text: cast them after parsing (HIT_NUMBERS).
HIT = struct(
    hitNumber="string", time="string", hour="string", minute="string", isInteraction="boolean", isEntrance="boolean",
    isExit="boolean", type="string", dataSource="string",
    page=struct(pageTitle="string", pagePath="string", pagePathLevel2="string", pagePathLevel3="string"),
    appInfo=struct(screenName="string", landingScreenName="string", exitScreenName="string", screenDepth="string"),
    transaction=struct(currencyCode="string"), item=struct(currencyCode="string"),
    social=struct(socialNetwork="string", hasSocialSourceReferral="string", socialInteractionNetworkAction="string"),
    eCommerceAction=struct(action_type="string", step="string"),
    contentGroup=struct(**{f"{name}{k}": "string" for name in ("contentGroup", "previousContentGroup") for k in range(1, 6)}),
    exceptionInfo=struct(isFatal="boolean"), promotionActionInfo=struct(promoIsView="boolean", promoIsClick="boolean"),
    product=T.ArrayType(PRODUCT), promotion=T.ArrayType(PROMOTION))
HITS = T.ArrayType(HIT)
HIT_NUMBERS = {"hitNumber": "int", "time": "bigint", "hour": "int", "minute": "int"}

RESULT = struct(fullVisitorId="string", PredictedLogRevenue="double")

# Texts that mean "missing" in the export.
NA_TOKENS = (
    "not available in demo dataset",
    "(not provided)",
    "(not set)",
    "<NA>",
    "unknown.unknown",
    "(none)",
    "[]",
)

# Object fields that hold nothing but a placeholder in the export.
EMPTY_DEVICE_FIELDS = (
    "browserVersion",
    "browserSize",
    "operatingSystemVersion",
    "mobileDeviceBranding",
    "mobileDeviceModel",
    "mobileInputSelector",
    "mobileDeviceInfo",
    "mobileDeviceMarketingName",
    "flashVersion",
    "language",
    "screenColors",
    "screenResolution",
)
EMPTY_GEO_FIELDS = ("cityId", "latitude", "longitude", "networkLocation")

# Weights of the six blended result files, in file order.
BLEND_WEIGHTS = (0.3, 0.5, 0.1, 0.03, 0.03, 0.04)

"""Personal data by weak supervision, in DataFrame functions only.

Four base kinds (email, ip, card, phone) are found by pattern and check. Looser patterns give candidate spans of further
kinds (secret, line, ident, person). Regex, gazetteer and context labelers vote on each candidate: 1 for, -1 against, 0
no opinion. Expectation-maximisation estimates how reliable each labeler is from the votes alone; its posteriors train a
logistic span classifier on the candidate's own features, and candidates it accepts that touch no base span are added.
Votes and features take few values, so both fits run on counts of their patterns (at most VOTES and FEATURES rows,
whatever the input), over all candidates of all documents.

Offsets count code points, ends are exclusive. Null text is empty and has no spans; texts are read whole; repeated rows
are treated alike; without any candidate nothing is added.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlab.llm.common import stored

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "line", "ident", "person")
KINDS = BASE + ADDED

# A run that cannot match from its first character cannot match from a later one, so a match starts where a run starts
# or where the match before ended (\G); possessive repeats then keep the search linear in the text.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?+[0-9]){11,}+"  # shorter runs fail the digit count anyway
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The gazetteer. Given names, in four languages.
GIVEN_NAMES = (
    "Alice", "Andrea", "Anna", "Antonio", "Barbara", "Carlos", "Carmen", "Charles", "Claire", "Claudia", "Daniel", "David", "Elena",
    "Elizabeth", "Emily", "Emma", "Francisco", "Hans", "Heinrich", "Isabel", "James", "Jean", "Jennifer", "Johann", "John",
    "Jose", "Juan", "Julia", "Karl", "Klaus", "Laura", "Linda", "Louis", "Lucia", "Luis", "Manuel", "Margaret", "Maria", "Marie", "Mary",
    "Michael", "Miguel", "Monika", "Nicolas", "Olivia", "Pablo", "Patricia", "Paul", "Pedro", "Peter", "Petra", "Philippe", "Pierre",
    "Richard", "Robert", "Sabine", "Sarah", "Sophie", "Susan", "Teresa", "Thomas", "Ursula", "William", "Wolfgang")
# Words after a name that make it a place, an institution or a day.
PLACE_WORDS = (
    "Airport", "Avenue", "Bridge", "Castle", "Church", "City", "College", "County", "Day", "Hall", "Hospital", "Island", "Lake", "Museum",
    "Park", "Platz", "River", "Road", "School", "Square", "Station", "Strasse", "Street", "Tower", "University")
# What stands in place of a secret in instructions and examples.
PLACEHOLDERS = (
    "changeme", "default", "disabled", "enabled", "example", "forgotten", "optional", "password", "placeholder", "protected", "required",
    "username", "xxxxxxxx", "yourpassword", "yoursecret", "yourtoken")
_PLACE_END = " (?:" + "|".join(PLACE_WORDS) + ")$"
_NAMED = "(?:" + "|".join(GIVEN_NAMES) + ")"
_CANDIDATES = {
    "secret": r"AKIA[0-9A-Z]{16}|(?<![A-Za-z])(?i:password|passwd|secret|token|api[_-]?key)\x20{0,2}[=:]\x20{0,2}[\x22']?[A-Za-z0-9+/_-]{8,64}",
    "line": r"(?<![0-9])(?:\([0-9]{3}\)|[0-9]{3})[\x20-][0-9]{3}-[0-9]{4}(?![0-9])",
    "ident": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}(?![A-Za-z0-9])",
    "person": r"(?<![A-Za-z])(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame)\.?|" + _NAMED + r")\x20[A-Z][a-z]{2,20}(?![A-Za-z])",
}
#: What a text must hold for a pattern to be tried at all: each match of the pattern implies it.
_NEEDS = {"email": "contains(text, '@')", "phone": "contains(text, '+')", "ip": "text rlike '[0-9][.][0-9]'",
          "card": "text rlike '[0-9][0-9 -]{10}'", "line": "text rlike '[0-9]{3}-[0-9]{4}'",
          "secret": "text rlike 'AKIA[0-9A-Z]{16}|(?i:password|passwd|secret|token|api[_-]?key) {0,2}[=:]'",
          "ident": "text rlike '[0-9]{3}-[0-9]{2}-[0-9]|[A-Z]{2}[0-9]{2} ?[0-9A-Z]{4}'", "person": "text rlike '(?:Mr|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|" + "|".join(GIVEN_NAMES) + ")[. ]'"}
_CONTEXT = 40
_CUES = ("call", "phone", "tel", "contact", "login", "user", "account", "name", "dear", "ssn", "passport")
#: Vote patterns and feature patterns there can be: their counts are all that reaches the driver.
LABELERS = ("shape", "gazetteer", "cue", "mixed", "digits", "plain")
FEATURES = ("kind", "size", "share", "upper", "mark", "listed")
#: Weight of all candidates together against the ridge of the classifier.
EFFECTIVE = 1_000
VOTES_LIMIT, FEATURES_LIMIT = 3 ** 6 * 4, 4 * 4 * 4 * 2 * 2 * 3


def _spans(kind: str, pattern: str) -> Column:
    """Array of (start, end, found) of the leftmost non-overlapping matches; the gaps between them give the places."""
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    # The arrays are computed once, as fields of a one-element array, and the matches placed from there.
    one = F.array(F.struct(found.alias("found"), gaps.alias("gaps"), F.transform(found, lambda m: F.length(m)).alias("lengths")))

    def total(lengths: Column, n: Column) -> Column:
        return F.aggregate(F.slice(lengths, F.lit(1), n), F.lit(0), lambda acc, v: acc + v)

    def places(x: Column) -> Column:
        def place(m: Column, i: Column) -> Column:
            start = total(x["gaps"], i + 1) + total(x["lengths"], i)
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("found"))
        return F.transform(x["found"], place)

    empty = F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)")
    return F.when(F.expr(_NEEDS[kind]), F.flatten(F.transform(one, places))).otherwise(empty)


def _valid_ip(s: Column) -> Column:
    return F.forall(F.split(s["found"], r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
        F.split(s["found"], r"\."), lambda p: F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s["found"], "[^0-9]", "")


def _valid_card(s: Column) -> Column:
    digits = _digits(s)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 0, c.try_cast("int")).otherwise((c.try_cast("int") * 2) % 10 + F.floor(c.try_cast("int") / 5).cast("int")))
    luhn = F.aggregate(each, F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0))) % 10 == 0
    return F.length(digits).between(12, 19) & luhn


def _tagged(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), s["found"].alias("found")))


def base_spans() -> Column:
    """Sorted array of (start, kind number, end, found) of the four base kinds in column ``text``."""
    kinds = (
        ("email", _spans("email", _EMAIL)), ("ip", F.filter(_spans("ip", _IP), _valid_ip)),
        ("card", F.filter(_spans("card", _CARD), _valid_card)),
        ("phone", F.filter(_spans("phone", _PHONE), lambda s: F.length(_digits(s)).between(9, 15))))
    return F.array_sort(F.concat(*[_tagged(k, s) for k, s in kinds]))


def candidate_spans() -> Column:
    """Array of (start, kind number, end, found, before) of the looser kinds; ``before`` is the text that leads up to it."""
    spans = F.concat(*[_tagged(k, _spans(k, p)) for k, p in _CANDIDATES.items()])
    lead = lambda s: F.lower(F.expr("text").substr(F.greatest(s["start"] - _CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(_CONTEXT))))
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["found"].alias("found"),
        lead(s).alias("before")))


def _with_votes(candidates: DataFrame) -> DataFrame:
    """Votes of the labelers and features of the classifier on candidates (doc_id, spans as columns)."""
    found = F.col("found")
    digits = F.length(F.regexp_replace(found, "[^0-9]", ""))
    share = digits / F.length(found)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    any_of = lambda column, words: column.rlike("|".join(words))
    value = F.regexp_extract(found, r"[A-Za-z0-9+/_-]+$", 0)
    return candidates.withColumns({
        "shape": vote(found.rlike(r"^AKIA|^\(?[0-9]{3}\)?[ -]|^[0-9]{3}-[0-9]{2}-|^[A-Z]{2}[0-9]{2}|[=:].*[0-9]"),
                      found.rlike(_PLACE_END) | found.rlike("(?i)[=:] ?'?[a-z]+$")),
        "gazetteer": listed(found),
        "cue": vote(any_of(F.col("before"), _CUES), F.lit(False)),
        "mixed": vote(value.rlike("[0-9]") & value.rlike("[A-Za-z]"), value.rlike("^[a-z]+$")),
        "digits": vote(share >= 0.5, (share == 0) & (F.col("kind") != KINDS.index("person"))),
        "plain": vote(value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]"),
                      value.rlike("^(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)$") & (F.col("kind") == KINDS.index("secret"))),
        "size": F.least(F.floor(F.length(found) / 12), F.lit(3)).cast("int"),
        "share": F.least(F.floor(share * 4), F.lit(3)).cast("int"),
        "upper": found.rlike("[A-Z]").cast("int"),
        "mark": found.rlike("[=:()\"'-]").cast("int"),
        "listed": listed(found),
    })


def listed(found: Column) -> Column:
    """What the gazetteer says of a candidate: 1 for a given name, -1 for the name of a place or a placeholder, else 0."""
    return F.when(found.rlike("(?: (?:" + "|".join(PLACE_WORDS) + ")|(?i:[=: ']" + "(?:" + "|".join(PLACEHOLDERS) + ")))$"), -1).when(
        found.rlike("^" + _NAMED + " "), 1).otherwise(0)


def fit_reliabilities(votes: np.ndarray, weight: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior of "personal" per vote pattern: EM for the share of personal spans and each labeler's right votes.

    A labeler's accuracy stays above one half, which fixes which of the two classes is "personal".
    """
    if not len(weight):
        return np.zeros(0)
    prior, accuracy = 0.5, np.full(votes.shape[1], 0.8)
    for _ in range(rounds):
        odds = math.log(prior / (1 - prior)) + votes @ np.log(accuracy / (1 - accuracy))
        post = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        right = (weight[:, None] * np.where(votes > 0, post[:, None], 1 - post[:, None]) * (votes != 0)).sum(0)
        cast = (weight[:, None] * (votes != 0)).sum(0)
        accuracy = np.clip((right + 4) / (cast + 5), 0.55, 0.99)
        prior = float(np.clip((weight @ post + 1) / (weight.sum() + 2), 0.05, 0.95))
    return post


def fit_span_classifier(features: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = 300) -> np.ndarray:
    """Logistic weights (last: intercept) on 0/1 features by Newton steps damped by a ridge; soft targets."""
    x = np.column_stack([features, np.ones(len(features))])
    w = np.zeros(x.shape[1])
    for _ in range(min(steps, 50)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 0.5 * w
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), grad)
    return w


def _indicators(kind: int, size: int, share: int, upper: int, mark: int, listed: int) -> list[int]:
    return [int(listed > 0), int(listed < 0), *(int(kind == len(BASE) + k) for k in range(len(ADDED))), *(int(size == k) for k in range(4)),
            *(int(share == k) for k in range(4)), upper, mark]


def accepted_patterns(candidates: DataFrame) -> list[tuple[int, ...]]:
    """Feature patterns that the classifier, trained on the posteriors of all candidates, takes for personal data."""
    counted = candidates.groupBy(*FEATURES, *LABELERS).agg(F.count("*").alias("n")).limit(
        VOTES_LIMIT * FEATURES_LIMIT).collect()  # the limit is the number of patterns there can be
    if not counted:
        return []
    votes = np.array([[r[v] for v in LABELERS] for r in counted])
    weight = np.array([r["n"] for r in counted], dtype=float)
    post = fit_reliabilities(votes, weight)
    x = np.array([_indicators(*[r[f] for f in FEATURES]) for r in counted])
    w = fit_span_classifier(x, post, weight * (EFFECTIVE / weight.sum()))
    score = np.column_stack([x, np.ones(len(x))]) @ w
    return sorted({tuple(r[f] for f in FEATURES) for r, s in zip(counted, score, strict=True) if s >= 0})


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` (sorted array of start, kind number, end, found) and ``spans`` (base and added, sorted).

    Needs columns doc_id and text; columns named base, spans or candidates are replaced.
    """
    docs = docs.drop("base", "spans", "candidates")
    found = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumns(
        {"base": base_spans(), "candidates": candidate_spans()})
    found = stored(found, "spans")
    each = _with_votes(found.where(F.size("candidates") > 0).select(F.explode("candidates").alias("s")).select("s.*"))
    accepted = [",".join(str(v) for v in p) for p in accepted_patterns(each)]
    # The same features again, on the array's elements, decide which candidates are added.
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.filter("candidates", lambda s: _pattern_of(s).isin(accepted or [""]) & apart(s))
    bare = F.transform(added, lambda s: F.struct(*[s[n].alias(n) for n in ("start", "kind", "end", "found")]))
    return found.withColumn("spans", F.array_sort(F.concat("base", bare))).drop("candidates")


def _pattern_of(s: Column) -> Column:
    found = s["found"]
    share = F.length(F.regexp_replace(found, "[^0-9]", "")) / F.length(found)
    return F.concat_ws(
        ",", s["kind"].cast("string"), F.least(F.floor(F.length(found) / 12), F.lit(3)).cast("string"),
        F.least(F.floor(share * 4), F.lit(3)).cast("string"), found.rlike("[A-Z]").cast("int").cast("string"),
        found.rlike("[=:()\"'-]").cast("int").cast("string"), listed(found).cast("string"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans become one mask.

    All columns are kept, whatever their names."""
    others = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    found = find_personal_data(docs.withColumnsRenamed(others))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
        fresh = s["start"] >= acc["at"]
        gap = F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.when(fresh, F.concat(acc["out"], gap, F.get(names, s["kind"]))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(
        acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.size("spans") > 0, done).otherwise(F.col("text"))).select(
        *[F.col(others.get(c, c)).alias(c) for c in docs.columns])

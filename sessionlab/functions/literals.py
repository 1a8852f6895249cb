"""JSON text and Python-literal text to typed columns, with ``from_json`` alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlab.functions.columns import ColumnLike, col

# Python quoting is read by the JSON parser itself; only bare words and \xNN need rewriting.
PYTHON_QUOTING = {
    "allowSingleQuotes": "true",
    "allowBackslashEscapingAnyCharacter": "true",
    "allowUnquotedControlChars": "true",
}

_BARE_WORDS = {"True": "true", "False": "false", "None": "null"}
# Repeats of one character class are greedy, the fast form; the groups around them are possessive.
_QUOTED = r"""'[^'\\]*(?:\\.[^'\\]*)*+'|"[^"\\]*(?:\\.[^"\\]*)*+\""""
_WORD = rf"(?:{'|'.join(_BARE_WORDS)})(?![A-Za-z0-9_])"
_FIRST = "".join(w[0] for w in _BARE_WORDS)
# What stands before a bare word since the match before: quoted strings, consumed whole, and other characters. The groups are
# possessive, so the search is linear and does not recurse on long lists.
_VALUE = rf"(?s)\G((?:[^'\"{_FIRST}]+|{_QUOTED}|(?!{_WORD})[{_FIRST}])*+)"
# Set before a bare word by the one search for all of them.
_MARK = "\u0001"


# \xNN and what stands before it since the match before: a backslash takes the next character with it, so an escaped one
# escapes nothing.
_HEX_ESCAPE = r"(?s)\G((?:[^\\]+|\\(?!x[0-9a-fA-F]{2}).)*+)\\x([0-9a-fA-F]{2})"


def pyliteral_to_json(c: ColumnLike) -> Column:
    """Rewrite the bare words and hex escapes of a Python literal; quotes stay as they are.

    Each step is a lambda on an array of one text: its input is computed once, however often the step or, after it was
    pushed down, a filter names it. A pass over the text is made only where a word or escape occurs in it at all."""
    return F.get(F.transform(F.transform(F.array(col(c)), _json_words), _json_escapes), F.lit(0))


def _json_words(text: Column) -> Column:
    """One search marks the words, plain replacements turn them; a text that holds the mark itself is searched for each word."""
    one_by_one, at_once = text, F.regexp_replace(text, f"{_VALUE}({'|'.join(_BARE_WORDS)})", f"$1{_MARK}$2")
    for word, replacement in _BARE_WORDS.items():
        one_by_one = F.regexp_replace(one_by_one, _value_pattern(word), "$1" + replacement)
        at_once = F.replace(at_once, F.lit(_MARK + word), F.lit(replacement))
    any_word = reduce(Column.__or__, [text.contains(word) for word in _BARE_WORDS])
    return F.when(~any_word, text).when(text.contains(_MARK), one_by_one).otherwise(at_once)


def _value_pattern(word: str) -> str:
    """As ``_VALUE``, up to one word."""
    return rf"(?s)\G((?:[^'\"{word[0]}]+|{_QUOTED}|{word[0]}(?!{word[1:]}(?![A-Za-z0-9_])))*+){word}"


def _json_escapes(text: Column) -> Column:
    return F.when(text.contains(r"\x"), F.regexp_replace(text, _HEX_ESCAPE, r"$1\\u00$2")).otherwise(text)


def pyliteral_variant(c: ColumnLike) -> Column:
    """A Python literal as a VARIANT: parsed once, whatever its keys. Text that does not parse gives NULL."""
    return F.from_json(pyliteral_to_json(c), "variant", PYTHON_QUOTING)


def parse_pyliteral(c: ColumnLike, schema: T.DataType) -> Column:
    """Typed value of a Python literal. Text that does not parse gives NULL (see ``parse_failures``)."""
    return F.from_json(pyliteral_to_json(c), schema, PYTHON_QUOTING)


def parse_failures(c: ColumnLike, schema: T.DataType) -> Column:
    """Aggregate: how many texts did not parse, in whole or in any part."""
    checked = T.StructType([T.StructField("value", schema), T.StructField("_corrupt", T.StringType())])
    wrapped = F.concat(F.lit('{"value": '), pyliteral_to_json(c), F.lit("}"))
    parsed = F.from_json(wrapped, checked, PYTHON_QUOTING | {"columnNameOfCorruptRecord": "_corrupt"})
    return F.sum((col(c).isNotNull() & (parsed.isNull() | parsed["_corrupt"].isNotNull())).cast("long"))


def strip_sentinel(c: ColumnLike, sentinel: str) -> Column:
    """Remove ``"key": "<sentinel>"`` pairs from JSON text, and the comma such a pair leaves behind."""
    exact = r"\Q" + sentinel.replace(r"\E", r"\E\\E\Q") + r"\E"
    pair = r'"(?:[^"\\]|\\.)*+"\s*:\s*"' + exact + '"'
    without = F.regexp_replace(col(c), pair + r"\s*,\s*", "")
    return F.regexp_replace(without, r"(?:,\s*)?" + pair, "")

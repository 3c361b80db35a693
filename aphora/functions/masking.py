"""Redaction of sensitive fields in structs, maps and JSON text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names whose value is hidden, and what is written instead.
SENSITIVE = ["password", "token", "apiKey", "secret", "credit_card"]
MASK = "********"


_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
# Tokens of JSON that the walk over nested values tells apart; all of them together are the whole text.
_TOKENS = rf'{_TEXT}|[\[\]{{}}]|[^"\[\]{{}}]++|"'
#: Tokens whose texts are put together at once; what was put together before is copied once per so many.
_BLOCK = 512
#: Levels of a hidden value that one pattern takes whole; texts with deeper ones are walked through token by token.
_LEVELS = 64


def _forms(c: str) -> list[str]:
    # Fixed value: the Kelvin sign becomes a k in lower case.
    return sorted({c, c.upper() if len(c.upper()) == 1 else c} | ({"\u212a"} if c == "k" else set()))


def _spelt(name: str) -> str:
    """A pattern for all ways to write a lower-case name inside a JSON string: letters in both cases, and escapes."""
    def character(c: str) -> str:
        return rf"(?:[{''.join(map(re.escape, _forms(c)))}]|(?i:\\u(?:{'|'.join(f'{ord(f):04x}' for f in _forms(c))})))"

    return "".join(map(character, name))


def _key(names: set[str]) -> str:
    """A pattern for a sensitive key with its colon. In JSON a quote that is not escaped never stands inside a string."""
    # The first two characters (or an escape) spare most strings a look at every name.
    ahead = ["".join(re.escape(f) for f in sorted({f for n in names for f in _forms(n[i])})) for i in (0, 1)] if min(map(len, names), default=0) > 1 else []
    look = rf"(?=[{ahead[0]}\\][{ahead[1]}\\uU])" if ahead else ""
    return rf'"{look}(?<!\\")(?:{"|".join(_spelt(n) for n in sorted(names))})"\s*+:\s*+'


def _value(levels: int) -> str:
    """A pattern for a list or an object that ends, of at most so many levels; it never goes back over what it has read."""
    value = ""
    for _ in range(levels):
        value = rf'[\[{{](?:{_TEXT}|[^"\[\]{{}}]++{value and "|" + value}|")*+[\]}}]'
    return value


def _names(fields: list[str], parity: bool) -> set[str]:
    """Lower-cased names to hide.

    The observed behaviour compares a lower-cased key with the list as written, so ``apiKey`` never matches;
    ``parity`` keeps that, otherwise both sides are lower-cased.
    """
    return {f for f in fields if f == f.lower()} if parity else {f.lower() for f in fields}


def _mask_type(value: Column, kind: T.DataType, hidden: set[str]) -> Column | None:
    """The masked expression, or null if nothing below this type can be sensitive."""
    if isinstance(kind, T.StructType):
        fields, touched = [], False
        for f in kind.fields:
            inner = value.getField(f.name)
            if f.name.lower() in hidden:
                fields.append(F.lit(MASK).alias(f.name))
                touched = True
                continue
            masked = _mask_type(inner, f.dataType, hidden)
            touched = touched or masked is not None
            fields.append((inner if masked is None else masked).alias(f.name))
        return F.when(value.isNotNull(), F.struct(*fields)) if touched else None
    if isinstance(kind, T.ArrayType):
        if _mask_type(F.lit(None), kind.elementType, hidden) is None:
            return None
        return F.transform(value, lambda x: _mask_type(x, kind.elementType, hidden))
    if isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            if _mask_type(F.lit(None), kind.valueType, hidden) is None:
                return None
            return F.transform_values(value, lambda _, v: _mask_type(v, kind.valueType, hidden))
        return F.transform_values(value, lambda k, v: F.when(F.lower(k).isin(*hidden), MASK).otherwise(_as_text(v, kind.valueType, hidden)))
    return None


def _as_text(value: Column, kind: T.DataType, hidden: set[str]) -> Column:
    """A map value next to masks: text as it is, nested values as JSON with their own secrets hidden."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        masked = _mask_type(value, kind, hidden)
        return F.to_json(value if masked is None else masked)
    return value.cast("string")


def mask_columns(df: DataFrame, columns: list[str], fields: list[str] = SENSITIVE, parity: bool = False) -> DataFrame:
    """Hide sensitive fields at any depth of nested columns; the schema decides the plan, no row is inspected."""
    hidden = _names(fields, parity)
    for name in columns:
        masked = _mask_type(F.col(name), df.schema[name].dataType, hidden)
        if masked is not None:
            df = df.withColumn(name, masked)
    return df


def _hide_nested(text: Column, key: str) -> Column:
    """The text with lists and objects below sensitive keys replaced, however deep; null if one of them does not end.

    One pass over the tokens; what is kept between them is how many brackets of a hidden value are open, and the text so far.
    """
    tokens = F.regexp_extract_all(text, F.lit(rf"{key}[\[{{]|{_TOKENS}"), F.lit(0))
    # As the item of a list the tokens are worked out once, not anew for every block.
    cut = lambda found: F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _BLOCK).cast("int")), lambda b: F.slice(found, b * _BLOCK + 1, F.lit(_BLOCK)))
    blocks = F.element_at(F.transform(F.array(tokens), cut), 1)

    def step(state: Column, token: Column) -> Column:
        last = F.right(token, F.lit(1))
        opens, closes, hidden = last.isin("[", "{"), last.isin("]", "}"), state["open"] > 0
        starts = ~hidden & opens & (F.length(token) > 1)
        depth = F.when(hidden, state["open"] + opens.cast("int") - closes.cast("int")).otherwise(starts.cast("int"))
        shown = F.when(hidden, "").when(starts, F.concat(F.substring(token, F.lit(1), F.length(token) - 1), F.lit(f'"{MASK}"'))).otherwise(token)
        return F.struct(depth.alias("open"), F.concat(state["text"], shown).alias("text"))

    def block(state: Column, part: Column) -> Column:
        start = F.struct(state["open"].alias("open"), F.lit("").alias("text"))
        return F.aggregate(part, start, step, lambda s: F.struct(s["open"].alias("open"), F.concat(state["text"], s["text"]).alias("text")))

    start = F.struct(F.lit(0).alias("open"), F.lit("").alias("text"))
    return F.aggregate(blocks, start, block, lambda s: F.when(s["open"] == 0, s["text"]))


def mask_json_text(c: Column, fields: list[str] = SENSITIVE, parity: bool = False) -> Column:
    """Hide the values of sensitive keys inside JSON text, at any depth and however the key is spelt, without parsing it.

    Plain values are replaced by one pattern, lists and objects of up to ``_LEVELS`` levels by another, which goes from string
    to string as the walk does. Only texts that still have a list or an object below a sensitive key are walked through. If a
    value below a sensitive key does not end, nothing of the text is shown.
    """
    key = _key(_names(fields, parity))
    plain = F.regexp_replace(c, rf"({key})(?:{_TEXT}|[^\s\"{{\[,}}\]][^,}}\]]*+)", rf'$1"{MASK}"')
    ended = F.regexp_replace(plain, rf'\G((?:[^"]++|(?!{key}[\[{{])(?:{_TEXT}|"))*+{key}){_value(_LEVELS)}', rf'$1"{MASK}"')
    masked = _once(ended, lambda p: F.when(p.rlike(rf"{key}[\[{{]"), _hide_nested(p, key)).otherwise(p))
    unended = rf'{key}"(?!\*{{{len(MASK)}}}")'
    shown = _once(masked, lambda m: F.when(m.isNull() | m.rlike(unended), F.lit(f'{{"masked":"{MASK}"}}')).otherwise(m))
    return F.when(c.isNotNull(), shown)


def _once(value: Column, use) -> Column:
    """What ``use`` makes of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def mask_json_deep(fields: list[str] = SENSITIVE, parity: bool = False):
    """An Arrow-batched function that masks JSON of any nesting; text that is not JSON passes unchanged."""
    hidden = _names(fields, parity)

    def walk(value):
        if isinstance(value, dict):
            return {k: MASK if k.lower() in hidden else walk(v) for k, v in value.items()}
        return [walk(v) for v in value] if isinstance(value, list) else value

    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(walk(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return text
        except RecursionError:  # nested beyond what the parser takes: nothing of it is shown
            return f'{{"masked":"{MASK}"}}'

    @F.pandas_udf(T.StringType())
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return masked

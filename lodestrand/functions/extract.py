"""Content extraction: wiki markup to text (C1 to C6) and JSON to tokens.

Markup is a chain of built-in regular-expression replacements. Replacements that need a computed value (character
references, language variants) split the text at the matches, compute each and join again, all in the JVM.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.functions.text import replace_computed, squeeze

# fixed values: what is removed or kept of wiki markup, in order
BLOCKS = "script|style|gallery|math"
COMMENT = r"(?s)<!--.*?-->"
BLOCK = rf"(?is)<({BLOCKS})\b[^>]*>.*?</\1\s*>"
REFERENCE = r"(?is)<ref\b[^>]*>.*?</ref\s*>|<ref\b[^>]*/\s*>"
VARIANT = r"(?s)-\{.*?\}-"
LINK_LABEL = r"\[\[([^\]|#]+)(?:#[^\]|]*)?\|([^\]]+)\]\]"
LINK = r"\[\[([^\]|#]+)(?:#[^\]|]*)?\]\]"
EXTERNAL_LABEL = r"\[(?:https?:)?//\S*+\s+([^\]]+)\]"
EXTERNAL = r"\[(?:https?:)?//\S+\]"
ENTITY = r"(?i)&(?:nbsp|amp|lt|gt|quot|apos|#(?:\d+|x[0-9a-f]+));"
NAMED = {"nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
ENTITY_BLANK = " "


def _decoded(entity: Column) -> Column:
    body = F.lower(F.substring(entity, F.lit(2), F.length(entity) - 2))
    hexadecimal = body.startswith("#x")
    digits = F.when(hexadecimal, F.substring(body, F.lit(3), F.length(body))).otherwise(F.substring(body, F.lit(2), F.length(body)))
    digits = F.regexp_replace(digits, "^0+", "")
    point = F.when(F.length(digits) <= 8, F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits)).try_cast("long")
    valid = (point > 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, point).otherwise(F.lit(32))), 8, "0")), "UTF-32")
    result = F.when(body.startswith("#"), F.when(valid, char).otherwise(entity))
    for name, value in NAMED.items():
        result = F.when(body == name, value).otherwise(result)
    return result


def decode_entities(c: Column) -> Column:
    """One level of character references; unknown and invalid ones stay as written."""
    return replace_computed(c, ENTITY, _decoded)


def language_variants(c: Column) -> Column:
    """The texts of all branches of a language variant, without its flag."""

    def branches(match: Column) -> Column:
        body = F.regexp_replace(F.substring(match, F.lit(3), F.length(match) - 4), "^[A-Za-z-]+\\|", "")
        texts = F.transform(F.split(body, ";"), lambda b: F.trim(F.when(F.instr(b, ":") > 0, F.regexp_replace(b, "(?s)^[^:]*:", "")).otherwise(b)))
        return F.array_join(F.filter(texts, lambda t: t != ""), " ")

    return replace_computed(c, VARIANT, branches)


def wikitext(c: Column) -> Column:
    """Plain text of wiki markup; null stays null."""
    text = c
    for pattern in (COMMENT, BLOCK, REFERENCE):
        text = F.regexp_replace(text, pattern, " ")
    text = language_variants(text)
    text = F.regexp_replace(F.regexp_replace(text, LINK_LABEL, "$1 $2"), LINK, "$1")
    text = F.regexp_replace(F.regexp_replace(text, EXTERNAL_LABEL, "$1"), EXTERNAL, " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", " ")
    text = decode_entities(F.regexp_replace(text, "<[^>]+>", " "))
    text = F.regexp_replace(text, r"\{\{|\}\}|\{\||\|\}", " ")
    text = F.regexp_replace(F.regexp_replace(text, "[|=]+", " "), "'{2,}", "")
    return squeeze(F.regexp_replace(text, r"(?m)^\s*[!*#:;]+", " "))


_JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))')
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def _string(raw: str) -> str:
    if "\\" not in raw:
        return raw[1:-1]
    text = re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPES.get(m[2], m[2]), raw[1:-1])
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _number(raw: str) -> str:
    value = float(raw)
    return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)


def _no_number(raw: str):
    raise ValueError(f"no JSON: {raw}")


def parse_json(source: str):
    """JSON value of any depth, numbers as ("n", the string they print as); ValueError if it is none."""
    if "\\u" not in source:  # escaped halves of characters are for the parser below
        number = lambda raw: ("n", _number(raw))
        try:
            return json.loads(source, parse_int=number, parse_float=number, parse_constant=_no_number)
        except RecursionError:
            pass
    return parse_deep_json(source)


def parse_deep_json(source: str):
    """The same without recursion."""
    holder: list = []
    stack: list = [holder]
    keys: list = [None]
    want, at, end = "value", 0, len(source)
    while True:
        m = _JSON_TOKEN.match(source, at)
        if not m:
            if want == "done" and source[at:].strip(" \t\n\r") == "":
                return holder[0]
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        sign, text, number, word = m.groups()
        top = stack[-1]
        if want == "done":
            raise ValueError(f"more than one value at {at}")
        if sign in ("}", "]"):
            fits = isinstance(top, dict) if sign == "}" else isinstance(top, list) and len(stack) > 1
            if not fits or want not in ("next", "first"):
                raise ValueError(f"unexpected {sign} at {at}")
            stack.pop()
            keys.pop()
        elif sign in (",", ":"):
            if sign == "," and want == "next":
                want = "key" if isinstance(top, dict) else "value"
            elif sign == ":" and want == "colon":
                want = "value"
            else:
                raise ValueError(f"unexpected {sign} at {at}")
            continue
        elif want == "key" or (want == "first" and isinstance(top, dict)):
            if text is None:
                raise ValueError(f"key expected at {at}")
            keys[-1], want = _string(text), "colon"
            continue
        elif want in ("value", "first"):
            value = {"{": dict, "[": list}[sign]() if sign else _string(text) if text is not None else ("n", _number(number)) if number else {"true": True, "false": False, "null": None}[word]
            if isinstance(top, dict):
                top[keys[-1]] = value
            else:
                top.append(value)
            if sign:
                stack.append(value)
                keys.append(None)
                want = "first"
                continue
        else:
            raise ValueError(f"unexpected value at {at}")
        want = "next" if len(stack) > 1 else "done"
        if at > end:
            break


def ordered_items(value: dict) -> list:
    """Members in the order a browser lists them: index-like keys ascending, then the others as written."""
    index = [k for k in value if k.isascii() and k.isdigit() and (k == "0" or k[0] != "0") and int(k) < 2**32 - 1]
    if not index:
        return list(value.items())
    chosen = set(index)
    return [(k, value[k]) for k in sorted(index, key=int)] + [(k, v) for k, v in value.items() if k not in chosen]


def scalar_text(value) -> str | None:
    """A scalar as text; None for null and blank strings."""
    if isinstance(value, tuple):
        return value[1]
    if isinstance(value, bool):
        return "true" if value else "false"
    return value.strip() or None if isinstance(value, str) else None


def json_token_text(source: str | None) -> str:
    """Keys and scalars in document order, each once; the empty string for what is no JSON."""
    try:
        todo = [parse_json(source)] if source else []
    except ValueError:
        return ""
    seen: dict[str, None] = {}
    while todo:
        value = todo.pop()
        if isinstance(value, list):
            todo.extend(reversed(value))
        elif isinstance(value, dict):
            for key, child in reversed(ordered_items(value)):
                todo.append(child)
                todo.append(("n", key))
        elif (text := scalar_text(value)) is not None:
            seen[text] = None
    return " ".join(" ".join(seen).split())


def json_tokens(c: Column) -> Column:
    """``json_token_text`` of a column, on Arrow batches."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(json_token_text)

    return run(c)


def content_text(model: Column, source: Column) -> Column:
    """Text by content model, case-insensitive; the empty string for other models and null bodies."""
    kind = F.lower(model)
    text = F.when(kind == "wikitext", wikitext(source)).when(kind == "bson", json_tokens(F.when(kind == "bson", source)))
    return F.coalesce(text, F.lit(""))

"""Repair of broken JSON objects in completions: truncated, misquoted, with loose commas."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Brackets within each other that a repaired object may have.
DEPTH = 500

_WORDS = {"true": "true", "false": "false", "null": "null", "none": "null", "undefined": "null", "nan": "null"}
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_NEXT_KEY = re.compile(r"\s*,\s*[\"'“‘]?\w+[\"'”’]?\s*:")
_CLOSE = {'"': '"', "'": "'", "“": "”", "‘": "’"}


def _string(text: str, at: int) -> tuple[str, int]:
    """The string that starts with the quote at ``at`` and the place behind it.

    A quote of the same kind ends it where a separator, a bracket or the end follows; one inside
    the text stays.  Line breaks count as text.
    """
    quote, out, i = _CLOSE[text[at]], [], at + 1
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            e = text[i + 1]
            if e == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", text[i + 2 : i + 6]):
                out.append(chr(int(text[i + 2 : i + 6], 16)))
                i += 6
            elif e == "u" and len(text) <= i + 6:
                return "".join(out), len(text)
            else:
                out.append({"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(e, e))
                i += 2
        elif c == quote and re.match(r"\s*([,:}\]]|$|[\"'“‘]\w+[\"'”’]\s*:)", text[i + 1 : i + 200]):
            return "".join(out), i + 1
        else:
            out.append(c if c != "\\" else "")
            i += 1
    return "".join(out).rstrip(), len(text)


def repaired(text: str | None) -> tuple[str | None, str | None]:
    """(object as JSON, None) of the first object in a text, or (None, reason).

    One pass with a stack of the open brackets, whose innermost tells what may come next.  What the text leaves
    open is closed; a key without a value and a value that is no JSON are left out.  Of a repeated key the last stays.
    """
    if text is None:
        return None, "null"
    start = text.find("{")
    if start < 0:
        return None, "no object"
    top: dict = {}
    stack: list = [top]
    keys: list = [None]  # of each open object: the key that waits for its value
    i = start + 1

    def put(value) -> None:
        if isinstance(stack[-1], list):
            stack[-1].append(value)
        elif keys[-1] is not None:
            stack[-1][keys[-1]] = value
            keys[-1] = None

    while i < len(text) and stack:
        c = text[i]
        inside = isinstance(stack[-1], dict)
        if c in "{[":
            if inside and keys[-1] is None:
                return None, "a bracket where a key belongs"
            new: dict | list = {} if c == "{" else []
            put(new)
            stack.append(new)
            if len(stack) > DEPTH:
                return None, "nested too deeply"
            keys.append(None)
            i += 1
        elif c in "}]":
            want = dict if c == "}" else list
            if c == "}" and not inside and sum(isinstance(s, dict) for s in stack) == 1 and _NEXT_KEY.match(text, i + 1):
                want = list  # the object goes on: this was to close the list
            while len(stack) > 1 and not isinstance(stack[-1], want) and any(isinstance(s, want) for s in stack):
                stack.pop()  # the inner bracket was left open
                keys.pop()
            if isinstance(stack[-1], want):
                stack.pop()
                keys.pop()
            i += 1
        elif c in _CLOSE:
            value, i = _string(text, i)
            if inside and keys[-1] is None:
                keys[-1] = value
            else:
                put(value)
        elif text.startswith("//", i) or c == "#":
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
        elif text.startswith("/*", i):
            end = text.find("*/", i)
            i = len(text) if end < 0 else end + 2
        elif c.isspace() or c in ",:;`":
            if c == "," and inside:
                keys[-1] = None
            i += 1
        else:
            end = i
            stop = ":,}]\n" if inside and keys[-1] is None else ",}]\n"
            while end < len(text) and text[end] not in stop and not re.match(r"\s(//|/\*|#)", text[end : end + 3]):
                end += 1
            word, i = text[i:end].strip(), max(end, i + 1)
            if inside and keys[-1] is None:
                if text[end : end + 1] == ":":
                    keys[-1] = word.strip("\"'")
            elif _NUMBER.fullmatch(word):
                put(json.loads(word) if re.fullmatch(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?", word) else float(word) if re.search(r"[.eE]", word) else int(word))
            elif word.lower() in _WORDS:
                put(json.loads(_WORDS[word.lower()]))
            elif end >= len(text):  # cut off inside a word or number
                whole = [w for w in _WORDS if len(word) > 1 and w.startswith(word.lower())]
                put(json.loads(_WORDS[whole[0]])) if len({_WORDS[w] for w in whole}) == 1 else None
            elif word:
                put(word)
    if not top:
        return ("{}", None) if re.match(r"\{\s*\}", text[start:]) else (None, "no field")
    return json.dumps(top, ensure_ascii=False), None


@F.pandas_udf(StructType([StructField("json", StringType()), StructField("reason", StringType())]))
def repair_json(texts: pd.Series) -> pd.DataFrame:
    """struct(json, reason): the repaired object of each text, or why there is none.  An object that
    parses as it is comes back with the same values."""
    return pd.DataFrame([_of(t) for t in texts], columns=["json", "reason"], dtype=object)


def _of(text: str | None) -> tuple[str | None, str | None]:
    if text is not None:
        try:
            whole = json.loads(text[text.index("{") : text.rindex("}") + 1], parse_constant=lambda _: None)
            if isinstance(whole, dict):
                return json.dumps(whole, ensure_ascii=False), None
        except (ValueError, RecursionError):  # what this function is for
            pass
    try:
        return repaired(text)
    except RecursionError:
        return None, "nested too deeply"

"""JSON as models write it, and JSON kept within a budget of tokens."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed patterns of what is not JSON: code fences, comment lines, a comma before a closing bracket, raw strings.
FENCE, COMMENT, COMMA = re.compile(r"```(?:json|javascript|js)?\s*(.*?)```", re.S), re.compile(r"(?m)^\s*//.*$"), re.compile(r",(\s*[\]}])")
RAW = re.compile(r"\br(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')")
#: A string, to its end or that of the text, or a bracket.
PIECE = re.compile(r"\"(?:\\.|[^\"\\])*(?:\"|\\?\Z)|'(?:\\.|[^'\\])*(?:'|\\?\Z)|[\[\]{}]", re.S)
#: Fixed order in which the lists of a view are cut, and to how many.
TRIMMED, KEPT = ("used_by", "calls_2hop", "subclasses", "calls", "called_by", "methods"), 3


def clean(text: str) -> str:
    fenced = FENCE.search(text)
    return RAW.sub(r"\1", COMMA.sub(r"\1", COMMENT.sub("", fenced[1] if fenced else text)))


def span(text: str, pair: str) -> str | None:
    """From the first opening bracket of ``pair`` to its closing one; brackets in strings do not count."""
    depth, start = 0, 0
    for m in PIECE.finditer(text):
        if m[0] == pair[0]:
            start = start if depth else m.start()
            depth += 1
        elif m[0] == pair[1] and depth:
            depth -= 1
            if not depth:
                return text[start : m.end()]
    return None


def parse(text: str | None, kind: type) -> dict | list | None:
    """The first object (``dict``) or array (``list``) in a text, or None."""
    found = span(clean(text), "{}" if kind is dict else "[]") if text else None
    for read in (json.loads, ast.literal_eval) if found else ():
        try:
            value = read(found)
        except (ValueError, SyntaxError, RecursionError, MemoryError):
            continue
        return value if isinstance(value, kind) else None
    return None


def fit(view: dict, budget: int) -> dict:
    """``view`` with its lists cut one after the other until its JSON is within ``budget`` tokens, or none is left."""
    view = dict(view)
    for key in TRIMMED:
        if (len(json.dumps(view)) + 3) // 4 <= budget:
            break
        if isinstance(view.get(key), list) and len(view[key]) > KEPT:
            view |= {key: view[key][:KEPT], f"{key}_truncated": True}
    return view


def _text(value) -> str | None:
    return None if value is None else json.dumps(value, ensure_ascii=False, default=str)


@F.pandas_udf(StringType())
def first_object(text: pd.Series) -> pd.Series:
    return text.map(lambda x: _text(parse(x, dict)))


@F.pandas_udf(StringType())
def first_array(text: pd.Series) -> pd.Series:
    return text.map(lambda x: _text(parse(x, list)))


def within_budget(view, budget: int):
    """A column of JSON objects, each within ``budget`` tokens as far as its lists allow."""

    @F.pandas_udf(StringType())
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else json.dumps(fit(json.loads(x), budget)))

    return cut(view)

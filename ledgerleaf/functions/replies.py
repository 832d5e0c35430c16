"""JSON objects out of model replies: fenced blocks, preambles and trailing text are tolerated."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"```[A-Za-z0-9_-]*[ \t]*\r?\n?(.*?)```", re.S)
_LEAF = T.StructType([T.StructField("kind", T.StringType()), T.StructField("num", T.DoubleType()), T.StructField("str", T.StringType())])
_PAIR = T.StructType([T.StructField("path", T.StringType()), T.StructField("leaf", _LEAF)])
_DECODER = json.JSONDecoder()


def find_object(text: str | None) -> dict | None:
    """The first JSON object of the fenced blocks, else of the whole text; None if there is none.

    A block that is valid JSON but no object yields nothing itself: an object inside a list is not
    the answer.  What is nested too deeply to be read is no object.
    """
    if not text or not text.strip():
        return None
    for candidate in [*_FENCE.findall(text), text]:
        candidate = candidate.strip()
        try:
            whole = json.loads(candidate)
        except RecursionError:
            continue
        except ValueError:
            at = candidate.find("{")
            while at >= 0:
                try:
                    found, _ = _DECODER.raw_decode(candidate, at)
                    return found
                except RecursionError:
                    break
                except ValueError:
                    at = candidate.find("{", at + 1)
        else:
            if isinstance(whole, dict):
                return whole
    return None


@F.pandas_udf(T.StringType())
def parse_json_object(replies: pd.Series) -> pd.Series:
    """The object as canonical JSON, or null."""

    def canonical(reply) -> str | None:
        try:
            found = find_object(reply if isinstance(reply, str) else None)
            return None if found is None else json.dumps(found, ensure_ascii=False, sort_keys=True)
        except RecursionError:
            return None

    return pd.Series([canonical(t) for t in replies], dtype=object)


def _leaves(value, out: list) -> None:
    """Paths and leaves in document order, by a stack of our own: any depth that was read will do."""
    todo = [(value, "")]
    while todo:
        value, path = todo.pop()
        if isinstance(value, (dict, list)) and value:
            inner = value.items() if isinstance(value, dict) else enumerate(value)
            todo += reversed([(x, f"{path}.{k}" if path else str(k)) for k, x in inner])
            continue
        kind = "null" if value is None else "bool" if isinstance(value, bool) else "num" if isinstance(value, (int, float)) else "str" if isinstance(value, str) else "empty_list" if isinstance(value, list) else "empty_map"
        out.append({"path": path, "leaf": {"kind": kind, "num": float(value) if kind == "num" else None, "str": str(value).lower() if kind == "bool" else value if kind == "str" else None}})


def flat_object(text: str | None) -> list[dict]:
    try:
        value = json.loads(text) if text else None
    except (ValueError, RecursionError):
        value = None
    out: list[dict] = []
    if isinstance(value, dict) and value:
        _leaves(value, out)
    return out


@F.udf(T.ArrayType(_PAIR), useArrow=True)
def flatten_json(text: str) -> list[dict]:
    """Paths and leaves of any JSON object, for documents without a declared schema."""
    return flat_object(text)

"""Engines that ask a language or vision model, and the schemas and prompts they send.

A model is any callable ``complete(prompt, system, schema, images) -> reply text``; clients, keys and
providers are the caller's, so nothing here reaches a network.  It is called on executors, once a
document, and must be picklable.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd

from .engines import Extract
from .functions.replies import find_object
from .types import json_schema, schema_for

Complete = Callable[[str, str, dict, list[bytes]], str]
TRANSCRIPT = "_transcript"

#: What a schema says about itself rather than about the answer.
_ABOUT = {"title", "default", "additionalProperties", "$schema", "$comment", "$defs", "examples", "discriminator"}
#: The order in which a prompt shows keywords; others follow by name.
_SHOWN = {k: i for i, k in enumerate("type const enum format description required properties items".split())}

SYSTEM = (
    "You read business documents and return their data as JSON. Copy values as printed and keep every text in its own script. "
    "Write dates as YYYY-MM-DD, currencies as three-letter codes, and amounts as plain numbers. A value that is not printed is null: do not compute, guess or translate one."
)
VISION = SYSTEM + f" Read all pages, in order. Put your plain reading of them under {TRANSCRIPT!r}."


class ModelError(RuntimeError):
    """A call that failed, or a reply without a JSON object; asking again may help."""


class _Resolver:
    """Schemas without references: each is replaced by what it names, and what stands beside the
    reference wins.  A schema that contains itself becomes an object of any shape there."""

    def __init__(self, schema: dict, union: Callable[[dict, list[dict], bool], dict]):
        self.defs, self.union = schema.get("$defs") or {}, union

    def __call__(self, node: Any, within: frozenset[str] = frozenset()) -> Any:
        if isinstance(node, list):
            return [self(x, within) for x in node]
        if not isinstance(node, dict):
            return node
        if (ref := node.get("$ref")) is not None:
            name = str(ref).split("/")[-1]
            if name in within:
                return {"type": "object"}
            if not isinstance(self.defs.get(name), dict):
                raise ValueError(f"the schema has no definition for {ref}")
            own = {k: v for k, v in node.items() if k != "$ref"}
            return self(self.defs[name] | own, within | {name})
        made: dict[str, Any] = {}
        for key in node.keys() - _ABOUT - {"anyOf"}:
            # Below "properties" keys are names of fields, whatever they are called.
            made[key] = {name: self(x, within) for name, x in node[key].items()} if key == "properties" else self(node[key], within) if key in ("items", "contains", "prefixItems", "not") else node[key]
        if "anyOf" in node:
            ways = [x for x in node["anyOf"] if isinstance(x, dict)]
            real = [self(x, within) for x in ways if x.get("type") != "null"]
            made = self.union(made, real, len(real) < len(ways))
        return dict(sorted(made.items(), key=lambda kv: (_SHOWN.get(kv[0], len(_SHOWN)), kv[0])))


def prompt_schema(schema: dict) -> dict:
    """A schema as a prompt shows it: references resolved, remarks dropped, ``X or null`` as one type."""

    def union(own: dict, ways: list[dict], nullable: bool) -> dict:
        if len(ways) == 1 and nullable:
            only = ways[0] | own
            return only | {"type": [only["type"], "null"]} if isinstance(only.get("type"), str) else only
        return own | {"anyOf": ways + [{"type": "null"}] * nullable}

    return _Resolver(schema, union)(schema)


def narrow_schema(schema: dict) -> dict:
    """The same for services whose dialect has neither references, unions, constants nor type lists:
    ``nullable`` marks what may be null, and of several alternatives the first is taken."""

    def union(own: dict, ways: list[dict], nullable: bool) -> dict:
        return (ways[0] if ways else {"type": "string"}) | own | ({"nullable": True} if nullable else {})

    def plain(node: Any) -> Any:
        if not isinstance(node, dict):
            return node
        out = {k: {n: plain(x) for n, x in v.items()} if k == "properties" else plain(v) for k, v in node.items() if k != "const"}
        if "const" in node:
            out["enum"] = [node["const"]]
        if isinstance(node.get("type"), list):
            kinds = [t for t in node["type"] if t != "null"]
            out["type"] = kinds[0] if kinds else "string"
            if "null" in node["type"]:
                out["nullable"] = True
        return out

    return plain(_Resolver(schema, union)(schema))


def shown(schema: dict, indent: int = 0) -> str:
    """Indented JSON with lists of plain values on one line."""
    pad = "  " * (indent + 1)
    if isinstance(schema, dict) and schema:
        return "{\n" + ",\n".join(f"{pad}{json.dumps(k, ensure_ascii=False)}: {shown(v, indent + 1)}" for k, v in schema.items()) + "\n" + pad[2:] + "}"
    if isinstance(schema, list) and any(isinstance(x, (dict, list)) for x in schema):
        return "[\n" + ",\n".join(pad + shown(x, indent + 1) for x in schema) + "\n" + pad[2:] + "]"
    return json.dumps(schema, ensure_ascii=False)


def build_prompt(doc_type: str, text: str | None = None) -> str:
    """The request for one document; with its text, where that is what the model reads."""
    asked = f"Extract the fields of this {doc_type.strip().lower()}. Answer with one JSON object that fits this schema and has no other keys:\n\n{shown(prompt_schema(json_schema(schema_for(doc_type))))}"
    return asked if text is None else f"{asked}\n\nThe document's text:\n\n{text}"


def with_transcript(schema: dict) -> dict:
    field = {"type": "string", "description": "the text of all pages in reading order, as printed; not a field of the document"}
    return schema | {"properties": schema.get("properties", {}) | {TRANSCRIPT: field}}


def take_transcript(answer: dict) -> str | None:
    """Remove the transcript from an answer; one given page by page is joined."""
    value = answer.pop(TRANSCRIPT, None)
    if isinstance(value, (list, tuple)):
        value = "\n\n".join(t for t in (str(x).strip() for x in value) if t)
    return (value.strip() or None) if isinstance(value, str) else None


def ask(complete: Complete, prompt: str, system: str, schema: dict, images: list[bytes], attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> dict:
    """The JSON object of the reply.  Failed calls and replies without one are repeated, 1 to 12
    seconds apart; the last failure is raised.  Other errors are the caller's and are raised at once."""
    for turn in range(max(1, attempts)):
        try:
            found = find_object(complete(prompt, system, schema, images))
            if found is None:
                raise ModelError("the reply has no JSON object")
            return found
        except (ModelError, TimeoutError, ConnectionError):
            if turn + 1 >= attempts:
                raise
            wait(float(min(12, 2**turn)))
    raise AssertionError


def model_engine(complete: Complete, vision: bool = True, attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> Extract:
    """An engine for ``engines.register``.  With ``vision`` it reads the column ``pages`` (images)
    and leaves the text layer aside; without, it reads the text.  It has no confidence to report."""

    def answer(row) -> tuple:
        images = [bytes(x) for x in (row.pages if row.pages is not None else [])] if vision else []
        if vision and not images:
            return None, None, "no_pages"
        if not vision and not (row.text or "").strip():
            return None, None, "no_text"
        schema = json_schema(schema_for(row.doc_type))
        try:
            found = ask(complete, build_prompt(row.doc_type, None if vision else row.text), VISION if vision else SYSTEM, with_transcript(schema) if vision else schema, images, attempts, wait)
        except Exception as why:  # an engine reports, so that the others' answers are kept
            return None, None if vision else row.text, f"{type(why).__name__}: {why}"[:200]
        read = take_transcript(found)
        return json.dumps(found, ensure_ascii=False), read if vision else row.text, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                made, read, error = answer(row)
                yield pd.DataFrame({"path": [row.path], "json": pd.Series([made], dtype=object), "raw_text": pd.Series([read], dtype=object), "confidence": pd.Series([None], dtype="float64"), "error": pd.Series([error], dtype=object)})

    return run

"""JSON payloads inside page scripts.

Payload objects sit at any depth.  Spark has no walk over JSON of unknown shape
that keeps the order of keys, and unrolled levels would read every page once per
level.  So one small Arrow function hands out the objects (or leaves) that carry a
wanted key; rows without such a key never reach it, and everything after it is
plain columns again.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.functions import html as H
from lotwise.functions import text as T

_PUSH = "self.__next_f.push("
_SECOND_IS_TEXT = (
    r"""(?s)^\[\s*(?:-?[\d.eE+-]+|"[^"\\]*+(?:\\.[^"\\]*+)*+"|true|false|null)\s*,\s*\""""
)
_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*:)?'


def _starts_json(c: Column) -> Column:
    return c.startswith("[") | c.startswith("{")


def payload_texts(html: Column) -> Column:
    """JSON texts pushed by page scripts: the pushed array, then its second element
    if that is text with JSON after an id prefix."""
    pushes = F.filter(F.transform(H.scripts(html), lambda s: T.strip(s)), lambda s: s.startswith(_PUSH))

    def texts(push: Column) -> Column:
        outer = F.regexp_replace(F.substring(push, F.lit(len(_PUSH) + 1), F.length(push)), r"\);?$", "")
        return T.let(outer, lambda o: F.array_compact(F.array(o, T.let(second(o), inner))))

    def second(outer: Column) -> Column:
        return F.when(outer.rlike(_SECOND_IS_TEXT), F.get_json_object(outer, "$[1]"))

    def inner(text: Column) -> Column:
        tail = F.substring(text, F.locate(":", text) + 1, F.length(text))
        return F.when(text.contains(":") & _starts_json(tail), tail).when(_starts_json(text), text)

    return F.when(
        T.text(html).contains(_PUSH), F.flatten(F.transform(pushes, texts))
    ).otherwise(F.array().cast("array<string>"))


def string_leaves(json_text: Column, holding: str | None = None) -> Column:
    """String values of a JSON text in source order, keys left out.

    With ``holding`` (lower case, without escapes), those that hold it, in whatever case, and some others.
    """
    found = F.filter(
        F.regexp_extract_all(json_text, F.lit(_JSON_STRING), F.lit(0)),
        lambda s: ~s.endswith(":") & (F.lit(True) if holding is None else F.lower(s).contains(holding) | s.contains("\\")),
    )
    return F.from_json(
        F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")), "array<string>"
    )


_NESTED = (dict, list)


def _objects(root, wanted: frozenset[str]):
    """Every nested object that has one of the keys, parents first, in source order."""
    stack = [root]
    while stack:
        node = stack.pop()
        if type(node) is dict:
            if not wanted.isdisjoint(node):
                yield node
            children = node.values()
        elif type(node) is list:
            children = node
        else:
            continue
        stack.extend([v for v in reversed(children) if type(v) in _NESTED])


def _keyed(root, hits):
    """Every (key, path, value) whose key hits, parents first, in source order.

    A path is a chain of (rest, piece) until a hit writes it out; values below which no key
    can stand are not visited.
    """
    stack = [(None, None, root)]
    while stack:
        path, key, node = stack.pop()
        if key is not None and hits(key):
            yield key, _path(path), node
        if type(node) is dict:
            stack.extend([((path, k), k, v) for k, v in reversed(node.items()) if type(v) in _NESTED or hits(k)])
        elif type(node) is list:
            stack.extend([((path, i), None, node[i]) for i in range(len(node) - 1, -1, -1) if type(node[i]) in _NESTED])


def _path(chain) -> str:
    pieces = []
    while chain is not None:
        chain, piece = chain
        pieces.append(piece)
    text = ""
    for piece in reversed(pieces):
        text += f"[{piece}]" if type(piece) is int else f".{piece}" if text else piece
    return text


def _parse(text: str, prefix: bool):
    try:
        return json.JSONDecoder().raw_decode(text)[0] if prefix else json.loads(text)
    except (ValueError, RecursionError):  # not JSON, or nested too deep to read
        return None


def _plain(text: str) -> str:
    """Halves of surrogate pairs, which no column can hold, become '?'."""
    return text.encode("utf-8", "replace").decode()


_ENCODER = json.JSONEncoder(ensure_ascii=False)


def _text(node) -> str:
    text = _ENCODER.encode(node)
    return text if text.isascii() else _plain(text)


def objects_with(texts: Column, keys: Sequence[str], *, prefix: bool = False, members: Sequence[str] | None = None) -> Column:
    """Nested objects that have one of the keys, as JSON texts, parents first.

    ``prefix`` reads the first JSON value of a text and ignores what follows.  With ``members``,
    the objects keep only these of their own members: nothing else of a large one is written out.
    """
    wanted = frozenset(keys)
    kept = None if members is None else frozenset(members)

    @F.pandas_udf("array<string>")
    def find(rows: pd.Series) -> pd.Series:
        def one(row):
            if row is None:
                return []
            found = [node for text in row for node in _objects(_parse(text, prefix), wanted)]
            return [_text(node if kept is None else {k: v for k, v in node.items() if k in kept}) for node in found]

        return rows.map(one)

    return find(_worth_parsing(texts, list(keys)))


def keyed_values(texts: Column, words: Sequence[str]) -> Column:
    """Keys that contain one of the words (lower case), with path and value text."""
    wanted = list(words)

    @F.pandas_udf("array<struct<key string, path string, value string>>")
    def find(rows: pd.Series) -> pd.Series:
        # Pages share their keys, so each is compared with the words once.
        hits = lru_cache(4096)(lambda key: any(w in key.lower() for w in wanted))

        def one(row):
            if row is None:
                return []
            return [
                {"key": _plain(key), "path": _plain(path), "value": _plain(str(node))}
                for text in row
                for key, path, node in _keyed(_parse(text, False), hits)
            ]

        return rows.map(one)

    return find(F.when(F.size(texts) > 0, texts))


def _worth_parsing(texts: Column, keys: Sequence[str]) -> Column:
    hit = F.exists(texts, lambda t: T.contains_any(t, [json.dumps(k, ensure_ascii=False) for k in keys]))
    return F.when(hit, F.filter(texts, lambda t: T.contains_any(t, [f'"{k}"' for k in keys])))

"""Strict JSON reading and an iterative walk over its nodes, in plain Python for Arrow batches."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?", re.ASCII)
SPACE = re.compile(r"[ \t\n\r]*")
WORDS = {"true": True, "false": False, "null": None}


def _refuse(word: str):
    raise ValueError(word)


def _number(text: str):
    return float(text) if set(text) & set(".eE") else int(text)


def _deep(text: str):
    """Strict JSON without recursion, for documents nested deeper than the built-in reader goes."""
    root: list = []
    stack: list = [(root, None)]  # (container, pending member name)
    i, n, want = SPACE.match(text).end(), len(text), "value"
    while i < n:
        c = text[i]
        box, name = stack[-1]
        if want in ("value", "first") and c in '{["-0123456789tfn':
            if c == '"':
                value, i = json.decoder.scanstring(text, i + 1, True)
            elif c in "{[":
                value, i = ({} if c == "{" else []), i + 1
            elif c in "tfn":
                word = next((w for w in WORDS if text.startswith(w, i)), None)
                if word is None:
                    raise ValueError(i)
                value, i = WORDS[word], i + len(word)
            else:
                m = NUMBER.match(text, i)
                if not m:
                    raise ValueError(i)
                value, i = _number(m[0]), m.end()
            if isinstance(box, dict):
                box[name] = value
            else:
                box.append(value)
            if c in "{[":
                stack.append((value, None))
                want = "name1" if c == "{" else "first"
            else:
                want = "next"
        elif want in ("name", "name1") and c == '"':
            name, i = json.decoder.scanstring(text, i + 1, True)
            i = SPACE.match(text, i).end()
            if text[i : i + 1] != ":":
                raise ValueError(i)
            stack[-1], i, want = (box, name), i + 1, "value"
        elif (want in ("next", "name1") and c == "}" and isinstance(box, dict)) or (want in ("next", "first") and c == "]" and isinstance(box, list) and len(stack) > 1):
            stack.pop()
            i, want = i + 1, "next"
        elif want == "next" and c == "," and len(stack) > 1:
            i, want = i + 1, "name" if isinstance(box, dict) else "value"
        else:
            raise ValueError(i)
        i = SPACE.match(text, i).end()
    if len(stack) != 1 or len(root) != 1:
        raise ValueError("end")
    return root[0]


def loads(text: str):
    """The value of a strict JSON text; ValueError if it is none (NaN and Infinity are none)."""
    sys.set_int_max_str_digits(0)
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return _deep(text)


def document(text: str | None):
    """(True, value) of a document; a text that is one JSON string holding JSON is opened once."""
    if not text:
        return False, None
    try:
        value = loads(text)
        if isinstance(value, str):
            try:
                value = loads(value)
            except ValueError:
                pass
        return True, value
    except ValueError:
        return False, None


def kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "float"
    if isinstance(v, str):
        return "string"
    return "array" if isinstance(v, list) else "object"


def walk(root, path: str = "", above: str = "", general: str = "", top: bool = True) -> Iterator[tuple]:
    """Every node below the root, preorder: (path, object path above, ordinals, key, value, container path, general path).

    The general path has [] for any element and is the name of the related table. A node of a document
    is walked by giving its paths and top=False.
    """
    if isinstance(root, dict):
        stack = [_members(root, path, path, general, (), top)]
    elif isinstance(root, list):
        stack = [_elements(root, path, above, general, ())]
    else:
        return
    while stack:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
            continue
        yield node
        path, above, ords, _, value, _, general = node
        if isinstance(value, dict):
            stack.append(_members(value, path, path, general, ords, False))
        elif isinstance(value, list):
            stack.append(_elements(value, path, above, general, ords))


def _members(obj: dict, path: str, above: str, general: str, ords: tuple, top: bool):
    for i, (k, v) in enumerate(obj.items()):
        yield (k if top else f"{path}.{k}"), above, ords + (i,), k, v, path, (k if top else f"{general}.{k}")


def _elements(arr: list, path: str, above: str, general: str, ords: tuple):
    for i, v in enumerate(arr):
        yield f"{path}[{i}]", above, ords + (i,), None, v, path, f"{general}[]"


def clean(s: str) -> str:
    """Text that Arrow can hold: lone surrogates become U+FFFD."""
    try:
        s.encode()
        return s
    except UnicodeEncodeError:
        return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def text_of(v) -> str | None:
    """A scalar as text (strings as they are), a container as JSON."""
    if v is None or isinstance(v, str):
        return None if v is None else clean(v)
    return clean(json.dumps(v, ensure_ascii=False))

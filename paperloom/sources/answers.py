"""Repair of answers that should be a JSON list of objects: one pass over the characters with a stack of what is open."""

from __future__ import annotations

import json
import re

#: A list's start: a bracket before an object, another bracket's end or the end of the answer.
_START = re.compile(r"\[(?=\s*(?:\{|\]|$))")
_BARE = re.compile(r"[^\s,\]}{:\[\"]+")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_WORDS = {"null": None, "None": None}


def _closes(text: str, at: int, key: bool) -> bool:
    """Whether the quote at ``at`` ends its string: what follows must go on as JSON would; other quotes belong to the text."""
    rest = text[at + 1 :].lstrip() if at + 200 > len(text) else text[at + 1 : at + 200].lstrip() or text[at + 1 :].lstrip()
    if key:
        return rest[:1] == ":"
    if rest[:1] in ("", "]"):
        return rest[1:].lstrip()[:1] in ("", ",", "}", "]", "`") if rest else True
    if rest[:1] == "}":
        return rest[1:].lstrip()[:1] in ("", ",", "]", "}", "{")
    return rest[:1] == "," and (ahead := rest[1:].lstrip()[:1]) in ("", '"', "'", "}", "]", "{")


def _string(text: str, at: int, key: bool) -> tuple[str | None, int]:
    """The string whose quote stands at ``at`` and the place behind it; None where the answer ends within it."""
    quote, out, at = text[at], [], at + 1
    while at < len(text):
        c = text[at]
        if c == "\\" and at + 1 < len(text):
            c = text[at + 1]
            if c == "u" and re.fullmatch(r"[0-9A-Fa-f]{4}", text[at + 2 : at + 6]):
                out.append(chr(int(text[at + 2 : at + 6], 16)))
                at += 6
                continue
            out.append(_ESCAPES.get(c, c))
            at += 2
        elif c == quote and _closes(text, at, key):
            return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace"), at + 1
        else:
            out.append(c)
            at += 1
    return None, at


def repaired(answer: str | None) -> str | None:
    """A JSON list of the objects in an answer, null where there is no list.

    Text before and behind the list, fences, commas too many, missing commas, single quotes, line breaks and unescaped quotes
    within strings are repaired; an object that is cut off goes; values other than strings are kept as they are written."""
    if answer is None or (start := _START.search(answer)) is None:
        return None
    found: list[dict] = []
    stack: list[tuple[str, dict]] = [("list", {})]
    key, at = None, start.end()
    while at < len(answer) and stack:
        c, (kind, own) = answer[at], stack[-1]
        if c == "{":
            stack.append(("object", {}))
            if kind == "object" and key is not None:
                own[key] = stack[-1][1]
            key, at = None, at + 1
        elif c == "[":
            stack.append(("list", {}))
            at += 1
        elif c == "}" and kind == "object":
            stack.pop()
            if len(stack) == 1:
                found.append(own)
            key, at = None, at + 1
        elif c == "]" and kind == "list":
            stack.pop()
            key, at = None, at + 1
        elif c in "\"'":
            text, at = _string(answer, at, kind == "object" and key is None)
            if text is not None and kind == "object":
                if key is None:
                    key = text
                else:
                    own[key], key = text, None
        elif (bare := _BARE.match(answer, at)) is not None and not c.isspace():
            if kind == "object" and key is not None:
                own[key], key = _WORDS.get(bare[0], bare[0]), None
            elif kind == "object" and answer[bare.end() :].lstrip()[:1] == ":":
                key = bare[0]
            at = bare.end()
        else:
            at += 1
    return json.dumps(found)

"""Replies of a language model: truncation, extraction and repair of their JSON."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vaultlens.functions import text as T

_SPACE = re.compile(r"[ \t\r\n]*")
_PLAIN = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null")
_NUMBER_END = re.compile(r"\.|[eE][-+]?")
#: An escape that breaks off, or the first half of a pair of them.
_CUT_ESCAPE = re.compile(r"(?:\\u[dD][89abAB][0-9a-fA-F]{2})?\\(?:u[0-9a-fA-F]{0,3})?\Z|\\u[dD][89abAB][0-9a-fA-F]{2}\Z")


def looks_truncated(c: Column | str) -> Column:
    """Whether a reply seems to break off: blank, an open quote at the end, more than one bracket open, or a dangling mark.

    Brackets within strings count as well, and one missing closer is let pass.
    """
    s = T.rstrip(c)
    n = lambda chars: F.length(s) - F.length(F.translate(s, chars, ""))
    return F.coalesce((s == "") | (s.endswith('"') & (n('"') % 2 != 0)) | (n("{[") > n("}]") + 1) | F.right(s, F.lit(1)).isin(",", ":", "\\"), F.lit(True))


def fenced(c: Column | str) -> Column:
    """The payload of a reply: its first JSON fence, else its first fence, else all of it, stripped."""
    s = T.strip(c)
    json_fence = F.regexp_extract(s, r"(?s)```json[\s]*(.*?)[\s]*```", 1)
    fence = F.regexp_extract(s, r"(?s)```[\s]*(.*?)[\s]*```", 1)
    has = lambda p: s.rlike(p)
    return F.when(has(r"(?s)```json[\s]*(.*?)[\s]*```"), T.strip(json_fence)).when(~F.contains(s, F.lit("```json")) & has(r"(?s)```[\s]*(.*?)[\s]*```"), T.strip(fence)).otherwise(s)


class _Prefix:
    """Reads JSON that may break off: what was there counts, a member without its value does not."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        """The next mark; empty at the end of the text."""
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def value(self) -> tuple[bool, object]:
        """Whether there is a value here, and what it is."""
        mark = self.peek()
        if mark == "{":
            return True, self.members()
        if mark == "[":
            return True, self.items()
        if mark == '"':
            return True, self.string()[1]
        if m := _PLAIN.match(self.text, self.at):
            self.at = len(self.text) if _NUMBER_END.fullmatch(self.text, m.end()) else m.end()
            return True, json.loads(m.group())
        if mark and not any(word.startswith(self.text[self.at :]) for word in ("true", "false", "null", "-")):
            raise ValueError(mark)
        self.at = len(self.text)
        return False, None

    def string(self) -> tuple[bool, str]:
        """Whether a string is closed, and what it says."""
        try:
            out, self.at = scanstring(self.text, self.at + 1, False)
            return True, out
        except json.JSONDecodeError as e:
            if not e.msg.startswith(("Unterminated", "Invalid \\uXXXX")):
                raise
        rest = self.text[self.at + 1 :]
        cut = _CUT_ESCAPE.search(rest)
        even = cut and (len(rest[: cut.start()]) - len(rest[: cut.start()].rstrip("\\"))) % 2 == 0
        self.at = len(self.text)
        return False, scanstring((rest[: cut.start()] if even else rest) + '"', 0, False)[0]

    def go_on(self, end: str) -> bool:
        """After a member: whether another one may follow."""
        mark = self.peek()
        if mark not in (",", end, ""):
            raise ValueError(mark)
        self.at += len(mark)
        return mark == ","

    def items(self) -> list:
        self.at += 1
        out: list = []
        if self.peek() == "]":
            self.at += 1
            return out
        while True:
            some, x = self.value()
            if some:
                out.append(x)
            if not some or not self.go_on("]"):
                return out

    def members(self) -> dict:
        self.at += 1
        out: dict = {}
        if self.peek() == "}":
            self.at += 1
            return out
        while self.peek():
            if self.peek() != '"':
                raise ValueError(self.peek())
            closed, key = self.string()
            if not closed or self.peek() not in (":", ""):
                if closed:
                    raise ValueError(self.peek())
                break
            self.at += 1
            some, x = self.value()
            if not some:
                break
            out[key] = x
            if not self.go_on("}"):
                break
        return out


def _whole(text: str) -> bool:
    """Whether a text has no halves of pairs, which UTF-8 can't hold."""
    try:
        text.encode()
        return True
    except UnicodeEncodeError:
        return False


def repair_json(text: str) -> str | None:
    """JSON of a text that breaks off, as far as it goes; None if it is no beginning of an object or array.

    A key without its value is left out, a value that breaks off ends there.
    """
    p = _Prefix(text)
    try:
        if p.peek() not in ("{", "["):
            return None
        found = p.value()[1]
        if p.peek():
            return None
        out = json.dumps(found, ensure_ascii=False)
        return out if out.isascii() or _whole(out) else json.dumps(found)
    except (ValueError, RecursionError):
        return None


def parse_reply(text: str | None) -> str | None:
    """Valid JSON of a payload, repaired if need be; None if there is none."""
    if text is None:
        return None
    try:
        json.loads(text)
        return text
    except ValueError:
        return repair_json(text)


def breaks_off(reply: str) -> bool:
    """Whether a reply is blank, or its JSON begins and does not end."""
    text = reply.strip()
    start = re.search(r"[{\[]", text)
    if not text or not start:
        return not text
    try:
        json.JSONDecoder().raw_decode(text, start.start())
        return False
    except (ValueError, RecursionError):
        return repair_json(text[start.start() :]) is not None


@F.pandas_udf(StringType())
def reply_json(payload: pd.Series) -> pd.Series:
    """parse_reply for columns; use on fenced()."""
    return payload.map(parse_reply)

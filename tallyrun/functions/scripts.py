"""Values that a page's scripts state literally: JSON bodies, assigned and passed objects and lists, addresses that calls name.  No script is run.

A script is cut into tokens by one automaton (blanks and comments, strings, templates without substitutions, numbers, words, signs).  A value is read from
tokens alone; where a bracket does not open a literal the next one is tried, and nesting is bounded, so every token is read a bounded number of times.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql.functions import udtf

from .markup import Page

MOST_DEPTH = 48
# Calls that fetch what they are given first, and names that hold an address.
FETCHES = frozenset("fetch get post ajax open request".split())
ADDRESS_NAMES = frozenset("url endpoint apiurl apiendpoint baseurl jobsurl searchurl".split())
FLIGHT_CALL = "__next_f.push"

_TOKEN = re.compile(
    r"""(?P<blank>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\$]|\\.|\$(?!\{))*`)"""
    r"""|(?P<number>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<sign>.)""",
    re.S,
)
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|.))", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}
_NAMED = {"true": True, "false": False, "null": None, "undefined": None, "NaN": None}

Token = tuple[str, str]


class NoLiteral(ValueError):
    """What stands here is no literal value."""


def tokens(script: str) -> list[Token]:
    return [(m.lastgroup, m[0]) for m in _TOKEN.finditer(script) if m.lastgroup != "blank"]


def string_value(token: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        return chr(min(int(code, 16), 0x10FFFF)) if code else _PLAIN.get(m[4], m[4])

    text = _ESCAPE.sub(one, token[1:-1])
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def read_value(run: list[Token], at: int, depth: int = 0) -> tuple[object, int]:
    """The literal at a token, and the place behind it."""
    if at >= len(run) or depth > MOST_DEPTH:
        raise NoLiteral
    kind, text = run[at]
    if kind == "string":
        return string_value(text), at + 1
    if kind == "number":
        return (int(text, 16) if text[:2].lower() == "0x" else float(text) if set(text) & set(".eE") else int(text)), at + 1
    if kind == "word":
        if text == "void" and run[at + 1 : at + 2] == [("number", "0")]:
            return None, at + 2
        if text in _NAMED:
            return _NAMED[text], at + 1
        raise NoLiteral
    if text == "!" and at + 1 < len(run) and run[at + 1] in (("number", "0"), ("number", "1")):
        return run[at + 1][1] == "0", at + 2
    if text == "-" and at + 1 < len(run) and run[at + 1][0] == "number":
        value, end = read_value(run, at + 1, depth)
        return -value, end
    if text == "[":
        return _read_list(run, at + 1, depth)
    if text == "{":
        return _read_object(run, at + 1, depth)
    raise NoLiteral


def _behind(run: list[Token], at: int, close: str) -> tuple[bool, int]:
    """Behind a member: whether the bracket closed, and the place to go on; a comma may stand before the bracket."""
    sign = run[at] if at < len(run) else ("", "")
    if sign == ("sign", ","):
        at += 1
        return (True, at + 1) if run[at : at + 1] == [("sign", close)] else (False, at)
    if sign == ("sign", close):
        return True, at + 1
    raise NoLiteral


def _read_list(run: list[Token], at: int, depth: int) -> tuple[list, int]:
    out: list = []
    done = run[at : at + 1] == [("sign", "]")]
    at += done
    while not done:
        value, at = read_value(run, at, depth + 1)
        out.append(value)
        done, at = _behind(run, at, "]")
    return out, at


def _read_object(run: list[Token], at: int, depth: int) -> tuple[dict, int]:
    out: dict = {}
    done = run[at : at + 1] == [("sign", "}")]
    at += done
    while not done:
        if at + 1 >= len(run) or run[at][0] == "sign" or run[at + 1] != ("sign", ":"):
            raise NoLiteral
        key = string_value(run[at][1]) if run[at][0] == "string" else run[at][1]
        out[key], at = read_value(run, at + 2, depth + 1)
        done, at = _behind(run, at, "}")
    return out, at


def _name(run: list[Token], at: int) -> str:
    """The words, joined by points, that end before a token."""
    out: list[str] = []
    while at >= 0 and run[at][0] == "word":
        out.append(run[at][1])
        if at < 2 or run[at - 1] != ("sign", "."):
            break
        at -= 2
    return ".".join(reversed(out))


def literals(script: str) -> Iterator[tuple[str, object]]:
    """(name, value) of the objects, lists and addresses that a script states: the name assigned, the key, or the call it is passed to."""
    run, at = tokens(script), 0
    while at < len(run):
        kind, text = run[at]
        before = run[at - 1][1] if at and run[at - 1][0] == "sign" else ""
        if (kind == "sign" and text in "[{") or kind == "string":
            key = run[at - 2][1] if before == ":" and at > 1 and run[at - 2][0] == "string" else None
            name = string_value(key) if key else _name(run, at - 2) if before in ("=", ":", "(") else ""
            last = name.rpartition(".")[2]
            wanted = kind == "sign" or (last in FETCHES if before == "(" else last.lower() in ADDRESS_NAMES)
            if wanted:
                try:
                    value, end = read_value(run, at)
                except NoLiteral:
                    pass
                else:
                    if value:
                        yield name, value
                    at = end
                    continue
        at += 1


def flight_values(chunks: str) -> Iterator[object]:
    """The JSON values of a streamed page's lines, ``id:value`` each."""
    for line in chunks.splitlines():
        key, mark, body = line.partition(":")
        if mark and re.fullmatch(r"[0-9A-Za-z]{1,32}", key):
            try:
                yield json.loads(body)
            except ValueError:
                continue


def page_values(html: str | None) -> Iterator[tuple[int, str, object]]:
    """(script, name, value) of a page: whole JSON scripts (no name), literals of others, then what streamed chunks hold (no name, the last script)."""
    chunks, page = [], Page.of(html)
    for k, (kind, body) in enumerate(page.scripts):
        text = body.strip().removeprefix("<![CDATA[").removesuffix("]]>").strip()
        if "json" in kind.lower() or text[:1] in ("{", "["):
            try:
                yield k, "", json.loads(text)
                continue
            except ValueError:
                if "json" in kind.lower():
                    continue
        for name, value in literals(text):
            if name.endswith(FLIGHT_CALL) and isinstance(value, list):
                chunks += [x for x in value if isinstance(x, str)]
            else:
                yield k, name, value
    for value in flight_values("".join(chunks)):
        yield len(page.scripts) - 1, "", value


@udtf(returnType="position int, script int, name string, value string")
class script_values:
    """``page_values`` with the values as JSON."""

    def eval(self, html: str) -> Iterator[tuple]:
        for k, (script, name, value) in enumerate(page_values(html)):
            yield k, script, name, json.dumps(value, ensure_ascii=False)

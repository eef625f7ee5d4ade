"""What can be told from the text of a pattern.

``required`` lists texts that every match holds, so that most lines never meet the pattern.
``linear`` gives an equal pattern without backtracking for a frequent form: parts of fixed
width with ``.*`` between them.  Such a pattern matches a line once at most: from the first
place of its first part to the last place of its last part, if the parts between fit.  The
earliest place of each part leaves most room for the next, so each is searched for once,
and an atomic group keeps what was found.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

_SET = r"\[\^?\]?(?:\\.|[^\]\\])*\]"
_ATOM = re.compile(rf"(?P<set>{_SET})|\\(?P<kind>[sSdDwWtnrfv])|\\(?P<escaped>[^a-zA-Z0-9])|(?P<any>\.)|(?P<plain>[^\\\[\](){{}}.*+?^$|])", re.DOTALL)
_REPEAT = re.compile(r"(?P<some>[*+?])(?P<how>[?+]?)|\{\d*,?\d*\}[?+]?")


@dataclass(frozen=True)
class Item:
    """An atom as written, the character it stands for if there is just one, and how it is repeated."""

    atom: str
    literal: str | None
    repeat: str


def _item(pattern: str, at: int) -> tuple[Item, int] | None:
    atom = _ATOM.match(pattern, at)
    if atom is None:
        return None
    repeat = _REPEAT.match(pattern, atom.end())
    end = repeat.end() if repeat else atom.end()
    return Item(atom.group(), atom["escaped"] or atom["plain"], repeat.group() if repeat else ""), end


def _group_end(pattern: str, at: int) -> int:
    """The place after the group that begins here."""
    depth = 0
    for token in re.compile(rf"\\.|{_SET}|[()]|.", re.DOTALL).finditer(pattern, at):
        depth += {"(": 1, ")": -1}.get(token.group(), 0)
        if not depth:
            return token.end()
    return len(pattern)


def required(pattern: str) -> tuple[str, ...]:
    """Lower-case ASCII texts that every match of a pattern holds when case is ignored; none where that cannot be told."""
    if re.search(r"\(\?[a-zA-Z]*x", pattern):
        return ()
    runs, run, at = [], "", 0
    while at < len(pattern):
        found = _item(pattern, at)
        if found is None:
            if pattern[at] == "|":
                return ()
            runs, run = [*runs, run], ""
            at = _group_end(pattern, at) if pattern[at] == "(" else at + (2 if pattern[at] == "\\" else 1)
            repeat = _REPEAT.match(pattern, at)
            at = repeat.end() if repeat else at
            continue
        item, at = found
        known = item.literal is not None and item.literal.isascii() and item.repeat in ("", "+")
        if known:
            run += item.literal.lower()
        if not known or item.repeat:
            runs, run = [*runs, run], ""
    runs = sorted({*runs, run} - {""}, key=lambda text: (-len(text), text))
    return tuple(text for n, text in enumerate(runs) if not any(text in longer for longer in runs[:n]))


def _parts(pattern: str) -> list[list[Item]] | None:
    """The items between the ``.*`` of a pattern that is a plain sequence of items."""
    parts: list[list[Item]] = [[]]
    at = 0
    while at < len(pattern):
        found = _item(pattern, at)
        if found is None or found[0].repeat not in ("", "*", "+"):
            return None
        item, at = found
        if item.atom == "." and item.repeat:
            if item.repeat == "+":
                parts[-1].append(replace(item, repeat=""))
            parts.append([])
        else:
            parts[-1].append(item)
    return parts


def _trimmed(part: list[Item], left: bool, right: bool) -> list[Item]:
    """A part without what a neighbouring ``.*`` takes as well: of a repeated item there, at most one is needed."""
    part = list(part)
    for on, end in ((left, 0), (right, -1)):
        while on and part and part[end].repeat == "*":
            part.pop(end)
        if on and part and part[end].repeat == "+":
            part[end] = replace(part[end], repeat="")
    return part


def linear(pattern: str) -> str | None:
    """An equal pattern that takes linear time on a line without line ends; group 1 is the text before the match, group 2 the match."""
    parts = _parts(pattern)
    if parts is None or len(parts) < 2:
        return None
    last = len(parts) - 1
    parts = [_trimmed(part, n > 0, n < last) for n, part in enumerate(parts)]
    first, *middle, end = parts
    fixed = [*first, *(item for part in middle for item in part), *end[:-1]]
    if any(item.repeat for item in fixed) or not any(parts):
        return None

    def text(part: list[Item]) -> str:
        return "".join(item.atom + item.repeat for item in part)

    steps = "".join(f"(?>.*?{text(part)})" for part in middle if part)
    tail = f"(?>.*{text(end)})" if end else ".*"
    return f"^((?>.*?(?={text(first)})))({text(first)}{steps}{tail})"

"""Immutable texts as trees of short leaves, which are cut and joined without copying what they hold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf (text) or the concatenation of two ropes. chars counts code points, ends counts line ends, so that both
    the place of a code point and that of a line are found by going down one path."""

    chars: int
    ends: int
    depth: int
    text: str | None = None
    left: Rope | None = None
    right: Rope | None = None


EMPTY = Rope(0, 0, 0, "")


def leaf(text: str) -> Rope:
    return Rope(len(text), text.count("\n"), 0, text) if text else EMPTY


def join(left: Rope, right: Rope) -> Rope:
    if not left.chars or not right.chars:
        return left if left.chars else right
    return Rope(left.chars + right.chars, left.ends + right.ends, 1 + max(left.depth, right.depth), None, left, right)


def build(text: str, leaf_chars: int) -> Rope:
    """A balanced tree over leaves of leaf_chars code points."""
    level = [leaf(text[i : i + leaf_chars]) for i in range(0, len(text), leaf_chars)] or [EMPTY]
    while len(level) > 1:
        level = [join(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def leaves(rope: Rope) -> Iterator[str]:
    waiting = [rope]
    while waiting:
        node = waiting.pop()
        if node.text is not None:
            yield node.text
        else:
            waiting += (node.right, node.left)


def flat(rope: Rope) -> str:
    return "".join(leaves(rope))


def units(rope: Rope) -> int:
    """Lines: as many as line ends, and one more if something follows the last of them."""
    node = rope
    while node.text is None:
        node = node.right
    return rope.ends + bool(node.text and node.text[-1] != "\n")


def split_chars(rope: Rope, at: int) -> tuple[Rope, Rope]:
    """The first `at` code points, and the rest."""
    if at <= 0 or at >= rope.chars:
        return (EMPTY, rope) if at <= 0 else (rope, EMPTY)
    if rope.text is not None:
        return leaf(rope.text[:at]), leaf(rope.text[at:])
    if at <= rope.left.chars:
        first, second = split_chars(rope.left, at)
        return first, join(second, rope.right)
    first, second = split_chars(rope.right, at - rope.left.chars)
    return join(rope.left, first), second


def split_units(rope: Rope, at: int) -> tuple[Rope, Rope]:
    """The first `at` lines, and the rest."""
    if at > rope.ends:
        return rope, EMPTY
    if at <= 0:
        return EMPTY, rope
    if rope.text is not None:
        place = -1
        for _ in range(at):
            place = rope.text.index("\n", place + 1)
        return split_chars(rope, place + 1)
    if at <= rope.left.ends:
        first, second = split_units(rope.left, at)
        return first, join(second, rope.right)
    first, second = split_units(rope.right, at - rope.left.ends)
    return join(rope.left, first), second

"""A rope: text as a balanced tree of immutable leaves, cut and joined by unit rank without copying the text.

A unit is a run of letters A-Z, a-z or one other code point. Leaves hold some thousands of code points and end where a unit ends; every node
caches its numbers of units and code points and its height, so a unit rank or a place of a code point is found on one way down. split() and
concat() make new nodes along that way alone (heights of siblings differ by one at most, as in an AVL tree) and share all other subtrees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)
LETTERS = re.compile("[A-Za-z]+")
LEAF_CHARS = 4096


@dataclass(frozen=True, slots=True)
class Leaf:
    text: str
    units: int
    chars: int
    height: int = 0


@dataclass(frozen=True, slots=True)
class Node:
    left: Rope
    right: Rope
    units: int
    chars: int
    height: int


Rope = Leaf | Node
EMPTY = Leaf("", 0, 0)


def count_units(text: str) -> int:
    runs = LETTERS.findall(text)
    return len(text) - sum(map(len, runs)) + len(runs)


def _leaf(text: str) -> Leaf:
    return Leaf(text, count_units(text), len(text))


def _node(left: Rope, right: Rope) -> Node:
    return Node(left, right, left.units + right.units, left.chars + right.chars, 1 + max(left.height, right.height))


def _level(left: Rope, right: Rope) -> Node:
    """A node of two subtrees whose heights differ by two at most."""
    if left.height > right.height + 1:
        if left.left.height >= left.right.height:
            return _node(left.left, _node(left.right, right))
        return _node(_node(left.left, left.right.left), _node(left.right.right, right))
    if right.height > left.height + 1:
        if right.right.height >= right.left.height:
            return _node(_node(left, right.left), right.right)
        return _node(_node(left, right.left.left), _node(right.left.right, right.right))
    return _node(left, right)


def _edge(rope: Rope, last: bool) -> str:
    while isinstance(rope, Node):
        rope = rope.right if last else rope.left
    return rope.text[-1 if last else 0]


def concat(left: Rope, right: Rope) -> Rope:
    """One after the other; no run of letters may go across, as the counts of units wouldn't add up."""
    if not left.chars or not right.chars:
        return left if left.chars else right
    if LETTERS.match(_edge(left, True)) and LETTERS.match(_edge(right, False)):
        raise ValueError("A run of letters goes across the joint.")
    return _join(left, right)


def _join(left: Rope, right: Rope) -> Rope:
    if left.height > right.height + 1:
        return _level(left.left, _join(left.right, right))
    if right.height > left.height + 1:
        return _level(_join(left, right.left), right.right)
    return _node(left, right)


def build(text: str, leaf_chars: int = LEAF_CHARS) -> Rope:
    """Leaves of about so many code points (a longer run of letters lies whole in one), paired level by level."""
    leaves, at = [], 0
    while at < len(text):
        end = min(at + leaf_chars, len(text))
        if end < len(text) and LETTERS.match(text, end - 1):
            end = LETTERS.match(text, end - 1).end()
        leaves.append(_leaf(text[at:end]))
        at = end
    level: list[Rope] = leaves or [EMPTY]
    while len(level) > 1:
        level = [_join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def split(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first so many units and the rest."""
    if rank <= 0:
        return EMPTY, rope
    if rank >= rope.units:
        return rope, EMPTY
    if isinstance(rope, Leaf):
        for seen, unit in enumerate(UNIT.finditer(rope.text), 1):
            if seen == rank:
                return Leaf(rope.text[: unit.end()], rank, unit.end()), Leaf(rope.text[unit.end() :], rope.units - rank, rope.chars - unit.end())
    if rank <= rope.left.units:
        left, right = split(rope.left, rank)
        return left, _join(right, rope.right) if right.chars else rope.right
    left, right = split(rope.right, rank - rope.left.units)
    return _join(rope.left, left) if left.chars else rope.left, right


def unit_rank(rope: Rope, place: int) -> int:
    """How many units end at or before the first so many code points."""
    rank = 0
    while isinstance(rope, Node):
        if place < rope.left.chars:
            rope = rope.left
        else:
            place, rank, rope = place - rope.left.chars, rank + rope.left.units, rope.right
    return rank + count_units(rope.text[:place])


def leaves(rope: Rope) -> Iterator[Leaf]:
    todo = [rope]
    while todo:
        rope = todo.pop()
        if isinstance(rope, Node):
            todo += (rope.right, rope.left)
        else:
            yield rope


def find(rope: Rope, pattern: str) -> int:
    """The place of the first occurrence in code points, which may lie across leaves, or -1."""
    before, tail = 0, ""
    for leaf in leaves(rope):
        text = tail + leaf.text
        at = text.find(pattern)
        if at >= 0:
            return before - len(tail) + at
        before += leaf.chars
        tail = text[len(text) - len(pattern) + 1 :] if len(text) >= len(pattern) else text
    return -1


def text_of(rope: Rope) -> str:
    return "".join(leaf.text for leaf in leaves(rope))

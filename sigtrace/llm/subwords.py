"""Byte-level subword vocabularies: units that can be tokenised apart from their text.

A blank between two other characters always starts a new piece of byte-level
splitting, and a single line feed between them is always a piece of its own.
So a regular text falls apart into units that can be looked up in a memo; an
irregular one (doubled or other blanks around a cut) is tokenised as a whole.
"""

from __future__ import annotations


def lines_of_units(text: str) -> list[list[str]] | None:
    """A text's lines as lists of units, or None if it is irregular.

    The first unit of a line has no blank before it, the others have one; a line
    feed at the very end leaves an empty last line.
    """
    lines = [line.split(" ") for line in text.split("\n")]
    if len(lines) > 1 and lines[-1] == [""] and lines[-2] != [""]:
        lines[-1] = []
    for line in lines:
        if "" in line:
            return None
    return lines


def separable(unit: str) -> bool:
    return not (unit[0].isspace() or unit[-1].isspace())

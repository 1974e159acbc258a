"""Regular expressions whose meaning does not depend on the engine's Unicode settings.

Java's ``\\b`` looks at Unicode letters and its ``\\s`` misses the no-break space. The rules here were
written for ASCII word boundaries and Unicode spaces, so both are spelled out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "A-Za-z0-9_"
_EDGE = f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"
_SPACES = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def portable(pattern: str, ignore_case: bool = False) -> str:
    """Spells out word boundaries, spaces and end-of-text in a pattern."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two, ch = pattern[i:i + 2], pattern[i]
        if two == r"\b" and not in_class:
            out.append(_EDGE)
            i += 2
        elif two == r"\s":
            out.append(_SPACES if in_class else f"[{_SPACES}]")
            i += 2
        elif ch == "\\":
            out.append(two)
            i += 2
        else:
            if ch == "[" and not in_class:
                in_class = True
            elif ch == "]" and in_class:
                in_class = False
            out.append(r"\z" if ch == "$" and not in_class else ch)
            i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def _first_letters(words: str) -> str:
    """Letters the alternatives can begin with; '' when that is not plain to see."""
    depth, starts, letters = 0, True, set()
    for ch in words:
        if starts and ch.isalpha():
            letters.add(ch.lower())
            starts = False
        elif ch == "(":
            depth += 1
            # A group that opens an alternative passes its own beginnings on.
            if not starts and depth == 1:
                depth += 100
        elif ch == ")":
            depth -= 101 if depth == 101 else 1
        elif ch == "|":
            starts = depth < 100
        elif starts:
            return ""
    return "".join(sorted(letters))


def whole_words(words: str) -> str:
    """Any of ``words`` standing alone, ignoring case. The alternatives begin and end with word characters.

    A look-ahead for the possible first letters lets the matcher skip most positions at once.
    """
    letters = _first_letters(words)
    skip = f"(?=[{letters}])" if letters else ""
    return f"(?i){skip}(?<![{_WORD}])(?:{words})(?![{_WORD}])"


def word_start(letters: str) -> str:
    """A word boundary before one of the given word characters (a class body), for the start of a pattern.

    Before a word character a boundary is the absence of one on the other side; the letters come first, so most positions cost one look.
    """
    return f"(?=[{letters}])(?<![{_WORD}])"


# The characters of the class _SPACES.
_SPACE_CHARS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    """Strips every kind of space from both ends; only the ends are looked at."""
    return F.btrim(text, F.lit(_SPACE_CHARS))


def blank(text: Column) -> Column:
    return ~text.rlike(f"[^{_SPACES}]")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it to ``body``.

    Without it an expression that uses an intermediate value several times is planned as that
    many copies, and nested rules grow exponentially.
    """
    return F.element_at(F.transform(F.array(value), body), 1)

"""What a checker raises when it can't tell."""

from __future__ import annotations


class ParserGaveUp(Exception):
    """The parser itself failed (nesting too deep for it, say); the text has no verdict."""

"""Python's own parser as a checker: grammar only, nothing is compiled further or run."""

from __future__ import annotations

import ast
import warnings

from loomwright.functions.giveup import ParserGaveUp

__all__ = ["ParserGaveUp", "check"]


def check(code: str) -> str | None:
    """Null for valid code, else the error's text."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(code)
    except SyntaxError as e:
        return f"SyntaxError: {e.msg} at line {e.lineno}"
    except (MemoryError, RecursionError, ValueError, OverflowError) as e:
        raise ParserGaveUp(type(e).__name__) from e
    return None

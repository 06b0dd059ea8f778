"""A recogniser of Java 8 source: whether a text is a compilation unit, without building a tree."""

from loomwright.functions.javasyntax.parser import check

__all__ = ["check"]

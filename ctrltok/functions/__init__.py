"""Column-level building blocks (no DataFrame-level shuffles in here)."""

from ctrltok.functions import bins, depth, edit, text, tokens

__all__ = ["bins", "depth", "edit", "text", "tokens"]

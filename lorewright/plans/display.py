"""What the command line prints: lines with a sign of their kind, pairs of names and values, and a banner. Colours only on
a terminal."""

from __future__ import annotations

import sys

#: Sign and ANSI colour of each kind of line.
KINDS = {"step": ("→", 36), "info": ("·", 0), "done": ("✓", 32), "warning": ("!", 33), "error": ("✗", 31)}


def coloured(text: str, colour: int, on: bool) -> str:
    return f"\x1b[{colour}m{text}\x1b[0m" if on and colour else text


def say(kind: str, text: str, out=None) -> None:
    """A line of a kind; errors and warnings go to the error stream."""
    sign, colour = KINDS[kind]
    out = out or (sys.stderr if kind in ("error", "warning") else sys.stdout)
    print(f"{coloured(sign, colour, out.isatty())} {text}", file=out)


def pairs(values: dict, out=None) -> None:
    """Names and values, the values below one another."""
    wide = max(map(len, values), default=0)
    for name, value in values.items():
        print(f"  {name.ljust(wide)}  {value}", file=out or sys.stdout)


def banner(title: str, values: dict, out=None) -> None:
    """A frame with a title over names and values."""
    wide = max(map(len, values), default=0)
    rows = [title, "", *(f"{n.ljust(wide)}  {v}" for n, v in values.items())] if values else [title]
    across = max(map(len, rows))
    print("\n".join(["┌" + "─" * (across + 2) + "┐", *(f"│ {r.ljust(across)} │" for r in rows), "└" + "─" * (across + 2) + "┘"]), file=out or sys.stdout)

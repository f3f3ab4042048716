"""Settings given as text: lists, truth values, plain values, sweeps."""

from __future__ import annotations

import itertools
import re
from typing import NamedTuple

#: Words for true and false.
TRUE, FALSE = {"1", "true", "t", "yes", "y", "on"}, {"0", "false", "f", "no", "n", "off"}


def parse_bool(s: str) -> bool:
    low = s.strip().lower()
    if low in TRUE:
        return True
    if low in FALSE:
        return False
    raise ValueError(f"neither true nor false: {s!r}")


def parse_list(s: str, kind=str) -> list:
    """Values divided by commas, blanks left out; none at all is an error."""
    out = [kind(x.strip()) for x in s.split(",") if x.strip()]
    if not out:
        raise ValueError("an empty list")
    return out


def plain_value(s: str) -> bool | int | float | str:
    """A truth value, whole number or number if the text is one, else the text."""
    if s.strip().lower() in ("true", "false"):
        return parse_bool(s)
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return s


def flat_settings(pairs: list[str]) -> dict[str, bool | int | float | str]:
    """"name=value" texts as typed settings; a name that isn't a word, or comes twice, is an error."""
    out: dict[str, bool | int | float | str] = {}
    for p in pairs:
        name, sign, value = p.partition("=")
        if not sign or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()) or name.strip() in out:
            raise ValueError(f"not a setting: {p!r}")
        out[name.strip()] = plain_value(value.strip())
    return out


class Point(NamedTuple):
    """One point of a sweep."""

    size: int
    overlap: int
    titles: bool

    @property
    def slug(self) -> str:
        return f"cs-{self.size}_ov-{self.overlap}_title-{'on' if self.titles else 'off'}"


def sweep(sizes: str, overlaps: str, titles: str = "true") -> list[Point]:
    """All combinations, in the order given."""
    return [Point(*x) for x in itertools.product(parse_list(sizes, int), parse_list(overlaps, int), parse_list(titles, parse_bool))]


def text_source(name: str) -> str:
    """The field that indexes are made of; only "text" is known."""
    if name != "text":
        raise ValueError(f"no such text: {name!r}; there is 'text' only")
    return name

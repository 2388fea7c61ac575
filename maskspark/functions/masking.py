"""Masking of one text cell within a session, in plain Python: what the table operators run in each worker."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property

from maskspark.config import MaskConfig
from maskspark.functions import rules
from maskspark.functions.lexicon import HAN

#: Values that a session keeps of one category; the oldest goes first, its number is not given out again.
MOST_VALUES = 2000
#: A run of ASCII characters without a space that is longer than this is refused.
LONGEST_RUN = 4 * 1024 * 1024
PLACEHOLDER = re.compile(r"\[REDACTED_([A-Z0-9_]+)_([0-9]+)\]")
_HAN = re.compile(f"[{HAN}]")
_RUN = re.compile(r"[^ \t\n\r\f\u0080-\U0010ffff]+")


class TooLong(ValueError):
    """The text holds a run that no rule may look at."""


def longest_run(text: str) -> int:
    return max((m.end() - m.start() for m in _RUN.finditer(text)), default=0)


@dataclass
class Session:
    """Numbers given to values so far, by category."""

    values: dict[str, dict[str, int]] = field(default_factory=dict)
    last: Counter[str] = field(default_factory=Counter)

    def placeholder(self, cat: str, value: str) -> str:
        own = self.values.setdefault(cat, {})
        n = own.get(value)
        if n is None:
            while len(own) >= MOST_VALUES:
                del own[next(iter(own))]
            self.last[cat] += 1
            n = own[value] = self.last[cat]
        return f"[REDACTED_{cat.upper()}_{n}]"

    def reverse(self) -> dict[str, str]:
        return {f"[REDACTED_{cat.upper()}_{n}]": value for cat, own in self.values.items() for value, n in own.items()}


#: (category, value, placeholder) as masked.
Hit = tuple[str, str, str]


_DIGITS = re.compile("[0-9]{4,}")


class _Look:
    """What is quick to see of a text, found out once it is asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def han(self) -> bool:
        return _HAN.search(self.text) is not None

    @cached_property
    def lower(self) -> str:
        return self.text.lower()

    @cached_property
    def digits(self) -> int:
        return max(map(len, _DIGITS.findall(self.text)), default=0)

    @cached_property
    def word(self) -> int:
        return max(map(len, self.text.split()), default=0)

    def may(self, rule: rules.Rule) -> bool:
        """Whether the rule can find anything here."""
        if rule.han and not self.han:
            return False
        if rule.signs and not any(map((self.lower if rule.folded else self.text).__contains__, rule.signs)):
            return False
        return not (rule.digits > 4 and self.digits < rule.digits or rule.digits and not self.digits or rule.word and self.word < rule.word)


class Masker:
    """A configuration's rules, compiled once a worker."""

    def __init__(self, cfg: MaskConfig | None = None):
        self.cfg = cfg or MaskConfig()
        self.rules = rules.active(self.cfg) if self.cfg.enabled else []
        self.preserved: Callable[[str], bool] = frozenset(self.cfg.preserve_values).__contains__

    def mask(self, text: str, session: Session, hits: list[Hit] | None = None) -> str:
        """The text with each rule applied to what the rules before it left; numbers in order of rule, then place."""
        if not text or not self.rules:
            return text
        if len(text) > LONGEST_RUN and longest_run(text) > LONGEST_RUN:
            raise TooLong(f"a run of more than {LONGEST_RUN} characters without a space")
        look, before = _Look(text), False
        for rule in self.rules:
            if (rule.after and not before) or not look.may(rule):
                before = False
                continue
            parts, at = [], 0
            for s, e in rule.find(text, self.preserved):
                placeholder = session.placeholder(rule.cat, text[s:e])
                if hits is not None:
                    hits.append((rule.cat, text[s:e], placeholder))
                parts += (text[at:s], placeholder)
                at = e
            before = bool(parts)
            if before:
                text = "".join((*parts, text[at:]))
                look = _Look(text)
        return text


def counts(hits: Iterable[Hit]) -> dict[str, int]:
    return dict(Counter(cat for cat, _, _ in hits))


def restore(text: str | None, values: dict[str, str]) -> str | None:
    """Placeholders back to values, in one pass: what a value holds is not restored again."""
    if not text or "REDACTED_" not in text:
        return text
    return PLACEHOLDER.sub(lambda m: values.get(m[0], m[0]), text)


#: A placeholder is no longer than this.
LONGEST_PLACEHOLDER = 48
_TAIL = re.compile(r"\[(?:REDACTED_)?[A-Z0-9_]*\Z")


def split_tail(text: str) -> tuple[str, str]:
    """Text that is complete, and an end that may be the start of a placeholder."""
    at = text.rfind("[")
    if at >= 0 and len(text) - at <= LONGEST_PLACEHOLDER and _TAIL.match(text, at):
        return text[:at], text[at:]
    return text, ""


def misses(text: str | None) -> int:
    return text.count("REDACTED_") if text else 0

"""Regular spans of secrets and personal data, found in linear time in whole texts."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable

Span = tuple[str, int, int]

# The patterns of the contract. A run is matched from its start only: where that fails, no later
# start in the run can match, so look-behinds save the quadratic retries of long runs.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]")
#: Digits doubled in Luhn's sum.
DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def secret_spans(text: str) -> list[Span]:
    """assign, access and hex spans, kind after kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(DOUBLED[int(d)] for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[Span]:
    """A local part has no @, so it is the run before an @ that begins after the last address."""
    out, last = [], 0
    for m in DOMAIN.finditer(text):
        start = at = m.start()
        while start > last:  # in steps, so that a long text before the @ is not copied
            piece = text[max(last, start - 256) : start]
            run = len(piece) - max((x.end() for x in NOT_LOCAL.finditer(piece)), default=0)
            start -= run
            if run < len(piece):
                break
        if start < at:
            out.append(("email", start, m.end()))
            last = m.end()
    return out


def private_spans(text: str) -> list[Span]:
    """email, ip, card and phone spans, kind after kind."""
    out = emails(text) if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p) < 4 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = NO_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NO_DIGIT.sub("", m[0])) <= 15]
    return out


def in_order(spans: Iterable[Span], kinds: list[str]) -> str:
    """kind:start:end by start, then by kind as listed, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]))))



class Taken:
    """Answers whether a span meets one of the given spans."""

    def __init__(self, spans: Iterable[Span]) -> None:
        self.ends: list[int] = []
        self.starts: list[int] = []
        for _, start, end in sorted(spans, key=lambda x: x[1]):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(end, self.ends[-1])
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end

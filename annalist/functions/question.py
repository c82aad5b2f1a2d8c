"""What a question asks for: its times, intents and further words.  A question is a literal, so this is plain Python."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions import vocab as V

DAY = 86400
INTENTS = {"summary": V.SUMMARY_QUESTION, "rule": V.RULE_QUESTION, "rule_answer": V.RULE_ANSWER_QUESTION, "causal": V.CAUSAL_QUESTION, "order": V.ORDER_QUESTION, "preference": V.PREFERENCE_QUESTION, "recent": V.RECENT_QUESTION}


@dataclass(frozen=True)
class Clue:
    """A window of time: its centre (epoch seconds), or how far back from now it is, and half its width; all in seconds."""

    label: str
    raw: str
    half: float
    back: float = 0.0
    centre: float | None = None

    def at(self, now: float) -> float:
        return now - self.back if self.centre is None else self.centre


def epoch(year: int, month: int = 1, day: int = 1) -> float:
    return datetime(year, month, day, tzinfo=UTC).timestamp()


def absolute(label: str, m: re.Match, now: float) -> Clue:
    """The clue of a named year, month or date; without a year the latest one that isn't later than ``now``."""
    named = m.groupdict()
    year = named.get("y") and int(named["y"])
    if label == "year_range":
        low, high = sorted((year, int(named["z"])))
        return Clue(label, m[0], ((high - low) / 2 + 0.5) * 365 * DAY, centre=epoch((low + high) // 2))
    month = named.get("m")
    month = 1 if month is None else int(month) if month.isdigit() else V.MONTHS.index(month) + 1
    day = min(int(named.get("d") or 1), 28)
    if year is None:
        year = datetime.fromtimestamp(now, UTC).year
        year -= epoch(year, month, day) > now
    return Clue(label, m[0], V.HALF_DAYS[label] * DAY, centre=epoch(year, month, day))


def clues(question: str, now: float) -> list[Clue]:
    """Explicit times of a question, in the order of the rules; no letter belongs to two of them."""
    text, taken = question.lower(), [False] * len(question)
    if len(text) != len(question):  # a letter that is longer in lower case
        taken = [False] * len(text)

    def matches(pattern: str) -> Iterator[re.Match]:
        for m in re.finditer(pattern, text):
            if not any(taken[m.start() : m.end()]):
                taken[m.start() : m.end()] = [True] * (m.end() - m.start())
                yield m

    out = []
    for pattern in (V.COUNTED_ENGLISH, V.COUNTED_CHINESE):
        for m in matches(pattern):
            n = V.NUMBER_WORDS.get(m[1]) or int(m[1])
            unit, days = V.UNIT_DAYS[m[2]]
            out.append(Clue(f"{n}_{unit}s_ago", m[0], days * DAY / 2, n * days * DAY))
    for pattern, label, days, half in V.RELATIVE_TIMES:
        out += [Clue(label, m[0], half * DAY, days * DAY) for m in matches(pattern)]
    for pattern, label in V.ABSOLUTE_TIMES:
        out += [absolute(label, m, now) for m in matches(pattern)]
    return out


def years(found: list[Clue]) -> list[int]:
    """Years that clues name; of a range its two ends."""
    out = set()
    for c in found:
        if c.label == "year_range":
            out.update(int(y) for y in re.findall(r"20\d\d", c.raw))
        elif c.centre is not None:
            out.add(datetime.fromtimestamp(c.centre, UTC).year)
    return sorted(out)


def intents(question: str) -> dict[str, bool]:
    """Which intents a question has; the patterns of answers, preferences and recent times are for lower case."""
    return {name: bool(re.search(pattern, question if name in ("summary", "rule", "causal", "order") else question.lower())) for name, pattern in INTENTS.items()}


def expanded(question: str) -> str:
    """The question and synonyms of its words that it doesn't have yet."""
    low, more = question.lower(), []
    for table, has in ((V.SYNONYMS_CHINESE, lambda w: w in question), (V.SYNONYMS_ENGLISH, lambda w: re.search(rf"\b{re.escape(w)}\b", low))):
        for word, others in table.items():
            if has(word):
                more += [x for x in others if x.lower() not in low and x not in more]
    return " ".join([question, *more])


def weight(moment: Column, now: Column, windows: Column) -> Column:
    """Of an array of windows (centre or null, back, half): the greatest factor that any gives to a moment; 1 without windows or
    without a moment."""
    one = lambda w: F.when(F.abs(moment - F.coalesce(w["centre"], now - w["back"])) <= w["half"], F.lit(V.INSIDE)).otherwise(F.lit(V.OUTSIDE))
    return F.when((F.size(windows) > 0) & moment.isNotNull(), F.array_max(F.transform(windows, one))).otherwise(F.lit(1.0))

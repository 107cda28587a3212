"""The query grammar: words, "phrases", -exclusions and field:value filters; and what a question asks for."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from ..functions.dates import FILTER_TOKENS
from ..functions.text import STOPWORDS
from ..functions.vectors import _stem

# The grammar's fields, and words that open a question.
FIELDS = ("after", "before", "from", "has", "in", "is", "link", "mentions", "person", "provider", "sent", "tag", "type")
OPENERS = "are can could did do does find had has have how is list show should tell was were what when where which who whom whose why will would".split()
# Signals of a question.
SIGNALS = [
    ("file", r"\b(file|document|deck|pdf|spreadsheet|attachment)s?\b"),
    ("email", r"\b(email|mail|inbox|gmail)\b"),
    ("note", r"\b(note|notion|page|spec|doc)\b"),
    ("video", r"\b(video|watch|transcript|playlist)\b"),
    ("person_lookup", r"\b(who|with whom|from whom|about whom)\b"),
    ("deadline", r"\b(when|deadline|due|by when|eta)\b"),
    ("has_attachment", r"\b(attach|attached|attachment)\b"),
    ("decision", r"\b(decide|decided|decision|agreed|outcome)\b"),
    ("time_relative", r"\b(today|yesterday|this week|last week|this month|last month)\b"),
]


@dataclass
class ParsedQuery:
    raw: str = ""
    text: str = ""
    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    filters: dict[str, list[str]] = field(default_factory=dict)
    content_terms: list[str] = field(default_factory=list)
    natural_language: bool = False

    def retrieval_terms(self) -> list[str]:
        """A question is searched by its content words, anything else by all of its words."""
        return self.content_terms if self.natural_language and self.content_terms else self.terms

    def is_empty(self) -> bool:
        return not (self.terms or self.phrases or self.filters)


def words_of(text: str) -> list[str]:
    found = (w.strip(".'-") for w in re.findall(r"[A-Za-z0-9_@.'+-]+", text.lower()))
    return [w for w in found if len(w) >= 2]


def normalise(key: str, value: str, now: dt.datetime) -> str:
    value = value.strip()
    if key in ("after", "before", "sent") and value.lower() in FILTER_TOKENS:
        return (now - dt.timedelta(days=FILTER_TOKENS[value.lower()])).date().isoformat()
    if key in ("type", "has", "link", "is"):
        return value.lower()
    return value.lstrip("@").lower() if key == "from" else value


def is_question(text: str) -> bool:
    words = text.lower().split()
    if not words:
        return False
    if words[0] in OPENERS:
        return True
    tokens = re.findall(r'"[^"]+"|\S+', text)
    return len(tokens) >= 3 and sum(t in STOPWORDS for t in tokens) >= 0.4 * len(tokens)


def parse(query: str, now: dt.datetime | None = None) -> ParsedQuery:
    """Filters of unknown fields stay words. Stop words are told by the word itself, before it is stemmed."""
    now = now or dt.datetime.now(dt.timezone.utc)
    out = ParsedQuery(raw=(query or "").strip())
    rest = []
    at = 0
    for m in re.finditer(r'\b(\w+):("[^"]*"|\S+)', out.raw):
        key = m[1].lower()
        if key in FIELDS:
            out.filters.setdefault(key, []).append(normalise(key, m[2].strip('"'), now))
            rest.append(out.raw[at : m.start()])
            at = m.end()
    rest.append(out.raw[at:])
    out.text = " ".join(rest).strip()
    for m in re.finditer(r'"([^"]+)"|(\S+)', out.text):
        if m[1]:
            out.phrases.append(m[1])
        elif m[2].startswith("-") and len(m[2]) > 1:
            out.exclude += [_stem(w) for w in words_of(m[2][1:])]
        else:
            found = words_of(m[2])
            out.terms += [_stem(w) for w in found]
            out.content_terms += [_stem(w) for w in found if w not in STOPWORDS]
    out.natural_language = is_question(out.text)
    return out


def signals(question: str) -> list[str]:
    parsed, low = parse(question), question.lower()
    found = [name for name, rx in SIGNALS if re.search(rx, low)]
    return found + ["has_attachment"] * ("has" in parsed.filters and "has_attachment" not in found)

"""Predicates on column and sheet *names*.

Names are schema, not data: there are a few dozen per table, so these run in plain Python
while a plan is being built and never touch a row.
"""

from __future__ import annotations

import re
import unicodedata

from sondeo.functions import vocabulary as V


def semantic_key(text) -> str:
    """Lower case, no accents, runs of anything but letters and digits become one space."""
    plain = unicodedata.normalize("NFKD", str(text if text is not None else "").lower())
    plain = "".join(ch for ch in plain if not unicodedata.combining(ch))
    return " ".join(re.findall(r"[a-z0-9]+", plain))


def mentions(name, words) -> bool:
    """Does a name contain one of ``words``?

    Words of three letters or fewer must be a whole token, so that ``cantidad`` does not
    count as an ``id`` nor ``mesa`` as a ``mes``. Longer words may occur anywhere.
    """
    raw = str(name if name is not None else "").lower()
    key = semantic_key(raw)
    tokens = set(key.split())
    for word in words:
        if not re.search(r"\w", word):
            hit = word in raw
        elif len(word) <= 3:
            hit = semantic_key(word) in tokens
        else:
            hit = semantic_key(word) in key
        if hit:
            return True
    return False


def is_generic(name) -> bool:
    """``Col_3``, ``Unnamed: 2`` or blank."""
    text = str(name if name is not None else "").strip().lower()
    return not text or text.startswith(("col_", "unnamed"))


def is_generic_report_header(name) -> bool:
    """The stricter test for report tables: too short, or a numbered filler name."""
    text = str(name if name is not None else "").strip().lower()
    if sum(ch.isalnum() for ch in text) <= 2:
        return True
    return re.fullmatch(r"col(?:umna)?[_ -]?\d+|unnamed:? ?\d*|field[_ -]?\d+", text) is not None


def is_unnamed(name) -> bool:
    """The organiser's test for a column nobody named."""
    text = str(name if name is not None else "").strip().lower()
    return not text or text.startswith("unnamed") or re.fullmatch(r"col[_ -]?\d+", text) is not None


def unique_names(names) -> list[str]:
    """Blank or ``Unnamed`` names become ``Col_{position}``; repeats get ``_{n}``."""
    repeats: dict[str, int] = {}
    out = []
    for position, name in enumerate(names):
        text = "" if name is None else str(name).strip()
        if not text or text.startswith("Unnamed"):
            text = f"Col_{position}"
        seen = repeats.get(text)
        repeats[text] = 0 if seen is None else seen + 1
        out.append(text if seen is None else f"{text}_{repeats[text]}")
    return out


def is_identifier(name) -> bool:
    return mentions(name, V.IDENTIFIER_HEADERS)


def is_person(name) -> bool:
    return mentions(name, V.REPORT_PERSON_HEADERS)


def is_executive_dimension(name) -> bool:
    return mentions(name, V.EXECUTIVE_HEADERS + V.REPORT_EXECUTIVE_HEADERS)


def is_executive_metric(name) -> bool:
    return mentions(name, V.METRIC_HEADERS)


def is_date_like(name) -> bool:
    return mentions(name, V.DATE_HEADERS)


def is_calendar(name) -> bool:
    return mentions(name, V.CALENDAR_HEADERS)


def is_time_like(text) -> bool:
    """A month, week, quarter or year in a header."""
    return (
        mentions(text, V.TIME_LABELS)
        or re.search(r"\b20\d{2}\b|\b\d{1,2}[/-]\d{1,2}", str(text or "")) is not None
    )


def metric_kind(name) -> str:
    """``percent``, ``currency`` or ``number``, from the header alone."""
    if mentions(name, V.PERCENT_HEADERS):
        return "percent"
    return "currency" if mentions(name, V.REPORT_MONEY_HEADERS) else "number"


def currency_column(names) -> str | None:
    return next((n for n in names if mentions(n, V.CURRENCY_HEADERS)), None)


def rate_column(names) -> str | None:
    return next((n for n in names if mentions(n, V.RATE_HEADERS)), None)


def semantic_role(name) -> str | None:
    """objective / activity / question / risk / owner, or nothing."""
    return next((role for role, words in V.SEMANTIC_ROLES.items() if mentions(name, words)), None)


def header_points(name) -> int:
    """Importance points a header earns by its words alone."""
    return sum(points for words, points in V.IMPORTANCE_BY_HEADER if mentions(name, words))


def pick_columns(names, family: str = "general", limit: int = V.MAX_TABLE_COLUMNS) -> list[str]:
    """Named columns, those the sheet family cares about first."""
    named = [n for n in names if not is_generic(n)] or list(names)
    wanted = V.FAMILY_COLUMNS.get(family, ())
    return sorted(named, key=lambda n: not mentions(n, wanted))[:limit]

"""Scalar text functions as Spark columns: cleaning, ids, time ranges, bus lines, districts, passwords."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHITE = r"\s\x{1C}-\x{1F}\x{85}\x{A0}"


def strip(text: Column | str) -> Column:
    """Without white space of any kind at both ends; Spark's trim removes blanks only."""
    return F.regexp_replace(text, f"^[{_WHITE}]+|[{_WHITE}]+$", "")


def bound(value: Column | str, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it and however many columns take parts of the result."""
    return F.transform(F.array(value), use)[0]


def clean_message(text: Column | str) -> Column:
    """Stripped, then without semicolons at the end."""
    return F.regexp_replace(strip(text), ";+$", "")


def clean_date(text: Column | str) -> Column:
    """Stripped; a suffix behind the date stays, see :func:`event_date`."""
    return strip(text)


def event_date(text: Column | str) -> Column:
    """The dd.MM.yyyy date in a text, or null."""
    found = F.regexp_substr(text, F.lit(r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}"))
    return F.try_to_timestamp(found, F.lit("dd.MM.yyyy")).cast("date")


def matched(text: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of the first match of a pattern, null where there is no match."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def url_id(url: Column | str, pattern: str = r"([0-9]+)\.html") -> Column:
    """The number in a URL, null where there is none."""
    return F.try_to_number(matched(url, pattern), F.lit("9" * 18)).cast("long")


def message_url(prefix: str, msg_id: Column | str) -> Column:
    return F.format_string(prefix.replace("%", "%%") + "%d.html", msg_id)


def prompt(first: Column | str, second: Column | str) -> Column:
    """Two texts with a line break between."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return F.concat(column(first), F.lit("\n"), column(second))


def chat_prompt(system: str, user: Column | str) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", F.col(user) if isinstance(user, str) else user))


def capitalise(text: Column | str) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(F.col(text) if isinstance(text, str) else text, F.lit(2)))


def folded_key(text: Column | str) -> Column:
    """How e-mail addresses are compared: stripped and in lower case."""
    return F.lower(strip(text))


#: Districts in order of preference, each with the substrings that name it.
DISTRICTS: Mapping[str, Sequence[str]] = {
    "левски": ("владислав варненчик", "цар симеон", "искър"),
    "възраждане": ("царевец", "стефан караджа", "роза"),
    "аспарухово": ("аспарухово", "девня"),
    "младост": ("младост", "христо ботев"),
    "трошево": ("трошево", "бенковски"),
    "вл. варненчик": ("вл. варненчик",),
    "център": ("преслав", "шипка", "цар калоян", "драгоман", "опълченска"),
    "чайка": ("чайка", "златни пясъци"),
    "бриз": ("бриз", "св. св. константин и елена"),
    "евксиноград": ("евксиноград",),
    "galata": ("галата",),
    "прибой": ("прибой",),
}
UNKNOWN_DISTRICT = "Неизвестен район"


def first_match(text: Column | str, groups: Mapping[str, Sequence[str]], unknown: str) -> Column:
    """The first group, in order, of which the lower-cased text holds a keyword."""
    lowered, out = F.lower(text), None
    for name, keywords in groups.items():
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | F.contains(lowered, F.lit(keyword))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(unknown) if out is None else out.otherwise(unknown)


def district(address: Column | str) -> Column:
    """The district of an address, its first letter in upper case, or the label of an unknown one."""
    names = {capital(name): keywords for name, keywords in DISTRICTS.items()}
    return first_match(address, names, UNKNOWN_DISTRICT)


def capital(name: str) -> str:
    return name[:1].upper() + name[1:]


def password_strength(password: Column | str) -> Column:
    """0 to 4: length of 8, both cases, a digit, something else; empty or null scores 0."""
    text = F.coalesce(F.col(password) if isinstance(password, str) else password, F.lit(""))
    checks = (F.char_length(text) >= 8, text.rlike("[a-z]") & text.rlike("[A-Z]"), text.rlike("[0-9]"), text.rlike("[^a-zA-Z0-9]"))
    return sum((c.cast("int") for c in checks), F.lit(0))


_CLOCK = r"([0-9]{1,2}+)(?:\s*[.,:]\s*([0-9]{2})(?![.0-9]))?+"
_FROM = rf"(?<![\p{{L}}0-9])от\s*(?:около\s*)?{_CLOCK}(?!\.?[0-9]|-)\s*ч?"
_TO = rf"(?<![\p{{L}}0-9])до\s*(?:около\s*)?{_CLOCK}(?!\.?[0-9]|-)\s*ч?"


def _minutes(text: Column, pattern: str) -> Column:
    """Minutes of the day of a matched clock time, null if there is none or it is later than 24:00."""

    def of(time: Column) -> Column:
        at = time["hour"] * 60 + time["minute"]
        return F.when((at <= 1440) & (time["minute"] < 60), at)

    def parts(numbers: Column) -> Column:
        hour, minute = (F.get(numbers, F.lit(k)).cast("int") for k in (0, 1))
        return bound(F.struct(hour.alias("hour"), F.coalesce(minute, F.lit(0)).alias("minute")), of)

    # the numbers of what is matched: an empty text that is cast to a number costs an exception
    return bound(F.regexp_extract_all(F.regexp_extract(text, pattern, 0), F.lit("[0-9]+"), F.lit(0)), parts)


def time_range(text: Column | str) -> Column:
    """struct<start_minute:int, end_minute:int> of a notice's "from ... to ..." times.

    Hours may stand alone or with minutes behind a point, comma or colon; 24.00
    is minute 1440.  Either end may be missing.  Digits of dates are no times.
    """
    lowered = F.lower(F.regexp_replace(text, r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}", " "))
    return bound(lowered, lambda t: F.struct(_minutes(t, _FROM).alias("start_minute"), _minutes(t, _TO).alias("end_minute")))


def clock(minutes: Column) -> Column:
    """HH:MM of a minute of the day."""
    return F.when(minutes.isNotNull(), F.format_string("%02d:%02d", F.floor(minutes / 60), minutes % 60))


#: A line that is named by its speed, words of a change of route, and the code for all lines.
EXPRESS = (r"209\s+Бърз", "209B")
ROUTE_WORDS = r"(?i)маршрут|автобус|линия|линии|движение|спирк"
ALL_LINES = "0"


def bus_lines(text: Column | str) -> Column:
    """array<string> of the lines that a notice names: number and upper-case Latin letter.

    A change of route without a named line gives the code for all lines; a text
    about something else gives null.
    """
    text = F.regexp_replace(F.col(text) if isinstance(text, str) else text, "(?i)" + EXPRESS[0], EXPRESS[1])
    listed = F.regexp_extract_all(text, F.lit(r"(?i)(?:лини[яи]|автобус(?:и|на|ни)?|№)[^0-9.;:]{0,24}((?:[0-9]{1,3}\s?[A-Za-z]?(?![\p{L}0-9.:])(?:\s*(?:,|и|-)\s*)?)+)"), F.lit(1))
    flat = F.flatten(F.transform(listed, lambda x: F.regexp_extract_all(x, F.lit(r"([0-9]{1,3}\s?[A-Za-z]?)"), F.lit(1))))
    lines = F.array_distinct(F.transform(flat, lambda x: F.upper(F.regexp_replace(x, r"\s", ""))))
    named = F.array_union(lines, F.regexp_extract_all(text, F.lit(f"({EXPRESS[1]})"), F.lit(1)))
    return F.when(F.size(named) > 0, named).when(text.rlike(ROUTE_WORDS), F.array(F.lit(ALL_LINES)))


def violations(email: Column, password: Column, repeated: Column | None = None, required: Mapping[str, Column] | None = None, limits: Mapping[str, tuple[int, int]] | None = None) -> Column:
    """array<string> of what is wrong with a registration, empty if nothing is."""
    limits = limits or {"email": (5, 50), "password": (8, 50)}
    wrong = [
        (~F.coalesce(email, F.lit("")).rlike(r"^[^@\s]+@[^@\s]+$"), "email_format"),
        (~F.char_length(F.coalesce(email, F.lit(""))).between(*limits["email"]), "email_length"),
        (~F.char_length(F.coalesce(password, F.lit(""))).between(*limits["password"]), "password_length"),
    ]
    wrong += [(~password.eqNullSafe(repeated), "passwords_differ")] if repeated is not None else []
    wrong += [(F.coalesce(strip(c), F.lit("")) == "", f"{name}_missing") for name, c in (required or {}).items()]
    return F.array_compact(F.array(*(F.when(hit, name) for hit, name in wrong)))

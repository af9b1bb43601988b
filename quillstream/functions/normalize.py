"""Typed normalisation of raw field values as column expressions; bad values give null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names that dates may be written with.
MONTHS = {
    1: ("jan", "january", "janvier", "januar", "enero", "gennaio", "janeiro"),
    2: ("feb", "february", "fevrier", "février", "februar", "febrero", "febbraio", "fevereiro"),
    3: ("mar", "march", "mars", "marz", "märz", "marzo", "março"),
    4: ("apr", "april", "avril", "abril", "aprile"),
    5: ("may", "mai", "mayo", "maggio", "maio"),
    6: ("jun", "june", "juin", "juni", "junio", "giugno", "junho"),
    7: ("jul", "july", "juillet", "juli", "julio", "luglio", "julho"),
    8: ("aug", "august", "aout", "août", "agosto"),
    9: ("sep", "sept", "september", "septembre", "septiembre", "settembre", "setembro"),
    10: ("oct", "october", "octobre", "oktober", "octubre", "ottobre", "outubro"),
    11: ("nov", "november", "novembre", "noviembre", "novembro"),
    12: ("dec", "december", "decembre", "décembre", "dezember", "diciembre", "dicembre", "dezembro"),
}
#: Words read as true and as false.
TRUE, FALSE = ("true", "yes", "1", "y", "t", "verified", "passed"), ("false", "no", "0", "n", "f", "failed")

#: Parts of field names that hold dates, and amounts.
DATES = ("date", "dob", "birth", "joining", "validity")
AMOUNTS = ("amount", "total", "price", "fee", "salary", "balance", "cost", "percentage", "marks")


def _month(name: Column) -> Column:
    pairs = [F.lit(x) for number, names in MONTHS.items() for word in dict.fromkeys(names) for x in (word, number)]
    seen, flat = set(), []
    for word, number in zip(pairs[::2], pairs[1::2], strict=True):
        if str(word) not in seen:
            seen.add(str(word))
            flat += [word, number]
    return F.element_at(F.create_map(*flat), F.lower(name))


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null for days that no calendar has; two-digit years are of this century. Parts that can't be a date's aren't
    parsed, as each text that fails costs an exception."""

    def of(p: Column) -> Column:
        y = F.when(p["y"] < 100, p["y"] + 2000).otherwise(p["y"])
        fits = p["y"].isNotNull() & p["m"].between(1, 12) & p["d"].between(1, 31)
        return F.when(fits, F.try_to_date(F.format_string("%04d-%02d-%02d", y, p["m"], p["d"]), "yyyy-MM-dd"))

    return F.get(F.transform(F.array(F.struct(year.cast("int").alias("y"), month.cast("int").alias("m"), day.cast("int").alias("d"))), of), 0)


def _groups(text: Column, pattern: str, order: tuple[int, ...]) -> list[Column]:
    """Groups of a match; empty text without one, which is no number and no month."""
    return [F.regexp_extract(text, pattern, i) for i in order]


def _int(x: Column) -> Column:
    return x.try_cast("int")


def date_day_first(value: Column) -> Column:
    """Date of a document value as text: ISO, day month-name year, month-name day year, or day/month/year. A label before
    a colon, a weekday and a time are passed over."""
    text = F.trim(F.regexp_replace(F.regexp_replace(value, r"^[A-Za-z ]{2,30}:\s*", ""), r"[ T]\d{1,2}:\d{2}(:\d{2})?\s*$", ""))
    return F.get(F.transform(F.array(text), _day_first), 0)  # the text is made once


def _day_first(text: Column) -> Column:
    iso = _groups(text, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", (1, 2, 3))
    worded = _groups(text, r"^(?:\p{L}+[ ,]+)?(\d{1,2})(?:st|nd|rd|th|er)?[-/. ]+(?:de )?(\p{L}+)\.?(?: de)?[-/., ]+(\d{2,4})$", (1, 2, 3))
    led = _groups(text, r"^(\p{L}+)\.?[-/ ]+(\d{1,2})(?:st|nd|rd|th)?[-/, ]+(\d{2,4})$", (1, 2, 3))
    number = _groups(text, r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})$", (1, 2, 3))
    # digits alone are tried before words, which no such text has
    return F.coalesce(_date(*map(_int, iso)), _date(*map(_int, reversed(number))), _date(_int(worded[2]), _month(worded[1]), _int(worded[0])), _date(_int(led[2]), _month(led[0]), _int(led[1])))


def date_guessed(value: Column) -> Column:
    """Like ``date_day_first``, but 13 and over in second place means month/day/year."""
    number = [_int(g) for g in _groups(F.trim(value), r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})$", (1, 2, 3))]
    american = (number[1] > 12) & number[0].between(1, 12)
    return F.when(american, _date(number[2], number[0], number[1])).otherwise(date_day_first(value))


def amount(value: Column) -> Column:
    """DECIMAL(18, 2) of an amount: label, currency and /- are passed over; brackets or one minus mean negative; groups
    must be western (1,234,567), Indian (12,34,567) or none."""
    text = F.trim(F.regexp_replace(value, r"^[A-Za-z ]{3,30}:\s*", ""))
    round_ = text.rlike(r"^\(.*\)$")
    text = F.regexp_replace(F.regexp_replace(text, r"^\((.*)\)$", "$1"), r"\s*/-$", "")
    minus = F.length(text) - F.length(F.translate(text, "-", ""))
    bare = F.trim(F.regexp_replace(F.translate(text, "-", ""), r"(?i)^\s*(?:₹|Rs\.?|INR|USD|EUR|GBP|\$|€|£)\s*", ""))
    good = bare.rlike(r"^(?:\d{1,3}(?:,\d{3})+|\d{1,2}(?:,\d{2})*,\d{3}|\d+)(?:\.\d+)?$") & (minus <= 1) & text.rlike(r"^\s*-?[^-]*-?[\d.,]+$")
    number = F.round(F.translate(bare, ",", "").try_cast("decimal(38,6)"), 2).cast("decimal(18,2)")
    return F.when(good, F.when(round_ | (minus == 1), -number).otherwise(number))


def money(value: Column) -> Column:
    """Double of a currency text, two places: a comma after the last point is the decimal sign."""
    clean = F.regexp_replace(value, r"[^\d.,-]", "")
    comma, point = F.length(clean) - F.instr(F.reverse(clean), ","), F.length(clean) - F.instr(F.reverse(clean), ".")
    european = clean.contains(",") & clean.contains(".") & (comma > point)
    plain = F.when(european, F.translate(F.translate(clean, ".", ""), ",", ".")).otherwise(F.translate(clean, ",", ""))
    return F.round(plain.try_cast("decimal(38,6)"), 2).cast("double")


def number(value: Column) -> Column:
    return F.trim(F.translate(value, ",", "")).try_cast("double")


def percent(value: Column) -> Column:
    """Percentage: a fraction between 0 and 1 counts a hundredfold."""
    n = F.trim(F.translate(F.translate(value, "%", ""), ",", "")).try_cast("decimal(38,10)")
    return F.round(F.when((n > 0) & (n < 1), n * 100).otherwise(n), 2).cast("double")


def email(value: Column) -> Column:
    text = F.lower(F.trim(value))
    got = F.regexp_extract(text, r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", 0)
    return F.when(got != "", got).otherwise(text)


def phone(value: Column) -> Column:
    digits = F.regexp_replace(value, r"[^0-9+]", "")
    return F.when(F.length(digits) >= 7, digits).otherwise(F.trim(value))


def boolean(value: Column) -> Column:
    text = F.lower(F.trim(value))
    return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False)


def identifier(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(value), r"""^["'#:]+|["'.]+$""", ""))


def field(value: Column, data_type: Column) -> Column:
    """struct(value, valid, error) of a raw value by its type; missing values are valid, other types are trimmed text."""
    text = F.trim(value)
    missing = F.coalesce(text, F.lit("")) == ""
    kind = F.lower(F.trim(F.coalesce(data_type, F.lit("string"))))
    out = (
        F.when(kind == "date", date_guessed(text).cast("string")).when(kind == "money", money(text).cast("string")).when(kind == "number", number(text).cast("string"))
        .when(kind == "percent", percent(text).cast("string")).when(kind == "email", email(text)).when(kind == "phone", phone(text))
        .when(kind == "bool", boolean(text).cast("string")).when(kind == "id", identifier(text)).otherwise(text)
    )
    valid = F.when(kind == "email", out.contains("@") & out.contains(".")).when(kind == "phone", F.length(F.regexp_replace(out, "[^0-9]", "")) >= 7).otherwise(out.isNotNull())
    error = F.when(~valid, F.concat(F.lit("Value '"), value, F.lit("' is not a valid "), kind))
    return F.struct(F.when(~missing, out).alias("value"), (missing | valid).alias("valid"), F.when(~missing, error).alias("error"))


def by_name(name: Column, value: Column) -> Column:
    """struct(value, valid) of a field's text by what its name says: a date, an amount, or trimmed text; a date or an amount that
    can't be read stays as it is and isn't valid. Null is valid."""
    text = F.trim(value)
    low = F.lower(name)
    kind = F.when(low.rlike("|".join(DATES)), "date").when(low.rlike("|".join(AMOUNTS)), "amount")
    got = F.when(kind == "date", date_day_first(text).cast("string")).when(kind == "amount", amount(text).cast("string")).otherwise(text)
    blank = F.coalesce(text, F.lit("")) == ""
    return F.struct(F.coalesce(got, text).alias("value"), (blank | got.isNotNull()).alias("valid"))

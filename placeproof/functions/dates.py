"""Dates of variable precision (YYYY, YYYY-MM, YYYY-MM-DD) as strings; a missing part is never filled in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DATE_PATTERN = r"^\+?(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?(?:[T ].*)?$"
EMBEDDED_DATE = r"(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?"
TEXT_YEAR = r"(?<!\d)(18\d{2}|19\d{2}|20\d{2})(?!\d)"
RECENT_FROM, MIDDLE_FROM, HISTORIC_BEFORE = 2024, 2020, 1950
CAPTURE_SOURCES = ["exif", "source_metadata", "structured_data"]


def normalize_date(value: Column, today: Column) -> Column:
    """Keep the given precision; null for malformed, impossible or future values."""
    text = F.trim(value)
    year = F.regexp_extract(text, DATE_PATTERN, 1)
    month = F.regexp_extract(text, DATE_PATTERN, 2)
    day = F.regexp_extract(text, DATE_PATTERN, 3)
    full = F.concat_ws(
        "-", year, F.when(month == "", "01").otherwise(month), F.when(day == "", "01").otherwise(day))
    valid = text.rlike(DATE_PATTERN) & (year != "0000") & (F.try_to_date(full, "yyyy-MM-dd") <= today)
    shown = F.concat_ws("-", year, F.when(month != "", month), F.when(day != "", day))
    return F.when(valid, shown)


def unix_date(value: Column, today: Column, millis: bool = False) -> Column:
    """Epoch seconds or milliseconds to a UTC day, without touching the session time zone."""
    number = F.trim(value.cast("string")).try_cast("bigint")
    days = F.floor(number / F.lit(86_400_000.0 if millis else 86_400.0))
    parsed = F.when(days.between(-719_162, 2_932_896), F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")))
    return F.when(parsed <= today, parsed.cast("string"))


def text_year(today: Column, *values: Column) -> Column:
    """The first plausible year written in the texts; a hint only, never a capture date."""
    years = [F.nullif(F.regexp_extract(F.coalesce(v, F.lit("")), TEXT_YEAR, 1), F.lit("")).cast("int") for v in values]
    return F.coalesce(*[F.when(y <= F.year(today), y) for y in years])


def messy_date(value: Column, today: Column) -> Column:
    """The first date inside a metadata text."""
    parts = [F.nullif(F.regexp_extract(F.coalesce(value, F.lit("")), EMBEDDED_DATE, i), F.lit("")) for i in (1, 2, 3)]
    return normalize_date(F.concat_ws("-", *parts), today)


def claim_date(time: Column, precision: Column, today: Column) -> Column:
    """A structured claim cut to its stated precision: 9 and below is a year, 10 a month."""
    day = F.substring_index(F.ltrim(time, F.lit("+")), "T", 1)
    cut = F.when(precision <= 9, F.left(day, F.lit(4))).when(precision == 10, F.left(day, F.lit(7))).otherwise(day)
    return normalize_date(cut, today)


def capture_year(taken: Column) -> Column:
    return F.left(taken, F.lit(4)).try_cast("int")


def freshness(taken: Column, hint_year: Column) -> Column:
    year = capture_year(taken)
    return (
        F.when(year >= RECENT_FROM, "2024_plus")
        .when(year >= MIDDLE_FROM, "2020_2023")
        .when(year < HISTORIC_BEFORE, "historic")
        .when(year.isNotNull(), "older")
        .when(hint_year < HISTORIC_BEFORE, "historic")
        .otherwise("date_unknown")
    )


def _given(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def date_source(taken: Column, uploaded: Column, source: Column, hint_year: Column) -> Column:
    return (
        F.when(_given(taken), F.when(source.isin(CAPTURE_SOURCES), source).otherwise("source_metadata"))
        .when(_given(uploaded), "upload_only")
        .when(hint_year.isNotNull(), "text_hint")
        .otherwise("unknown")
    )


def date_label(taken: Column, uploaded: Column, source: Column, lang: Column) -> Column:
    russian = lang == "ru"
    basis = (
        F.when(source == "exif", "EXIF")
        .when(source == "structured_data", F.when(russian, "структурированные данные").otherwise("structured data"))
        .otherwise(F.when(russian, "метаданные источника").otherwise("source metadata"))
    )
    shot = F.concat(F.when(russian, "Снято ").otherwise("Taken "), taken, F.lit(" ("), basis, F.lit(")"))
    upload = F.concat(F.when(russian, "Только дата загрузки: ").otherwise("Upload date only: "), uploaded)
    return F.when(_given(taken), shot).when(_given(uploaded), upload)


def freshness_badge(taken: Column, uploaded: Column, fresh: Column, lang: Column) -> Column:
    russian = lang == "ru"
    return (
        F.when(_given(taken), F.when(fresh == "2024_plus", "2024+").otherwise(F.left(taken, F.lit(4))))
        .when(_given(uploaded), F.concat(
            F.when(russian, "загружено ").otherwise("uploaded "), F.left(uploaded, F.lit(4))))
        .otherwise(F.when(russian, "дата неизвестна").otherwise("date unknown"))
    )

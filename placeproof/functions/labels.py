"""Evidence labels by language. Unknown languages read English."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Our own wording; {d} distance, {c} category, {b} building, {t} type, {n} name, {s} site, {m} match.
ENGLISH = {
    "geo_inside": "Photo point inside the campus outline, {d} from its centre",
    "geo_edge": "Photo point {d} outside campus boundary, right at the edge",
    "geo_just_outside": "Photo point {d} outside campus boundary",
    "geo_near_point": "Photo point {d} from the registered location",
    "geo_point": "Photo point {d} from the registered location; boundary unknown",
    "geo_away": "Photo point {d} away from the campus",
    "no_geo": "No photo point",
    "category": "Filed under the category \"{c}\"",
    "subcategory": "Filed under the subcategory \"{c}\"",
    "building": "Photo point inside the building \"{b}\" ({t})",
    "building_subject": "Shows the campus building \"{b}\"",
    "name": "Text mentions \"{n}\"",
    "official": "Published on the official site {s}",
    "no_license": "Source page states no license",
    "not_visually_checked": "Not visually checked yet",
    "vision_campus_place": "Image check: a campus place",
    "vision_not_campus_place": "Image check: not a campus place",
    "vision_veto": "Image check: confidently not a campus place",
    "vision_inconclusive": "Image check: unclear",
    "review_campus_place": "Model review: a campus place",
    "review_not_campus_place": "Model review: not a campus place",
    "review_veto": "Model review: not a photograph",
    "review_inconclusive": "Model review: unclear",
    "people": "Seems to show people or an event rather than a place",
    "specimen": "Seems to show a sample up close rather than a place",
    "food_closeup": "Seems to show food up close rather than a place",
    "other_institution": "Seems to show a different institution (\"{m}\")",
    "unnamed_building": "unnamed",
}
RUSSIAN = {
    "geo_inside": "Точка съёмки внутри контура кампуса, {d} от центра",
    "geo_edge": "Точка съёмки в {d} за границей кампуса, у самого края",
    "geo_just_outside": "Точка съёмки в {d} за границей кампуса",
    "geo_near_point": "Точка съёмки в {d} от адреса университета",
    "geo_point": "Точка съёмки в {d} от адреса университета; граница неизвестна",
    "geo_away": "Точка съёмки далеко от кампуса: {d}",
    "no_geo": "Точка съёмки неизвестна",
    "category": "Файл из категории «{c}»",
    "subcategory": "Файл из подкатегории «{c}»",
    "building": "Точка съёмки внутри здания «{b}» ({t})",
    "building_subject": "На снимке здание кампуса «{b}»",
    "name": "В тексте есть «{n}»",
    "official": "Опубликовано на официальном сайте {s}",
    "no_license": "Источник не указал лицензию",
    "not_visually_checked": "Изображение ещё не проверено",
    "vision_campus_place": "Проверка изображения: место кампуса",
    "vision_not_campus_place": "Проверка изображения: не место кампуса",
    "vision_veto": "Проверка изображения: точно не место кампуса",
    "vision_inconclusive": "Проверка изображения: неясно",
    "review_campus_place": "Оценка модели: место кампуса",
    "review_not_campus_place": "Оценка модели: не место кампуса",
    "review_veto": "Оценка модели: не фотография",
    "review_inconclusive": "Оценка модели: неясно",
    "people": "Скорее люди или событие, чем место",
    "specimen": "Скорее образец крупным планом, чем место",
    "food_closeup": "Скорее еда крупным планом, чем место",
    "other_institution": "Скорее другое учреждение («{m}»)",
    "unnamed_building": "без названия",
}
BUILDING_TYPES_RUSSIAN = {
    "academic": "учебное", "dorm": "общежитие", "library": "библиотека", "sport": "спорт", "lab": "лаборатория",
    "food": "еда", "other": "другое",
}


def template(key: str, lang: Column | str) -> Column:
    if isinstance(lang, str):
        return F.lit((RUSSIAN if lang == "ru" else ENGLISH)[key])
    return F.when(lang == "ru", RUSSIAN[key]).otherwise(ENGLISH[key])


def label(key: str, lang: Column | str, **values: Column) -> Column:
    """One evidence label with its placeholders filled."""
    text = template(key, lang)
    for name, value in values.items():
        text = F.replace(text, F.lit("{%s}" % name), F.coalesce(value, F.lit("")))
    return text


def localize(key: Column, lang: Column) -> Column:
    """Template looked up by a key column."""
    def lookup(texts: dict[str, str]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), key)
    return F.when(lang == "ru", lookup(RUSSIAN)).otherwise(lookup(ENGLISH))


def building_type_name(kind: Column, lang: str) -> Column:
    if lang != "ru":
        return kind
    names = F.create_map(*[F.lit(x) for pair in BUILDING_TYPES_RUSSIAN.items() for x in pair])
    return F.coalesce(F.element_at(names, kind), kind)


def format_distance(meters: Column, lang: str) -> Column:
    """Nearest 10 m below a kilometre, else kilometres with one decimal; null stays null."""
    m, km = ("м", "км") if lang == "ru" else ("m", "km")
    short = F.format_string(f"%d {m}", (F.bround(meters / 10, 0) * 10).cast("bigint"))
    return F.when(meters < 1000, short).when(
        meters >= 1000, F.format_string(f"%.1f {km}", F.bround(meters / 1000, 1)))

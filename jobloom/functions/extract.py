"""Facts read from posting text: work mode, contracts, skills, cities, salaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_text, let, oddly_spaced

NOT_GIVEN = "Nie podano"

# Marks of each work mode, in the order of precedence.
WORK_MODES = (
    ("Remote", ("100% remote", "fully remote", "full remote", "full-remote", "remote-first", "remote only", "100% zdaln", "w pełni zdaln", "całkowicie zdaln", "wyłącznie zdaln", "tylko zdaln")),
    ("Hybrid", ("hybrid", "hybryd")),
    ("Remote", ("remote", "zdaln")),
    ("Office", ("office", "stacjonar", "on-site", "onsite", "on site", "w biurze")),
    ("Mobile", ("praca mobiln", "mobile work")),
)
# Marks of each kind of contract, in the order of the result.
CONTRACTS = (
    ("B2B", ("b2b",)),
    ("Permanent", ("permanent", "uop", "umowa o pracę", "umowa o prace", "employment contract", "contract of employment")),
    ("Mandate contract", ("mandate", "umowa zlecenie", " zlecenie")),
    ("Contract", ("umowa o dzieło", "umowa o dzielo", "contract for specific work")),
)
# Skills looked for, in the order of the result.
SKILLS = ("SQL", "Postman", "REST API", "REST", "Jira", "Confluence", "Swagger", "OpenAPI", "ERP", "WMS", "Playwright", "API Testing", "API testing", "Manual Testing", "Manual tests", "TestRail", "Xray", "Zephyr", "SoapUI")
# Cities with their folded spellings, in the order of the result.
CITIES = (
    ("Warszawa", ("warszawa", "warsaw")), ("Kraków", ("krakow", "cracow")), ("Łódź", ("lodz",)), ("Wrocław", ("wroclaw",)),
    ("Poznań", ("poznan",)), ("Gdańsk", ("gdansk",)), ("Gdynia", ("gdynia",)), ("Sopot", ("sopot",)), ("Szczecin", ("szczecin",)),
    ("Bydgoszcz", ("bydgoszcz",)), ("Lublin", ("lublin",)), ("Białystok", ("bialystok",)), ("Katowice", ("katowice",)),
    ("Gliwice", ("gliwice",)), ("Częstochowa", ("czestochowa",)), ("Radom", ("radom",)), ("Toruń", ("torun",)), ("Rzeszów", ("rzeszow",)),
    ("Kielce", ("kielce",)), ("Olsztyn", ("olsztyn",)), ("Opole", ("opole",)), ("Bielsko-Biała", ("bielsko",)), ("Zielona Góra", ("zielona gora",)),
    ("Legnica", ("legnica",)), ("Wałbrzych", ("walbrzych",)), ("Tychy", ("tychy",)), ("Sosnowiec", ("sosnowiec",)), ("Płock", ("plock",)),
    ("Elbląg", ("elblag",)), ("Koszalin", ("koszalin",)), ("Słupsk", ("slupsk",)), ("Tarnów", ("tarnow",)), ("Kalisz", ("kalisz",)),
    ("Lubin", ("lubin",)), ("Jelenia Góra", ("jelenia gora",)), ("Gorzów Wielkopolski", ("gorzow",)),
)


def has_any(text: Column, marks) -> Column:
    return reduce(lambda a, m: a | text.contains(m), marks, F.lit(False))


def work_mode(text: Column) -> Column:
    def named(t: Column) -> Column:
        out = F
        for mode, marks in WORK_MODES:
            out = out.when(has_any(t, marks), mode)
        return out.otherwise(NOT_GIVEN)

    return let(F.lower(F.coalesce(text, F.lit(""))), named)


def contracts(text: Column) -> Column:
    found = lambda t: F.array(*[F.when(has_any(t, marks), F.lit(name)) for name, marks in CONTRACTS])
    return F.array_compact(let(F.lower(F.coalesce(text, F.lit(""))), found))


#: Characters that Java's case-insensitive patterns take for ASCII letters, and those letters.
_AS_LETTERS = ("\u0130\u0131\u017f\u212a", "iisk")


def whole_words(text: Column, words) -> Column:
    """The words, in their order, that stand in a text as such, in any case. Patterns are slow, so that a word's is only tried where its letters are."""

    def found(t: Column) -> Column:
        named = lambda low: F.array(*[F.when(low.contains(w.lower()) & t.rlike(rf"(?iU)\b{w}\b"), F.lit(w)) for w in words])
        return let(F.lower(F.when(F.octet_length(t) > F.char_length(t), F.translate(t, *_AS_LETTERS)).otherwise(t)), named)

    return F.array_compact(let(F.coalesce(text, F.lit("")), found))


def extract_skills(text: Column) -> Column:
    """Skills that stand in a text as whole words."""
    return whole_words(text, SKILLS)


def extract_cities(text: Column) -> Column:
    padded = F.concat(F.lit(" "), F.regexp_replace(fold_text(text), "[^a-z]+", " "), F.lit(" "))
    found = lambda p: F.array(*[F.when(has_any(p, [f" {v} " for v in spellings]), F.lit(name)) for name, spellings in CITIES])
    return F.array_compact(let(padded, found))


# The pattern of a salary with a currency, and of one without.
UNIT = r"(?:/\s*|na\s*|per\s*)?(?:h|godz\.?|godzinę|godzinowo|hour|dzień|dzien|dniówka|day|mies\.?|miesięcznie|month|rocznie|rok|year)"
# an amount starts at its first digit and is taken whole: what follows is never one of its characters, so that no start or end within it is tried
SALARY = rf"(?iU)(?<!\d)(?:\d[\d\s,.]*+(?:-|–|do)\s*)?\d[\d\s,.]*+(?:PLN|EUR|USD|CHF|zł|złotych)(?!\w)(?:\s*(?:\+\s*VAT|netto|net|brutto))?(?:\s*{UNIT}(?!\w))?"
BARE_SALARY = (
    r"(?iU)(?:wynagrodzeni\w*|salary|pensja|stawka)\W{0,5}[^\d]{0,25}?(?:od\s*)?(\d[\d\s.,]*\d)\s*(?:k\b)?\s*(?:-|–|do|to)\s*(\d[\d\s.,]*\d)\s*(?:k\b)?\s*"
    r"(brutto|netto|gross|net)\b\s*(?:/|na|per|a)?\s*(miesi\w*|mies\.?|month|godz\w*|h\b|hour|rok\w*|year)?"
)


def extract_salary(text: Column) -> Column:
    """The first salary with its unit in one form; empty if there is none."""
    tidy = lambda x: F.trim(F.when(oddly_spaced(x), F.regexp_replace(x, r"(?U)\s+", " ")).otherwise(x))

    def read(t: Column) -> Column:
        bare = lambda k: F.trim(F.regexp_replace(F.regexp_extract(t, BARE_SALARY, k), r"\s+", " "))
        span = F.lower(bare(4))
        end = F.when(span.rlike("^(godz|h)"), " /h").when(span.rlike("^(rok|year)"), " /year").otherwise(" /month")
        fallback = F.when(bare(1) == "", "").otherwise(F.concat(bare(1), F.lit(" - "), bare(2), F.lit(" PLN "), F.lower(bare(3)), end))
        return let(F.regexp_extract(t, SALARY, 0), lambda f: F.when(f == "", fallback).otherwise(let(F.regexp_replace(f, r"(?iU)złotych|zł(?!\w)", "PLN"), in_one_form)))

    def in_one_form(found: Column) -> Column:
        amount = F.rtrim(F.regexp_replace(found, rf"(?iU)\s*{UNIT}$", ""))

        def named(unit: Column) -> Column:
            name = F.when(unit.rlike(r"godz|hour|(^|[\s/])h$"), " /h").when(unit.rlike("dzie|dniów|day"), " /day").when(unit.rlike("mies|month"), " /month").otherwise(" /year")
            return F.when(unit == "", found).otherwise(F.concat(amount, name))

        return let(F.lower(F.regexp_extract(found, rf"(?iU)\s*({UNIT})$", 1)), named)

    return let(let(F.coalesce(text, F.lit("")), tidy), read)


def salary_numbers(salary: Column) -> Column:
    """The numbers of a salary text, blanks within them removed; what does not read as a number is skipped."""
    parts = F.regexp_extract_all(F.coalesce(salary, F.lit("")), F.lit(r"(?U)\d[\d\s,.]*"), F.lit(0))
    return F.array_compact(F.transform(parts, lambda x: F.replace(F.regexp_replace(x, r"(?U)\s", ""), F.lit(","), F.lit(".")).try_cast("double")))


def mode_of_flags(remote: Column, hybrid: Column) -> Column:
    return F.when(remote, "Remote").when(hybrid, "Hybrid").otherwise(NOT_GIVEN)


def cities_first(text: Column, city: str, near: Column) -> Column:
    """Cities of a text, joined, the preferred one first where the text is ``near`` it; "not given" if there are none."""
    found = extract_cities(text)
    own = F.array(F.lit(city))
    moved = F.when(near | F.array_contains(found, city), F.concat(own, F.array_remove(found, city))).otherwise(found)
    return F.coalesce(F.nullif(F.array_join(moved, "; "), F.lit("")), F.lit(NOT_GIVEN))

"""Text rules as column expressions: names, scores, odds, money, clock times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions.numeric import col

# Accented letters and the plain letter each stands for.
ACCENT_MAP = {
    "a": "áàâäãåāăą", "c": "çćč", "d": "ď", "e": "éèêëēęě", "g": "ğģ", "i": "íìîïī", "k": "ķ",
    "l": "ľļ", "n": "ñńňņ", "o": "óòôöõōő", "r": "řŕ", "s": "šśşș", "t": "ťţț", "u": "úùûüūůű",
    "y": "ýÿ", "z": "žźż",
}
ACCENTED = "".join(ACCENT_MAP.values())
PLAIN = "".join(k * len(v) for k, v in ACCENT_MAP.items())

# The four dashes found between two scores.
DASH = "[–—‑-]"

# Filler words that do not identify a club.
FILLER_WORDS = (
    "fc cf sc ac as ss ssc afc cd ud rc sd us aj ogc losc rcd vfb vfl tsg sv bsc de el la los club "
    "1 04 05 96 1899 1900 1893 08 united city"
).split()


def strip_accents(name) -> Column:
    plain = F.translate(F.lower(col(name)), ACCENTED, PLAIN)
    return F.regexp_replace(plain, "[^\\x00-\\x7F]", "")


def slug(name) -> Column:
    """Lower-case ASCII words joined by hyphens."""
    return F.btrim(F.regexp_replace(strip_accents(name), "[^a-z0-9]+", "-"), F.lit("-"))


def last_word(text, default: str = "UNK") -> Column:
    words = F.split(F.trim(col(text)), "\\s+")
    word = F.element_at(words, -1)
    return F.coalesce(F.when(word != "", word), F.lit(default))


def first_listed(text, default: str = "ND") -> Column:
    return F.coalesce(F.split_part(col(text), F.lit(","), F.lit(1)), F.lit(default))


def name_key(name, birth_year, nationality) -> Column:
    """'slug|year|country': identity without a source id."""
    year = F.coalesce(col(birth_year).cast("int").cast("string"), F.lit("na"))
    return F.concat_ws("|", slug(name), year, last_word(nationality))


def is_hex_id(value) -> Column:
    return F.coalesce(col(value).rlike("^[0-9a-f]{8}$"), F.lit(False))


def age_years(age) -> Column:
    """'29' and '30-284' (years-days) both give whole years."""
    return F.split_part(col(age), F.lit("-"), F.lit(1)).try_cast("double")


def thousands(text) -> Column:
    """'2,086' -> 2086; an empty cell stays NULL."""
    return F.regexp_replace(col(text), ",", "").try_cast("double")


def strict_score(text) -> tuple[Column, Column]:
    """Both sides of a cell that is a score and nothing else; dates and codes give NULLs."""
    t = F.regexp_replace(col(text), "\\[\\[[^\\]|]*\\|?", "")
    t = F.regexp_replace(F.regexp_replace(t, "\\]\\]", ""), "\\(.*?\\)", "")
    t = F.trim(t)
    pattern = "^(\\d+)\\s*" + DASH + "\\s*(\\d+)$"
    return (
        F.regexp_extract(t, pattern, 1).try_cast("int"),
        F.regexp_extract(t, pattern, 2).try_cast("int"),
    )


def loose_score(text) -> tuple[Column, Column]:
    """Score inside a longer cell, shoot-out figures in brackets ignored: '(4) 2–2 (5)'."""
    pattern = "^(?:\\(\\d+\\)\\s*)?(\\d+)\\s*" + DASH + "\\s*(\\d+)"
    t = F.trim(col(text))
    return (
        F.regexp_extract(t, pattern, 1).try_cast("int"),
        F.regexp_extract(t, pattern, 2).try_cast("int"),
    )


def link_label(cell) -> Column:
    """Visible text of the first wiki link, else the cell without templates."""
    c = col(cell)
    pattern = "\\[\\[([^\\]|]+)(?:\\|([^\\]]+))?\\]\\]"
    label, target = F.regexp_extract(c, pattern, 2), F.regexp_extract(c, pattern, 1)
    bare = F.regexp_replace(F.regexp_replace(c, "\\{\\{[^{}]*\\}\\}", ""), "\\s+", " ")
    return F.trim(F.when(label != "", label).when(target != "", target).otherwise(bare))


def clock_minutes(text) -> Column:
    """'64:56' -> minutes as a fraction."""
    m = F.split_part(col(text), F.lit(":"), F.lit(1)).try_cast("double")
    s = F.split_part(col(text), F.lit(":"), F.lit(2)).try_cast("double")
    return m + s / 60


def decimal_odds(text) -> Column:
    """Decimal, American (+150, -120) or fractional (5/2) odds -> decimal odds above 1."""
    t = F.regexp_replace(F.trim(col(text)), ",", ".")
    top = F.split_part(t, F.lit("/"), F.lit(1)).try_cast("double")
    bottom = F.split_part(t, F.lit("/"), F.lit(2)).try_cast("double")
    v = t.try_cast("double")
    return (
        F.when(t.contains("/"), 1 + F.try_divide(top, bottom))
        .when(v >= 100, 1 + v / 100)
        .when(v <= -100, 1 + 100 / F.abs(v))
        .when(v > 1, v)
    )


def money(text) -> Column:
    """'$1,000' -> 1000."""
    return F.regexp_replace(col(text), "[^0-9.]", "").try_cast("double")


def count_of_attempts(text) -> tuple[Column, Column]:
    """'5 of 14' -> (5, 14)."""
    pattern = "^\\s*(\\d+)\\s+of\\s+(\\d+)\\s*$"
    return (
        F.regexp_extract(col(text), pattern, 1).try_cast("int"),
        F.regexp_extract(col(text), pattern, 2).try_cast("int"),
    )


def percent(text) -> Column:
    return F.regexp_extract(col(text), "(\\d+)\\s*%", 1).try_cast("int")


def name_tokens(name) -> Column:
    """Identifying words of a club name; all words when only filler remains."""
    words = F.filter(F.split(F.regexp_replace(strip_accents(name), "[^a-z0-9]+", " "), " "),
                     lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(FILLER_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def shared_tokens(left, right) -> Column:
    """Words of `left` found in `right`, one word being allowed to be a prefix (3+ letters) of the other."""
    return F.size(F.filter(col(left), lambda x: F.exists(col(right), lambda y: (x == y) | (
        (F.length(x) >= 3) & (F.length(y) >= 3) & (x.startswith(y) | y.startswith(x))))))


def short_name(name) -> Column:
    """Initial and last word: 'Raúl Pérez' -> 'R. Pérez'."""
    words = F.split(F.trim(col(name)), "\\s+")
    return F.when(F.size(words) > 1, F.concat(F.substring(words[0], 1, 1), F.lit(". "),
                                              F.element_at(words, -1))).otherwise(col(name))


def matchday_of_round(text) -> Column:
    """Trailing number of a round or phase label."""
    return F.regexp_extract(col(text), "(\\d+)\\s*$", 1).try_cast("int")


def local_kickoff(text) -> Column:
    """'20:00 (21:00)' -> the bracketed local time, else the time itself."""
    inner = F.regexp_extract(col(text), "\\((\\d{1,2}:\\d{2})\\)", 1)
    return F.when(inner != "", inner).otherwise(F.nullif(F.trim(col(text)), F.lit("")))


def mixed_date(text) -> Column:
    """dd/mm/yyyy, dd/mm/yy or ISO text -> date."""
    t = col(text)
    return F.coalesce(
        F.when(t.rlike("^\\d{1,2}/\\d{1,2}/\\d{4}$"), F.try_to_date(t, "d/M/yyyy")),
        F.when(t.rlike("^\\d{1,2}/\\d{1,2}/\\d{2}$"), F.try_to_date(t, "d/M/yy")),
        F.when(t.rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")),
    )


def season_label(code) -> Column:
    """'2324' -> '2023-24'."""
    c = col(code)
    return F.concat(F.lit("20"), F.substring(c, 1, 2), F.lit("-"), F.substring(c, 3, 2))


# Region shown with each confederation code.
REGIONS = {
    "UEFA": "Europea (UEFA)",
    "CONMEBOL": "Sudamericana (CONMEBOL)",
    "CAF": "Africana (CAF)",
    "AFC": "Asiática (AFC)",
    "CONCACAF": "Concacaf",
    "FIFA": "Mundial (FIFA)",
}


def lookup(key, mapping: dict, default=None) -> Column:
    """Value of a small fixed mapping, else `default` (a column or literal), else the key itself."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    fallback = col(key) if default is None else (
        default if isinstance(default, Column) else F.lit(default))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(key)), fallback)


def region_label(code) -> Column:
    return F.coalesce(lookup(F.upper(col(code)), REGIONS, F.lit(None).cast("string")), col(code))

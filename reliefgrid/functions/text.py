"""Name normalisation and extraction from report lines, file names and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reliefgrid.functions.numeric import as_col, parse_count, parse_number

# The sixteen states and federal territories.
STATES = [
    "Johor",
    "Kedah",
    "Kelantan",
    "Melaka",
    "Negeri Sembilan",
    "Pahang",
    "Perak",
    "Perlis",
    "Pulau Pinang",
    "Sabah",
    "Sarawak",
    "Selangor",
    "Terengganu",
    "W.P. Kuala Lumpur",
    "W.P. Labuan",
    "W.P. Putrajaya",
]

# Spellings that stand for a state.
STATE_ALIASES = {
    "Kuala Lumpur": "W.P. Kuala Lumpur",
    "KL": "W.P. Kuala Lumpur",
    "Wilayah Persekutuan Kuala Lumpur": "W.P. Kuala Lumpur",
    "Putrajaya": "W.P. Putrajaya",
    "Wilayah Persekutuan Putrajaya": "W.P. Putrajaya",
    "Labuan": "W.P. Labuan",
    "Wilayah Persekutuan Labuan": "W.P. Labuan",
    "Penang": "Pulau Pinang",
}

# State spellings searched in report lines, in search order.
REPORT_STATE_ALIASES = [
    ("PENANG", "Pulau Pinang"),
    ("PULAU PINANG", "Pulau Pinang"),
    ("KUALA LUMPUR", "W.P. Kuala Lumpur"),
    ("PUTRAJAYA", "W.P. Putrajaya"),
    ("LABUAN", "W.P. Labuan"),
    ("SELANGOR", "Selangor"),
    ("PERAK", "Perak"),
    ("KEDAH", "Kedah"),
    ("PERLIS", "Perlis"),
    ("NEGERI SEMBILAN", "Negeri Sembilan"),
    ("MELAKA", "Melaka"),
    ("JOHOR", "Johor"),
    ("PAHANG", "Pahang"),
    ("TERENGGANU", "Terengganu"),
    ("KELANTAN", "Kelantan"),
    ("SABAH", "Sabah"),
    ("SARAWAK", "Sarawak"),
]

# Origin markets searched in arrival lines, in search order.
REPORT_MARKETS = [
    "SINGAPORE",
    "INDONESIA",
    "CHINA",
    "THAILAND",
    "BRUNEI",
    "INDIA",
    "AUSTRALIA",
    "UNITED KINGDOM",
    "JAPAN",
    "PHILIPPINES",
]

# Region clusters, their states and the accepted cluster names.
REGION_CLUSTERS = {
    "Northern": ["Perlis", "Kedah", "Pulau Pinang", "Perak"],
    "Central": ["Selangor", "W.P. Kuala Lumpur", "W.P. Putrajaya"],
    "Southern": ["Negeri Sembilan", "Melaka", "Johor"],
    "East Coast": ["Kelantan", "Terengganu", "Pahang"],
    "East Malaysia": ["Sabah", "Sarawak", "W.P. Labuan"],
}
CLUSTER_NAMES = {
    "Northern": ["northern", "northern belt", "north"],
    "Central": ["central", "central belt"],
    "Southern": ["southern", "southern belt", "south"],
    "East Coast": ["east coast", "east coast belt"],
    "East Malaysia": ["borneo", "east malaysia", "sabah sarawak"],
    "West Coast": ["west coast", "west coast belt", "pantai barat"],
    "All": ["all", "all states", "all 16 states"],
}

# District spellings folded to one name (key lower case).
DISTRICT_SYNONYMS = {
    "larut dan matang": "Larut & Matang",
    "larut, matang dan selama": "Larut & Matang",
    "larut & matang": "Larut & Matang",
    "seberang perai tengah": "S.P.Tengah",
    "s.p.tengah": "S.P.Tengah",
    "seberang perai utara": "S.P.Utara",
    "s.p.utara": "S.P.Utara",
    "seberang perai selatan": "S.P. Selatan",
    "s.p. selatan": "S.P. Selatan",
    "hulu terengganu": "Hulu",
    "hulu": "Hulu",
    "lubok antu": "Lubok Antu",
}

# Generic place words ignored when names are matched.
GENERIC_PLACE_WORDS = ["taman", "sungai", "bukit", "pulau", "tasik", "kuala", "teluk", "tanjung"]

# Keywords that mark the character of a place.
PLACE_FLAGS = {
    "is_beach": ["pantai", "laut", "port", "kuala", "langkawi", "bachok", "mersing", "dungun", "semporna", "tioman",
                 "kudat", "miri", "mukah"],
    "is_urban": ["bahru", "bharu", "kinta", "timur laut", "petaling", "kinabalu", "kuching", "tengah", "klang",
                 "seremban", "kuala lumpur", "putrajaya", "sepang", "miri", "sibu", "bintulu", "sandakan", "tawau"],
    "is_nature": ["cameron", "ranau", "baling", "lipis", "hulu", "padang", "keningau", "jerantut", "gua musang",
                  "taman negara", "kapit", "limbang"],
    "is_heritage": ["melaka", "timur laut", "kuala kangsar", "taiping", "muar", "pekan", "kuala lipis", "kangar",
                    "george town", "kuching", "mukah", "sri aman"],
}

MONTH_TAGS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def state_name(raw: Column | str) -> Column:
    """Canonical state; unknown names pass through trimmed, null becomes ''."""
    clean = F.trim(F.coalesce(as_col(raw), F.lit("")))
    return F.coalesce(F.try_element_at(literal_map(STATE_ALIASES), clean), clean)


def district_name(raw: Column | str) -> Column:
    clean = F.trim(F.coalesce(as_col(raw), F.lit("")))
    return F.coalesce(F.try_element_at(literal_map(DISTRICT_SYNONYMS), F.lower(clean)), clean)


def state_key(raw: Column | str) -> Column:
    """Key that makes panel spellings meet: no 'W.P. ' prefix, trimmed, lower case."""
    return F.lower(F.trim(F.replace(as_col(raw), F.lit("W.P. "), F.lit(""))))


def words(line: Column | str) -> Column:
    return F.filter(F.split(as_col(line), r"\s+"), lambda w: w != "")


def _digit_words(line: Column | str) -> Column:
    """Tokens of lines that hold any digit; other lines are not split."""
    return F.when(as_col(line).rlike("[0-9]"), words(line)).otherwise(F.array().cast("array<string>"))


def line_numbers(line: Column | str) -> Column:
    """All tokens that read as numbers, in order."""
    return F.filter(F.transform(_digit_words(line), parse_number), lambda n: n.isNotNull())


def line_counts(line: Column | str, above: int | None = None) -> Column:
    """All tokens that read as whole counts, in order, optionally only those above a bound."""
    counts = F.filter(F.transform(_digit_words(line), parse_count), lambda n: n.isNotNull())
    return counts if above is None else F.filter(counts, lambda n: n > above)


def rejoin_split_name(text: Column | str, first: str = "NEGERI", second: str = "SEMBILAN") -> Column:
    """Put a two-word name that the report broke over lines back on one line."""
    whole = as_col(text)
    around = F.regexp_replace(whole, rf"(?i){first}\s*\n\s*([\d.\s-]+)\n\s*{second}", f"{first} {second} $1")
    joined = F.regexp_replace(around, rf"(?i){first}\s*\n\s*{second}", f"{first} {second}")
    return F.when(F.lower(whole).contains(first.lower()), joined).otherwise(whole)


def file_year(name: Column | str) -> Column:
    return F.regexp_extract(as_col(name), r"\d{4}", 0).try_cast("int")


def file_period(name: Column | str) -> Column:
    quarter = F.regexp_extract(as_col(name), "Q[1-4]", 0)
    return F.when(quarter != "", quarter).otherwise("Annual")


def file_month(name: Column | str) -> Column:
    low = F.lower(as_col(name))
    return F.coalesce(*[F.when(low.contains(m), F.lit(m.upper())) for m in MONTH_TAGS], F.lit("annual"))


def file_arrival_type(name: Column | str) -> Column:
    low = F.lower(as_col(name))
    return F.when(low.contains("excursionist"), "excursionist").when(low.contains("visitor"), "visitor").otherwise("tourist")


def occupancy_value(year: Column, numbers: Column) -> Column:
    """The column that holds the rate moved over the years: 2nd to 2021, 1st in 2022, last afterwards."""
    value = (
        F.when(year.between(2017, 2021), F.coalesce(F.get(numbers, F.lit(1)), F.get(numbers, F.lit(0))))
        .when(year == 2022, F.get(numbers, F.lit(0)))
        .otherwise(F.try_element_at(numbers, F.lit(-1)))
    )
    return F.when(value > 0.0, value)


def protection_class(raw: Column | str) -> Column:
    """'Tahap 2', 'tahap2', '2', '2.0' -> 2; null when no class 1-3 can be read."""
    text = as_col(raw).cast("string")
    number = text.try_cast("double").cast("int")
    read = F.when(number.isNotNull(), number).otherwise(F.regexp_extract(text, "[123]", 0).try_cast("int"))
    return F.when(read.between(1, 3), read)


def zone_type_number(raw: Column | str) -> Column:
    """'KSAS 12', 'ksas12', '12' -> 12; null outside 1-15."""
    text = as_col(raw).cast("string")
    number = text.try_cast("double").cast("int")
    read = F.when(number.isNotNull(), number).otherwise(F.regexp_extract(text, r"\d{1,2}", 0).try_cast("int"))
    return F.when(read.between(1, 15), read)


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def before_bracket(text: Column | str) -> Column:
    return F.substring_index(as_col(text), "(", 1)


def slug(name: Column | str) -> Column:
    """First two ASCII words joined with '_'; 'tapak' when there are none."""
    head = F.array_join(F.slice(ascii_words(before_bracket(name)), 1, 2), "_")
    return F.when(head != "", head).otherwise("tapak")


def zone_words(name: Column | str, district: Column | str) -> Column:
    """Significant words of a zone name and its district."""
    text = F.concat_ws(" ", before_bracket(F.coalesce(as_col(name), F.lit(""))), F.coalesce(as_col(district), F.lit("")))
    long_words = F.filter(ascii_words(text), lambda w: F.length(w) > 4)
    return F.array_distinct(F.array_except(long_words, F.array(*[F.lit(w) for w in GENERIC_PLACE_WORDS])))


def hotspot_words(name: Column | str) -> Column:
    return F.array_distinct(F.filter(ascii_words(F.coalesce(as_col(name), F.lit(""))), lambda w: F.length(w) > 4))


def place_flag(name: Column | str, flag: str) -> Column:
    return F.lower(as_col(name)).rlike("|".join(PLACE_FLAGS[flag]))


def first_line(value: Column | str) -> Column:
    return F.trim(F.get(F.split(as_col(value), "\n"), F.lit(0)))

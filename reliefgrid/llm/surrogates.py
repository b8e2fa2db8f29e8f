"""Personal data and secrets replaced by keyed surrogates of the same type and format.

Every surrogate is a keyed permutation of the values of its own shape: digits stay digits, letters stay letters of their script and
case, vowels stay vowels in names, separators stay where they are, card numbers keep their check digit's validity, addresses stay
public or private. Known first names are permuted within the names of their script and gender; other first names keep their ending,
which carries gender in most languages. So equal values get equal surrogates in all documents, name parts keep theirs in any
combination, and different values get different ones. Names have any number of parts, with initials and particles; further mentions of
their parts in the document, without a title or cue, get the same surrogates.

What a permutation cannot exclude is checked over the distinct values of all documents: a value must not stay as it is, no two values
may share a surrogate, and a surrogate should not be a value that some document holds. Values that fail are keyed again. Those that still
fail after ATTEMPTS keys, as where nearly all values of a shape occur, are ranked by shape and joined to surrogates of that shape that
are free, or of a longer one where none is. A secret without a letter or digit, such as a masked password, is none.

Defined results: a null text stays null and has no entities; each row is treated by itself, also when rows or ids repeat or ids are
null; an empty table gives an empty table; all columns are handed on, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from reliefgrid.llm.stored import stored

KEY = b"surrogates-1"  # a secret of the pipeline's owner
ROUNDS = 8
ATTEMPTS = 8

#: Titles by gender, first names by script and gender.
TITLES = {
    "f": ["Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Señora", "Sra.", "Madame", "Mme", "Signora", "госпожа", "г-жа"],
    "m": ["Mr.", "Mr", "Herr", "Herrn", "Señor", "Sr.", "Monsieur", "Signor", "господин", "г-н"],
    "n": ["Dr.", "Prof."],
}
CUES = ["my name is", "My name is", "Dear", "Name:", "mein Name ist", "me llamo", "je m'appelle"]
FIRST_NAMES = {
    ("latin", "f"): ["Alice", "Anna", "Carla", "Carmen", "Claire", "Elena", "Emma", "Hannah", "Julia", "Laura", "Maria", "Marie", "Mary", "Olivia", "Paula", "Sarah", "Sofia", "Susan"],
    ("latin", "m"): ["Adam", "Carlos", "Daniel", "David", "Felix", "Hans", "Jack", "James", "Jean", "John", "Juan", "Karl", "Luis", "Martin", "Michael", "Paul", "Pierre", "Thomas"],
    ("cyrillic", "f"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"],
    ("cyrillic", "m"): ["Антон", "Борис", "Иван", "Максим", "Олег", "Павел", "Сергей", "Юрий"],
}
#: Letters that stand for each other: vowels and consonants of each script, lower case.
LETTERS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóú", "äöü", "àèù", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
DIGITS, HEX = "0123456789", "0123456789abcdef"
CLASSES = {c: letters for letters in LETTERS for c in letters}

_NAME = r"[^\W\d_]*[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω][^\W\d_]+(?:-[^\W\d_]+)?"
_PARTICLE = r"(?:von|van|vom|zu|zur|der|den|dem|de|del|della|di|da|dos|du|la|le|ten|ter|bin|al)"
_INITIAL = r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]\."
_NAMES = rf"(?:{_PARTICLE} |{_INITIAL} ?)*{_NAME}(?: (?:{_INITIAL} ?|{_PARTICLE} )*{_NAME})*"
_TITLED = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
#: kind, pattern, signs of which a text must have one; the group ``v`` is what is replaced. Earlier kinds win where two overlap.
PATTERNS = [
    ("secret", r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[ \t]*[=:][ \t]*[\"']?(?P<v>[^\s\"',;]{6,})", ("=", ":")),
    ("secret", r"\b(?:AKIA|ASIA)(?P<v>[A-Z0-9]{16})\b", ("AKIA", "ASIA")),
    ("secret", r"\b(?:ghp_|gho_|sk-|xox[bp]-)(?P<v>[A-Za-z0-9-]{16,})\b", ("ghp_", "gho_", "sk-", "xox")),
    ("email", r"(?P<v>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})", ("@",)),
    ("iban", r"\b(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b", DIGITS),
    ("ip", r"(?<![\d.])(?P<v>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\d.]*\d)", DIGITS),
    ("ip6", r"(?<![\w:.])(?P<v>(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})(?![\w:]|\.\d)", DIGITS),
    ("card", r"(?<![\d.+-])(?P<v>(?:[3-6]\d|2[2-7])\d{2}(?:[ -]?\d{4}){2}[ -]?\d{1,4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\d-]|\.\d)", DIGITS),
    ("ssn", r"(?<![\d-])(?P<v>\d{3}-\d{2}-\d{4})(?![\d-])", DIGITS),
    ("phone", r"(?<![\w.+-])(?P<v>\+\(?\d(?:[ .()/-]{0,2}\d){6,14}|(?:1[-. ])?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4})(?!\w|-\w)", DIGITS),
    ("name", rf"(?<!\w)(?:{_TITLED}) (?P<v>{_NAMES})", tuple(t for ts in TITLES.values() for t in ts)),
    ("name", rf"(?<!\w)(?:{'|'.join(map(re.escape, CUES))}) (?P<v>{_NAMES})", tuple(CUES)),
]


def known_sign(c: str) -> bool:
    low = c.lower()
    return c in DIGITS or c in (low, low.upper()) and low.upper().lower() == low and (low in CLASSES or low in "abcdefghijklmnopqrstuvwxyz")


@functools.cache
def generic(c: str) -> str:
    """The signs that stand for a letter or digit of a script that LETTERS lacks: those of its kind in its block of 256."""
    kind = unicodedata.category(c)
    if kind[0] != "L" and kind != "Nd" or known_sign(c):
        return ""
    low = ord(c) & ~0xFF
    return "".join(x for x in map(chr, range(low, low + 256)) if unicodedata.category(x) == kind and not known_sign(x))


def permutable(c: str) -> bool:
    return known_sign(c) or len(generic(c)) > 1


PARTICLE = re.compile(_PARTICLE)


def further_mentions(text: str, spans: list[tuple[int, int]], parts: dict[str, str]) -> list[tuple[int, int, str]]:
    """(start, end, surrogate) of the name parts that the text mentions again outside of the spans."""
    if not parts:
        return []
    last, rest = 0, []
    for low, high in spans:
        rest += [text[last:low], "\0" * (high - low)]
        last = high
    longest = sorted(map(re.escape, parts), key=len, reverse=True)
    found = re.finditer(rf"(?<!\w)(?:{'|'.join(longest)})(?!\w)", "".join([*rest, text[last:]]))
    return [(*m.span(), parts[m.group()]) for m in found]


def name_parts(value: str, fresh: str) -> dict[str, str]:
    """The surrogate of each part of a name, without particles and initials."""
    pairs = zip(value.split(" "), fresh.split(" "), strict=True)
    return {a: b for a, b in pairs if not PARTICLE.fullmatch(a) and not a.endswith(".")}


class Detector:
    def __init__(self):
        self.patterns = [(kind, re.compile(p), signs) for kind, p, signs in PATTERNS]
        self.digit = re.compile("[0-9]")

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, gender) of each entity, in order, none within another."""
        found: list[tuple[int, int, str, str]] = []
        digits = self.digit.search(text) is not None
        for kind, pattern, signs in self.patterns:
            if not (digits if signs is DIGITS else any(s in text for s in signs)):
                continue
            own = [
                (*m.span("v"), kind, self.gender(m.group()) if kind == "name" else "")
                for m in pattern.finditer(text) if self.valid(kind, m.group("v"))
            ]
            if own:
                found += own
                # later patterns do not see what is taken
                last, parts = 0, []
                for low, high, *_ in own:
                    parts += [text[last:low], "\0" * (high - low)]
                    last = high
                text = "".join([*parts, text[last:]])
        return sorted(found)

    @staticmethod
    def valid(kind: str, value: str) -> bool:
        """Numbers that only look like cards or accounts are none: their check digits must fit."""
        if kind == "card":
            digits = [int(c) for c in value if c in DIGITS]
            return luhn(digits[:-1]) == digits[-1]
        if kind == "ip6":
            try:
                return ipaddress.IPv6Address(value) is not None and any(c in DIGITS for c in value)
            except ValueError:
                return False
        if kind == "secret":
            return any(map(permutable, value))
        return kind != "iban" or iban_check(value) == value[2:4]

    @staticmethod
    def gender(text: str) -> str:
        for gender, titles in TITLES.items():
            if any(text.startswith(t + " ") for t in titles):
                return gender
        return "n"


def luhn(digits: list[int]) -> int:
    """The check digit that follows these digits."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        total += d if k % 2 else (2 * d if d < 5 else 2 * d - 9)
    return -total % 10


def iban_check(value: str) -> str:
    """The two check digits that fit a country and an account number."""
    signs = "".join(c for c in value if c.isalnum())
    number = "".join(str(int(c, 36)) for c in f"{signs[4:]}{signs[:2]}00")
    return f"{98 - int(number) % 97:02d}"


def network(o: list[int]) -> int:
    """Octets that say which network it is, for networks that are not public."""
    if o[0] in (0, 10, 127) or o[0] >= 224:
        return 1
    return 2 if o[:2] in ([192, 168], [169, 254]) or o[0] == 172 and 16 <= o[1] < 32 else 0


class Surrogates:
    """Keyed permutations by type and shape."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.classes = CLASSES
        self.genders = {name: group for group, names in FIRST_NAMES.items() for name in names}

    def stream(self, tweak: str, other: list[int], n: int) -> list[int]:
        out = hashlib.blake2b(f"{tweak}|{','.join(map(str, other))}".encode(), key=self.key, digest_size=64).digest()
        while len(out) < 2 * n:
            out += hashlib.blake2b(out[-64:], key=self.key, digest_size=64).digest()
        return [int.from_bytes(out[2 * i : 2 * i + 2], "big") for i in range(n)]

    def permuted(self, tweak: str, values: list[int], radices: list[int]) -> list[int]:
        """A Feistel network over two halves of the values, each taken modulo its radix."""
        values, half = list(values), len(values) // 2
        sides = (range(half), range(half, len(values)))
        for r in range(ROUNDS):
            to, of = sides[r % 2], sides[1 - r % 2]
            for i, x in zip(to, self.stream(f"{tweak}|{r}", [values[k] for k in of], len(to)), strict=True):
                values[i] = (values[i] + x) % radices[i]
        return values

    def shaped(self, tweak: str, text: str, hexadecimal: bool = False, vowels: bool = False, keep: frozenset[int] = frozenset()) -> str:
        """The text with each sign replaced by one of its class; other signs and the places in ``keep`` stay."""
        places, alphabets = self.alphabets(text, hexadecimal, vowels, keep)
        shape = "".join("9" if c in DIGITS else "A" if c.isupper() else "a" for c in text)
        values = [a.index(text[i] if text[i] in a else text[i].lower()) for i, a in zip(places, alphabets, strict=True)]
        fresh = self.permuted(f"{tweak}|{'' if hexadecimal else shape}|{len(text)}", values, [len(a) for a in alphabets])
        return self.put(text, places, alphabets, fresh)

    @staticmethod
    def put(text: str, places: list[int], alphabets: list[str], values: list[int]) -> str:
        out = list(text)
        for i, v, a in zip(places, values, alphabets, strict=True):
            out[i] = a[v].upper() if text[i].isupper() and text[i] not in a else a[v]
        return "".join(out)

    def alphabets(self, text: str, hexadecimal: bool, vowels: bool, keep: frozenset[int]) -> tuple[list[int], list[str]]:
        """The places whose sign is replaced, and the signs that each may get."""
        places, alphabets = [], []
        for i, c in enumerate(text):
            low = c.lower()
            if i in keep:
                continue
            if hexadecimal and c in HEX:
                alphabet = HEX
            elif c in DIGITS:
                alphabet = DIGITS
            elif not known_sign(c):
                alphabet = generic(c)
            elif not vowels and "a" <= low <= "z":
                alphabet = "abcdefghijklmnopqrstuvwxyz"
            else:
                alphabet = self.classes[low]
            if alphabet:
                places.append(i)
                alphabets.append(alphabet)
        return places, alphabets

    def nth(self, kind: str, value: str, n: int) -> tuple[str | None, int]:
        """The n-th value of the shape of a canonical value, and how many there are. None: of another sort, or there are no more."""
        if kind == "ip":
            octets = [int(x) for x in value.split(".")]
            fixed = network(octets)
            size = 256 ** (4 - fixed)
            fresh = octets[:fixed] + [n // 256**k % 256 for k in range(3 - fixed, -1, -1)]
            return ".".join(map(str, fresh)) if n < size and network(fresh) == fixed else None, size
        tail, keep = "", frozenset()
        if kind == "email":
            value, _, top = value.rpartition(".")
            tail = f".{top}"
        elif kind == "phone":
            keep = self.code(value)
        elif kind == "iban":
            keep = frozenset(range(4))
        elif kind == "card":
            keep = frozenset((0, len(value) - 1))
        elif kind == "ip6":
            keep = frozenset(range(4))
        hexadecimal = kind == "ip6" or kind == "secret" and len(value) > 7 and all(c in HEX for c in value)
        places, alphabets = self.alphabets(value, hexadecimal, kind == "name", keep)
        size, values = math.prod(map(len, alphabets)), []
        if n >= size:
            return None, size
        for a in reversed(alphabets):
            n, v = divmod(n, len(a))
            values.append(v)
        fresh = self.put(value, places, alphabets, values[::-1])
        if kind == "card":
            fresh = fresh[:-1] + str(luhn([int(c) for c in fresh[:-1]]))
        if kind == "iban":
            fresh = fresh[:2] + iban_check(fresh) + fresh[4:]
        return fresh + tail, size

    @staticmethod
    def longer(kind: str, value: str) -> str:
        """A value of a shape that has more values, for one whose shape has none left."""
        if kind == "ip":
            if network([int(x) for x in value.split(".")]) == 0:
                raise ValueError("no address is free")
            return "1.0.0.0" if value.startswith("10.") else "10.0.0.0"
        if kind == "card":
            return value[:-1] + "0" + value[-1]
        if kind == "ip6":
            return f"{int(value[:4], 16) + 1 & 0xFFFF:04x}{value[4:]}"  # the next network
        if kind in ("email", "secret"):
            return "a" + value
        return value + ("0" if kind in ("iban", "ssn", "phone") else "n")

    @staticmethod
    def spelled(kind: str, value: str, fresh: str) -> str:
        """A canonical surrogate in the spelling of a mention."""
        if kind == "card":
            digits, out = list(fresh), []
            for c in value:
                out.append(digits.pop(0) if c in DIGITS else c)
            return "".join(out + digits)
        if kind == "ip6":
            fresh = fresh if len(value) == 39 else ipaddress.IPv6Address(fresh).compressed
            return fresh.upper() if value != value.lower() else fresh
        if kind == "email" and len(fresh) == len(value):
            return "".join(b.upper() if a.isupper() else b for a, b in zip(value, fresh, strict=True))
        return fresh

    @staticmethod
    def code(value: str) -> frozenset[int]:
        """Places of the sign and the country code of a phone number."""
        found = re.match(r"\+\d{1,3}(?=[ .(/-])|\+(?:1|7|\d\d)", value)
        return frozenset(range(found.end() if found else 0))

    def of(self, kind: str, value: str, gender: str, attempt: int) -> str:
        tweak = f"{kind}|{attempt}"
        if kind == "ip":
            return self.address(tweak, value)
        if kind == "ip6":
            whole = ipaddress.IPv6Address(value).exploded  # the first group says which network it is
            return self.spelled(kind, value, self.shaped(tweak, whole, hexadecimal=True, keep=frozenset(range(4))))
        if kind == "card":
            return self.card(tweak, value)
        if kind == "phone":
            return self.shaped(tweak, value, keep=self.code(value))
        if kind == "email":
            user, _, domain = value.partition("@")
            labels, _, top = domain.rpartition(".")
            # the whole address is one value in lower case: its case is that of the text
            fresh = self.shaped(tweak, f"{user}@{labels}".lower())
            return "".join(b.upper() if a.isupper() else b for a, b in zip(f"{user}@{labels}", fresh, strict=True)) + f".{top}"
        if kind == "name":
            return self.name(tweak, value, gender)
        if kind == "iban":
            fresh = self.shaped(tweak, value, keep=frozenset(range(4)))
            return fresh[:2] + iban_check(fresh) + fresh[4:]
        return self.shaped(tweak, value, hexadecimal=kind == "secret" and len(value) > 7 and all(c in HEX for c in value))

    def card(self, tweak: str, value: str) -> str:
        digits = [int(c) for c in value if c in DIGITS]
        middle = self.permuted(f"{tweak}|{len(digits)}", digits[1:-1], [10] * (len(digits) - 2))
        body = [digits[0], *middle]
        fresh = iter([*body, luhn(body)])
        return "".join(str(next(fresh)) if c in DIGITS else c for c in value)

    def address(self, tweak: str, value: str) -> str:
        octets = [int(x) for x in value.split(".")]
        fixed = network(octets)
        fresh = octets
        while True:  # walks on until it is public again; private parts stay as they are
            fresh = octets[:fixed] + self.permuted(f"{tweak}|{fixed}|{octets[:fixed]}", fresh[fixed:], [256] * (4 - fixed))
            if network(fresh) == fixed:
                return ".".join(map(str, fresh))

    def name(self, tweak: str, value: str, gender: str) -> str:
        """Part by part, so that parts keep their surrogate in any combination."""
        parts = value.split(" ")
        out = []
        for part in parts:
            if PARTICLE.fullmatch(part):
                out.append(part)
                continue
            group = self.genders.get(part)
            if group and (gender in ("n", group[1]) or part in FIRST_NAMES[group]):
                names = FIRST_NAMES[group]
                ranks = sorted(range(len(names)), key=lambda i, t=tweak, g=group: self.stream(f"{t}|{g}|{i}", [], 4))
                # one cycle through all names of the group: none keeps its own
                out.append(names[ranks[(ranks.index(names.index(part)) + 1) % len(names)]])
            else:
                first = len(parts) > 1 and part is parts[0]
                ending = len(part) - (1 if part[-1:].lower() in self.classes and len(part) > 2 else 0)
                out.append(self.shaped(f"{tweak}|{'first' if first else 'last'}", part, vowels=True, keep=frozenset(range(ending, len(part))) if first else frozenset()))
        return " ".join(out)


def canonical(kind: str, value: str) -> str:
    """What two mentions of one value have in common."""
    if kind == "email":
        return value.lower()
    if kind == "ip6":
        return ipaddress.IPv6Address(value).exploded
    if kind == "card":
        return "".join(c for c in value if c in DIGITS)
    return value


def entity_values(docs: DataFrame) -> DataFrame:
    """kind, value, gender: the distinct entities of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector()
        for batch in batches:
            rows = set()
            for text in batch.column(0).to_pylist():
                if text:
                    rows |= {(kind, canonical(kind, text[a:b]), gender) for a, b, kind, gender in detector.find(text)}
            columns = list(zip(*sorted(rows), strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["kind", "value", "gender"])

    found = docs.select(docs["text"].cast("string")).mapInArrow(run, "kind string, value string, gender string")
    return stored(found.groupBy("kind", "value").agg(F.max("gender").alias("gender")), "entities")


def failed_values(values: DataFrame, key: bytes = KEY) -> DataFrame | None:
    """kind, value, attempt of the values whose first surrogate fails the checks, and ``fixed``, the surrogate of those that no key
    gives one; None where none fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            fresh = [canonical(kind, made.of(kind, value, gender, attempt)) for kind, value, gender, attempt in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fresh, pa.string())], names=[*names, "surrogate"])

    names = ["kind", "value", "gender", "attempt"]
    schema = "kind string, value string, gender string, attempt int, surrogate string"
    table = values.withColumn("attempt", F.lit(0))
    for attempt in range(1, ATTEMPTS + 1):
        made = stored(table.select(*names).mapInArrow(run, schema), "surrogates")
        shared = made.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "value")).alias("first"))
        taken = values.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("taken"))
        checked = made.join(shared.where("n > 1").drop("n"), ["kind", "surrogate"], "left").join(taken, ["kind", "surrogate"], "left")
        double = F.col("first").isNotNull() & (F.col("first.value") != F.col("value"))
        # a name is permuted within a short list, where every surrogate is somebody's name
        bad = double | (F.col("surrogate") == F.col("value")) | (F.coalesce("taken", F.lit(False)) & (F.col("kind") != "name"))
        checked = stored(checked.select(*names, bad.alias("bad"), (double | (F.col("surrogate") == F.col("value"))).alias("wrong")), "checked")
        if checked.where("bad").isEmpty():
            break
        if attempt == ATTEMPTS:
            break
        table = checked.select("kind", "value", "gender", F.when(F.col("bad"), attempt).otherwise(F.col("attempt")).cast("int").alias("attempt"))
    again = made.where("attempt > 0").select("kind", "value", "attempt").withColumn("fixed", F.lit(None).cast("string"))
    wrong = checked.where("wrong").select("kind", "value")
    if not wrong.isEmpty():
        used = made.join(wrong, ["kind", "value"], "left_anti").select("kind", "surrogate")
        fixed = free_surrogates(wrong, used.unionByName(values.select("kind", F.col("value").alias("surrogate"))), key)
        again = again.join(wrong, ["kind", "value"], "left_anti").unionByName(
            fixed.select("kind", "value", F.lit(ATTEMPTS).alias("attempt"), F.col("surrogate").alias("fixed"))
        )
    return None if again.isEmpty() else again


def free_surrogates(left: DataFrame, used: DataFrame, key: bytes) -> DataFrame:
    """kind, value, surrogate: for each value another one that is not in ``used`` (kind, surrogate), of its shape as long as that has any."""

    def nth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        for batch in batches:
            found = [made.nth(*row) for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([min(n, 1 << 62) for _, n in found], pa.int64())
            ], names=["kind", "value", "surrogate", "size"])

    def next_shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        for batch in batches:
            rows = []
            for kind, value, shape, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at >= size:
                    shape, at = made.longer(kind, shape), 0
                    shape = made.nth(kind, shape, 0)[0] or shape
                rows.append((kind, value, shape, at))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.string()] * 3, pa.int64()), strict=True)], names=names)

    names, schema = ["kind", "value", "shape", "at"], "kind string, value string, surrogate string, size long"
    left = left.select("kind", "value", F.lit(0).alias("n")).mapInArrow(nth, schema)
    left = stored(left.select("kind", "value", F.coalesce("surrogate", "value").alias("shape"), F.lit(0).cast("long").alias("at")), "left")
    done = None
    while not left.isEmpty():
        ranked = left.withColumn("rank", F.row_number().over(W.partitionBy("kind", "shape").orderBy("value")))
        groups = left.groupBy("kind", "shape").agg(F.min("at").alias("at"), (F.min("at") + 8 * F.count("*") + 64).alias("end"))
        tried = groups.select("kind", F.col("shape").alias("value"), F.explode(F.sequence("at", F.col("end") - 1)).alias("n")).mapInArrow(nth, schema)
        tried = stored(tried.withColumnRenamed("value", "shape"), "tried")
        free = tried.where("surrogate IS NOT NULL").dropDuplicates(["kind", "surrogate"]).join(used, ["kind", "surrogate"], "left_anti")
        free = free.withColumn("rank", F.row_number().over(W.partitionBy("kind", "shape").orderBy("surrogate")))
        given = stored(ranked.join(free, ["kind", "shape", "rank"]).select("kind", "value", "surrogate"), "given")
        done = given if done is None else done.unionByName(given)
        used = used.unionByName(given.select("kind", "surrogate"))
        sizes = tried.groupBy("kind", "shape").agg(F.max("size").alias("size"))
        rest = left.drop("at").join(given, ["kind", "value"], "left_anti").join(groups, ["kind", "shape"]).join(sizes, ["kind", "shape"])
        left = stored(rest.select("kind", "value", "shape", F.col("end").alias("at"), "size").mapInArrow(
            next_shape, "kind string, value string, shape string, at long"
        ), "left")
    return done


def with_surrogates(docs: DataFrame, key: bytes = KEY, count_column: str | None = None) -> DataFrame:
    """The documents with surrogates in ``text``, in all their columns; n_chars, where there is one, is counted anew."""
    failed = failed_values(entity_values(docs), key)
    at = docs.columns.index("text")
    text = docs["text"].cast("string")
    again = F.lit(None).cast("array<struct<kind:string,value:string,attempt:int,fixed:string>>")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), text.alias("text"), again.alias("again"))
    if failed is not None:
        rows = _with_failed(rows.drop("again"), failed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector, made = Detector(), Surrogates(key)
        for batch in batches:
            texts, counts = [], []
            for text, again in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                attempts = {(x["kind"], x["value"]): (x["attempt"], x["fixed"]) for x in again or ()}
                found = detector.find(text) if text else []
                fresh, parts = [], {}
                for a, b, kind, gender in found:
                    value = text[a:b]
                    attempt, fixed = attempts.get((kind, canonical(kind, value)), (0, None))
                    fresh.append((a, b, made.spelled(kind, value, fixed) if fixed else made.of(kind, value, gender, attempt)))
                    if kind == "name":
                        parts = name_parts(value, fresh[-1][2]) | parts  # the first mention decides
                fresh += further_mentions(text, [x[:2] for x in fresh], parts) if parts else []
                out, last = [], 0
                for a, b, value in sorted(fresh):
                    out += [text[last:a], value]
                    last = b
                texts.append("".join([*out, text[last:]]) if found else text)
                counts.append(len(fresh))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["d", "fresh", "n"]
            )

    done = rows.mapInArrow(run, T.StructType([
        T.StructField("d", rows.schema["d"].dataType), T.StructField("fresh", T.StringType()), T.StructField("n", T.LongType())
    ]))
    columns = [
        F.col("fresh").alias(c) if i == at else F.length("fresh").cast("long").alias(c) if c == "n_chars" else F.col("d").getField(c).alias(c)
        for i, c in enumerate(docs.columns)
    ]
    return done.select(*columns, *([F.col("n").alias(count_column)] if count_column else []))


def _with_failed(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """Brings each document the attempts of its own values that failed a check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector()
        for batch in batches:
            found = [
                (key, kind, value) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text
                for kind, value in {(kind, canonical(kind, text[a:b])) for a, b, kind, _ in detector.find(text)}
            ]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                names=["text_key", "kind", "value"],
            )

    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    mentions = keyed.select("text_key", "text").mapInArrow(run, "text_key long, kind string, value string").distinct()
    again = mentions.join(failed, ["kind", "value"]).groupBy("text_key").agg(
        F.collect_list(F.struct("kind", "value", "attempt", "fixed")).alias("again")  # the failed values of one text
    )
    return keyed.join(again, "text_key", "left").select("d", "text", "again")

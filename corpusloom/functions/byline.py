"""Bylines to people: names, places and departments of a free-text author line.

A byline is cut into parts at commas, semicolons, *und* and *and*.  Each part gets a class --
department, place, name particle, name, other -- and a small grammar over the classes puts people
together.  Places come from an optional gazetteer (lower-cased names); without one only form and
context tell a place.  Nothing here asks a network service, so a byline always gives one result.

The parser runs once for each distinct byline (:func:`parse_bylines`).
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: sections and ranks that are no people
DEPARTMENTS = frozenset(
    {
        "redaktion",
        "folio",
        "geschichte",
        "history",
        "kultur",
        "culture",
        "feuilleton",
        "debatte",
        "debate",
        "wirtschaft",
        "economy",
        "sport",
        "politik",
        "politics",
        "international",
        "inland",
        "domestic",
        "ausland",
        "foreign",
        "meinung",
        "opinion",
        "zuerich",
        "zurich",
        "schweiz",
        "switzerland",
        "visuals",
        "chefredaktor",
        "editor-in-chief",
        "ressortleiter",
        "korrespondent",
        "correspondent",
        "reporter",
        "redaktor",
        "editor",
        "section head",
    }
)
# fixed values: particles of family names
PARTICLES = frozenset({"von", "van", "de", "da", "di", "del", "der", "den", "du", "le", "la", "ten", "el", "al"})
# fixed values: words that tell a place
PLACE_WORDS = ("gazastreifen", "gaza", "valley", "city", "town", "nördlicher", "südlicher", "östlicher", "westlicher", "nord", "süd", "ost", "west")
PLACE_LINKS = frozenset({"de", "da", "am", "on", "in", "bei", "an"})
PLACE_STARTS = frozenset({"new", "tel", "san", "rio", "são", "los", "las", "el", "al", "saint", "st.", "bad"})

# fixed values: short words that are names, and short ones that are towns
COMMON_NAMES = frozenset(
    "max tom tim jan leo noa luk ben sam dan müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann schäfer koch bauer richter klein wolf".split()
)
KNOWN_CITIES = frozenset("rom bern biel wien paris berlin london tokio milan kiew".split())

PERSON = "first_name string, middle_name string, last_name string, location string, department string, name string, original string"
_SPLIT = re.compile(r"[,;]|\s+und\s+|\s+and\s+", re.I)
_INITIAL = re.compile(r"[A-ZÄÖÜ]\.")


@dataclass
class Person:
    first_name: str
    middle_name: str | None
    last_name: str
    location: str | None
    department: str | None
    original: str

    @property
    def name(self) -> str:
        return " ".join(x for x in (self.first_name, self.middle_name, self.last_name) if x)


def _capital(w: str) -> bool:
    return w[:1].isupper()


class Parser:
    def __init__(self, gazetteer: frozenset[str] = frozenset(), house: str = ""):
        self.places = frozenset(x.lower() for x in gazetteer)
        self.house = house.lower()

    def is_department(self, part: str) -> bool:
        x = part.strip().lower()
        own = bool(self.house) and (x == self.house or x.startswith((self.house + "-", self.house + " ")))
        return len(x) > 1 and (x in DEPARTMENTS or "redaktion" in x or own)

    def is_place(self, part: str) -> bool:
        return part.strip().lower() in self.places

    def _like_place(self, part: str) -> bool:
        """By form alone, for what follows a full name and a comma."""
        low, words = part.lower(), part.split()
        if self.is_place(part) or any(k in low for k in PLACE_WORDS):
            return True
        if any(w.lower() in PLACE_LINKS or w.lower().startswith("al-") for w in words[1:]):
            return True
        return not self.is_department(part) and all(map(_capital, words)) and (len(words) > 1 or len(part) > 2)

    def _name_alone(self, word: str) -> bool:
        """Whether one word on its own is a family name: an initial, a word of two letters, a short common name or a
        word in lower case.  Longer capitalised words are more likely a town, and capitals an agency."""
        if len(word) == 1 or len(word) == 2 and word[1] == ".":
            return True
        if not re.fullmatch(r"[^\W\d_]+(?:[-'.][^\W\d_]*)*", word) or word.isupper() and len(word) > 2 or self.is_place(word):
            return False
        low = word.lower()
        if not _capital(word) or self.is_department(word) or len(word) == 2:
            return True
        return len(word) < 5 and low in COMMON_NAMES and low not in KNOWN_CITIES

    def _full_name(self, part: str) -> bool:
        w = part.split()
        return len(w) >= 2 and _capital(w[0]) and (_capital(w[1]) or w[1].lower() in PARTICLES)

    def person(self, words: list[str], location: str | None, department: str | None, original: str) -> Person | None:
        """First, middle and last name of the words of one person."""
        words = [w for w in words if w]
        if len(words) > 1 and words[0] in ("Von", "von"):
            words = words[1:]
        if not words:
            return None
        if location and (location.lower() in (w.lower() for w in words) or location.lower() not in original.lower()):
            location = None
        first, middle, rest = words[0], None, words[1:]
        if not rest:
            return Person("", None, first, location, department, original)
        particle = next((i for i, w in enumerate(rest) if w.lower() in PARTICLES and i + 1 < len(rest)), None)
        initial = next((w for w in rest[:-1] if _INITIAL.fullmatch(w)), None)
        if initial:
            middle, last = initial, rest[-1]
        elif particle is not None:
            middle, last = " ".join(rest[:particle]) or None, " ".join(rest[particle:])
        else:
            middle, last = " ".join(rest[:-1]) or None, rest[-1]
        return Person(first, middle, last, location, department, original)

    def _place_alone(self, text: str) -> bool:
        words = text.split()
        if self.is_place(text):
            return True
        if len(words) == 1 or not _capital(words[0]):
            return False
        middle = words[1].lower()
        if len(words) == 3 and middle in PARTICLES and middle not in PLACE_LINKS:
            return False
        if len(words) == 3 and middle in PLACE_LINKS:
            return True
        return any(k in (w.lower() for w in words) for k in PLACE_WORDS) or len(words) == 2 and words[0].lower() in PLACE_STARTS

    def _chunk(self, words: list[str]) -> list[list[str]]:
        """Names run together: two words each, three with an initial or a particle between."""
        out, i = [], 0
        while i < len(words):
            n = 2
            while i + n < len(words) and (words[i + n - 1].lower() in PARTICLES or words[i + n].lower() in PARTICLES or _INITIAL.fullmatch(words[i + n - 1])):
                n += 1
            if len(words) - i - n == 1:
                n += 1
            out.append(words[i : i + n])
            i += n
        return out

    def parse(self, byline: str | None) -> list[Person]:
        text = (byline or "").strip()
        if not text:
            return []
        head, comma, tail = (x.strip() for x in text.partition(","))
        if comma and tail and "," not in tail and self._full_name(head):  # "Name, Place" and "Name, Place und Place"
            places = [p for p in re.split(r"\s+und\s+|\s+and\s+", tail, flags=re.I) if p.strip()]
            several = len(places) > 1
            fits = [p for p in places if self.is_place(p) or (p.lower() not in head.lower() and _capital(p) and len(p) > 2 if several else self._like_place(p))]
            if fits and not (several and all(self._full_name(p) and not self.is_place(p) for p in places)):
                one = self.person(head.split(), fits[0], None, text)
                return [one] if one else []
        if not comma and self._place_alone(text):
            return []
        if self.is_department(text):
            return [Person("", None, text, None, text, text)]
        if not comma and not _SPLIT.search(text):
            words = text.split()
            if self.is_department(words[0]) and len(words) > 2 and all(map(_capital, words)):  # "Kultur First Last"
                one = self.person(words[1:], None, words[0], text)
                return [one] if one else []
            if len(words) >= 4 and all(_capital(w) or w.lower() in PARTICLES for w in words) and words[0] not in ("Von", "von"):
                return [p for c in self._chunk(words) if (p := self.person(c, None, None, text))]
            one = self.person(words, None, None, text) if len(words) > 1 else None
            return [one] if one else []
        return self._walk([p.strip() for p in _SPLIT.split(text) if p.strip()], text)

    def _walk(self, parts: list[str], text: str) -> list[Person]:
        """The grammar over parts: places and departments hold until the next one."""
        out: list[Person] = []
        held: list[str] = []
        place = department = None

        def close() -> None:
            if len(held) == 1 and len(held[0].split()) == 1 and (out or place is None and department is None):
                held.clear()  # one word alone is nobody
            elif len(held) == 1 and len(held[0].split()) == 1 and not self._name_alone(held[0]):
                held.clear()  # a town or an agency
            if held:
                one = self.person(" ".join(held).split(), place, department, text)
                if one:
                    out.append(one)
                held.clear()

        for n, part in enumerate(parts):
            if self.is_department(part):
                close()
                department = part
            elif self.is_place(part):
                close()
                place = part
            elif self._full_name(part):
                close()
                held.append(part)
            elif part.lower() in PARTICLES:
                held.append(part)
            elif held and len(" ".join(held).split()) > 1 and held[-1].lower() not in PARTICLES:
                close()
                held.append(part)
            elif not held and n == 0 and len(parts) > 2 and _capital(part) and parts[2].lower() in PARTICLES:
                continue  # "Place, First, von, Last" without a gazetteer
            else:
                held.append(part)
        close()
        return out


def parse_bylines(df: DataFrame, column: str, gazetteer: frozenset[str] = frozenset(), house: str = "", out: str = "people") -> DataFrame:
    """``df`` with ``out``, the people of ``column``; each distinct byline is parsed once.

    The gazetteer travels with the function's code, so it has to be of bounded size.
    """
    if len(gazetteer) > 1_000_000:
        raise ValueError("the gazetteer has more than a million names")
    parser = Parser(gazetteer, house)

    @F.pandas_udf(f"array<struct<{PERSON.replace(' string', ':string')}>>")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [asdict(p) | {"name": p.name} for p in parser.parse(x)])

    distinct = df.select(F.col(column).alias("_byline")).where("_byline is not null").distinct().withColumn(out, parse("_byline"))
    return df.join(distinct, F.col(column) == F.col("_byline"), "left").withColumn(out, F.coalesce(out, F.array().cast(distinct.schema[out].dataType))).drop("_byline")

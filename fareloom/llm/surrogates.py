"""PII surrogates: detected entities get keyed replacements of their own kind.

An entity is replaced alike wherever it occurs, different entities are
replaced differently, and no replacement is an entity of the corpus. The
replacement follows from a secret key and the entity alone; the few that
collide are drawn again in a table of their own.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.llm.text import as_text, parts
from fareloom.staging import stage

# Titles with the gender they tell, and given names and surnames by script and gender.
TITLES = {
    "m": "Mr Sir Herr Herrn Monsieur Señor Sr Don Signor г-н господин κύριος",
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Señorita Sra Doña Signora г-жа госпожа κυρία",
    "n": "Dr Prof Professor",
}
GIVEN = {
    ("latin", "f"): "Alice Amelia Andrea Beatriz Camille Carla Carmen Charlotte Claire Clara Elena Emilia Emma Greta Hannah "
    "Helena Ingrid Isabel Julia Karin Laura Lucia Margot Maria Marta Nadine Olivia Paula Sophie Valeria",
    ("latin", "m"): "Adrian Albert Antonio Bernard Carlos Daniel Edward Felix Fernando George Gustav Henri Hugo Jacob James "
    "Javier Jonas Julien Karl Leon Louis Lukas Marcel Martin Oliver Pablo Robert Stefan Thomas Victor",
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Ксения Мария Наталья Ольга Светлана Татьяна Юлия",
    ("cyrillic", "m"): "Алексей Борис Виктор Григорий Дмитрий Иван Максим Николай Олег Павел Сергей Юрий",
    ("greek", "f"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία",
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σπύρος",
}
SURNAMES = {
    "latin": "Abbott Almeida Baker Bauer Becker Bennett Blanchard Castillo Chevalier Collins Delgado Dubois Eriksen Fischer "
    "Fontaine Foster Garnier Gomez Hartmann Herrera Jensen Keller Lambert Larsen Marchand Mendoza Novak Ortega Parker "
    "Perrin Quinn Ramos Richter Rousseau Sandoval Schuster Turner Vargas Wagner Winkler",
    "cyrillic": "Белов Волков Громов Зайцев Ковалёв Лебедев Морозов Новиков Орлов Соколов Тихонов Фёдоров",
    "greek": "Αλεξίου Βλάχος Γεωργίου Δημητρίου Ιωάννου Νικολάου Παππάς Στεφάνου",
}

_GIVEN_GENDER = {name: gender for (_, gender), names in GIVEN.items() for name in names.split()}
_LISTED = {name.casefold(): gender for name, gender in _GIVEN_GENDER.items()}
_TITLE_GENDER = {title: gender for gender, titles in TITLES.items() for title in titles.split()}

_NAME = r"\p{Lu}[\p{L}\p{M}'’-]+"
EMAIL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*)(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
CARD = r"(?<![\dA-Za-z])\d(?:[ -]?\d){12,18}(?![\dA-Za-z])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IBAN = r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|(?:sk|ghp|xox[bp])[-_][A-Za-z0-9_-]{16,})(?![A-Za-z0-9])"

#: What a secret begins with that need not hold a group of digits.
SECRET_PREFIXES = ("AKIA", *(f"{p}{mark}" for p in ("sk", "ghp", "xoxb", "xoxp") for mark in "-_"))

#: Draws of a name from the lists before made-up syllables are appended.
LISTED_DRAWS = 6
#: Draws of an address, phone number or mailbox in its own shape before the space is widened, and before each further step.
SHAPED_DRAWS = 4
#: Draws after which a space counts as exhausted.
MAX_DRAWS = 60


_POSSESSIVE = regex.compile(r"(?:['’][sS])?['’-]*$")


class Detector:
    """Finds entities in a text: (start, end, type, normal form), left to right, none overlapping.

    Names are found by a title or as a listed given name before a surname; the
    other mentions of such a name in the same text, given name or surname alone
    and in any case that begins with a capital, are found by these.
    """

    def __init__(self) -> None:
        self.numeric = [(kind, regex.compile(rule)) for kind, rule in (
            ("iban", IBAN), ("secret", SECRET), ("ip", IPV4), ("phone", PHONE), ("ssn", SSN), ("card", CARD)
        )]
        self.email = regex.compile(EMAIL)
        # Every rule under a guard must imply it: card, phone, address and account numbers hold three digits nearly
        # side by side (or an account number's head), secrets 32 hexadecimal digits or one of the prefixes.
        self.digit = regex.compile(r"\d(?:(?:[^\n]{0,2}\d){2}|\d ?[A-Z0-9]{4})|[0-9A-Fa-f]{32}")
        titles = "|".join(sorted(map(regex.escape, _TITLE_GENDER), key=len, reverse=True))
        neutral = "|".join(sorted(TITLES["n"].split(), key=len, reverse=True))
        # A title may be followed by academic ones, which are no names.
        self.titled = regex.compile(
            rf"(?<!\w)({titles})(?:\.?[ \t]+(?:{neutral})(?!\w))*+\.?[ \t]+({_NAME})(?:[ \t]+({_NAME}))?"
        )
        self.title = regex.compile(rf"(?<!\w)(?:{titles})(?!\w)")
        self.pair = regex.compile(rf"(?<!\w)({'|'.join(_GIVEN_GENDER)})[ \t]+({_NAME})")
        self.given = regex.compile(rf"(?<!\w)(?:{'|'.join(_GIVEN_GENDER)})[ \t]")
        self.capital = regex.compile(r"(?<!\w)\p{Lu}[\p{L}\p{M}'’-]++(?!\w)")
        self.piece = regex.compile(r"[\p{L}\p{M}]+")

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        return [entity[:4] for entity in self.read(text)]

    def read(self, text: str) -> list[tuple[int, int, str, str, str | None]]:
        """As ``find``, with the surname of the person where a title alone could tell the gender of a given name."""
        found: list[tuple[int, int, str, str, str | None]] = []
        if "@" in text:
            found += [(m.start(), m.end(), "email", m[0].lower(), None) for m in self.email.finditer(text)]
        if any(p in text for p in SECRET_PREFIXES) or self.digit.search(text):
            for kind, rule in self.numeric:
                found += [(m.start(), m.end(), kind, normal(kind, m[0]), None) for m in rule.finditer(text)]
        names = self.names(text)
        if names:
            found += names + self.bare(text, names)
        if len(found) < 2:
            return found
        # The earlier entity wins, then the longer one, then the kind that is listed first.
        found.sort(key=lambda e: (e[0], -e[1]))
        kept, end = [], 0
        for entity in found:
            if entity[0] >= end:
                kept.append(entity)
                end = entity[1]
        return kept

    def names(self, text: str) -> list[tuple[int, int, str, str, str | None]]:
        """The names of titles and lists, the gender of each person settled within the text."""
        found: list[tuple[int, int, str, str, str | None]] = []

        def add(m: regex.Match, group: int, kind: str, surname: str | None = None) -> None:
            start, end = m.start(group), m.end(group) - len(_POSSESSIVE.search(m[group])[0])
            if end > start:
                found.append((start, end, kind, text[start:end].casefold(), surname))

        if any(t in text for t in _TITLE_GENDER) and self.title.search(text):
            for m in self.titled.finditer(text):
                given = _bare_name(m[2])
                if m[3]:
                    kind = f"given_{_LISTED.get(given, _TITLE_GENDER[m[1]])}"
                    add(m, 2, kind, None if given in _LISTED else _bare_name(m[3]))
                    add(m, 3, "surname")
                elif given in _LISTED:
                    add(m, 2, f"given_{_LISTED[given]}")
                else:
                    add(m, 2, "surname")
        if self.given.search(text):
            for m in self.pair.finditer(text):
                add(m, 1, f"given_{_GIVEN_GENDER[m[1]]}")
                add(m, 2, "surname")
        told: dict[tuple[str, str], set[str]] = {}
        for _, _, kind, value, surname in found:
            if surname and kind in ("given_f", "given_m"):
                told.setdefault((value, surname), set()).add(kind)
        if told:
            for at, (start, end, kind, value, surname) in enumerate(found):
                if kind == "given_n" and len(kinds := told.get((value, surname), ())) == 1:
                    found[at] = (start, end, *kinds, value, surname)
        return found

    def bare(
        self, text: str, names: list[tuple[int, int, str, str, str | None]]
    ) -> list[tuple[int, int, str, str, str | None]]:
        """The other mentions of ``names``; one of several persons is whoever was named last before it, else first."""
        known: dict[str, list[tuple[int, int, str, str, str | None]]] = {}
        for name in sorted(names, key=lambda e: e[0]):
            known.setdefault(name[3], []).append(name)
        spans = {name[:2] for name in names}
        found = []

        def look(start: int, end: int) -> bool:
            holders = known.get(text[start:end].casefold())
            if holders and (start, end) not in spans:
                holder = holders[max(0, bisect_right(holders, start, key=lambda e: e[0]) - 1)]
                found.append((start, end, *holder[2:]))
            return bool(holders)

        for m in self.capital.finditer(text):
            if not look(m.start(), m.end() - len(_POSSESSIVE.search(m[0])[0])):
                # A part of a hyphenated or elided word may be the name.
                pieces = [p.span() for p in self.piece.finditer(text, m.start(), m.end())]
                if len(pieces) > 1:
                    for start, end in pieces:
                        look(start, end)
        return found


def _bare_name(written: str) -> str:
    """A name's normal form, without the ending of the possessive."""
    return _POSSESSIVE.sub("", written, count=1).casefold()


def normal(kind: str, value: str) -> str:
    """The form that all spellings of an entity share."""
    if kind == "email":
        return value.lower()
    if kind in ("phone", "card", "ssn"):
        return "".join(c for c in value if c.isdigit())
    if kind == "iban":
        return value.replace(" ", "")
    if kind.startswith("given") or kind == "surname":
        return value.casefold()
    return value


class Draws:
    """A keyed stream of numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int) -> None:
        self.seed = hashlib.blake2b(f"{kind}\0{value}\0{attempt}".encode("utf-8", "surrogatepass"), key=key).digest()
        self.at, self.block = 0, b""

    def below(self, n: int) -> int:
        """A number from 0 to n - 1."""
        if len(self.block) < 8:
            self.block += hashlib.blake2b(self.seed + self.at.to_bytes(8, "big")).digest()
            self.at += 1
        number, self.block = int.from_bytes(self.block[:8], "big"), self.block[8:]
        return number % n

    def among(self, items: str | list[str]) -> str:
        return items[self.below(len(items))]


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def script_of(word: str) -> str:
    first = word[:1]
    if "Ѐ" <= first <= "ԯ":
        return "cyrillic"
    if "Ͱ" <= first <= "Ͽ" or "ἀ" <= first <= "῿":
        return "greek"
    return "latin"


SYLLABLES = {
    "latin": [c + v for c in "bdfgklmnprstv" for v in "aeiou"],
    "cyrillic": [c + v for c in "бвгдклмнпрст" for v in "аеио"],
    "greek": [c + v for c in "βγδκλμνπρστ" for v in "αειο"],
}


def _name(draw: Draws, kind: str, value: str, attempt: int) -> str:
    script = script_of(value)
    if kind == "surname":
        names = SURNAMES[script].split()
    else:
        gender = kind[-1]
        names = [n for g in ("f", "m") if gender in (g, "n") for n in GIVEN[script, g].split()]
    name = draw.among(names)
    if attempt >= LISTED_DRAWS:  # the lists are short: made-up names have no end
        # A woman's name goes on ending as it did; the syllables stand before.
        made = "".join(draw.among(SYLLABLES[script]) for _ in range(2 + attempt // LISTED_DRAWS))
        name = made.capitalize() + name.lower()
    return name.casefold()


def _octet(draw: Draws, old: str) -> str:
    if len(old) == 3:
        return str(100 + draw.below(155))
    return str(10 + draw.below(90)) if len(old) == 2 else str(draw.below(10))


#: First octets of widened public addresses: none of a private range.
_PUBLIC = [str(n) for n in range(1, 224) if n not in (10, 127, 169, 172, 192)]


def _address(draw: Draws, value: str, attempt: int) -> str:
    """Digit counts are kept at first, then the range only; of 192.168, in the end, that it is private."""
    octets = value.split(".")
    kept = 2 if value.startswith("192.168.") else 1 if octets[0] in ("10", "127") else 0
    if attempt < SHAPED_DRAWS:
        return ".".join(octets[:kept] + [_octet(draw, x) for x in octets[kept:]])
    head = octets[:kept] or [draw.among(_PUBLIC)]
    if kept == 2 and attempt >= 2 * SHAPED_DRAWS:
        head = ["10"]
    return ".".join(head + [str(draw.below(256)) for _ in range(4 - len(head))])


def _like(draw: Draws, value: str) -> str:
    """Digits for digits, letters for letters of the same case; hexadecimal stays hexadecimal."""
    hexadecimal = all(c in "0123456789abcdefABCDEF" for c in value)
    lower, upper = ("abcdef", "ABCDEF") if hexadecimal else ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    out = []
    for c in value:
        if c.isdigit():
            out.append(draw.among("0123456789"))
        elif "a" <= c <= "z":
            out.append(draw.among(lower))
        elif "A" <= c <= "Z":
            out.append(draw.among(upper))
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The normal form that stands for an entity's normal form."""
    draw = Draws(key, kind, value, attempt)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        # Mailboxes of one domain stay together: the domain is drawn from itself alone.
        other = Draws(key, "domain", domain, 0)
        labels[:-1] = [_like(other, x) for x in labels[:-1]]
        more = "".join(draw.among("abcdefghijklmnopqrstuvwxyz") for _ in range(attempt // SHAPED_DRAWS))
        return _like(draw, local) + more + "@" + ".".join(labels)
    if kind == "ip":
        return _address(draw, value, attempt)
    if kind == "card":
        digits = value[0] + "".join(draw.among("0123456789") for _ in value[1:])
        if luhn(value):
            digits = next(d for d in (digits[:-1] + c for c in "0123456789") if luhn(d))
        return digits
    if kind == "phone":
        # The leading digits say the country and keep the number's length plausible.
        kept = 1 if len(value) > 10 else 0
        drawn = len(value) - kept + attempt // SHAPED_DRAWS
        return value[:kept] + "".join(draw.among("23456789" if i == 0 else "0123456789") for i in range(drawn))
    if kind == "iban":
        return value[:2] + _like(draw, value[2:])
    if kind == "secret" and value.startswith(("AKIA", "sk", "ghp", "xox")):
        head = 4 if value.startswith(("AKIA", "ghp", "xox")) else 3
        return value[:head] + _like(draw, value[head:])
    if kind.startswith("given") or kind == "surname":
        return _name(draw, kind, value, attempt)
    return _like(draw, value)


def shaped(kind: str, written: str, new: str) -> str:
    """A surrogate's normal form written as the entity was: separators, groups and case."""
    if kind in ("phone", "card", "ssn", "iban"):
        left = iter(new)
        return "".join([next(left) if c.isalnum() else c for c in written] + list(left))  # a widened one is longer
    if kind.startswith("given") or kind == "surname":
        if written.isupper() and len(written) > 1:
            return new.upper()
        return "-".join(p[:1].upper() + p[1:] for p in new.split("-"))
    if kind == "email":
        if written.isupper():
            return new.upper()
        return "".join(n.upper() if w.isupper() else n for w, n in zip(written, new)) if len(written) == len(new) else new
    return new


def _entities(text: Column) -> Column:
    kind = pa.list_(pa.struct([("type", pa.string()), ("value", pa.string()), ("surname", pa.string())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        detector = Detector()
        for texts in parts(batches):
            rows = []
            for text in as_text(texts):
                found = dict.fromkeys(entity[2:] for entity in detector.read(text))
                rows.append([{"type": t, "value": v, "surname": s} for t, v, s in found])
            yield pa.array(rows, kind)

    return F.arrow_udf(run, "array<struct<type:string,value:string,surname:string>>")(text)


def _drawn(key: bytes):
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for kinds, values, attempts in batches:
            rows = zip(kinds.to_pylist(), values.to_pylist(), attempts.to_pylist())
            yield pa.array([surrogate(key, k, v, a) for k, v, a in rows], pa.string())

    return F.arrow_udf(run, "string")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(type, value, attempt, surrogate) for distinct (type, value): all surrogates differ, and none is a value.

    Round by round, entities whose surrogate another one holds, or that is
    itself an entity, draw again. Of those that want the same surrogate the one
    of the fewest attempts keeps it, then the smallest value, so that a
    surrogate once alone is kept. Kinds of given names share one space.

    The spaces of addresses, phone numbers, mailboxes and names grow with the
    attempt. One that is exhausted all the same (half of all numbers of its
    kind are entities) raises.
    """
    draw = _drawn(key)
    space = F.when(F.col("type").startswith("given"), F.lit("given")).otherwise(F.col("type"))
    columns = ["type", "value", "attempt"]
    drawn = stage(
        entities.select("type", "value", F.lit(0).alias("attempt")).withColumn("surrogate", draw(*map(F.col, columns))),
        "surrogates",
    )
    while True:
        spaced = drawn.withColumn("space", space)
        owner = spaced.groupBy("space", "surrogate").agg(
            F.min(F.struct("attempt", "value", "type")).alias("owner"), F.count("*").alias("claims")
        )
        taken = owner.where("claims > 1").select("space", "surrogate", "owner")
        real = spaced.select("space", F.col("value").alias("surrogate")).distinct()
        losers = spaced.join(taken, ["space", "surrogate"]).where(
            (F.col("value") != F.col("owner.value")) | (F.col("type") != F.col("owner.type"))
        )
        clash = losers.select(*columns).union(spaced.join(real, ["space", "surrogate"], "left_semi").select(*columns))
        clash = stage(clash.distinct(), "surrogate-clashes")
        left = clash.groupBy("type").agg(F.max("attempt").alias("attempt"), F.count("*").alias("n")).collect()
        if not left:
            return drawn
        if spent := {r["type"]: r["n"] for r in left if r["attempt"] + 1 >= MAX_DRAWS}:
            raise ValueError(f"no distinct surrogates left after {MAX_DRAWS} draws for so many entities: {spent}")
        again = clash.withColumn("attempt", F.col("attempt") + 1).withColumn("surrogate", draw(*map(F.col, columns)))
        rest = drawn.join(clash.select("type", "value"), ["type", "value"], "left_anti")
        drawn = stage(rest.select(*drawn.columns).union(again.select(*drawn.columns)), "surrogates")


def settle(held: DataFrame) -> DataFrame:
    """``held`` with ``settled``: the type of a given name, after Dr or Prof that of the same person elsewhere.

    If titles of one gender go with given name and surname anywhere in the
    table, that is the person's. If those of both do, there are at least two
    persons, and whoever has a neutral title remains a third.
    """
    persons = held.where("surname is not null").groupBy("value", "surname").agg(
        F.max(F.when(F.col("type") != "given_n", F.col("type"))).alias("told"),
        F.min(F.when(F.col("type") != "given_n", F.col("type"))).alias("other"),
        F.max(F.col("type") == "given_n").alias("open"),
    )
    persons = persons.where("open and told = other").select("value", "surname", "told")
    persons = stage(persons, "surrogate-persons")
    open_ = (F.col("type") == "given_n") & F.col("surname").isNotNull()
    told = held.where(open_).join(persons, ["value", "surname"], "left")
    told = told.withColumn("settled", F.coalesce("told", "type")).drop("told")
    return held.where(~open_).withColumn("settled", F.col("type")).unionByName(told)


def _replaced(key: bytes):
    kind = pa.struct([("text", pa.string()), ("n_entities", pa.int64()), ("types", pa.list_(pa.string()))])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        detector = Detector()
        for texts, again in parts(batches):
            out, counts, types = [], [], []
            for text, redrawn in zip(as_text(texts), again.to_pylist()):
                # (type, value, surname) as found here to what the whole table says of it
                settled = {(r["type"], r["value"], r["surname"]): (r["settled"], r["attempt"]) for r in redrawn or ()}
                found = [
                    (start, end, *settled.get((kind_of, value, surname), (kind_of, 0)), value)
                    for start, end, kind_of, value, surname in detector.read(text)
                ]
                pieces, low = [], 0
                for start, end, kind_of, attempt, value in found:
                    new = surrogate(key, kind_of, value, attempt)
                    pieces += [text[low:start], shaped(kind_of, text[start:end], new)]
                    low = end
                out.append("".join(pieces) + text[low:])
                counts.append(len(found))
                types.append([e[2] for e in found])
            yield pa.StructArray.from_arrays(
                [pa.array(out, pa.string()), pa.array(counts, pa.int64()), pa.array(types, pa.list_(pa.string()))],
                fields=list(kind),
            )

    return F.arrow_udf(run, "struct<text:string,n_entities:bigint,types:array<string>>")


def with_surrogates(docs: DataFrame, key: bytes, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, n_entities, types), a row per row of ``docs``: the text with its entities replaced.

    ``types`` lists the kinds of the replaced entities in text order. Emails,
    IPv4 addresses, phone, card, social security and account numbers, secrets
    and personal names are replaced by others of the same shape: separators,
    digit counts, case, check digits where they held, private address ranges,
    script and gender of names. Of names only those are found that stand with a
    title or as a listed given name before a surname, and their other mentions
    in the same text (see ``Detector``). The same entity has the same surrogate in all
    documents, different ones have different surrogates, and no surrogate is an
    entity of the table. A given name of both genders is two entities; after Dr
    or Prof it has the gender that the text, else the table, tells of the same
    given name and surname, and is an entity of its own if these tell none or
    both. Mailboxes of one domain keep sharing one. Where the
    table holds so many alike that the shape has no room, addresses give up
    their digit counts (192.168 then its range for 10) and phone numbers and
    mailboxes grow longer; a table that exhausts even that raises.

    Null and empty texts come back as empty text. Rows that repeat are replaced
    alike. A null id is kept. An empty table gives no rows.
    """
    # The digest keeps rows without an id, or with the same one, apart; where it doesn't, they only share a lookup.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("digest", F.xxhash64("text"))
    held = stage(
        rows.select("doc_id", "digest", F.explode(_entities(F.col("text"))).alias("e"))
        .select("doc_id", "digest", "e.*")
        .distinct(),
        "entities",
    )
    held = stage(settle(held), "entities-settled")
    drawn = assign(held.select(F.col("settled").alias("type"), "value").distinct(), key)
    redrawn = stage(
        drawn.where("attempt > 0").select(F.col("type").alias("settled"), "value", "attempt"), "surrogates-again"
    )
    per_doc = (
        held.join(redrawn, ["settled", "value"], "left")
        .where("attempt is not null or settled <> type")
        .groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
        .agg(F.collect_set(F.struct("type", "value", "surname", "settled", F.coalesce("attempt", F.lit(0)).alias("attempt"))).alias("again"))
    )
    per_doc = stage(per_doc, "surrogates-by-document")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    joined = rows.join(per_doc, same, "left")
    done = joined.select("doc_id", _replaced(key)(F.col("text"), F.col("again")).alias("new"))
    return done.select("doc_id", "new.*")

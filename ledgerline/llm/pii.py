"""Surrogates for personal data: detected entities are replaced by keyed ones of the same kind and shape.

An entity's surrogate is drawn from a keyed hash of its kind and normal form, so every mention of it
in any document gets the same one (coreference), written in the mention's own punctuation and case.
Numbers keep their lengths and check digits, addresses their parts, names their gender and script.
A table of all distinct entities checks the draws: two entities of a kind never share a surrogate, and
no surrogate is an entity of the corpus; losers draw again until none is left.

Surnames and given names are entities of their own, so "Mr Smith" and "John Smith" stay one family.
Given names become stand-ins by a keyed order, made-up names where those run out. Initials become
other letters, and as the one exception those may be letters of the corpus. Null texts stay null. Rows
without entities are passed on as they are; repeated rows get the same text. All columns are kept.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.tables import read, stored

KEY = b"ledgerline"
#: Draws that keep an entity's length. Each later one makes the surrogate longer, so that there are
#: ten times as many and all entities find one of their own.
SHAPED_DRAWS = 8
#: From this draw on, by when as many entities as there are IPv4 addresses would have met theirs.
LONG_IP_DRAWS = 40

# Given names by script and gender, and titles by gender.
GIVEN = {
    ("latin", "f"): "Alice Anna Beatrice Camille Carmen Clara Elena Emma Gisela Hannah Ingrid Isabel Julia Laura Lucy Maria Martha Nadine Olivia Paula Rosa Sarah Sofia Sophie Ursula".split(),
    ("latin", "m"): "Albert Andrew Anton Carlos David Dieter Eduardo Emil Frank George Henri Hugo James Javier John Klaus Louis Marco Martin Michael Oscar Paul Peter Robert Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Галина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Александр Борис Виктор Дмитрий Иван Михаил Николай Олег Пётр Сергей".split(),
    ("greek", "f"): "Αγγελική Δήμητρα Ελένη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Ιωάννης Κώστας Νίκος".split(),
}
#: Names that stand for those above, at least as many, and none of them; found in texts like those.
STAND_INS = {
    ("latin", "f"): "Adele Agnes Bianca Brigitte Carla Cecilia Charlotte Cornelia Daniela Diana Edith Eleonora Eva Francesca Frieda Greta Helena Irene Johanna Josefina Katharina Lena Lidia Magdalena Margaret Monica Natalia Patricia Silvia Teresa Valeria Veronica".split(),
    ("latin", "m"): "Adrian Alfred Arthur Benjamin Bernard Bruno Charles Daniel Dominik Edward Felix Fernando Francis Frederik Gabriel Gregory Harold Ignacio Jakob Joseph Julian Konrad Leonard Lorenzo Lukas Manuel Nicolas Philip Rafael Richard Roberto Simon Stefan Tobias Walter William".split(),
    ("cyrillic", "f"): "Алла Валентина Дарья Екатерина Зоя Кира Лариса Людмила Маргарита Нина Полина Раиса Тамара Юлия".split(),
    ("cyrillic", "m"): "Алексей Андрей Антон Василий Владимир Геннадий Денис Евгений Игорь Кирилл Леонид Максим Павел Степан Юрий".split(),
    ("greek", "f"): "Αθηνά Άννα Βασιλική Ευαγγελία Θεοδώρα Ιωάννα Κωνσταντίνα Φωτεινή Χριστίνα".split(),
    ("greek", "m"): "Αντώνης Βασίλης Γεράσιμος Ηλίας Θανάσης Μιχάλης Παναγιώτης Σπύρος Στέλιος".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Doña Sra Госпожа Κυρία".split(),
    "m": "Mr Sir Herr Monsieur Señor Don Господин Κύριος".split(),
    "": "Dr Prof".split(),
}
SYLLABLES = {
    "latin": "bal ber dan del far gor han kel lin mar nor pel ras sol tan ver wil zan".split(),
    "cyrillic": "бал вер гор дан кол лав мир нов пет рос сол тан".split(),
    "greek": "βαλ γορ δαν καλ λεν μαρ νικ παλ ροσ σολ ταν".split(),
}
ENDINGS = {"latin": "son er ini ez".split(), "cyrillic": "ов ин ский".split(), "greek": "ος ης ίδης".split()}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
GIVEN_ENDINGS = {"latin": {"f": "a", "m": "o"}, "cyrillic": {"f": "а", "m": "ий"}, "greek": {"f": "α", "m": "ος"}}

_GENDER = {name: g for lists in (GIVEN, STAND_INS) for (_, g), names in lists.items() for name in names}
_TITLE = {title: g for g, titles in TITLES.items() for title in titles}
#: What a text must hold before it is looked at closely: something of every entity that ``detect`` finds.
#: Without word borders, which Arrow knows of ASCII letters only, and with the letters that Python takes for an i.
_MAYBE = (
    r"[\p{Nd}@]|(?i:token|secret|passw|ap[iıİ][_-]?key|access[_-]?key|ak[iıİ]a|gh[pousr]_)"
    rf"|(?:{'|'.join([*_TITLE, *_GENDER])})[. ]"
)

_NAME = r"[^\W\d_][\w'’-]+"
_PARTICLES = set("al bin da de del della den der di do dos du e el ibn la le ten ter van von y zu zum zur".split())
_TITLED = re.compile(rf"(?:(?:{'|'.join(_TITLE)})\.? )+")
_TITLE_WORD = re.compile(rf"(?:{'|'.join(_TITLE)})(?=\.? )")
_WORD = re.compile(_NAME)
_INITIAL = re.compile(r"([^\W\d_])(?:\.[ -]?| )(?=\w)")
_PERSON_START = re.compile(rf"(?:{'|'.join([*_TITLE, *_GENDER])})(?=[. ])")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}")
_SECRET = re.compile(
    r"\b(?P<aws>AKIA[0-9A-Z]{16})\b|\b(?P<host>gh[pousr]_[A-Za-z0-9]{36})\b"
    r"|\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\"?\s*[=:]\s*[\"']?(?P<value>[A-Za-z0-9+/_-]{12,})",
    re.IGNORECASE,
)
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")
#: Digits that stand close together, 7 and more: one number or several side by side.
_RUN = re.compile(r"(?<![\w.+-])[+(]?\d(?:(?:[ .,/-]|[ .,/-]?\(|\)[ .,/-]?|\)[ .,/-]?\(|[ ,/]?\+)?\d){6,}\)?(?!\w)")
_UNIT = re.compile(r"\+?\d+|\(\d{1,4}\)")
_SOLID = re.compile(r"\d{1,3}(?:(?:\.\d{3})+(?:,\d+)?|(?:,\d{3})+(?:\.\d+)?)|\d{1,12}\.\d+|\d+\.\d{1,12}|\d{1,3},\d+")  # decimals, marks for thousands
_DATE = re.compile(
    r"(?:19|20)\d\d([./-])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([./-])(?:0?[1-9]|[12]\d|3[01])\2(?:19|20)\d\d"
)
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
_CARD = re.compile(r"\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?")
_DIALLED = re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d)*")
_NATIONAL = re.compile(r"0?\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}")
#: National forms after a leading 0 in two, four and five parts.
_TRUNK = re.compile(r"0\d{2,4}[ ./-]\d{5,8}|0\d{2,3}[ ./-]\d{3}([ .-])\d\d\1\d\d|0\d([ .-])\d\d(?:\2\d\d){3}")
_USUAL = re.compile(r"(?:\+1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}|\+1[ .-]?\d{10}")
_THOUSANDS = re.compile(r"\d{1,3}(?:\.\d{3})+")


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _iban_end(text: str, start: int, end: int) -> int:
    """Where an account number ends: where its check digits fit, or else before a number next to it."""
    ends = [e for e in range(start + 15, end + 1) if e == end or not text[e].isalnum()]
    for e in reversed(ends):
        part = text[start:e].replace(" ", "")
        if 15 <= len(part) <= 34 and part.isascii() and part.isalnum() and int("".join(str(int(c, 36)) for c in part[4:] + part[:4])) % 97 == 1:
            return e
    blank = text.find(" ", start, end)
    return blank if blank - start >= 15 else end


def _script(word: str) -> str:
    first = word[:1].lower()
    return "cyrillic" if "а" <= first <= "я" or first == "ё" else "greek" if "α" <= first <= "ώ" or first == "ά" else "latin"


def _number_kind(text: str) -> tuple[str, int] | None:
    """The kind of a number, and how sure its form makes it: 4 to 1 a digit."""
    digits = re.sub(r"\D", "", text)
    n = len(digits)
    if n < 7 or n > 19:
        return None
    if _SSN.fullmatch(text):
        return "ssn", 4
    if n >= 13 and _CARD.fullmatch(text):
        if _luhn(digits):
            return "card", 4
        if n in (15, 16):
            return "card", 2
    if n > 15 or _THOUSANDS.fullmatch(text):
        return None
    if text[0] in "+(":
        if n < (8 if text[0] == "+" else 9) or not _DIALLED.fullmatch(text):
            return None
        if _USUAL.fullmatch(text):
            return "phone", 4
        return "phone", 1 if text.startswith("+1") and n > 11 else 2
    if _TRUNK.fullmatch(text):
        return "phone", 2
    if _NATIONAL.fullmatch(text):
        return "phone", 2 if _USUAL.fullmatch(text) else 1
    return None


def _numbers(text: str, start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """Start, end and kind of the numbers in a run of digits, outside the spans already taken.

    Numbers end at blanks and commas where they can; what is left over is tried again with ends at any mark.
    Of all ways to cut the run, the one with the most and surest digits counts.
    """
    units = [m.span() for m in _UNIT.finditer(text, start, end)]
    n = len(units)
    size = [sum(map(str.isdigit, text[s:e])) for s, e in units]
    blank = [k == 0 or text[units[k][0]] == "+" or not set(text[units[k - 1][1] : units[k][0]]).isdisjoint(" ()") for k in range(n)] + [True]
    free, shut = [True] * (n + 1), [any(s < y and x < e for x, y in taken) for s, e in units]
    first = 0
    for k in range(1, n + 1):
        if blank[k]:  # a stretch between blanks
            stretch = text[units[first][0] : units[k - 1][1]]
            if _SOLID.fullmatch(stretch):
                free[first + 1 : k] = [False] * (k - first - 1)
            else:
                if _DATE.fullmatch(stretch):
                    shut[first:k] = [True] * (k - first)
                for i in range(first + 1, k):
                    blank[i] = "," in text[units[i - 1][1] : units[i][0]]
            first = k

    def best(low: int, high: int, ends: list[bool]) -> list[tuple[int, int, str]]:
        score, step = [(0, 0)] * (high + 1), [None] * (high + 1)
        for i in range(high - 1, low - 1, -1):
            score[i] = score[i + 1]
            if shut[i] or i > low and not ends[i]:
                continue
            digits = 0
            for j in range(i + 1, high + 1):
                digits += size[j - 1]
                if shut[j - 1] or digits > 19:
                    break
                if digits < 7 or j < high and not ends[j]:
                    continue
                if kind := _number_kind(text[units[i][0] : units[j - 1][1]]):
                    found = score[j][0] + digits * kind[1], score[j][1] - 1
                    if found > score[i] or found == score[i] and step[i] is None:
                        score[i], step[i] = found, (j, kind[0])
        cuts, i = [], low
        while i < high:
            if step[i]:
                cuts.append((i, step[i][0], step[i][1]))
                i = step[i][0]
            else:
                i += 1
        return cuts

    last, cuts = 0, []
    for i, j, kind in [*best(0, n, blank), (n, n, "")]:
        if i > last:
            cuts += best(last, i, free)
        if kind:
            cuts.append((i, j, kind))
        last = j
    for i, j, kind in cuts:
        yield units[i][0], units[j - 1][1], kind


def _is_word(letter: str) -> bool:
    return letter.isalnum() or letter == "_"


def _person(text: str, at: int) -> tuple[int, list[tuple[int, int, str, str]]]:
    """End and entities of the person that a title or given name begins; none if no name follows.

    A person goes on over capitalised words and initials, and over particles between them. The
    last word is the surname; known given names before it are given names, other words count as
    surnames too, so that a word is the same entity wherever it stands.
    """
    titled = _TITLED.match(text, at)
    start = at = titled.end() if titled else at
    words: list[tuple[int, int]] = []
    initials: list[tuple[int, int]] = []
    end, n_initials = start, 0
    while not _TITLE_WORD.match(text, at) or not words:
        if m := _WORD.match(text, at):
            if m.group()[0].isupper():
                words.append(m.span())
                end, n_initials = m.end(), len(initials)
            elif m.group() not in _PARTICLES:
                break
            if text[m.end() : m.end() + 1] != " ":
                break
            at = m.end() + 1
        elif (m := _INITIAL.match(text, at)) and m[1].isupper():
            initials.append(m.span(1))
            at = m.end()
        elif text[at : at + 2] in ("e ", "y ") and words:
            at += 2
        else:
            break
    if len(words) < (1 if titled else 2):
        return start, []
    found = [(s, e, "initial", f"{_script(text[s:e])}:{text[s:e].lower()}") for s, e in initials[:n_initials]]
    for s, e in words:
        name = text[s:e]
        if name in _GENDER and e < end:
            found.append((s, e, "given", f"{_script(name)}:{_GENDER[name]}:{name.lower()}"))
        else:
            found.append((s, e, "surname", f"{_script(name)}:{name.lower()}"))
    return end, found


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and normal form of the entities of a text, none overlapping, in order."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        at = text.find("@")
        while at >= 0:
            # Only the surroundings of the sign are searched, so long texts cost no backtracking.
            start = max(0, at - 64)
            for m in _EMAIL.finditer(text, start, at + 256):
                if m.start() < at < m.end():
                    found.append((*m.span(), "email", m.group().lower()))
            at = text.find("@", at + 1)
    for m in _SECRET.finditer(text):
        name = m.lastgroup
        found.append((*m.span(name), "secret", m.group(name)))
    at = 0
    while m := _IBAN.search(text, at):
        at = _iban_end(text, *m.span())
        found.append((m.start(), at, "iban", text[m.start() : at].replace(" ", "")))
    for m in _IP.finditer(text):
        found.append((*m.span(), "ip", m.group()))
    taken = sorted(x[:2] for x in found)
    for m in _RUN.finditer(text):
        near = [x for x in taken if x[0] < m.end() and m.start() < x[1]]
        for s, e, kind in _numbers(text, *m.span(), near):
            found.append((s, e, kind, re.sub(r"\D", "", text[s:e])))
    end = 0
    for start in _PERSON_START.finditer(text):
        at = start.start()
        if at >= end and not (at and _is_word(text[at - 1])):
            end, parts = _person(text, at)
            found += parts
    kept, last = [], 0
    for x in sorted(set(found), key=lambda x: (x[0], -x[1])):
        if x[0] >= last:
            kept.append(x)
            last = x[1]
    return kept


class _Draws:
    """A stream of keyed choices for one entity and draw."""

    def __init__(self, key: bytes, kind: str, normal: str, draw: int):
        self.seed, self.held, self.n = (key, f"{kind}\0{normal}\0{draw}".encode()), b"", 0

    def below(self, n: int) -> int:
        if len(self.held) < 4:
            self.held += hmac.new(self.seed[0], self.seed[1] + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        value, self.held = int.from_bytes(self.held[:4], "big"), self.held[4:]
        return value % n

    def letter(self, like: str) -> str:
        if like.isdigit():
            return str(self.below(10))
        if "a" <= like.lower() <= "z":
            drawn = chr(ord("a") + self.below(26))
            return drawn.upper() if like.isupper() else drawn
        return like

    def letters(self, like: str) -> str:
        return "".join(map(self.letter, like))


@lru_cache
def _stand_ins(key: bytes, script: str, gender: str) -> tuple[list[str], list[str]]:
    """All known given names, and those that stand for them, both in a keyed order."""

    def ordered(names: list[str]) -> list[str]:
        return sorted((x.lower() for x in names), key=lambda x: hmac.new(key, f"given\0{x}".encode(), hashlib.sha256).digest())

    stand_ins = ordered(STAND_INS[script, gender])
    return ordered(GIVEN[script, gender]) + stand_ins, stand_ins


def surrogate(key: bytes, kind: str, normal: str, draw: int) -> str:
    """The ``draw``-th surrogate of an entity, in normal form."""
    draws = _Draws(key, kind, normal, draw)
    longer = max(0, draw - SHAPED_DRAWS + 1)
    if kind == "email":
        local, _, domain = normal.partition("@")
        local += "x" * longer
        labels = domain.split(".")
        top = labels[-2:] if labels[-2] == "example" else ["example", "com"]
        return f"{draws.letters(local)}@{'.'.join([*map(draws.letters, labels[:-2]), *top])}"
    if kind == "ip" and draw >= LONG_IP_DRAWS:
        return "2001:db8::" + ":".join(f"{draws.below(1 << 16):x}" for _ in range(4))
    if kind == "ip":
        least = {1: (1, 9), 2: (10, 90), 3: (100, 124)}
        parts = [least[len(p)] if draw < SHAPED_DRAWS else (1, 223) for p in normal.split(".")]
        return ".".join(str(a + draws.below(n)) for a, n in parts)
    if kind == "card":
        body = normal[0] + draws.letters(normal[1:-1] + "0" * longer)
        checked = next(d for d in "0123456789" if _luhn(body + d))
        return body + (checked if _luhn(normal) else str((int(checked) + 1 + draws.below(9)) % 10))
    if kind == "ssn":
        return "9" + draws.letters(normal[1:] + "0" * longer)
    if kind == "phone":
        head = len(normal) - min(len(normal), 10)
        rest = draws.letters(normal[head:] + "0" * longer)
        return normal[:head] + (str(2 + draws.below(8)) + rest[1:] if normal[head] != "0" else "0" + rest[1:])
    if kind == "iban":
        rest = draws.letters(normal[4:] + "0" * longer)
        value = int("".join(str(int(c, 36)) for c in rest + normal[:2] + "00"))
        return f"{normal[:2]}{98 - value % 97:02d}{rest}"
    if kind == "secret":
        keep = re.match(r"AKIA|gh[pousr]_|", normal).group()
        rest = normal[len(keep) :] + "0" * longer
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", rest):
            drawn = "".join("0123456789abcdef"[draws.below(16)] for _ in rest)
            return keep + (drawn.upper() if rest.isupper() else drawn)
        return keep + draws.letters(rest)
    if kind == "initial":  # another letter by a keyed order; letters are too few to be kept apart from real ones
        script, letter = normal.split(":", 1)
        ordered = sorted(ALPHABETS[script], key=lambda x: hmac.new(key, f"initial\0{x}".encode(), hashlib.sha256).digest())
        return f"{script}:{ordered[(ordered.index(letter) + 1 if letter in ordered else draws.below(len(ordered))) % len(ordered)]}"
    if kind == "given":
        script, gender, name = normal.split(":", 2)
        if draw < SHAPED_DRAWS:
            known, stand_ins = _stand_ins(key, script, gender)
            return f"{script}:{gender}:{stand_ins[(known.index(name) + draw) % len(stand_ins)]}"
        drawn = "".join(SYLLABLES[script][draws.below(len(SYLLABLES[script]))] for _ in range(1 + draw // SHAPED_DRAWS))
        return f"{script}:{gender}:{drawn}{GIVEN_ENDINGS[script][gender]}"
    script, name = normal.split(":", 1)
    drawn = "".join(SYLLABLES[script][draws.below(len(SYLLABLES[script]))] for _ in range(2 + draw // SHAPED_DRAWS + (len(name) > 8)))
    return f"{script}:{drawn}{ENDINGS[script][draws.below(len(ENDINGS[script]))]}"


def written(mention: str, kind: str, drawn: str) -> str:
    """A surrogate in the punctuation and case of a mention."""
    if kind == "initial":
        return drawn.rpartition(":")[2].upper()
    if kind in ("given", "surname"):
        name = drawn.rpartition(":")[2]
        return name.upper() if mention.isupper() else name.title()
    if kind == "email":
        return drawn.upper() if mention.isupper() else drawn
    if kind == "ip":
        return drawn
    rest = iter(drawn)
    shaped = [next(rest) if c.isalnum() or kind == "secret" else c for c in mention]
    return "".join([*shaped, *rest])


MENTIONS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("normal", T.StringType())]))
_MENTION_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("normal", pa.string())]))


def _with_mentions(docs: DataFrame, name: str) -> DataFrame:
    """Documents with the distinct (kind, normal) of their entities in column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.large_string()).fill_null("")
            out: list[list] = [[] for _ in range(len(text))]
            for i in pc.indices_nonzero(pc.match_substring_regex(text, _MAYBE)).to_pylist():
                out[i] = [{"kind": k, "normal": n} for k, n in sorted({x[2:] for x in detect(text[i].as_py()) if x[2] != "initial"})]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _MENTION_TYPE)], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, MENTIONS)]))


def surrogates(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, normal, surrogate for a table of distinct entities (kind, normal).

    Entities whose surrogate is a real entity or another one's draw again. Surrogates grow after
    ``SHAPED_DRAWS`` draws, so few rounds follow, however few there are of the first shape.
    """

    def draw(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [surrogate(key, *x) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "surrogate"])

        return rows.select("kind", "normal", "draw").mapInArrow(run, "kind string, normal string, draw int, surrogate string")

    entities = stored(entities)
    drawn = stored(draw(entities.withColumn("draw", F.lit(0))))
    while True:
        real = entities.select("kind", F.col("normal").alias("surrogate"), F.lit(True).alias("real"))
        # The smallest entity of those that drew one surrogate keeps it, unless it is a real entity.
        first = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("draw", "normal")).alias("first"))
        checked = drawn.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        loses = F.col("real").isNotNull() | (F.struct("draw", "normal") != F.col("first"))
        checked = stored(checked.select("kind", "normal", "draw", "surrogate", loses.alias("loses")))
        if checked.where("loses").isEmpty():
            return checked.select("kind", "normal", "surrogate")
        again = checked.where("loses").select("kind", "normal", (F.col("draw") + 1).alias("draw"))
        drawn = stored(checked.where("not loses").drop("loses").unionByName(draw(again)))


def pseudonymise(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``docs`` with all columns, entities in ``text`` replaced."""
    names = docs.columns
    tag = uuid.uuid5(uuid.NAMESPACE_OID, " ".join(names)).hex[:12]  # clashes with no column of the table
    mentions, row, found = f"mentions_{tag}", f"row_{tag}", f"found_{tag}"
    seen = _with_mentions(docs.withColumn("text", F.col("text").cast("string")), mentions)
    each = lambda df: df.select(F.explode(mentions).alias("m")).select("m.kind", "m.normal")
    # Texts with entities, some percent of all, are stored: they are looked at once more to be written.
    # Rows are met again by a hash of id and text: equal ones hold the same entities.
    held = stored(seen.where(F.size(mentions) > 0).withColumn(row, F.sha2(F.concat_ws("\0", F.col("doc_id").cast("string"), "text"), 256)))
    drawn = surrogates(each(held).distinct(), key)
    wanted = held.select(F.col(row), F.explode(mentions).alias("m")).distinct().select(row, "m.kind", "m.normal")
    known = wanted.join(drawn, ["kind", "normal"]).groupBy(row).agg(F.collect_list(F.struct("kind", "normal", "surrogate")).alias(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = []
            for text, pairs in zip(batch.column("text").to_pylist(), batch.column(found).to_pylist(), strict=True):
                drawn = {(p["kind"], p["normal"]): p["surrogate"] for p in pairs}
                parts, last = [], 0
                for s, e, kind, normal in detect(text):
                    new = surrogate(key, kind, normal, 0) if kind == "initial" else drawn[kind, normal]
                    parts += [text[last:s], written(text[s:e], kind, new)]
                    last = e
                out.append("".join([*parts, text[last:]]))
            yield batch.set_column(at, "text", pa.array(out, pa.string())).select(names)

    changed = held.join(known, row).select(*names, found).mapInArrow(run, T.StructType([f for f in seen.schema.fields if f.name in names]))
    return seen.where(F.size(mentions) == 0).select(*names).unionByName(changed)


def op4_pii(spark, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return pseudonymise(docs.withColumn("before", F.xxhash64("text"))).select(
        "doc_id", "text", (F.xxhash64("text") != F.col("before")).alias("changed")
    )

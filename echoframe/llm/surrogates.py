"""PII: detected entities receive keyed, type-consistent surrogates.

Structured entities (e-mail addresses, phone and card numbers, IP addresses, identity and
account numbers, secrets) are permuted within their own format by a keyed Feistel network
over exactly the strings of that format: same length, same kinds of characters and same
punctuation at every place, same check digit rule. Such a map is one to one, so equal
entities get equal surrogates in the whole corpus and different ones stay different, without
any table.

Names of persons are found by an honorific or a listed given name; every later or earlier
mention of a found name in the same text, whatever its case, is the same name. A listed given
name becomes another one of the same gender and script (a keyed permutation of the list).
Other Latin, Cyrillic and Greek names become built names of the same script: of the title's
gender for a given name, of the gender that a Cyrillic or Greek surname shows by its ending.
Names of other scripts are permuted within their own format. Built names can collide: all
distinct names of the corpus are counted, the built names are made long enough for few
collisions, and a table of the names that still collide, or that would become a listed or real
name of the corpus, keeps them apart. Surname and given name are replaced each for itself, so
"Mr Smith" is the same person as "John Smith".

Defined results
---------------
* A null text stays null with no entities; texts without entities are unchanged, byte for byte.
* Overlapping entities: the one that starts first, then the one that comes first in the list of patterns.
* Case tells no entities apart: "Smith" and "SMITH", "Jo@x.org" and "jo@x.org" get the same surrogate, each in its own case.
* A name that a text uses as given name and as surname takes the role of its first place there.
* Repeated rows give equal rows; other columns pass through `replace()`, and the new column, the last, gets underscores behind a name that is taken.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import fresh, schema_of, written

# -- detection ------------------------------------------------------------------------------------
_SEP = r"[^\w\n(+]{1,6}"
PATTERNS: tuple[tuple[str, str], ...] = (
    ("email", r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,24}\b"),
    ("secret", r"(?i:\b(?:token|secret|passw(?:or)?d|api[_ -]?key|access[_ -]?key|private[_ -]?key)\b[^\w\n\"'=:]{0,6}[=:]\W{0,6}?)(?P<secret>(?:(?<=[\"'])[^\s\"']{8,}(?=[\"']))|[A-Za-z0-9+/_-]{16,})"),
    ("secret", r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b"),
    ("account", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"),
    ("ip", r"(?<![\w:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![\w:])"),
    ("identity", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d.,+-])(?:\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|\d{4}([ -])\d{6}\3\d{5}|\d{13,19})(?![\d-])"),
    ("phone", rf"(?<![\w+])\+\d{{1,3}}(?:{_SEP})?\(\d{{2,4}}\){_SEP}\d{{3,4}}[ .-]\d{{3,4}}\b"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]\d{2,4}(?:[ .-]\d{2,4}(?!\.?\d)){2,4}\b"),
    ("phone", r"(?<![\w(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}\b|(?<![\d.-])\d{3}([.-])\d{3}\4\d{4}(?![\d-])|(?<!\w)\+\d{8,15}\b"),
)

#: Given names by script and gender.
GIVEN_NAMES: dict[tuple[str, str], tuple[str, ...]] = {
    ("latin", "f"): tuple("Alice Anna Barbara Carla Clara Elena Emily Emma Greta Hannah Ingrid Isabel Julia Laura Lucia Maria Martha Nora Olivia Paula Rosa Sarah Sofia Susan".split()),
    ("latin", "m"): tuple("Andreas Anton Bernard Carlos Daniel David Diego Edward Frank George Henri Jack James John Jonas Luis Manuel Martin Oliver Paul Peter Robert Thomas William".split()),
    ("cyrillic", "f"): tuple("Анна Вера Галина Дарья Елена Ирина Мария Наталья Ольга Светлана".split()),
    ("cyrillic", "m"): tuple("Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split()),
    ("greek", "f"): tuple("Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split()),
    ("greek", "m"): tuple("Γιάννης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split()),
}
HONORIFICS: dict[str, str] = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sra": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
_GENDER = {n: (g, s) for (s, g), names in GIVEN_NAMES.items() for n in names}
_LISTED = {n.casefold(): (n, g, s) for n, (g, s) in _GENDER.items()}
_CAPITAL = r"[^\W\d_a-zß-öø-ÿа-яёα-ώ]"
_NAME = rf"(?:{_CAPITAL}['’])?{_CAPITAL}[^\W\d_]+(?:[-'’](?!s\b)[^\W\d_]+)?"
_PERSON = rf"(?<!\w)(?:(?P<title>{'|'.join(HONORIFICS)})\.?[ \t]+(?P<one>{_NAME})(?:[ \t]+(?P<two>{_NAME}))?|(?P<given>{'|'.join(_GENDER)})[ \t]+(?P<family>{_NAME}))(?!\w)"
KINDS = ("email", "phone", "card", "ip", "identity", "account", "secret", "person")


def _compiled() -> tuple[re.Pattern, list[str]]:
    """One pattern of all structured ones; its groups e0, e1 ... tell which."""
    parts, kinds, groups = [], [], 1
    for k, (kind, p) in enumerate(PATTERNS):
        own = re.compile(re.sub(r"\\[1-9]", "", p)).groups
        base = groups
        numbers = iter(range(base + 1, base + 1 + own))
        opened = [next(numbers) for _ in range(own)]
        # back references count from the start of the whole pattern
        refs = sorted({int(x) for x in re.findall(r"\\([1-9])", p)})
        for r, to in zip(refs, opened, strict=False):
            p = p.replace(f"\\{r}", f"(?P=_{to})")
        for to in opened[: len(refs)]:
            p = p.replace("([ -])", f"(?P<_{to}>[ -])", 1) if "([ -])" in p else p.replace("([.-])", f"(?P<_{to}>[.-])", 1)
        parts.append(f"(?P<e{k}>{p})")
        kinds.append(kind)
        groups += own + 1
    return re.compile("|".join(parts)), kinds


_STRUCTURED, _KIND_OF = _compiled()
_PERSONS = re.compile(_PERSON)
_MENTION = re.compile(rf"(?<!\w){_NAME}(?!\w)")
_PIECE = re.compile(rf"{_CAPITAL}[^\W\d_]+")
_HEADS = (*HONORIFICS, *_GENDER)


def person_matches(text: str) -> Iterator[re.Match]:
    """Matches of persons; texts without an honorific or listed name are passed over quickly."""
    return _PERSONS.finditer(text) if any(h in text for h in _HEADS) else iter(())


# -- keyed permutations ---------------------------------------------------------------------------
#: Kinds of characters; a surrogate has the same kind at every place.
ALPHABETS: tuple[str, ...] = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "".join(map(chr, (*range(0xDF, 0xF7), *range(0xF8, 0x100)))), "".join(map(chr, (*range(0xC0, 0xD7), *range(0xD8, 0xDF)))),
    "".join(map(chr, range(0x3B1, 0x3CA))), "".join(map(chr, range(0x391, 0x3A2))), "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430))),
)
_PLACE = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}
_OTHER = ((0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FFF), (0xAC00, 0xD7A4), (0x5D0, 0x5EB), (0x621, 0x64B), (0x905, 0x93A), (0x531, 0x557), (0x561, 0x587), (0x10D0, 0x10FB), (0xE01, 0xE2F))
HEX = ("0123456789abcdef", "0123456789ABCDEF")


def permute(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of [0, n): Feistel rounds over an even number of bits, walked on until inside."""
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    salt = tweak.encode()
    while True:
        left, right = x >> half, x & mask
        for r in range(8):
            raw = hashlib.blake2b(right.to_bytes(half // 8 + 1, "little") + bytes([r]) + salt, key=key, digest_size=min(64, half // 8 + 9)).digest()
            while len(raw) * 8 < half:
                raw += hashlib.blake2b(raw, key=key).digest()
            left, right = right, left ^ (int.from_bytes(raw, "little") & mask)
        x = (left << half) | right
        if x < n:
            return x


def in_format(text: str, key: bytes, tweak: str, alphabets: dict[str, tuple[str, int]] | None = None) -> str:
    """The surrogate of text among all strings with the same kinds of characters; what is of no kind stays."""
    digits, value, size = [], 0, 1
    for c in text:
        got = (alphabets or {}).get(c) or _PLACE.get(c)
        if got is None:
            o = ord(c)
            span = next((s for s in _OTHER if s[0] <= o < s[1]), None)
            digits.append(span if span else c)
            if span:
                value, size = value * (span[1] - span[0]) + o - span[0], size * (span[1] - span[0])
        else:
            digits.append(got[0])
            value, size = value * len(got[0]) + got[1], size * len(got[0])
    shape = tweak + "".join(d[0] + "·" if isinstance(d, str) and len(d) > 1 else str(d) for d in digits)
    value = permute(value, size, key, shape)
    out = []
    for d in reversed(digits):
        if isinstance(d, tuple):
            value, i = divmod(value, d[1] - d[0])
            out.append(chr(d[0] + i))
        elif len(d) > 1:
            value, i = divmod(value, len(d))
            out.append(d[i])
        else:
            out.append(d)
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    """The check digit of a number without one."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def _digits(text: str, key: bytes, tweak: str, keep: int = 0) -> str:
    """Permutes the digits after the first `keep`; the rest of the text stays."""
    at = [i for i, c in enumerate(text) if c in "0123456789"][keep:]
    new = dict(zip(at, in_format("".join(text[i] for i in at), key, tweak), strict=True))
    return "".join(new.get(i, c) for i, c in enumerate(text))


def structured(kind: str, text: str, key: bytes) -> str:
    if kind == "card":
        digits = [c for c in text if c.isdigit()]
        off = (int(digits[-1]) - _luhn("".join(digits[:-1]))) % 10
        new = in_format("".join(digits[:-1]), key, "card")
        new += str((_luhn(new) + off) % 10)  # a valid number stays valid
        it = iter(new)
        return "".join(next(it) if c.isdigit() else c for c in text)
    if kind == "phone":
        code = re.match(r"\+(\d{1,3})(?=\D)", text)
        return _digits(text, key, "phone", len(code[1]) if code else 0)
    if kind == "ip":
        if ":" in text:
            return in_format(text, key, "ip6", {c: (HEX[0], i) for i, c in enumerate(HEX[0])})
        a = [int(x) for x in text.split(".")]
        v = permute((a[0] << 24) | (a[1] << 16) | (a[2] << 8) | a[3], 1 << 32, key, "ip4")
        return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))
    if kind == "identity":
        return _digits(text, key, "identity")
    if kind == "email":
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        local, _, domain = low.rpartition("@")
        host, _, top = domain.rpartition(".")
        new = f"{in_format(local, key, 'local')}@{in_format(host, key, 'host')}.{top}"
        return "".join(c.upper() if was != old and len(c.upper()) == 1 else c for c, was, old in zip(new, low, text, strict=True))
    if kind == "account":
        return text[:2] + in_format(text[2:], key, "account")
    hexes = next((h for h in HEX if all(c in h for c in text)), None)
    return in_format(text, key, "secret", {c: (hexes, i) for i, c in enumerate(hexes)} if hexes else None)


# -- names ----------------------------------------------------------------------------------------
#: Syllables of built names, by script: (onsets, vowels).
SYLLABLES = {"latin": ("b d f g h k l m n p r s t v w z".split(), "a e i o".split()), "cyrillic": ("б в г д ж з к л м н п р с т ф х".split(), "а е и о".split()), "greek": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ ψ".split(), "α ε ι ο".split())}
ENDINGS = {("latin", "f"): "a", ("latin", "m"): "o", ("cyrillic", "f"): "а", ("cyrillic", "m"): "ин", ("greek", "f"): "η", ("greek", "m"): "ος"}


def script_of(name: str) -> str:
    """latin, cyrillic, greek, or other."""
    o = ord(name[0])
    return "greek" if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else "cyrillic" if 0x400 <= o < 0x530 else "latin" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "other"


def ending_gender(canonical: str) -> str:
    """The gender that a surname shows by its own ending, so that it is the same wherever the name stands."""
    script, last = script_of(canonical), canonical[-1]
    if script == "cyrillic":
        return "f" if last in "ая" else "" if last in "оеиу" else "m"
    return ("m" if last == "σ" else "f") if script == "greek" else ""


def letters(canonical: str, gender: str, attempt: int, syllables: int, key: bytes) -> str:
    """The small letters of a built name of the same script and gender; 64 ways for each syllable. attempt: keeps colliding names apart."""
    script = script_of(canonical)
    on, vowels = SYLLABLES.get(script, SYLLABLES["latin"])
    v = int.from_bytes(hashlib.blake2b(f"{gender}|{canonical}|{attempt}".encode(), key=key, digest_size=32).digest(), "little")
    out = ""
    for _ in range(syllables):
        v, s = divmod(v, 64)
        out += on[s // 4] + vowels[s % 4]
    return out + ENDINGS.get((script, gender), "")


def permuted(name: str, key: bytes) -> str | None:
    """The surrogate of a name of another script within its own format; None for other names, or where nothing could change."""
    if script_of(name) != "other":
        return None
    new = in_format(name, key, "name")
    return new if new != name else None


def styled(small: str, name: str) -> str:
    """Small letters in the case of a name, with its hyphen or apostrophe."""
    if name.isupper():
        small = small.upper()
    at = next((i for i, c in enumerate(name) if c in "-'’"), 0)
    if not at:
        return small if name.isupper() else small.capitalize()
    cut = 1 if at == 1 else max(2, len(small) // 2)
    return small[:1].upper() + small[1:cut] + name[at] + (small[cut:].capitalize() if name[at + 1 : at + 2].isupper() and not name.isupper() else small[cut:])


def persons(m: re.Match) -> list[tuple[int, int, str, str]]:
    """(start, end, role, gender) of the names in a match. Roles: given (listed), first (a given name that is not listed), family."""
    gender = HONORIFICS.get(m["title"] or "", "")
    out = []
    for group in ("one", "two", "given", "family"):
        if m[group]:
            listed = _LISTED.get(m[group].casefold())
            if listed and group != "family":
                out.append((*m.span(group), "given", listed[1]))
            elif group == "one" and m["two"]:
                out.append((*m.span(group), "first", gender))
            else:
                out.append((*m.span(group), "family", ending_gender(m[group].casefold())))
    return out


def people(text: str) -> tuple[list[tuple[int, int]], dict[str, tuple[str, str]]]:
    """Places of names beside a title or a listed name, and role and gender of each name of the text, by its small letters."""
    places, names = [], {}
    for m in person_matches(text):
        for s, e, role, gender in persons(m):
            places.append((s, e))
            names.setdefault(text[s:e].casefold(), (role, gender))
    return places, names


def mentions(text: str, names: dict[str, tuple[str, str]]) -> Iterator[tuple[int, int]]:
    """Places of all capitalised words that are one of the names, also as a part of a hyphenated word."""
    for m in _MENTION.finditer(text):
        if m[0].casefold() in names:
            yield m.span()
        elif not m[0].isalpha():
            for p in _PIECE.finditer(text, *m.span()):
                if p[0].casefold() in names:
                    yield p.span()


class Replacer:
    """attempts: of names whose built name would collide, by (small letters, gender); these are a syllable longer."""

    def __init__(self, key: str, syllables: int = 3, attempts: dict[tuple[str, str], int] | None = None):
        self.key, self.syllables, self.attempts = key.encode()[:64], syllables, attempts or {}
        self.memo: dict[tuple[str, str], str] = {}

    def name(self, name: str, role: str, gender: str) -> str:
        canonical = name.casefold()
        if role == "given":
            listed, gender, script = _LISTED[canonical]
            names = GIVEN_NAMES[script, gender]
            new = names[permute(names.index(listed), len(names), self.key, f"given{script}{gender}")]
            return new.upper() if name.isupper() else new
        new = permuted(name, self.key)
        if new is None:
            attempt = self.attempts.get((canonical, gender))
            new = styled(letters(canonical, gender, attempt or 0, self.syllables + (attempt is not None), self.key), name)
        return new

    def surrogate(self, kind: str, text: str) -> str:
        got = self.memo.get((kind, text))
        if got is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            got = self.memo[kind, text] = structured(kind, text, self.key)
        return got

    def entities(self, text: str) -> list[tuple[int, int, str, str, str]]:
        """(start, end, kind, role, gender), in order, without overlaps."""
        found = []
        if any(c in text for c in "0123456789@=:"):
            for m in _STRUCTURED.finditer(text):
                kind = _KIND_OF[int(m.lastgroup[1:])] if m.lastgroup and m.lastgroup[0] == "e" else next(_KIND_OF[k] for k in range(len(_KIND_OF)) if m[f"e{k}"] is not None)
                span = m.span("secret") if m["secret"] else m.span()
                found.append((*span, kind, "", ""))
        places, names = people(text)
        if names:
            found += [(s, e, "person", *names[text[s:e].casefold()]) for s, e in (*places, *mentions(text, names))]
        found.sort(key=lambda x: x[0])
        out, at = [], 0
        for x in found:
            if x[0] >= at:
                out.append(x)
                at = x[1]
        return out

    def replace(self, text: str) -> tuple[str, list[str]]:
        parts, at, kinds = [], 0, []
        for s, e, kind, role, gender in self.entities(text):
            parts += [text[at:s], self.name(text[s:e], role, gender) if kind == "person" else self.surrogate(kind, text[s:e])]
            at = e
            kinds.append(kind)
        return ("".join(parts) + text[at:], kinds) if kinds else (text, kinds)


# -- operator -------------------------------------------------------------------------------------
KEY = "echoframe"
#: Collisions that are expected at most among built names, and rows of the table that keeps them apart at most.
COLLISIONS, EXCEPTIONS = 1_000, 100_000


def collisions(df: DataFrame, text: str, key: str) -> tuple[int, dict[tuple[str, str], int]]:
    """Syllables for built names, and the attempt of each name that would collide otherwise, by (small letters, gender).

    Only distinct names are shuffled. The table that reaches the driver holds the colliding ones:
    about COLLISIONS by choice of the length, EXCEPTIONS at most, beyond which names grow longer.
    """
    spark, secret = df.sparkSession, key.encode()[:64]
    names = schema_of("canonical string, gender string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sorted({(n, g) for t in b.column(0).to_pylist() if t for n, (role, g) in people(t)[1].items() if role != "given"})
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=names.names)

    distinct = written(df.select(text).mapInArrow(run, names).distinct(), "names")
    real = distinct.select(F.translate("canonical", "-'’", "").alias("letters")).distinct()
    n = distinct.count()
    syllables = 3
    while n * n > 2 * COLLISIONS * 64**syllables:
        syllables += 1
    while True:
        made_schema = schema_of("canonical string, gender string, letters string, listed boolean")

        def build(batches: Iterator[pa.RecordBatch], k: int = syllables) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(c, g, letters(c, g, 0, k, secret)) for c, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if permuted(c, secret) is None]
                yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.string()) for i in range(3)), pa.array([r[2] in _LISTED for r in rows], pa.bool_())], names=made_schema.names)

        made = distinct.mapInArrow(build, made_schema)
        taken = made.groupBy("letters").count().where("count > 1").select("letters")
        ranked = made.join(taken, "letters").withColumn("rank", F.row_number().over(Window.partitionBy("letters").orderBy("canonical", "gender"))).where("rank > 1")
        clash = ranked.select(names.names).union(made.join(real, "letters", "left_semi").select(names.names)).union(made.where("listed").select(names.names)).distinct()
        rows = clash.limit(EXCEPTIONS + 1).collect()
        if len(rows) <= EXCEPTIONS:
            break
        syllables += 1
    attempts: dict[tuple[str, str], int] = {}
    held: dict[str, tuple[str, str]] = {}
    pending = sorted(tuple(r) for r in rows)
    while pending:
        for name in pending:
            attempt = attempts.get(name, 0) + 1
            while (s := letters(*name, attempt, syllables + 1, secret)) in held or s in _LISTED:  # one syllable more than any other name has
                attempt += 1
            held[s] = name
            attempts[name] = attempt
        made = spark.createDataFrame([(letters(*name, attempts[name], syllables + 1, secret),) for name in pending], "letters string")
        pending = sorted(held[r.letters] for r in real.join(F.broadcast(made), "letters").select("letters").collect())
    return syllables, attempts


def replace(df: DataFrame, text: str = "text", key: str = KEY, counts: str = "entities") -> DataFrame:
    """The rows of df with surrogates in the text, and a last column of entity kinds, in order of place; all other columns stay."""
    (counts,) = fresh(df, counts)
    syllables, attempts = collisions(df, text, key)
    shared = df.sparkSession.sparkContext.broadcast(attempts)
    schema = T.StructType(df.schema.fields + [T.StructField(counts, T.ArrayType(T.StringType(), False))])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeper = Replacer(key, syllables, shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                col = part.schema.get_field_index(text)
                done = [(None, []) if t is None else keeper.replace(t) for t in part.column(col).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()) if n == text else part.column(part.schema.get_field_index(n)) for n in names] + [pa.array([d[1] for d in done], pa.list_(pa.field("element", pa.string(), False)))], names=[*names, counts])

    return df.mapInArrow(run, schema)


def count_of(kind: str) -> Column:
    """How many of a row's entities are of a kind."""
    return F.size(F.filter("entities", lambda k: k == kind)).cast("long").alias(f"n_{kind}")


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", *map(count_of, KINDS), (F.size("entities") > 0).alias("changed"), "text")

"""Personal data replaced by keyed surrogates of the same kind.

Each entity found has a normal form (an e-mail address in lower case, the digits of a
phone number), which a keyed permutation of all forms of its shape maps to another
one: digits to digits, letters to letters of their script and case, card numbers to
numbers with a right check digit, public addresses to public ones, first names to
first names of their gender. Being a permutation it keeps distinct entities distinct
and gives every mention of one entity, anywhere, the same surrogate; the mention's own
case and separators are put back.

A surrogate that is also somebody's real data in the corpus is a collision. All
surrogates are joined with all originals of the corpus; those that collide draw anew
until none does, and the few exceptions reach their texts in a join. Only narrow rows
of entities are shuffled; texts stay where they are while exceptions fit a broadcast.

Null texts stay null, empty ones empty; repeated rows get equal texts; other columns
are left alone.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolesift.llm.base import arrow_map, table
from rolesift.session import broadcast_if_small, materialize, release

KEY = b"a key that the caller should keep to itself"
# first names by script and gender, written as they are met: pools that map to themselves
NAMES = {
    "f": "Anna Maria Laura Emma Julia Sophie Clara Elena Marta Lucia Carmen Isabel Claire Camille Alice Louise Jeanne "
    "Greta Helga Ingrid Katrin Monika Susan Linda Karen Nancy Emily Olivia Hannah Grace",
    "m": "John Robert Michael David James William Thomas Daniel Peter Paul Martin Carlos Pablo Diego Javier Manuel "
    "Pierre Jacques Louis Henri Marcel Hans Karl Dieter Jürgen Stefan George Edward Henry Frank",
    "cyrillic f": "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна Екатерина Людмила",
    "cyrillic m": "Иван Пётр Сергей Андрей Дмитрий Алексей Николай Михаил Владимир Борис",
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Mme Monsieur Madame Доктор Господин Госпожа".split()
_FIRST = {name: (pool.split(), pool.split().index(name)) for pool in NAMES.values() for name in pool.split()}
_CUES = frozenset(x.encode() for x in (*_FIRST, *TITLES))
# ASCII marks as spaces, to find words that announce a person
_BARE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
# letters that stand for each other: by script, case, and whether they are vowels
_CLASSES = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâãäåèéêëìíîïòóôõöùúûü", "ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜ", "çñßøœæ", "ÇÑØŒÆ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ",
]
_CLASS_OF = {c: group for group in _CLASSES for c in group}
_HEX = "0123456789abcdef"
# draws for an entity whose surrogate is somebody's value; from the eighth on, those that can grow do
ROUNDS = 12
_MARKS = "!#$%&()*+-./:<=>?@[\\]^_`{|}~"


def _sort_of(c: str) -> tuple:
    """Script, category and, for letters with case, the block of 128 code points and whether case changes and returns."""
    kind = unicodedata.category(c)
    if kind == "Nd":
        return kind, ord(c) - unicodedata.decimal(c)
    if kind not in ("Lu", "Ll"):
        return kind, unicodedata.name(c, "").split(" ")[0]
    other = c.upper() if kind == "Ll" else c.lower()
    returns = len(other) == 1 and other != c and (other.lower() if kind == "Ll" else other.upper()) == c
    return kind, unicodedata.name(c, "").split(" ")[0], ord(c) >> 7, returns


# filled once by the driver and sent with the functions; a cache of functools workers could only import
_OTHERS: dict[str, str] = {}


def _other_classes() -> dict[str, str]:
    """The class of each letter and number of Unicode that is in none of ``_CLASSES``."""
    if _OTHERS:
        return _OTHERS
    groups: dict[tuple, list[str]] = {}
    for c in map(chr, range(sys.maxunicode + 1)):
        if c.isalnum() and c not in _CLASS_OF:
            groups.setdefault(_sort_of(c), []).append(c)
    few: dict[str, list[str]] = {}  # too few of a sort to stand for each other
    for sort in [s for s, group in groups.items() if len(group) < 4]:
        few.setdefault(sort[0], []).extend(groups.pop(sort))
    _OTHERS.update({c: group for some in (groups, few) for group in map("".join, some.values()) for c in group})
    return _OTHERS


def class_of(c: str) -> str | None:
    """The characters that may stand for one: every letter and number has some."""
    return _CLASS_OF.get(c) or (None if c.isascii() else _other_classes().get(c))


def _mark(c: str) -> str | None:
    """Classes for texts without any letter or number."""
    if c in _MARKS:
        return _MARKS
    row = ord(c) & ~127
    group = "".join(x for x in map(chr, range(row, row + 128)) if x.isprintable() and not x.isspace() and not x.isalnum())
    return group if row and c in group else None


def permute(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..n-1: a Feistel network, walked until it lands in range."""
    width = max(2, (n - 1).bit_length())
    right = width // 2
    left = width - right
    while True:
        a, b = x >> right, x & ((1 << right) - 1)
        for turn in range(8):
            seen, bits = (b, left) if turn % 2 == 0 else (a, right)
            data = b"%b|%b|%d|%d|%x" % (key, tweak.encode(), n, turn, seen)
            drawn = int.from_bytes(hashlib.shake_256(data).digest((bits + 7) // 8)) & ((1 << bits) - 1)
            if turn % 2 == 0:
                a ^= drawn
            else:
                b ^= drawn
        x = a << right | b
        if x < n:
            return x


def recode(text: str, key: bytes, tweak: str, classes: Callable[[str], str | None] = class_of) -> str:
    """Permute all texts of one shape: characters of a class change, others stay."""
    groups = [classes(c) for c in text]
    x, n = 0, 1
    for c, group in zip(text, groups):
        if group:
            x, n = x * len(group) + group.index(c), n * len(group)
    if n == 1:
        return text
    shape = "".join(g[0] if g else c for c, g in zip(text, groups))
    x, out = permute(x, n, key, f"{tweak}|{shape}"), []
    for c, group in zip(reversed(text), reversed(groups)):
        if group:
            x, digit = divmod(x, len(group))
            c = group[digit]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _hex(c: str) -> str | None:
    return _HEX if c in _HEX else None


def _email(normal: str, key: bytes, tweak: str) -> str:
    local, _, domain = normal.rpartition("@")
    name, _, top = domain.rpartition(".")
    return f"{recode(local, key, f'{tweak}|{domain}')}@{recode(name, key, tweak)}.{top}"


def _number(normal: str, key: bytes, tweak: str) -> str:
    """Long numbers: card numbers stay card numbers with their first digit, others others."""
    if luhn(normal):
        body = normal[0] + recode(normal[1:-1], key, tweak)
        return next(body + d for d in "0123456789" if luhn(body + d))
    while True:
        normal = recode(normal, key, tweak)
        if not luhn(normal):
            return normal


def _phone(normal: str, key: bytes, tweak: str) -> str:
    keep = 0 if normal[0] != "+" else 2 if normal[1] in "17" else 3
    return normal[:keep] + recode(normal[keep:], key, f"{tweak}|{normal[:keep]}")


def _ssn(normal: str, key: bytes, tweak: str) -> str:
    usual = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
    was = usual(normal)
    while True:
        normal = recode(normal, key, tweak)
        if usual(normal) == was:
            return normal


_NETS = ((0x0A000000, 24), (0xAC100000, 20), (0xC0A80000, 16), (0x7F000000, 24))


def _ip(normal: str, key: bytes, tweak: str) -> str:
    net = lambda x: next((i for i, (base, bits) in enumerate(_NETS) if x >> bits == base >> bits), None)
    x = int.from_bytes(bytes(map(int, normal.split("."))))
    was = net(x)
    while True:
        if was is None:
            x = permute(x, 1 << 32, key, tweak)
        else:
            base, bits = _NETS[was]
            x = base + permute(x - base, 1 << bits, key, f"{tweak}|{was}")
        if net(x) == was:
            return ".".join(map(str, x.to_bytes(4)))


def _iban(normal: str, key: bytes, tweak: str) -> str:
    body = recode(normal[4:], key, f"{tweak}|{normal[:2]}", {c: g for g in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in g}.get)
    rest = int("".join(str(int(c, 36)) for c in body + normal[:2] + "00")) % 97
    return f"{normal[:2]}{98 - rest:02d}{body}"


def _secret(normal: str, key: bytes, tweak: str) -> str:
    if all(c in _HEX for c in normal):
        return recode(normal, key, tweak, _hex)
    return recode(normal, key, tweak, class_of if any(map(class_of, normal)) else _mark)


def _name(normal: str, key: bytes, tweak: str) -> str:
    if normal in _FIRST:
        pool, at = _FIRST[normal]
        return pool[permute(at, len(pool), key, f"{tweak}|{pool[0]}")]
    return recode(normal, key, tweak)


def _double_name(normal: str, key: bytes, tweak: str) -> str:
    """Two other first names of the pool, joined: nobody's in the corpus, where a name ends at the hyphen."""
    pool, at = _FIRST[normal]
    order = sorted(range(len(pool)), key=lambda i: permute(i, len(pool), key, f"{tweak}|{pool[0]}"))
    place = order.index(at)
    return "-".join(pool[order[(place + k) % len(pool)]] for k in (1, 2))


MAKERS = {
    "email": _email, "number": _number, "phone": _phone, "ssn": _ssn, "ip": _ip, "iban": _iban,
    "secret": _secret, "mac": lambda n, k, t: recode(n, k, t, _hex), "ip6": lambda n, k, t: recode(n, k, t, _hex),
    "name": _name,
}

_FOUND = re.compile(
    r"""
    (?P<cue>(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd)\b["']?\s*[:=]\s*["']?))(?P<secret>[^\s"',;]{6,})
  | (?P<email>[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})
  | (?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
  | (?P<mac>\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b)
  | (?P<ip6>\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b)
  | (?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))
  | (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
  | (?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)
      | (?<!\w)\(\d{3}\)[ ]?\d{3}[ .-]\d{4}(?!\d) | (?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))
  | (?P<number>(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d]))
  | (?P<hex>\b(?=[0-9a-f]*\d)[0-9a-f]{32,}\b)
    """,
    re.VERBOSE,
)
_PERSON = re.compile(
    rf"\b(?P<title>(?:{'|'.join(TITLES)})\.?[ ])?(?P<names>(?:(?:{'|'.join(_FIRST)})\b(?:[ ][^\W\d_a-zа-я]\w+)?)"
    r"|(?<=[ .] )?[^\W\d_a-zа-я]\w+(?:[ ][^\W\d_a-zа-я]\w+)?)"
)
# what every match of _FOUND holds: a digit, an @, a word of a cue, or joined groups of hex digits
_PREFIX = re.compile(r"[\d@]|[0-9A-Fa-f][:-][0-9A-Fa-f]{1,4}[:-]|(?i:key|secret|token|passw|pwd)")


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    normal: str


def _plain_digits(text: str) -> str:
    """Digits of every script as 0-9."""
    return text if text.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


def normal_form(kind: str, text: str) -> str:
    if kind in ("number", "ssn", "phone", "iban"):
        text = _plain_digits(text)
    if kind in ("number", "ssn"):
        return re.sub(r"\D", "", text)
    if kind == "phone":
        return ("+" if text[0] == "+" else "") + re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    return text.lower() if kind in ("email", "mac", "ip6") else text


def like(text: str, surrogate: str) -> str:
    """The surrogate with the case, the separators and the script of digits of a mention."""
    n = sum(map(str.isalnum, text))
    if not n or n != sum(map(str.isalnum, surrogate)):
        return surrogate
    chars = (c for c in surrogate if c.isalnum())
    out = []
    for c in text:
        if c.isalnum():
            new = next(chars)
            if new in _HEX[:10] and c.isdecimal() and not c.isascii():
                new = chr(ord(c) - unicodedata.decimal(c) + int(new))
            c = new.upper() if c.isupper() and len(new.upper()) == 1 else new
        out.append(c)
    return "".join(out)


def entities(text: str) -> list[Entity]:
    """What is personal in a text, in order and without overlaps."""
    found = []
    if _PREFIX.search(text):
        for m in _FOUND.finditer(text):
            kind = m.lastgroup
            start, end = m.span(kind)
            kind = "secret" if kind == "hex" else kind
            found.append(Entity(start, end, kind, normal_form(kind, text[start:end])))
    if not _CUES.isdisjoint(text.encode("utf-8", "surrogatepass").translate(_BARE).split()):
        taken = [(e.start, e.end) for e in found]
        surnames = set()
        for m in _PERSON.finditer(text):
            words = m["names"].split(" ")
            if not m["title"] and words[0] not in _FIRST:
                continue
            at = m.start("names")
            for word in words:
                if not any(a < at + len(word) and at < b for a, b in taken):
                    found.append(Entity(at, at + len(word), "name", word))
                    taken.append((at, at + len(word)))
                    if word not in _FIRST and len(word) > 2:
                        surnames.add(word)
                at += len(word) + 1
        if surnames:  # the same people by surname alone
            for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, sorted(surnames)))})\b", text):
                if not any(a < m.end() and m.start() < b for a, b in taken):
                    found.append(Entity(m.start(), m.end(), "name", m[0]))
    return sorted(found, key=lambda e: e.start)


def surrogate(kind: str, normal: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate of a normal form. First names that draw anew become double names of their gender
    and script. After many attempts in a crowded shape other surrogates grow by characters."""
    if attempt and kind == "name" and normal in _FIRST:
        return _double_name(normal, key, f"{kind}|{attempt}")
    if attempt >= 8 and kind == "name":
        return _name(normal + normal[-1] * (attempt // 8), key, f"{kind}|{attempt}")
    if attempt >= 8 and kind in ("email", "secret"):
        return MAKERS[kind](chr(ord("a") + attempt % 26) + normal, key, f"{kind}|{attempt}")
    return MAKERS[kind](normal, key, f"{kind}|{attempt}")


def replaced(text: str, key: bytes, exceptions: Mapping[tuple[str, str], str]) -> tuple[str, int]:
    """A text with surrogates, and how many."""
    out, last, found = [], 0, entities(text)
    for e in found:
        new = exceptions.get((e.kind, e.normal)) or surrogate(e.kind, e.normal, key)
        mention = text[e.start : e.end]
        out += [text[last : e.start], new if e.kind == "ip" or mention in _FIRST else like(mention, new)]
        last = e.end
    return "".join([*out, text[last:]]), len(found)


def find(texts: DataFrame, key: bytes) -> DataFrame:
    """(node, kind, normal, drawn) of each entity of each text ``(node, text)``."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        got = [
            (node, kind, normal, surrogate(kind, normal, key))
            for node, text in zip(rows.column("node").to_pylist(), rows.column("text").to_pylist())
            for kind, normal in sorted({(e.kind, e.normal) for e in entities(text or "")})
        ]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
        columns = zip(*got) if got else ([], [], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["node", "kind", "normal", "drawn"]
        )

    return arrow_map(texts, batch, "node long, kind string, normal string, drawn string")


def _of_full_shapes(known: DataFrame) -> DataFrame:
    """(kind, normal, drawn) for entities of shapes in which (nearly) every value occurs.

    Their first surrogates are one to one, and no other entity has them, so they are
    kept; the few that stand for themselves change places with each other and one more.
    """
    known = materialize(known.select("kind", "normal", "drawn"))
    alone = known.filter("drawn = normal")
    one = known.filter("drawn != normal").groupBy("kind").agg(F.min(F.struct("normal", "drawn")).alias("x"))
    circle = alone.union(one.join(alone.select("kind").distinct(), "kind").select("kind", "x.*"))
    # about one value of a shape stands for itself
    order = Window.partitionBy("kind").orderBy("normal")
    ends = Window.partitionBy("kind")
    turned = circle.select(
        "kind", "normal", F.coalesce(F.lead("drawn").over(order), F.min_by("drawn", "normal").over(ends)).alias("drawn")
    )
    turned = materialize(turned)
    return known.join(turned.select("kind", "normal"), ["kind", "normal"], "left_anti").union(turned)


def redrawn(known: DataFrame, key: bytes) -> DataFrame:
    """(kind, normal, drawn): new surrogates for the entities ``(kind, normal, drawn)`` whose
    own is an original of the corpus or another one's surrogate. Where a finite shape (all of
    one private network) occurs so fully that ``ROUNDS`` draws find nothing free, surrogates
    are distinct still but may be values of others."""
    originals = known.select("kind", F.col("normal").alias("drawn"))
    clashing = materialize(known.join(originals, ["kind", "drawn"], "left_semi").select("kind", "normal"))
    done = None
    taken = known.select("kind", "drawn").union(originals)
    attempt = 1
    while clashing.limit(1).count():

        def batch(rows: pa.RecordBatch, attempt=attempt) -> dict:
            pairs = zip(rows.column("kind").to_pylist(), rows.column("normal").to_pylist())
            new = [surrogate(kind, normal, key, attempt) for kind, normal in pairs]
            return {"kind": rows.column("kind"), "normal": rows.column("normal"), "drawn": pa.array(new, pa.string())}

        drawn = materialize(arrow_map(clashing, batch, "kind string, normal string, drawn string"))
        free = drawn.join(taken, ["kind", "drawn"], "left_anti")
        won = materialize(free.groupBy("kind", "drawn").agg(F.min("normal").alias("normal")).select("kind", "normal", "drawn"))
        left = materialize(clashing.join(won.select("kind", "normal"), ["kind", "normal"], "left_anti"))
        release(clashing, drawn)
        clashing = left
        taken = taken.union(won.select("kind", "drawn"))
        done = won if done is None else done.union(won)
        attempt += 1
        if attempt > ROUNDS:
            full = _of_full_shapes(known.join(clashing, ["kind", "normal"], "left_semi"))
            done = full if done is None else done.union(full)
            break
    return known.limit(0).select("kind", "normal", "drawn") if done is None else done


def anonymise(documents: DataFrame, key: bytes = KEY, text: str = "text", counted: bool = False) -> DataFrame:
    """The documents with surrogates in their text; with ``counted`` also ``n_entities``."""
    _other_classes()
    texts = documents.select(F.xxhash64(text).alias("node"), F.col(text).alias("text"))
    found = materialize(find(texts, key).distinct())
    known = materialize(found.select("kind", "normal", "drawn").distinct())
    exceptions = redrawn(known, key)
    by_text = found.select("node", "kind", "normal").join(exceptions, ["kind", "normal"])
    by_text = materialize(by_text.groupBy("node").agg(F.collect_list(F.struct("kind", "normal", "drawn")).alias("odd")))
    columns = documents.columns
    row = documents.select(F.struct(*columns).alias("row"), F.xxhash64(text).alias("node"))
    with_odd = row.join(broadcast_if_small(by_text), "node", "left").select("row", "odd")
    place = columns.index(text)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        fields = rows.column("row").flatten()
        out, numbers = [], []
        for value, odd in zip(fields[place], rows.column("odd")):
            value, odd = value.as_py(), odd.as_py() or []
            new, n = (None, 0) if value is None else replaced(value, key, {(x["kind"], x["normal"]): x["drawn"] for x in odd})
            out.append(new)
            numbers.append(n)
        fields[place] = pa.array(out, pa.string())
        names = list(columns)
        if counted:
            fields.append(pa.array(numbers, pa.int64()))
            names.append("n_entities")
        return pa.RecordBatch.from_arrays(fields, names=names)

    schema = documents.select(*columns, *([F.lit(0).cast("long").alias("n_entities")] if counted else [])).schema
    return arrow_map(with_odd, batch, schema)


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), counted=True)


QUERIES = {"op2_surrogates": (op2_surrogates, None)}

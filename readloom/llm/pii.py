"""Surrogates for personal data: keyed, of the same type, gender, script and format, distinct and coreferent.

An entity is a type and a normal form, so that spellings of one number or address are one entity.  Names are found
after titles; further mentions of them in the same document, without a title, are the same entities.  The gender of a
given name is the one that most titles before it tell in the whole corpus, else what its last letter suggests.

A surrogate is a keyed function of entity, gender and attempt.  Attempt 0 and the suggested gender are right for almost
all; the collision check, over all distinct entities of the corpus, finds those whose surrogate another entity has too
or is itself an entity of the corpus (given names and surnames taken together), and moves all but one on to their next
attempt until none is left.  Only these exceptions are kept as a table.  Up to FEW go with every task; more meet their
documents in a join.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from functools import cache
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import join_groups, small_batches, stored, texts_of

#: Titles that tell gender (None: they don't), before names.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": None, "Prof": None, "Herr": "m", "Frau": "f", "M": "m", "Mme": "f", "Mlle": "f", "Sr": "m", "Sra": "f", "Señor": "m", "Señora": "f", "г-н": "m", "г-жа": "f"}
GIVEN = {
    ("latin", "f"): "Ada Berta Clara Dora Edith Flora Greta Hilda Irma Julia Karin Lena Marta Nora Olga Paula Rosa Sofia Tina Ursula Vera Wanda".split(),
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Konrad Leo Martin Noah Oscar Paul Ralph Simon Tomas Uwe Victor Walter".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Зоя Ирина Ксения Лидия Мария Нина Ольга Полина".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел".split(),
    ("greek", "f"): "Άννα Δήμητρα Ειρήνη Ζωή Θάλεια Καλλιόπη Μαρία Νίκη Ουρανία Σοφία Φανή Χλόη".split(),
    ("greek", "m"): "Άγγελος Βασίλης Γιώργος Δημήτρης Ηλίας Θάνος Κώστας Λεωνίδας Μάνος Νίκος Πέτρος Στέλιος".split(),
}
SYLLABLES = {
    "latin": "ba be bo da del den dor el fa fen ga gor ha hel in ka ker la lin lo ma mel mor na nel no or pa per ra ren ro sa sel sor ta ten tor va vel ven wa win za".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до за ка ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то".split(),
    "greek": "βα βε βο γα γε γο δα δε δο ζα ζε κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε το".split(),
}
#: Ends of given names: those that suggest a woman, and those that made-up names get.
FEMALE = "aeаяαηά"
ENDS = {("latin", "f"): "a", ("latin", "m"): "n", ("cyrillic", "f"): "а", ("cyrillic", "m"): "н", ("greek", "f"): "α", ("greek", "m"): "ς"}
#: Fixed by the international numbering plan: country codes of one and of two digits; all others have three.
ONE, TWO = "17", "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Exceptions that go with every task.
FEW = 50_000
NAME_KINDS = ("given", "surname")
_titles = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
_name = r"[^\W\d_][^\W\d_'’-]+(?:[-'’][^\W\d_]+)*"
PATTERNS: list[tuple[str, re.Pattern]] = [
    ("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("card", re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+(?!1)\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("ip6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")),
    ("ip", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)")),
]
NAMES = re.compile(rf"(?<!\w)({_titles})\.? ({_name})(?: ({_name}))?")
HAS_TITLE = re.compile(rf"(?<!\w)(?:{_titles})\.? [^\W\d_]").search
HAS_DIGIT = re.compile(r"\d").search
WORDS = re.compile(_name).finditer
PARTS = re.compile("([-'’])").split
POSSESSED = re.compile("['’](?=\\w+$)").split


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_check(plain: str) -> int:
    """98 minus the remainder of the rearranged account number: the two check digits when they are 00."""
    return 98 - int("".join(str(int(c, 36)) for c in plain[4:] + plain[:2] + "00")) % 97


def normal(kind: str, text: str) -> str:
    if kind == "phone" and not text.startswith("+"):
        return "+1" + re.sub(r"\D", "", text)  # the national form of numbers of country code 1
    if kind in ("card", "phone", "ssn"):
        return ("+" if text.startswith("+") else "") + re.sub(r"\D", "", text)
    if kind == "ip6":
        return ipaddress.IPv6Address(text).exploded
    return text.replace(" ", "") if kind == "iban" else text.lower() if kind == "email" else text.casefold() if kind in NAME_KINDS else text


def _valid(kind: str, text: str) -> bool:
    if kind == "card":
        return luhn(re.sub(r"\D", "", text))
    if kind == "ip":
        return all(int(p) < 256 for p in text.split("."))
    if kind == "ip6":
        try:
            return int(ipaddress.IPv6Address(text)) > 0
        except ValueError:
            return False
    if kind == "iban":
        plain = text.replace(" ", "")
        return len(plain) <= 34 and int(plain[2:4]) == iban_check(plain)
    return True


def _capital(word: str) -> bool:
    return not word[0].islower()  # scripts without letter case have no other mark of a name


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of the entities of a text, in order, none within another; kinds earlier in PATTERNS win.

    gender is what the title before a given name tells (m, f or nothing).  Names that a title marks somewhere in the
    text are found wherever they stand in it as words that don't begin with a small letter.
    """
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray()

    def add(start: int, end: int, kind: str, gender: str = "") -> None:
        nonlocal taken
        taken = taken or bytearray(len(text))
        taken[start:end] = b"\1" * (end - start)
        found.append((start, end, kind, gender))

    digits = HAS_DIGIT(text) is not None
    for kind, pattern in PATTERNS:
        if kind == "email" and "@" not in text or kind == "ip6" and ":" not in text or kind not in ("email", "ip6") and not digits:
            continue
        for m in pattern.finditer(text):
            if _valid(kind, m[0]) and 1 not in taken[m.start() : m.end()]:
                add(*m.span(), kind)
    if HAS_TITLE(text):
        names: dict[str, str] = {}
        for m in NAMES.finditer(text):
            last = 3 if m[3] and _capital(m[3]) else 2
            if _capital(m[2]) and 1 not in taken[m.start() : m.end(last)]:
                if last == 3:
                    add(*m.span(2), "given", TITLES[m[1]] or "")
                    names.setdefault(normal("given", m[2]), "given")
                end = m.end(last) - 2 * m[last].endswith(("'s", "’s"))  # whose something is
                add(m.start(last), end, "surname")
                names[normal("surname", text[m.start(last) : end])] = "surname"
        if names:
            for m in WORDS(text):
                for end in {m.end(): 1, m.start() + len(POSSESSED(m[0])[0]): 1}:
                    kind = names.get(text[m.start() : end].casefold()) if _capital(m[0]) else None
                    if kind and 1 not in taken[m.start() : m.end()]:
                        add(m.start(), end, kind)
    return sorted(found)


def likely_gender(entity: str) -> str:
    return "f" if entity[-1:] in FEMALE else "m"


class Stream:
    """A stream of pseudo-random bytes: HMAC-SHA256 of the entity and attempt, in counter mode."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.block, self.data = key, "\x00".join(parts).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.data) < 4:
            self.data += hmac.digest(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256)
            self.block += 1
        value, self.data = int.from_bytes(self.data[:4], "big"), self.data[4:]
        return value % n


def _shape(s: str, stream: Stream) -> str:
    out = []
    for c in s:
        if c.isdigit():
            out.append(str(stream.below(10)))
        elif "a" <= c <= "z":
            out.append(chr(97 + stream.below(26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + stream.below(26)))
        else:
            out.append(c)
    return "".join(out)


@cache
def _alike(c: str) -> str:
    """Letters of the script of c, of the same kind, near it in the code table."""
    script, kind = unicodedata.name(c, "?").split()[0], unicodedata.category(c)
    near = map(chr, range(ord(c) & ~127, (ord(c) & ~127) + 128))
    return "".join(x for x in near if unicodedata.category(x) == kind and unicodedata.name(x, "").split(" ")[0] == script)


def _name_part(part: str, kind: str, gender: str, attempt: int, stream: Stream) -> str:
    script = next((x for x, signs in (("cyrillic", "[Ѐ-ӿ]"), ("greek", "[Ͱ-Ͽἀ-῿]"), ("latin", "[a-zß-ɏ]")) if re.search(signs, part)), None)
    if script is None:  # as many letters of its script, with the attempts some more
        return "".join((a := _alike(c))[stream.below(len(a))] if _alike(c) else c for c in part + part[-1] * (attempt // 4))
    parts = SYLLABLES[script]
    if kind == "given":
        if attempt < 4:
            names = GIVEN[script, gender]
            return names[stream.below(len(names))].casefold()
        return "".join(parts[stream.below(len(parts))] for _ in range(2 + attempt // 8)) + ENDS[script, gender].casefold()
    end = "" if script != "cyrillic" else "ва" if part.endswith("а") else "в"
    return "".join(parts[stream.below(len(parts))] for _ in range(3 + attempt // 4)) + end


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0, gender: str = "") -> str:
    """The surrogate's normal form for an entity's normal form; of a given name, with the gender (none: the likely one)."""
    stream = Stream(key, kind, entity, str(attempt))
    if kind == "email":
        local, domain = entity.rsplit("@", 1)
        # One domain is one surrogate domain for all its addresses; the top-level domain is kept.
        names, top = domain.rsplit(".", 1)
        return f"{_shape(local, stream)}@{_shape(names, Stream(key, 'domain', names))}.{top}"
    if kind == "phone":
        keep = 1 + (1 if entity[1] in ONE else 2 if entity[1:3] in TWO else 3)  # the country code stays
        return entity[:keep] + _shape(entity[keep:], stream)
    if kind == "ip6":
        groups = (g if g == "0000" else f"{1 + stream.below(65535):04x}" for g in entity.split(":"))
        return ":".join(groups)
    if kind == "card":
        body = entity[0] + _shape(entity[1:-1], stream)  # the first digit tells the issuer's branch
        return next(body + d for d in "0123456789" if luhn(body + d))
    if kind == "ssn":
        return f"{1 + stream.below(665):03d}{1 + stream.below(99):02d}{1 + stream.below(9999):04d}"
    if kind == "ip":
        return ".".join(str(1 + stream.below(254)) for _ in range(4))
    if kind == "iban":
        body = entity[:2] + "00" + _shape(entity[4:], stream)
        return f"{body[:2]}{iban_check(body):02d}{body[4:]}"
    gender = gender or likely_gender(entity)
    return "".join(p if i % 2 or not p else _name_part(p, kind, gender, attempt, stream) for i, p in enumerate(PARTS(entity)))


def _cased(value: str, like: str) -> str:
    """value with the letter case of like: all capitals, or capitals where like has them."""
    if like.isupper() and len(like) > 1:
        return value.upper()
    at = {min(i, len(value) - 1) for i, c in enumerate(like) if c.isupper()}
    value = "".join(c.upper() if i in at else c for i, c in enumerate(value))
    return value[:-1] + "ς" if value.endswith("σ") else value


def formatted(kind: str, value: str, like: str) -> str:
    """A surrogate's normal form, written as the entity was: separators, signs and letter case."""
    if kind in ("card", "phone", "ssn"):
        digits = iter(value.removeprefix("+1" if kind == "phone" and not like.startswith("+") else "+"))
        return "".join(next(digits, "") if c.isdigit() else c for c in like)
    if kind == "iban":
        signs = iter(value)
        return "".join(c if c == " " else next(signs, "") for c in like)
    if kind == "email":
        if like.isupper():
            return value.upper()
        return "".join(v.upper() if c.isupper() else v for v, c in zip(value, like, strict=False)) + value[len(like) :]
    if kind == "ip":
        return value
    if kind == "ip6":
        value = value if len(like) == 39 else ipaddress.IPv6Address(value).compressed
        return value.upper() if like.isupper() else value
    return "".join(_cased(v, x) for v, x in zip(PARTS(value), PARTS(like), strict=True))


def replaced(text: str, key: bytes, fixes: dict[tuple[str, str], tuple[int, str]]) -> tuple[str, list[str]]:
    """A text with its entities replaced, and their kinds; fixes holds attempt and gender of entities that need others."""
    out, at, kinds = [], 0, []
    for start, end, kind, _ in entities(text):
        entity = normal(kind, text[start:end])
        value = surrogate(key, kind, entity, *fixes.get((kind, entity), (0, "")))
        out += [text[at:start], formatted(kind, value, text[start:end])]
        at = end
        kinds.append(kind)
    return "".join([*out, text[at:]]), kinds


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, kind, entity, gender: the distinct entities of each row of docs(doc_id, text), with what titles tell."""
    names = ["doc_id", "kind", "entity", "gender"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in {(k, normal(k, t[s:e]), g) for s, e, k, g in entities(t)}]
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names)

    small_batches(docs.sparkSession)
    return texts_of(docs).mapInArrow(run, "doc_id long, kind string, entity string, gender string")


def with_gender(found: DataFrame) -> DataFrame:
    """kind, entity, gender of the distinct entities of mentions: of a given name, the gender that most mentions tell; else none."""
    told = F.sum(F.when(F.col("gender") == "f", 1).when(F.col("gender") == "m", -1).otherwise(0))
    sums = found.groupBy("kind", "entity").agg(told.alias("told"))
    return sums.select("kind", "entity", F.when(F.col("told") > 0, "f").when(F.col("told") < 0, "m").otherwise("").alias("gender"))


def _with_surrogates(rows: DataFrame, make: Callable[[str, str, int, str], str]) -> DataFrame:
    columns = ["kind", "entity", "attempt", "gender"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [make(*x) for x in zip(*(b.column(c).to_pylist() for c in columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(made, pa.string())], [*columns, "surrogate"])

    made = rows.select(*columns).mapInArrow(run, "kind string, entity string, attempt int, gender string, surrogate string")
    return made.withColumn("space", _space())


def _space() -> Column:
    """Kinds in which surrogates must differ from each other."""
    return F.when(F.col("kind").isin(*NAME_KINDS), "name").otherwise(F.col("kind"))


def assigned(found: DataFrame, make: Callable[[str, str, int, str], str], most: int = 200) -> DataFrame:
    """kind, entity, attempt, gender, surrogate of found(kind, entity, gender), distinct entities.

    Within a kind, and among names of both kinds, no surrogate is given twice and none is itself an entity.  All
    comparisons are joins or groupings on the surrogate.  The driver sees one count a round.
    """
    names = stored(found.select("kind", "entity", "gender").withColumn("space", _space()), "entities")
    real = names.select("space", F.col("entity").alias("surrogate"), F.lit(1).alias("real")).distinct()
    done: DataFrame | None = None
    todo = names.withColumn("attempt", F.lit(0))
    for _ in range(most):
        new = stored(_with_surrogates(todo, make).join(real, ["space", "surrogate"], "left"), "attempts")
        winners = new.where("real is null").groupBy("space", "surrogate").agg(F.min(F.struct("kind", "entity")).alias("first"))
        if done is not None:
            winners = winners.join(done.select("space", "surrogate"), ["space", "surrogate"], "left_anti")
        winners = winners.select("space", "surrogate", "first.kind", "first.entity")
        good = new.drop("real").join(winners, ["space", "surrogate", "kind", "entity"], "left_semi")
        good = stored(good, "assigned")
        todo = new.join(good, ["kind", "entity"], "left_anti").select("kind", "entity", "gender", (F.col("attempt") + 1).alias("attempt"))
        done = good if done is None else done.unionByName(good)
        if todo.isEmpty():
            return done.drop("space")
    raise ValueError(f"entities without a surrogate of their own after {most} attempts")


def pseudonymised(docs: DataFrame, key: bytes, make: Callable[[str, str, int, str], str] | None = None, few: int = FEW) -> DataFrame:
    """Replace the personal data of every whole text of docs(doc_id, text).

    Returns doc_id, text, n_entities, kinds (comma-joined, in order).  One row per row; repeated rows get equal texts;
    a null text counts as empty; a text without entities is unchanged; an empty table gives no rows.  Equal entities
    get equal surrogates in all documents, different ones different ones.
    """
    make = make or (lambda kind, entity, attempt, gender: surrogate(key, kind, entity, attempt, gender))
    found = stored(mentions(docs), "mentions")
    likely = F.when(F.substring("entity", -1, 1).isin(*FEMALE), "f").otherwise("m")
    other = assigned(with_gender(found), make).where((F.col("attempt") > 0) | (F.col("gender") != "") & (F.col("gender") != likely))
    other = stored(other.select("kind", "entity", "attempt", "gender"), "exceptions")
    texts, known = texts_of(docs), {}
    if other.count() <= few:
        known = {(r.kind, r.entity): (r.attempt, r.gender) for r in other.collect()}
        rows = texts.withColumn("fixes", F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int,gender:string>>"))
    else:
        often = found.groupBy("kind", "entity").agg(F.count("*").alias("df"))
        keyed = other.join(often, ["kind", "entity"]).select(F.struct("kind", "entity").alias("key"), "attempt", "gender", "df")
        met = join_groups(found.select("doc_id", F.struct("kind", "entity").alias("key")).distinct(), stored(keyed, "frequent-exceptions"), "key", "df", found.count()).where("attempt is not null")
        fixes = met.groupBy("doc_id").agg(F.collect_set(F.struct(F.col("key.kind").alias("kind"), F.col("key.entity").alias("entity"), "attempt", "gender")).alias("fixes"))
        rows = texts.join(fixes.withColumnRenamed("doc_id", "_id"), texts["doc_id"].eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "fixes")
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, kinds = [], [], []
            for text, fixes in zip(b.column("text").to_pylist(), b.column("fixes").to_pylist(), strict=True):
                new, of = replaced(text, key, shared.value if fixes is None else {(f["kind"], f["entity"]): (f["attempt"], f["gender"]) for f in fixes})
                texts.append(new)
                n.append(len(of))
                kinds.append(",".join(of))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(kinds, pa.string())], ["doc_id", "text", "n_entities", "kinds"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_entities", T.LongType()), T.StructField("kinds", T.StringType())])
    return rows.mapInArrow(run, schema)

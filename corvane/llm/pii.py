"""Surrogates for personal data: keyed, of the same type, format, script and gender, one to one."""

from __future__ import annotations

import hashlib
import random
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, settle, spread

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Titles that tell the gender of the name after them, and given names that need no title.
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "госпожа"]
TITLES_M = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин"]
GIVEN = {
    "latin f": [
        "Anna", "Maria", "Laura", "Julia", "Sophie", "Emma", "Elena", "Claire", "Lucia", "Marta", "Helen", "Alice",
        "Sarah", "Emily", "Charlotte", "Katharina", "Isabelle", "Camille", "Carmen", "Teresa", "Ingrid", "Margaret", "Elizabeth", "Susan",
    ],
    "latin m": [
        "John", "Peter", "Paul", "Thomas", "Lucas", "Martin", "David", "Pierre", "Carlos", "Hans", "Miguel", "James",
        "Robert", "William", "Michael", "Daniel", "Stefan", "Andreas", "Antoine", "Olivier", "Javier", "Fernando", "Henrik", "George",
    ],
    "cyrillic f": ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана", "Екатерина", "Людмила"],
    "cyrillic m": ["Иван", "Пётр", "Сергей", "Алексей", "Михаил", "Андрей", "Дмитрий", "Николай", "Владимир", "Александр"],
}
_NAME = r"\p{Lu}\p{Ll}{1,30}(?:-\p{Lu}\p{Ll}{1,30})?"
#: type -> pattern. The order is that of the alternation: at one place, the first that matches wins. Every repeated
#: group is bounded (a domain has 127 labels at most), as Java's matcher takes stack for each turn of one.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})|\([0-9]{2,4}\))(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "local_phone": r"(?<![0-9-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "name": rf"(?<!\p{{L}})(?:(?:{'|'.join(TITLES_F + TITLES_M)})\.? {_NAME}(?: {_NAME})?|(?:{'|'.join(n for g in GIVEN.values() for n in g)}) {_NAME})(?!\p{{L}})",
}
EVERY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A cheap test that every text with an entity passes.
QUICK = rf"@|[0-9][0-9. -]{{5}}|\+[0-9]|\([0-9]{{2,4}}\)|[A-Z]{{2}}[0-9]{{2}}|(?<!\p{{L}})(?:{'|'.join(TITLES_F + TITLES_M + [n for g in GIVEN.values() for n in g])})[. ]"
#: Character classes; each is permuted by itself, so a surrogate has the shape of what it stands for. Chunk lengths
#: keep a half of a chunk, times a class size, within a long.
CLASSES = {
    "digit": ("0123456789", 16),
    "vowel": ("aeiou", 16),
    "consonant": ("bcdfghjklmnpqrstvwxyz", 10),
    "accented": ("áàâäãéèêëíìîïóòôöõúùûü", 10),
    "other": ("çñßšžýœæøåłśćńđþ", 10),
    "cyr_vowel": ("аеёиоуыэюя", 12),
    "cyr_consonant": ("бвгджзйклмнпрстфхцчшщъь", 10),
}
_LETTERS = [c for c in CLASSES if c != "digit"]
ROUNDS = 6


def _noise(key: str, tag: Column, n: Column, i: Column, x: Column) -> Column:
    """A keyed number of 60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tag, n, i, x), 256), 1, 15), 16, 10).cast("long")


def permuted_text(text: Column, alphabet: Column, most: Column, key: str, tag: Column) -> Column:
    """A keyed permutation of all strings of one length over the alphabet, in chunks of at most ``most`` characters.

    A Feistel network over the halves of a chunk, read as numbers: each round adds a keyed number of one half to the
    other, which can be undone. Between going there and back a keyed number other than zero is added to the whole, so
    two strings never meet and no chunk stays as it is.
    """
    base = F.length(alphabet).cast("long")

    def number(s: Column) -> Column:
        return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a * base + F.instr(alphabet, c) - 1))

    def string(x: Column, n: Column) -> Column:
        place = lambda k: F.floor(x / F.pow(base.cast("double"), n - k)) % base
        return F.when(n == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substring(alphabet, place(k).cast("int") + 1, F.lit(1))), ""))

    def one(c: Column) -> Column:
        n = F.length(c)
        left = F.floor(n / F.lit(2)).cast("int")
        size = lambda k: F.round(F.pow(base.cast("double"), k)).cast("long")
        start = F.struct(number(F.substring(c, F.lit(1), left)).alias("a"), number(F.substring(c, left + 1, n)).alias("b"))

        def turn(s: Column, i: Column, sign: int) -> Column:
            even = i % 2 == 0
            a = F.when(even, F.pmod(s.a + sign * (_noise(key, tag, n, i, s.b) % size(left)), size(left))).otherwise(s.a)
            b = F.when(even, s.b).otherwise(F.pmod(s.b + sign * (_noise(key, tag, n, i, s.a) % size(n - left)), size(n - left)))
            return F.struct(a.alias("a"), b.alias("b"))

        def moved(s: Column) -> Column:
            low, every = size(n - left), size(n)
            step = 1 + _noise(key, tag, n, F.lit(-1), F.lit(0)) % (every - 1)
            to = lambda v: F.struct(F.round((v - v % low) / low).cast("long").alias("a"), (v % low).alias("b"))
            return F.element_at(F.transform(F.array((s.a * low + s.b + step) % every), to), 1)

        last = 2 * ROUNDS - 1
        there = F.aggregate(F.sequence(F.lit(0), F.lit(last)), start, lambda s, i: turn(s, i, 1), moved)
        return F.aggregate(F.sequence(F.lit(last), F.lit(0)), there, lambda s, i: turn(s, i, -1), lambda s: F.concat(string(s.a, left), string(s.b, n - left)))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / most).cast("int")), lambda k: F.substring(text, k * most + 1, most))
    return F.when(F.length(text) == 0, "").otherwise(F.array_join(F.transform(chunks, one), ""))


def _only(s: Column, alphabet: str) -> Column:
    return F.regexp_replace(F.lower(s), f"[^{alphabet}]", "")


def _parts(s: Column, classes: list[str], tag: str) -> list[Column]:
    """What permuted_text() takes for the characters of each class of s."""
    return [F.struct(_only(s, CLASSES[c][0]).alias("s"), F.lit(CLASSES[c][0]).alias("of"), F.lit(CLASSES[c][1]).alias("most"), F.lit(f"{tag}/{c}").alias("tag")) for c in classes]


def _permuted(parts: Column, key: str) -> Column:
    return F.transform(parts, lambda x: permuted_text(x.s, x.of, x.most, key, x.tag))


def _woven(s: Column, classes: list[str], parts: Column, first: int = 1) -> Column:
    """s with the characters of each class taken from parts, in order; case and all other characters stay in place."""

    def char(i: Column) -> Column:
        c = F.substring(s, i, F.lit(1))
        low, out = F.lower(c), c
        for j, name in enumerate(classes):
            at = F.length(_only(F.substring(s, F.lit(1), i), CLASSES[name][0]))
            new = F.substring(F.element_at(parts, first + j), at, F.lit(1))
            out = F.when(low.rlike(f"[{CLASSES[name][0]}]"), F.when(c == low, new).otherwise(F.upper(new))).otherwise(out)
        return out

    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), char), "")


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda over an array of one keeps it from being computed at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


@lru_cache
def _other_letters() -> list[list[str]]:
    """Letters of no class, by script and case; letters with both cases are listed in one of them."""
    held = {x for alphabet, _ in CLASSES.values() for c in alphabet for x in (c, c.upper())}
    out: dict[tuple[str, str], list[str]] = {}
    for c in map(chr, range(0x110000)):
        kind = unicodedata.category(c)
        if kind in ("Lu", "Ll") and c not in held:
            paired = len(c.swapcase()) == 1 and c.swapcase() != c and c.swapcase().swapcase() == c and c.swapcase() not in held
            if not paired or kind == "Ll":
                out.setdefault((unicodedata.name(c).split(" ")[0], "both" if paired else kind), []).append(c)
    return list(out.values())


def _turned(s: Column, key: str) -> Column:
    """s with each letter of no class replaced by another of its script and case, along one keyed ring of them."""
    there, back = [], []
    for letters in _other_letters():
        ring = list(letters)
        random.Random(hashlib.sha256(f"{key}|{''.join(letters)}".encode()).digest()).shuffle(ring)
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            both = len(a.swapcase()) == 1 == len(b.swapcase()) and a.swapcase().swapcase() == a != a.swapcase()
            there += [a, a.swapcase()] if both else [a]
            back += [b, b.swapcase()] if both else [b]
    return F.translate(s, "".join(there), "".join(back))


def _luhn(digits: Column) -> Column:
    """The check digit of the digits before it."""
    n = F.length(digits)
    worth = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return (10 - total % 10) % 10


def _filled(s: Column, digits: Column) -> Column:
    """s with its digits replaced in order."""
    at = lambda i: F.length(F.regexp_replace(F.substring(s, F.lit(1), i), "[^0-9]", ""))
    char = lambda d, i: F.when(F.substring(s, i, F.lit(1)).rlike("[0-9]"), F.substring(d, at(i), F.lit(1))).otherwise(F.substring(s, i, F.lit(1)))
    return F.element_at(F.transform(F.array(digits), lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: char(d, i)), "")), 1)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _check_digit(d: Column, body: Column) -> Column:
    """A card number of body, whose last digit is as far from the right check digit as that of d was: valid stays valid."""
    n = F.length(d)
    off = (F.substring(d, n, F.lit(1)).cast("int") - _luhn(F.substring(d, F.lit(1), n - 1)) + 10) % 10
    return _bound(body, lambda b: F.concat(b, ((_luhn(b) + off) % 10).cast("string")))


def _ip(s: Column, key: str) -> Column:
    """Halves of 16 bits there and back through the same kind of network: every result is another address."""
    o = lambda i: F.split_part(s, F.lit("."), F.lit(i)).cast("long")
    half, every, tag, four = 1 << 16, 1 << 32, F.lit("ip"), F.lit(4)
    start = F.struct((o(1) * 256 + o(2)).alias("a"), (o(3) * 256 + o(4)).alias("b"))
    there = lambda x, i: F.struct(x.b.alias("a"), ((x.a + _noise(key, tag, four, i, x.b) % half) % half).alias("b"))
    back = lambda x, i: F.struct(F.pmod(x.b - _noise(key, tag, four, i, x.a) % half, F.lit(half)).alias("a"), x.a.alias("b"))
    step = 1 + _noise(key, tag, four, F.lit(-1), F.lit(0)) % (every - 1)
    cut = lambda v: F.struct(F.floor(v / F.lit(half)).alias("a"), (v % half).alias("b"))
    moved = lambda x: F.element_at(F.transform(F.array((x.a * half + x.b + step) % every), cut), 1)
    done = lambda x: F.concat_ws(".", F.floor(x.a / F.lit(256)), x.a % 256, F.floor(x.b / F.lit(256)), x.b % 256)
    return F.aggregate(F.sequence(F.lit(5), F.lit(0)), F.aggregate(F.sequence(F.lit(0), F.lit(5)), start, there, moved), back, done)


def _check97(chars: Column, country: Column) -> Column:
    """The check number of an account: 98 less the rest by 97 of the account, the country and two zeros, letters as 10 to 35."""
    worth = lambda a, c: F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return 98 - F.aggregate(F.split(F.concat(chars, country, F.lit("00")), ""), F.lit(0), worth)


def _iban(s: Column, account: Column) -> Column:
    """s with another account; the check number is as far from the right one as it was: valid stays valid."""
    country, bare = F.substring(s, 1, 2), lambda x: F.replace(x, F.lit(" "), F.lit(""))
    off = F.substring(s, 3, 2).cast("int") - _check97(bare(F.substring(s, F.lit(5), F.length(s))), country)
    return _bound(account, lambda new: F.concat(country, F.lpad(F.pmod(_check97(bare(new), country) + off, F.lit(100)).cast("string"), 2, "0"), new))


def _given(s: Column, key: str) -> Column:
    """A known given name becomes another of its script and gender, by a keyed rotation of the list; else null."""
    turned: list[Column] = []
    for group, names in GIVEN.items():
        turn = int(hashlib.sha256(f"{key}|{group}".encode()).hexdigest(), 16) % (len(names) - 1) + 1
        for i, name in enumerate(names):
            turned += [F.lit(name), F.lit(names[(i + turn) % len(names)])]
    return F.try_element_at(F.create_map(*turned), s)


def _name(s: Column, key: str) -> Column:
    """Title kept, so the gender is; known given names within their list, other words by their letters.

    The last letter of a word of four or more stays, as it tells the gender in many languages; shorter words change
    throughout. A word that would become a known given name goes through the permutation once more, which keeps
    unknown words one to one.
    """
    known = [n for g in GIVEN.values() for n in g]

    def letters(w: Column) -> Column:
        def once(x: Column) -> Column:
            moving = F.length(x) - F.when(F.length(x) > 3, 1).otherwise(0)
            head = F.substring(x, F.lit(1), moving)
            new = _bound(_permuted(F.array(*_parts(head, _LETTERS, "name")), key), lambda p: _woven(head, _LETTERS, p))
            return F.concat(_turned(new, key), F.substring(x, moving + 1, F.length(x)))

        return F.aggregate(F.sequence(F.lit(0), F.lit(1)), w, lambda x, i: F.when((i == 0) | x.isin(known), once(x)).otherwise(x))

    def word(w: Column) -> Column:
        return F.when(F.regexp_replace(w, r"\.$", "").isin(TITLES_F + TITLES_M), w).when(w.isin(known), _given(w, key)).otherwise(letters(w))

    return F.array_join(F.transform(F.split(s, " "), word), " ")


def kind_of(s: Column) -> Column:
    out = F.lit("name")
    for name, pattern in reversed([(k, p) for k, p in PATTERNS.items() if k != "name"]):
        out = F.when(s.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def surrogate(kind: Column, s: Column, key: str) -> Column:
    """One to one within a kind and a format; formats of different shape never meet, as the shape is kept.

    Of an email the local part and the domain are replaced each by itself, so one domain stays one domain, and the
    top-level domain is kept; of an iban and a phone the country, of a card the first digit and whether it is valid.
    """
    mixed = ["digit", "vowel", "consonant"]
    local, domain = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
    top = F.substring_index(domain, ".", -1)
    rest = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    account = F.substring(s, F.lit(5), F.length(s))
    d = _digits(s)
    n = F.length(d)
    country = F.when(s.startswith("+"), F.length(_digits(F.regexp_extract(s, r"^\+[0-9]{1,3}", 0)))).otherwise(F.lit(0))
    alphabet, most = map(F.lit, CLASSES["digit"])
    digits = lambda x, tag: F.array(F.struct(x.alias("s"), alphabet.alias("of"), most.alias("most"), F.lit(tag).alias("tag")))
    parts = (
        F.when(kind == "email", F.array(*_parts(local, mixed, "local"), *_parts(rest, mixed, "domain")))
        .when(kind == "iban", F.array(*_parts(account, mixed, "iban")))
        .when(kind == "phone", digits(F.substring(d, country + 1, n), "phone"))
        .when(kind.isin("ssn", "local_phone"), digits(d, "number"))
        .when(kind == "card", digits(F.substring(d, F.lit(2), n - 2), "card"))
    )

    def whole(p: Column) -> Column:
        one = F.element_at(p, 1)
        number = F.when(kind == "card", _check_digit(d, F.concat(F.substring(d, 1, 1), one))).when(kind == "phone", F.concat(F.substring(d, F.lit(1), country), one)).otherwise(one)
        return (
            F.when(kind == "email", F.concat(_woven(local, mixed, p), F.lit("@"), _woven(rest, mixed, p, 4), F.lit("."), top))
            .when(kind == "iban", _iban(s, _woven(account, mixed, p)))
            .otherwise(_filled(s, number))
        )

    return F.when(kind == "ip", _ip(s, key)).when(kind == "name", _name(s, key)).otherwise(_bound(_permuted(parts, key), whole))


def _alone(entities: Column) -> Column:
    """A pattern of the words of the names among the entities, without titles, each as a whole word; null without names."""
    bare = lambda w: F.regexp_replace(w, r"\.$", "").isin(TITLES_F + TITLES_M)
    words = F.flatten(F.transform(F.filter(entities, lambda s: kind_of(s) == "name"), lambda s: F.filter(F.split(s, " "), lambda w: ~bare(w))))
    longest = lambda a, b: F.length(b) - F.length(a)  # noqa: E731  a double name comes before its first half
    found = F.array_sort(F.array_distinct(words), longest)
    return F.when(F.size(found) > 0, F.concat(F.lit(r"(?<!\p{L})(?=\p{Lu})(?:"), F.array_join(found, "|"), F.lit(r")(?!\p{L})")))


def surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, entities (array of kind, entity, surrogate, in order), text, distinct_kept.

    text has every entity replaced, and every word of a name found in the document wherever else it stands in it, by
    the same word. The surrogate of an entity hangs on the key and the entity alone, so an entity is the same person in
    every document, whatever the partitioning, and no table of all entities is needed: the maps are permutations
    without fixed points, and two entities of a kind never get one surrogate. distinct_kept checks just that within
    the document; checked() checks it over all of them. A null text stays null and has no entities; whole texts are
    searched. Repeated rows get equal answers. An empty table gives an empty one. An empty key is an error. No shuffle.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    rows = spread(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("t")))
    hit = F.col("t").rlike(QUICK)
    found = rows.withColumn("m", F.when(hit, F.regexp_extract_all("t", F.lit(EVERY), F.lit(0))))
    held = found.withColumn("x", F.concat(F.lit(EVERY + "|"), _alone(F.col("m"))))
    named = F.col("x").isNotNull()
    cut = held.withColumns({
        "m": F.when(named, F.regexp_extract_all("t", "x", F.lit(0))).otherwise(F.col("m")),
        "g": F.when(named, F.split("t", F.col("x"))).when(F.size("m") > 0, F.split("t", EVERY)),
    })
    typed = cut.withColumn("e", F.transform("m", lambda s: F.struct(kind_of(s).alias("kind"), s.alias("entity"))))
    full = typed.withColumn("e", F.transform("e", lambda x: F.struct(x.kind.alias("kind"), x.entity.alias("entity"), surrogate(x.kind, x.entity, key).alias("surrogate"))))
    new = F.array_join(F.transform(F.arrays_zip("g", "e"), lambda x: F.concat(x.g, F.coalesce(x.e.surrogate, F.lit("")))), "")
    pairs = F.array_distinct(F.transform("e", lambda x: F.struct(x.kind, x.entity)))
    fakes = F.array_distinct(F.transform("e", lambda x: F.struct(x.kind, x.surrogate)))
    none = F.array().cast("array<struct<kind:string,entity:string,surrogate:string>>")
    return full.select(
        "doc_id",
        F.coalesce("e", none).alias("entities"),
        F.when(F.size("m") > 0, new).otherwise(F.col("t")).alias("text"),
        F.coalesce(F.size(pairs) == F.size(fakes), F.lit(True)).alias("distinct_kept"),
    )


def collisions(done: DataFrame) -> DataFrame:
    """surrogates() -> surrogates that stand for several entities of one kind: (kind, surrogate, entities). Empty."""
    each = done.select(F.explode_outer("entities").alias("x")).filter("x is not null")  # explode() would be tested on a second computation
    held = each.select("x.*").groupBy("kind", "surrogate", "entity").count()
    return held.groupBy("kind", "surrogate").agg(F.count("*").alias("entities")).filter("entities > 1")


def checked(done: DataFrame) -> DataFrame:
    """surrogates(), computed once and kept, when no two entities of any documents share one; else an error."""
    done = settle(done)
    twice = collisions(done).limit(3).collect()
    if twice:
        raise RuntimeError(f"surrogates that stand for several entities, for example {[(r['kind'], r['surrogate']) for r in twice]}")
    return done

"""Surrogates for personal data: keyed, consistent by type, distinct and coreferent.

Detected: e-mail addresses, phone numbers (international, in brackets, North American
with dashes, dots or spaces, national with a leading 0), IPv4 and IPv6 addresses, social
security numbers, Luhn-correct card numbers, IBANs, credentials (access keys, passwords
and tokens after their name, also "password is ...", long hex strings) and names after
an honorific, with later mentions of the same name in the text. A name without any
honorific in its text is not found.

A mention is first brought to its canonical form (digits of a number, lower case of an
address, an IBAN without spaces, ...): mentions that agree there are one entity. The
entity gets a keyed permutation of that form: digits by digits, letters by letters of
the same script. Being permutations (Feistel networks keyed with BLAKE2), they give
different entities different surrogates and the same entity the same one, in any task,
without a dictionary. The surrogate is then dressed like the mention: its spaces, marks,
case and, for phones, with or without country code. What makes a type valid is kept: a
Luhn-correct number stays so, an IBAN is right or wrong modulo 97 as it was, an address
stays public or private, a country code stays and an area code stays possible. The
domain of an e-mail address is permuted by itself, so colleagues share it. Names known
by gender move along a keyed ring of that gender; in others vowels become vowels and
consonants consonants. Honorifics, and so gender, stay. No surrogate equals its entity:
where a permutation has a fixed point the next key is taken.

A collision check over the whole corpus follows, in Spark: all entities are grouped by
kind and surrogate; where two share one, all but the first get a surrogate of the next
key and all are compared again, until none is shared.

Defined cases: null text stays null with no entities; empty text stays empty. Text
without entities is returned as it is. A null id changes nothing. Repeated rows are
treated alike. Texts of any length are read whole. Other columns pass through untouched;
a count whose name is already a column gets a trailing underscore.
"""

import hashlib
import ipaddress
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import stash

#: Key of the permutations where the caller gives none; rounds of each Feistel network; rounds of the collision check; entities in collision.
DEFAULT_KEY, ROUNDS, CHECKS, LOSERS = "surrogates-1", 6, 64, 100_000
KINDS = ("email", "secret", "iban", "ip", "ssn", "card", "phone", "name")
#: Honorifics by gender.
HONORIFICS = {"m": ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "M", "Señor", "Sr", "Don"), "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña"), "n": ("Dr", "Prof", "Mx")}
#: Given names that are swapped within their gender.
GIVEN = {
    "m": ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Paul", "Peter", "Hans", "Karl", "Stefan", "Jean", "Pierre", "Michel", "Louis", "José", "Juan", "Carlos", "Miguel"),
    "f": ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Anna", "Laura", "Ursula", "Monika", "Petra", "Marie", "Claire", "Sophie", "Julie", "María", "Carmen", "Ana", "Lucía"),
}
#: Country calling codes of one and of two digits; all others have three.
CALLING = {1: ("1", "7"), 2: ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")}
TITLES = sorted({h for hs in HONORIFICS.values() for h in hs} | {"mr", "mrs", "ms", "dr", "prof"}, key=lambda h: (-len(h), h))
#: Any honorific, by its first letter.
HONORIFIC = "|".join(rf"{x}(?<!\w{x})(?:" + "|".join(h[1:] for h in TITLES if h[0] == x) + ")" for x in sorted({h[0] for h in TITLES}))
#: Patterns by kind, first kinds first. Each starts with plain characters, so that a search skips ahead fast.
FOUND = {
    "email": r"\w(?<![\w.+-]\w)[\w.+-]*(?<=\w)@(?:[\w-]+\.)+[^\W\d_]{2,}(?!\w)",
    "secret": r"(?:AKIA(?<!\wAKIA)[0-9A-Z]{16}\b|\b(?:sk|pk|gh[po]|xox[abp])[-_][\w-]{16,}|(?i:(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key)\s?(?:[=:]\s?|is\s(?=[^\s,;]*[\d!@#$%^&*])))[^\s,;]{6,}(?<!\.)|[0-9a-f](?<!\w.)[0-9a-f]{31,}\b)",
    "iban": r"[A-Z](?<!\w.)[A-Z]\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"\d(?<![\w.]\d)\d{0,2}(?:\.\d{1,3}){3}(?![\w]|\.\d)|[0-9a-fA-F:](?<![\w:.].)[0-9a-fA-F:]*:[0-9a-fA-F:]*(?![\w:]|\.\d)",
    "ssn": r"\d(?<![\w.-]\d)\d\d-\d\d-\d{4}(?![\w-])",
    "card": r"[3-6](?<![\w.-]\d)\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])",
    "phone": r"[+(](?<![\w.+].)(?:(?<=\+)\d{1,3}[ .-]?\(|(?<=\())\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|\+(?<![\w.+].)(?:\d{7,15}|\d{1,3}(?:[ .-]\d{1,4}){2,6})(?!\w)|\d(?<![\w.+-]\d)(?:\d{2}([.-])\d{3}\1\d{4}|\d{2} \d{3} \d{4}|(?<=0)\d{2,4}[ /-]\d{5,8})(?!\w)",
    "name": r"(?:" + HONORIFIC + r")\.? [^\W\d_a-zà-öø-ÿ][^\W\d_]+(?: [^\W\d_a-zà-öø-ÿ][^\W\d_]+)?",
}
UPPER, LOWER, DIGITS, HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
VOWELS = "aeiou"
CONSONANTS = "".join(c for c in LOWER if c not in VOWELS)


class Cipher:
    """Keyed permutations of strings over small alphabets."""

    def __init__(self, key):
        self.key = key.encode()

    def number(self, tweak, *parts):
        return int.from_bytes(hashlib.blake2b("\x1f".join((tweak, *map(str, parts))).encode(), key=self.key[:64], digest_size=16).digest(), "big")

    def digits(self, values, radix, tweak):
        """A permutation of the lists of this length over range(radix)."""
        n = len(values)
        if n == 1:
            order = sorted(range(radix), key=lambda v: self.number(tweak, "one", v))
            return [order[values[0]]]
        half = n // 2
        left, right = list(values[:half]), list(values[half:])
        for i in range(ROUNDS):
            target, source = (left, right) if i % 2 == 0 else (right, left)
            add = self.number(tweak, n, i, ",".join(map(str, source)))
            for k in range(len(target) - 1, -1, -1):
                add, step = divmod(add + target[k], radix)
                target[k] = step
        return left + right

    def text(self, chars, alphabet, tweak):
        at = {c: i for i, c in enumerate(alphabet)}
        return [alphabet[v] for v in self.digits([at[c] for c in chars], len(alphabet), tweak)]

    def shaped(self, text, alphabets, tweak):
        """Characters of each alphabet are permuted among their places; other letters within their script's block."""
        out, groups = list(text), {}
        for i, c in enumerate(text):
            for a in alphabets:
                if c in a:
                    groups.setdefault(a, []).append(i)
                    break
            else:
                if c.isalpha() and block(c):
                    groups.setdefault(block(c), []).append(i)
        shape = "".join("x" if c.isalnum() else c for c in text)
        for a, places in groups.items():
            for i, c in zip(places, self.text([text[i] for i in places], a, f"{tweak}|{shape}|{a[:1]}{len(a)}"), strict=True):
                out[i] = c
        return "".join(out)


_BLOCKS = {}


def cased(c):
    """1 upper, 0 lower with a partner in its block of 128 code points, -1 without case, None for a letter that has case but no such partner."""
    other = c.swapcase()
    if other == c:
        return -1 if not c.isupper() and not c.islower() else None
    return int(c.isupper()) if len(other) == 1 and ord(other) // 128 == ord(c) // 128 else None


def block(c):
    """Letters of the same case near a letter: those of its 128 code points; none if it has to stay."""
    start, case = ord(c) // 128 * 128, cased(c)
    if (start, case) not in _BLOCKS:
        _BLOCKS[start, case] = "".join(x for x in map(chr, range(start, start + 128)) if x.isalpha() and cased(x) == case) if case is not None else ""
    return _BLOCKS[start, case]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def address_class(octets):
    a, b = octets[:2]
    if a == 10 or (a == 172 and 16 <= b < 32) or (a == 192 and b == 168):
        return "private"
    return "other" if a in (0, 127) or a >= 224 else "public"


class Surrogates:
    """Surrogate of a canonical entity. ``attempt`` above zero is for the losers of a collision."""

    def __init__(self, key):
        self.cipher, self.known = Cipher(key), {}

    def __call__(self, kind, entity, attempt=0):
        at = (kind, entity, attempt)
        if at not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            # Past a fixed point: keys that no attempt of the collision check takes.
            for k in range(1000):
                made = getattr(self, kind)(entity, f"{kind}{attempt}" + f"+{k}" * (k > 0))
                if made != entity:
                    break
            self.known[at] = made
        return self.known[at]

    def digits_of(self, digits, tweak, keep, good):
        """Permute all digits but the first ``keep``, walking on until ``good`` holds of them."""
        head, tail = digits[:keep], [int(c) for c in digits[keep:]]
        while True:
            tail = self.cipher.digits(tail, 10, f"{tweak}|{head}|{len(tail)}")
            made = head + "".join(map(str, tail))
            if good(made):
                return made

    def card(self, entity, tweak):
        return self.digits_of(entity, tweak, 1, luhn)

    def ssn(self, entity, tweak):
        # Areas 000, 666 and 9xx, group 00 and serial 0000 are never issued.
        issued = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        was = issued(entity)
        return self.digits_of(entity, tweak, 0, lambda d: issued(d) == was)

    def phone(self, entity, tweak):
        plus, digits = entity.startswith("+"), entity.lstrip("+")
        keep = calling_code(digits) if plus else 1
        firsts = [keep, keep + 3] if plus and digits[0] == "1" and len(digits) == 11 else [keep]
        possible = lambda d: all(d[i] not in ("01" if len(firsts) == 2 else "0") for i in firsts if i < len(d))
        was = possible(digits)
        return "+" * plus + self.digits_of(digits, tweak, keep, lambda d: possible(d) == was)

    def ip(self, entity, tweak):
        if ":" in entity:
            # The first group tells the kind of network; groups of zeros stay.
            groups = [int(g, 16) for g in entity.split(":")]
            places = [i for i in range(1, 8) if groups[i]]
            if places:
                made = self.cipher.digits([groups[i] - 1 for i in places], 65535, f"{tweak}|{groups[0]}|{places}")
                for i, v in zip(places, made, strict=True):
                    groups[i] = v + 1
            return ":".join(f"{g:04x}" for g in groups)
        octets = [int(x) for x in entity.split(".")]
        kind = address_class(octets)
        fixed = {"private": 1 + (octets[0] != 10), "other": 1}.get(kind, 0)
        tail = octets[fixed:]
        while True:
            tail = self.cipher.digits(tail, 256, f"{tweak}|{octets[:fixed]}")
            if address_class(octets[:fixed] + tail) == kind:
                return ".".join(map(str, octets[:fixed] + tail))

    def email(self, entity, tweak):
        user, _, domain = entity.rpartition("@")
        body, _, top = domain.rpartition(".")
        # Each part by itself, whatever the attempt for the domain: one domain, one surrogate.
        return f"{self.cipher.shaped(user, (LOWER, DIGITS), tweak)}@{self.cipher.shaped(body, (LOWER, DIGITS), 'domain')}.{top}"

    def iban(self, entity, tweak):
        body = self.cipher.shaped(entity[4:], (UPPER, DIGITS), tweak + entity[:2])
        off = (int(entity[2:4]) - right_check(entity[:2], entity[4:])) % 97
        check = right_check(entity[:2], body) + off
        return f"{entity[:2]}{check - 97 * (check > 98):02d}{body}"

    def secret(self, entity, tweak):
        head = re.match(r"AKIA|(?:sk|pk|gh[po]|xox[abp])[-_]|", entity)[0]
        value = entity[len(head) :]
        if value and all(c in HEX for c in value):
            return head + "".join(self.cipher.text(value, HEX, tweak))
        return head + self.cipher.shaped(value, (LOWER, UPPER, DIGITS), tweak)

    def name(self, entity, tweak):
        """One word of a name, in lower case."""
        for names in GIVEN.values():
            low = [n.lower() for n in names]
            if entity in low:
                ring = sorted(low, key=lambda v: self.cipher.number(tweak, v))
                return ring[(ring.index(entity) + 1) % len(ring)]
        made = entity
        while True:
            made = self.cipher.shaped(made, (VOWELS, CONSONANTS), tweak)
            if made not in LISTED:
                return made


LISTED = {n.lower() for names in GIVEN.values() for n in names}
FINDERS = {k: re.compile(p) for k, p in FOUND.items()}
HEAD = re.compile(r"(?i:(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key)\s?(?:[=:]\s?|is\s))[\"']?")
#: What a text must hold for a kind to be searched for.
LONG_NUMBER = re.compile(r"\d[\d ().:/-]{5,}\d")
WORDS = ("passw", "pwd", "passphrase", "secret", "token", "api_key", "api-key", "apikey", "akia", "sk-", "sk_", "pk-", "pk_", "ghp", "gho", "xox")
HEX_RUN = re.compile(r"\b[0-9a-f]{32}")


def calling_code(digits):
    """Length of the country code that the digits begin with."""
    return next((n for n, codes in CALLING.items() if digits.startswith(codes)), 3)


def right_check(country, body):
    """The check number that makes an IBAN right modulo 97."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97


def value_of(secret):
    """(head, value, tail) of a credential: its name and quotes apart."""
    head = HEAD.match(secret)
    head = head[0] if head else ""
    value = secret[len(head) :].rstrip("\"'")
    return head, value, secret[len(head) + len(value) :]


def canonical(kind, mention):
    """What makes two mentions the same entity."""
    if kind in ("email", "name"):
        return mention.lower()
    if kind == "secret":
        return value_of(mention)[1]
    if kind == "iban":
        return mention.replace(" ", "")
    if kind == "ip":
        return ipaddress.IPv6Address(mention).exploded if ":" in mention else ".".join(str(int(x)) for x in mention.split("."))
    digits = "".join(c for c in mention if c.isdigit())
    if kind == "phone":
        return f"+{digits}" if mention.startswith("+") else f"+1{digits}" if len(digits) == 10 and digits[0] != "0" else digits
    return digits


def dressed(kind, mention, made):
    """The surrogate of a mention's entity in the mention's format."""
    if kind == "secret":
        head, _, tail = value_of(mention)
        return head + made + tail
    if kind == "ip":
        return made if ":" not in made or len(mention) == 39 else ipaddress.IPv6Address(made).compressed
    if kind == "name":
        if len(made) != len(mention):
            return made.capitalize()
        return "".join(m.upper() if c.isupper() and len(m.upper()) == 1 else m for m, c in zip(made, mention, strict=True))
    if kind == "email":
        return made
    if kind == "iban":
        source = iter(made)
        return "".join(c if c == " " else next(source) for c in mention)
    count = sum(c.isdigit() for c in mention)
    source = iter([c for c in made if c.isdigit()][-count:])
    return "".join(next(source) if c.isdigit() else c for c in mention)


def credible(kind, mention):
    """Whether a match is an entity of its kind."""
    if kind == "card":
        return luhn([c for c in mention if c.isdigit()])
    if kind == "ip":
        try:
            ipaddress.ip_address(mention if ":" in mention else ".".join(str(int(x)) for x in mention.split(".")))
        except ValueError:
            return False
        return ":" not in mention or sum(c.isalnum() for c in mention) > 4
    if kind == "phone":
        return 7 <= sum(c.isdigit() for c in mention) <= 16
    if kind == "secret":
        return bool(value_of(mention)[1])
    return True


def entities(text):
    """(kind, begin, end) of the entities of a text, in order; names as single words, later mentions too."""
    found = []
    long_number = LONG_NUMBER.search(text) is not None
    low = text.lower()
    worded = any(w in low for w in WORDS) or HEX_RUN.search(text) is not None
    kinds = ["email"] * ("@" in text) + ["secret"] * worded + ["iban", "ip", "ssn", "card", "phone"] * long_number + ["ip"] * (not long_number and text.count(":") > 1) + ["name"]

    def free(b, e):
        return not any(x < e and b < y for _, x, y in found)

    names = set()
    for kind in kinds:
        for m in FINDERS[kind].finditer(text):
            if kind == "name":
                names.update(m[0].split(" ")[1:])
            elif free(m.start(), m.end()) and credible(kind, m[0]):
                found.append((kind, m.start(), m.end()))
    if names:
        mention = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, names), key=lambda n: (-len(n), n))) + r")(?!\w)")
        found += [("name", m.start(), m.end()) for m in mention.finditer(text) if free(m.start(), m.end())]
    return sorted(found, key=lambda x: x[1])


def _mentions(key):
    def run(batches):
        import pyarrow as pa

        make = Surrogates(key)
        for batch in batches:
            rows = {}
            for text in batch.column(0):
                text = text.as_py()
                if text:
                    for kind, b, e in entities(text):
                        entity = canonical(kind, text[b:e])
                        rows[kind, entity] = make(kind, entity)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([e for _, e in rows], pa.string()), pa.array(list(rows.values()), pa.string())], ["kind", "entity", "surrogate"])

    return run


def _again(key):
    def run(batches):
        import pyarrow as pa

        make = Surrogates(key)
        for batch in batches:
            kinds, names, attempts = (batch.column(i).to_pylist() for i in range(3))
            made = [make(k, e, a) for k, e, a in zip(kinds, names, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "entity", "attempt", "surrogate"])

    return run


def settled(texts: DataFrame, key: str) -> DataFrame:
    """(kind, entity, attempt, surrogate) of every entity of the corpus; no two of a kind share a surrogate."""
    found = texts.mapInArrow(_mentions(key), "kind string, entity string, surrogate string").distinct()
    now = stash(found.select("kind", "entity", F.lit(0).alias("attempt"), "surrogate"))
    place = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "entity"))
    for _ in range(CHECKS):
        ranked = now.withColumn("place", place)
        losers = ranked.where("place > 1")
        if losers.isEmpty():
            return now
        fresh = losers.select("kind", "entity", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_again(key), now.schema)
        now = stash(ranked.where("place = 1").drop("place").unionByName(fresh))
    raise ValueError("surrogates still collide; choose another key")


def resolved(texts: DataFrame, key: str) -> dict:
    """The attempts of entities that lost a collision: none as a rule, LOSERS at most."""
    rows = settled(texts, key).where("attempt > 0").limit(LOSERS + 1).collect()
    if len(rows) > LOSERS:
        raise ValueError("more colliding surrogates than expected; choose another key")
    return {(r["kind"], r["entity"]): r["attempt"] for r in rows}


def _rewrite(key, losers):
    def run(batches):
        import pyarrow as pa

        make, again = Surrogates(key), losers.value
        for batch in batches:
            texts, counts = [], {k: [] for k in KINDS}
            for text in batch.column(1):
                text = text.as_py()
                found = entities(text) if text else []
                tally = dict.fromkeys(KINDS, 0)
                if found:
                    parts, at = [], 0
                    for kind, b, e in found:
                        entity = canonical(kind, text[b:e])
                        parts += [text[at:b], dressed(kind, text[b:e], make(kind, entity, again.get((kind, entity), 0)))]
                        at = e
                        tally[kind] += 1
                    text = "".join([*parts, text[at:]])
                texts.append(text)
                for k in KINDS:
                    counts[k].append(tally[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *[pa.array(counts[k], pa.int32()) for k in KINDS]], ["row", "new_text", *[f"n_{k}" for k in KINDS]])

    return run


def pseudonymised(docs: DataFrame, key: str = DEFAULT_KEY, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, the text rewritten, and n_email ... n_name beside them."""
    names = docs.columns
    text = docs[text_col].cast("string")
    losers = docs.sparkSession.sparkContext.broadcast(resolved(docs.select(text.alias("text")), key))
    others = [c for c in names if c != text_col]
    # The other columns travel as one struct with plain names, so that theirs can't clash with ours.
    packed = docs.select(F.struct(F.lit(0).alias("none"), *[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(others)]).alias("row"), text.alias("text"))
    kinds = [T.StructField("row", packed.schema["row"].dataType), T.StructField("new_text", T.StringType()), *[T.StructField(f"n_{k}", T.IntegerType()) for k in KINDS]]
    new = packed.mapInArrow(_rewrite(key, losers), T.StructType(kinds))
    own = {k: f"n_{k}" for k in KINDS}
    for k in KINDS:
        while own[k] in names:
            own[k] += "_"
    return new.select(*[F.col("new_text").alias(c) if c == text_col else F.col(f"row.c{others.index(c)}").alias(c) for c in names], *[F.col(f"n_{k}").alias(v) for k, v in own.items()])

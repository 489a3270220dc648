"""Personal data and secrets replaced by keyed surrogates; DataFrame functions only.

Found: e-mail addresses, IPv4 addresses, payment card numbers that pass the Luhn check, telephone
numbers, US social security numbers, secrets after names like ``password=``, cloud access keys, and
persons named after a title, with initials and up to five names. A surrogate is made from a keyed hash of the entity's canonical form
and keeps its kind, length and format: digits stay digits, letters keep case and script, cards pass
the Luhn check, titles (and with them gender) stay. One entity has one surrogate in all documents
and in all ways it is written, and one surname has one with every title. Surrogates of different
entities differ, and differ from every entity that was found. Where the format is crowded, private
addresses move to 10.0.0.0/8, names and e-mail addresses grow, and numbers and secrets take the
free values of their format by rank; a format without enough free values is an error.
"""

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, stored

_MALE = "Mr|Herr|Monsieur|Señor|Sr|Господин|господин|г-н|Κύριος"
_FEMALE = "Mrs|Ms|Frau|Madame|Mme|Mademoiselle|Señora|Señorita|Sra|Госпожа|госпожа|г-жа|Κυρία"
_NEUTRAL = "Dr|Prof"
_TITLE_STARTS = "".join(sorted({t[0] for t in f"{_MALE}|{_FEMALE}|{_NEUTRAL}".split("|")}))
_NAME = r"\p{Lu}[\p{L}\p{M}'’-]{1,40}"
_INITIALS = r"(?:\p{Lu}\.){1,3}"
_PARTICLE = "(?:von|van|der|den|ten|zu|de|del|della|di|da|dos|du|la|le|bin|al)"
_SECRET_NAME = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|client[_-]?secret)"

_IP = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"
_SSN = r"\d{3}-\d{2}-\d{4}(?![\w-])"
#: Groupings of card numbers, the likelier first. Other groupings count if they stand alone.
_CARDS = [r"\d{13,19}", r"\d{4}(?:[ -]\d{4}){3}", r"\d{4}[ -]\d{6}[ -]\d{4,5}", r"\d{4}(?:[ -]\d{3}){3}", r"\d{4}(?:[ -]\d{4}){3}[ -]\d{1,3}"]
_CARD_GROUPS = [1, 4, 3, 4, 5]
#: What a group of digits must not begin to belong to the number before it.
_OTHER = rf"(?!{_IP}|[\w.%+-]+@)"
_NO_GROUP = rf"(?!{_IP}|{_SSN}|[\w.%+-]+@|\d{{4}}-\d{{2}}-\d{{2}}(?!\d)|\d{{13}}|\d{{4}}(?:[ -]\d{{4}}){{3}}|\d{{4}}[ -]\d{{6}}[ -]\d{{4}}|\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}(?!\w))"
_GROUP = rf"(?:[ .-]?{_NO_GROUP}\d{{2,4}})"
#: North American numbers have ten digits after +1; of others the groups tell the end.
_NORTH = r"(?:\+1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}"
_ABROAD = rf"(?:\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?|\(\d{{2,4}}\)[ .-]?)\d{{2,4}}{_GROUP}{{1,3}}"
#: Without +: 3-3-4, or a leading 0. Three groups with blanks between must look like an area and exchange.
_NATIONAL = (
    r"(?<![\w.+-])(?:(?:1[ .-])?(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|[2-9]\d{2} [2-9]\d{2}[ -]\d{4})|1[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}"
    r"|0\d{2,4}[ -]\d{3,4}[ -]?\d{3,4}(?! \d{4}(?!\d)))(?![.-]\d)"
)

#: kind -> pattern; of two that begin at one place the first wins. "card" finds whole runs of digit
#: groups, which pieces_of takes apart.
KINDS = {
    "secret": rf"(?=[pPsStTaAcC])\b{_SECRET_NAME}[ \t]*[=:][ \t]*(?:\"[^\"\s]{{6,}}\"|'[^'\s]{{6,}}'|[^\s\"',;]{{6,}})",
    "access_key": r"(?=A)\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "email": r"(?=[A-Za-z0-9])\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}\b",
    "ip": rf"(?=[0-9])(?<![\w.]){_IP}",
    "ssn": rf"(?=[0-9])(?<![\w-]){_SSN}",
    "phone": rf"(?=[+(0-9])(?<![\w+])(?:{_NORTH}|{_ABROAD}|{_NATIONAL})(?!\w)",
    "card": rf"(?=[0-9])(?<![\w.-])(?=(?:\d[ -]?){{13}})\d++(?!\w|-\p{{L}})(?:[ -]{_OTHER}\d++(?!\w|-\p{{L}}))*+",
    "person": rf"(?=[{_TITLE_STARTS}])\b(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.? (?:(?:{_NAME}|{_INITIALS}|{_PARTICLE}) ){{0,4}}{_NAME}",
}
#: A look ahead at the first character lets most places of a text fail at once.
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
_SECRET_PREFIX = rf"^{_SECRET_NAME}[ \t]*[=:][ \t]*[\"']?"
#: Kinds whose canonical form is their digits.
_DIGITS = ("card", "phone", "ssn")

#: Given names by script and gender; surnames are made of syllables.
_GIVEN = {
    "latin": {
        "m": ["Adam", "Bruno", "Daniel", "Emil", "Felix", "Hugo", "Jonas", "Leon", "Martin", "Oscar", "Simon", "Victor"],
        "f": ["Anna", "Clara", "Diana", "Emma", "Julia", "Laura", "Maria", "Nora", "Olivia", "Petra", "Sara", "Vera"],
        "n": ["Alex", "Andrea", "Chris", "Dominique", "Kim", "Lou", "Maxime", "Nicola", "Robin", "Sam", "Sascha", "Toni"],
    },
    "cyrillic": {
        "m": ["Антон", "Борис", "Виктор", "Иван", "Кирилл", "Максим", "Олег", "Павел"],
        "f": ["Анна", "Вера", "Дарья", "Ирина", "Мария", "Нина", "Ольга", "Юлия"],
        "n": ["Саша", "Женя", "Валя", "Слава"],
    },
    "greek": {
        "m": ["Νίκος", "Πέτρος", "Γιάννης", "Κώστας"],
        "f": ["Μαρία", "Ελένη", "Άννα", "Σοφία"],
        "n": ["Αλέξης", "Χρύσα"],
    },
}
_SYLLABLES = {
    "latin": ["ba", "be", "do", "fa", "ga", "ke", "la", "le", "mi", "mo", "na", "ne", "pa", "ra", "ro", "sa", "ta", "ti", "va", "vo"],
    "cyrillic": ["ба", "во", "га", "до", "за", "ка", "ла", "ме", "на", "по", "ра", "ро", "са", "та", "ти", "ха"],
    "greek": ["βα", "γα", "δη", "κα", "λα", "με", "νο", "πα", "ρα", "σα", "τα", "φι"],
}
#: Endings that tell a surname's gender: script -> gender -> ending.
_ENDING = {
    "latin": {"m": "n", "f": "n", "n": "n"},
    "cyrillic": {"m": "нов", "f": "нова", "n": "нко"},
    "greek": {"m": "κης", "f": "κη", "n": "κου"},
}


def has_entities(text: Column) -> Column:
    """Whether ``text`` has any; texts that lack what each kind needs are told by cheap tests."""
    named = (text.contains("=") | text.contains(":")) & text.rlike(KINDS["secret"])
    other = text.rlike("[0-9@]") & text.rlike(PATTERN)
    return named | other | text.rlike(KINDS["person"]) | (text.contains("AKIA") | text.contains("ASIA")) & text.rlike(KINDS["access_key"])


def mentions_of(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, check digit included."""
    places = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int"))

    def add(total, at):
        double = at["v"] * 2
        return total + F.when(at["i"] % 2 == 0, at["v"]).otherwise(double - F.when(double > 9, 9).otherwise(0))

    indexed = F.transform(places, lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    return F.aggregate(indexed, F.lit(0), add)


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def _is_card(raw: Column, pattern: str) -> Column:
    shaped = raw.rlike(f"^(?:{pattern})$")
    return shaped & (_luhn_sum(F.when(shaped, _digits(raw)).otherwise("0")) % 10 == 0)


def pieces_of(raw: Column) -> Column:
    """A mention cut into what can be one entity each and what lies between.

    In a run of digit groups, cards in a usual grouping, SSNs and phones are looked for from every
    group on; a run without any stays whole.
    """
    groups = F.regexp_extract_all(raw, F.lit(r"\d+[ -]?"), F.lit(0))
    number = "|".join((KINDS["ssn"], KINDS["phone"]))

    def length(i):
        """How many groups the entity that begins at group ``i`` has; null if none does."""
        joined = {n: F.regexp_replace(F.array_join(F.slice(groups, i, F.lit(n)), ""), "[ -]$", "") for n in range(1, 6)}
        card = [F.when(_is_card(joined[n], c), n) for c, n in zip(_CARDS, _CARD_GROUPS, strict=True)]
        return F.coalesce(*(F.when(joined[n].rlike(f"^(?:{number})$"), n) for n in range(1, 6)), *card)

    def step(state, at):
        inside = at["i"] < state["next"]
        group = F.element_at(groups, at["i"])
        end = F.regexp_extract(group, "[ -]?$", 0)
        whole = F.array_join(F.slice(groups, at["i"], at["n"]), "")
        tail = F.regexp_extract(whole, "[ -]?$", 0)
        found = F.array(F.regexp_replace(whole, "[ -]$", ""), tail)
        new = F.when(at["n"].isNotNull(), found).otherwise(F.array(F.regexp_replace(group, "[ -]$", ""), end))
        return F.struct(
            F.when(inside, state["next"]).otherwise(at["i"] + F.coalesce(at["n"], F.lit(1))).alias("next"),
            F.when(inside, state["pieces"]).otherwise(F.concat(state["pieces"], new)).alias("pieces"),
        )

    lengths = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda i: F.struct(i.alias("i"), length(i).alias("n")))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("pieces"))
    cut = F.when(F.exists(lengths, lambda x: x["n"].isNotNull()), F.aggregate(lengths, start, step)["pieces"])
    return F.when(raw.rlike(r"^\d[\d -]*$"), F.coalesce(cut, F.array(raw))).otherwise(F.array(raw))


def kind_of(raw: Column) -> Column:
    """The kind of an entity; null for a number that only looks like a card."""
    kind = None
    for name, pattern in KINDS.items():
        test = _is_card(raw, r"\d(?:[ -]?\d){12,18}") if name == "card" else raw.rlike(f"^(?:{pattern})$")
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return kind


def canonical(kind: Column, raw: Column) -> Column:
    """The form in which two ways of writing one entity agree."""
    value = F.regexp_replace(F.regexp_replace(raw, _SECRET_PREFIX, ""), "[\"']$", "")
    # ten digits are those after +1
    north = (kind == "phone") & raw.rlike(r"^\(?[1-9]\d{2}\)?[ .-]?\d{3}[ .-]?\d{4}$")
    return (
        F.when(north, F.concat(F.lit("1"), _digits(raw)))
        .when(kind.isin(*_DIGITS), _digits(raw))
        .when(kind == "email", F.lower(raw))
        .when(kind == "secret", value)
        .when(kind == "person", F.regexp_replace(raw, r"^(\S+?)\.? ", "$1 "))
        .otherwise(raw)
    )


def _stream(key: str, kind: Column, value: Column, attempt: int, bytes_needed: Column) -> Column:
    """Hex digits of a keyed hash, two for each byte needed; the key is mixed in at both ends."""
    blocks = F.sequence(F.lit(0), F.floor(bytes_needed / 32).cast("int"))
    seed = F.concat_ws("\u0000", F.lit(key), kind, value, F.lit(str(attempt)))
    inner = F.sha2(seed, 256)
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat(F.lit(key), inner, b.cast("string")), 256)), "")


def _byte(stream: Column, i: Column) -> Column:
    """Four hex digits from place ``i`` (from 0) as a number, so that remainders are near even."""
    return F.conv(F.substring(stream, i * 2 + 1, F.lit(4)), 16, 10).cast("int")


_ALPHABETS = {
    r"[0-9]": "0123456789",
    r"[a-z]": "abcdefghijklmnopqrstuvwxyz",
    r"[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"[а-яё]": "абвгдежзиклмнопрстуфхцчшэюя",
    r"[А-ЯЁ]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    r"[α-ω]": "αβγδεζηθικλμνξοπρστυφχψω",
    r"[Α-Ω]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
}


def _scrambled(value: Column, stream: Column, hexadecimal: Column) -> Column:
    """Each letter and digit replaced by one of its own kind; all else stays."""

    def one(i):
        c = F.substring(value, i + 1, F.lit(1))
        n = _byte(stream, i)
        out = F.when(hexadecimal & c.rlike("[a-f]"), F.substring(F.lit("abcdef"), n % 6 + 1, F.lit(1)))
        for letters, alphabet in _ALPHABETS.items():
            out = out.when(c.rlike(letters), F.substring(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(value) - 1), one), "")


def _words_of(value: Column) -> Column:
    """The names of a person: place, kind (surname or given name, of a script), word and ending."""
    words = F.split(value, " ")
    title, last = F.element_at(words, 1), F.element_at(words, -1)
    gender = F.when(title.rlike(f"^(?:{_MALE})$"), "m").when(title.rlike(f"^(?:{_FEMALE})$"), "f").otherwise("n")
    script = F.when(last.rlike(r"\p{IsCyrillic}"), "cyrillic").when(last.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    ending = F.lit("")
    for name, endings in _ENDING.items():
        for g, of in endings.items():
            ending = F.when((script == name) & (gender == g), of).otherwise(ending)
    names = F.slice(words, F.lit(2), F.size(words) - 1)

    def one(word, i):
        final = i == F.size(words) - 2
        kind = F.when(final, F.concat_ws(" ", F.lit("surname"), script)).when(word.rlike(f"^{_INITIALS}$"), "initials")
        kind = kind.when(word.rlike(f"^{_PARTICLE}$"), "particle").otherwise(F.concat_ws(" ", F.lit("given"), script, gender))
        return F.struct(i.alias("place"), kind.alias("kind"), word.alias("word"), F.when(final, ending).otherwise("").alias("ending"))

    return F.transform(names, one)


def _turned(initials: Column, key: str) -> Column:
    """Other initials: each alphabet is turned by a keyed number of letters."""
    sets = [a for a in _ALPHABETS.values() if a.isupper()]
    turn = int.from_bytes(hashlib.sha256(f"{key}\0initials".encode()).digest())
    turned = [a[k:] + a[:k] for a in sets for k in [1 + turn % (len(a) - 1)]]
    return F.translate(initials, "".join(sets), "".join(turned))


def _name(kind: Column, stream: Column, attempt: int) -> Column:
    """A surname without its ending or a given name; later attempts draw from more."""
    out = F.lit(None).cast("string")
    for script, syllables in _SYLLABLES.items():

        def made(n, of=syllables):
            return F.concat(*(F.element_at(F.lit(of), _byte(stream, F.lit(2 * k + 2)) % len(of) + 1) for k in range(n)))

        out = F.when(kind == f"surname {script}", F.initcap(made(4 + attempt // 2))).otherwise(out)
        for gender, names in _GIVEN[script].items():
            given = F.element_at(F.lit(names), _byte(stream, F.lit(0)) % len(names) + 1)
            if attempt:
                given = F.initcap(F.concat(made(2 + attempt // 2), F.lower(given)))
            out = F.when(kind == f"given {script} {gender}", given).otherwise(out)
    return out


def surrogate(kind: Column, value: Column, attempt: int, stream: Column) -> Column:
    """The surrogate of a canonical form, canonical too; ``stream`` is its keyed hash."""
    plain = _scrambled(value, stream, (kind == "secret") & value.rlike("^[0-9a-f]+$"))
    body = F.concat(F.substring(value, 1, 1), F.substring(plain, F.lit(2), F.length(value) - 2))
    check = (10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    octets = F.split(value, r"\.")
    private = F.element_at(octets, 1).isin("10", "127", "172", "192", "169", "0")
    new = [F.pmod(_byte(stream, F.lit(2 * k)), F.lit(254)) + 1 for k in range(4)]
    # first octet 1 to 126 but 10, and 128 to 168: public, unicast
    head = F.pmod(_byte(stream, F.lit(0)), F.lit(160)) + 11
    head = F.when(head >= 127, head + 1).otherwise(head)
    head = F.when(head.isin(169, 172), F.lit(11)).otherwise(head)
    kept = [F.element_at(octets, 1), F.element_at(octets, 2)] if attempt < CROWDED else [F.lit("10"), new[1].cast("string")]
    ip = F.when(private, F.concat_ws(".", *kept, new[2].cast("string"), new[3].cast("string")))
    ip = ip.otherwise(F.concat_ws(".", head.cast("string"), *(n.cast("string") for n in new[1:])))
    # the top-level domain stays, and so does the first digit of a number
    domain = F.regexp_extract(value, r"\.[a-z]+$", 0)
    more = [F.substring(F.lit(_ALPHABETS["[a-z]"]), _byte(stream, F.lit(2 * k + 1)) % 26 + 1, F.lit(1)) for k in range(attempt - CROWDED + 1)]
    email = F.concat(*more, F.substring(plain, F.lit(1), F.length(value) - F.length(domain)), domain)
    return (
        F.when(kind == "card", F.concat(body, check.cast("string")))
        .when(kind == "ip", ip)
        .when(kind == "email", email)
        .when(kind == "access_key", F.concat(F.substring(value, 1, 4), F.substring(plain, F.lit(5), F.lit(16))))
        .when(kind.rlike("^(?:surname|given) "), _name(kind, stream, attempt))
        .when(kind == "phone", F.concat(F.substring(value, 1, 1), F.substring(plain, F.lit(2), F.length(value))))
        .otherwise(plain)
    )


def written_as(kind: Column, raw: Column, new: Column) -> Column:
    """A surrogate in the format in which the entity was written."""

    def digit(i):
        c = F.substring(raw, i, F.lit(1))
        at = F.length(_digits(F.substring(raw, F.lit(1), i)))
        at = at + F.length(new) - F.length(_digits(raw))
        return F.when(c.rlike("[0-9]"), F.substring(new, at, F.lit(1))).otherwise(c)

    def cased(i):
        c = F.substring(new, i, F.lit(1))
        return F.when(F.substring(raw, i, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)

    along = F.sequence(F.lit(1), F.length(raw))
    prefix = F.regexp_extract(raw, _SECRET_PREFIX, 0)
    return (
        F.when(kind.isin(*_DIGITS), F.array_join(F.transform(along, digit), ""))
        .when(kind == "email", F.array_join(F.transform(F.sequence(F.lit(1), F.length(new)), cased), ""))
        .when(kind == "secret", F.concat(prefix, new, F.regexp_extract(raw, "[\"']$", 0)))
        .when((kind == "person") & raw.rlike(r"^\S+\. "), F.regexp_replace(new, "^([^ .]+) ", "$1. "))
        .otherwise(new)
    )


#: The round from which on private addresses and e-mail addresses get more room, and the rounds
#: after which what is left of NUMBERED kinds takes free values by rank. Others go on growing.
CROWDED, ATTEMPTS = 4, 12
NUMBERED = ("ip", "ssn", "phone", "card", "secret", "access_key")


def _format(kind: Column, value: Column) -> Column:
    """What the surrogates of crowded entities have in common: entities of one format share its values."""
    mask = value
    for letters, alphabet in _ALPHABETS.items():
        mask = F.regexp_replace(mask, letters, alphabet[0])
    first = F.concat(F.substring(value, 1, 1), F.length(value).cast("string"))
    private = value.rlike(r"^(?:10|127|172|192|169|0)\.")
    return (
        F.when(kind.isin("card", "phone"), first)
        .when(kind == "ip", F.when(private, "private").otherwise("public"))
        .when(kind == "access_key", F.concat(F.substring(value, 1, 4), mask))
        .when(kind == "secret", F.when(value.rlike("^[0-9a-f]+$"), F.concat(F.lit("hex "), mask)).otherwise(F.concat(F.lit("any "), mask)))
        .otherwise(mask)
    )


def _numbered(kind: Column, value: Column, n: Column) -> Column:
    """The ``n``-th value (from 0) of the format of ``value``; begins anew after the last."""
    octets = [F.pmod(F.floor(n / 254**k), F.lit(254)) + 1 for k in range(3)]
    head = F.pmod(F.floor(n / 254**3), F.lit(160)) + 11
    head = F.when(head >= 127, head + 1).otherwise(head)
    head = F.when(head.isin(169, 172), F.lit(11)).otherwise(head)
    head = F.when(_format(kind, value) == "private", F.lit(10)).otherwise(head)
    ip = F.concat_ws(".", *(x.cast("string") for x in (head, *octets)))
    kept = F.when(kind.isin("card", "phone"), 1).when(kind == "access_key", 4).otherwise(0)
    hexadecimal = (kind == "secret") & value.rlike("^[0-9a-f]+$")
    sets = [(c, F.lit(a)) for c, a in _ALPHABETS.items()]

    def one(state, i):
        c = F.substring(value, i, F.lit(1))
        of = F.when(hexadecimal & c.rlike("[a-f]"), "abcdef")
        for letters, alphabet in sets:
            of = of.when(c.rlike(letters), alphabet)
        of = F.when(i > kept, of).otherwise(F.lit(None))
        of = F.coalesce(of, c)
        new = F.substring(of, (state["n"] % F.length(of)).cast("int") + 1, F.lit(1))
        return F.struct(F.floor(state["n"] / F.length(of)).alias("n"), F.concat(new, state["out"]).alias("out"))

    length = F.length(value) - F.when(kind == "card", 1).otherwise(0)
    start = F.struct(n.cast("long").alias("n"), F.lit("").alias("out"))
    text = F.aggregate(F.sequence(length, F.lit(1), F.lit(-1)), start, one)["out"]
    check = (10 - _luhn_sum(F.concat(text, F.lit("0"))) % 10) % 10
    return F.when(kind == "ip", ip).when(kind == "card", F.concat(text, check.cast("string"))).otherwise(text)


def _by_rank(left: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate): free values of the format for what hashing has left open.

    As many values as a format has entities and taken ones are made, so enough are free if any are.
    """
    kind = F.col("kind")
    left = left.withColumn("format", _format(kind, F.col("value")))
    held = taken.where(kind.isin(*NUMBERED)).withColumn("format", _format(kind, F.col("surrogate")))
    sizes = left.groupBy("kind", "format").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    used = held.groupBy("kind", "format").agg(F.count("*").alias("used"))
    sizes = sizes.join(used, ["kind", "format"], "left")
    last = F.col("n") + F.coalesce("used", F.lit(0)) - 1
    made = sizes.select("kind", "format", "value", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("n"))
    made = made.select("kind", "format", _numbered(kind, F.col("value"), F.col("n")).alias("surrogate")).distinct()
    free = made.join(taken, ["kind", "surrogate"], "left_anti")
    rank = lambda c: F.row_number().over(Window.partitionBy("kind", "format").orderBy(F.sha2(F.concat(F.lit(key), c), 256)))
    both = left.withColumn("rank", rank(F.col("value"))).join(free.withColumn("rank", rank(F.col("surrogate"))), ["kind", "format", "rank"], "left")
    both = stored(both, "ranked")
    full = both.where("surrogate is null").groupBy("kind").count().collect()  # at most one row a kind
    if full:
        raise ValueError("more entities than free values of their format: " + ", ".join(f"{r['kind']} {r['count']}" for r in full))
    return both.select("kind", "value", "surrogate")


def _settled(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of (kind, value): no surrogate twice, none that is an entity.

    A surname is compared without its ending. Given names differ from each other and from what
    they replace; that the person is another is told by the surname.
    """
    kind, value = F.col("kind"), F.col("value")
    open_ = stored(entities.select("kind", "value").distinct(), "entities")
    stems = [F.regexp_replace(value, f"{e}$", "") for e in sorted({e for of in _ENDING.values() for e in of.values()})]
    forms = F.when(kind.startswith("surname "), F.array(value, *stems)).otherwise(F.array(value))
    real = open_.where(~kind.startswith("given ")).select("kind", F.explode(forms).alias("surrogate")).distinct()
    done, attempt = None, 0
    while done is None or not open_.isEmpty():
        taken = real if done is None else real.union(done.select("kind", "surrogate"))
        if attempt >= ATTEMPTS:
            left = stored(open_.where(kind.isin(*NUMBERED)), "left")
            if not left.isEmpty():
                done = done.union(_by_rank(left, taken.distinct(), key))
                open_ = open_.where(~kind.isin(*NUMBERED))
                taken = real.union(done.select("kind", "surrogate"))
        made = open_.withColumn("stream", _stream(key, kind, value, attempt, F.length(value) + 2 * attempt + 32))
        made = made.withColumn("surrogate", surrogate(kind, value, attempt, F.col("stream"))).drop("stream")
        made = stored(made.where("surrogate <> value"), "made")
        good = made.join(taken.distinct(), ["kind", "surrogate"], "left_anti").groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        good = stored(good.select("kind", "value", "surrogate"), "surrogates")
        done = good if done is None else done.union(good)
        open_ = stored(open_.join(good, ["kind", "value"], "left_anti"), "open")
        attempt += 1
    return done


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of distinct entities (kind, value); persons by their names."""
    entities = stored(entities.select("kind", "value").distinct(), "found")
    people = entities.where("kind = 'person'")
    names = stored(people.select(F.col("value").alias("person"), F.inline(_words_of(F.col("value")))), "names")
    parts = names.select("kind", F.col("word").alias("value"))
    small = F.col("kind").isin("initials", "particle")
    table = _settled(entities.where("kind <> 'person'").union(parts.where(~small)), key)
    kept = F.when(F.col("kind") == "initials", _turned(F.col("value"), key)).otherwise(F.col("value"))
    table = table.union(parts.where(small).distinct().withColumn("surrogate", kept))
    of = names.join(table.withColumnRenamed("value", "word"), ["kind", "word"])
    of = of.groupBy("person").agg(F.sort_array(F.collect_list(F.struct("place", F.concat("surrogate", "ending").alias("new")))).alias("names"))
    title = F.substring_index("person", " ", 1)
    made = of.select(F.lit("person").alias("kind"), F.col("person").alias("value"), F.concat_ws(" ", title, F.col("names.new")).alias("surrogate"))
    return table.where(f"kind in ('email', {', '.join(repr(k) for k in NUMBERED)})").union(made)


def replace_entities(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with every entity of column ``text`` replaced; other columns as they were.

    ``count`` names a column to add: how many entities were replaced. Null texts stay null (count
    0). Texts without entities, empty ones too, stay as they are and are not shuffled. Repeated
    rows and copies are replaced alike. An empty table gives an empty one.
    """
    if count in docs.columns:
        raise ValueError(f"the column {count!r} is there already")
    found = has_entities(F.col(text))
    plain = docs.where(F.col(text).isNull() | ~found)
    # one text in a third of all rows is one key; its rows are dealt by a salt of the whole row
    salt = F.pmod(F.xxhash64(*named(docs.columns)), F.lit(64))
    rows = docs.where(found).select(F.struct(*named(docs.columns)).alias("row"), F.sha2(text, 256).alias("of"), salt.alias("salt"))
    texts = docs.where(found).select(F.sha2(text, 256).alias("of"), salt.alias("salt"), F.posexplode(mentions_of(F.col(text))).alias("at", "raw"))
    mentions = stored(texts.groupBy("of", "salt", "at").agg(F.first("raw").alias("raw")), "mentions")
    pieces = mentions.select("raw").distinct().select("raw", F.posexplode(pieces_of(F.col("raw"))).alias("place", "piece"))
    pieces = pieces.withColumn("kind", kind_of(F.col("piece"))).withColumn("value", canonical(F.col("kind"), F.col("piece")))
    pieces = stored(pieces, "pieces")
    table = surrogate_table(pieces.where("kind is not null"), key)
    new = pieces.join(table, ["kind", "value"], "left").withColumn("new", written_as(F.col("kind"), F.col("piece"), F.col("surrogate")))
    new = new.groupBy("raw").agg(
        F.sort_array(F.collect_list(F.struct("place", F.coalesce("new", "piece").alias("new")))).alias("new"), F.count("new").alias("n")
    )
    filled = mentions.join(new.select("raw", F.array_join("new.new", "").alias("new"), "n"), "raw")
    filled = filled.groupBy("of", "salt").agg(
        F.sort_array(F.collect_list(F.struct("at", "new"))).alias("new"),
        F.sum("n").alias("replaced"),
    )
    # what lies between mentions, and the mentions' new forms, in turn
    between = F.split(F.col(f"row.{text}"), PATTERN, -1)
    joined = F.concat(F.element_at(between, 1), F.array_join(F.zip_with(F.col("new.new"), F.slice(between, F.lit(2), F.size(between)), lambda x, y: F.concat(x, y)), ""))
    out = rows.join(filled, ["of", "salt"]).withColumn("joined", joined)
    columns = [F.col("joined").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    if count:
        columns.append(F.col("replaced").alias(count))
        plain = plain.withColumn(count, F.lit(0).cast("long"))
    return plain.unionByName(out.select(*columns))

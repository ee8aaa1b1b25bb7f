"""PII surrogates (operator 1), with DataFrame functions only.

Entities are found by patterns, one for each type; names by a form of address before them, and in
the same text wherever they are repeated, whole or by the family name. Each distinct entity of the corpus gets one
surrogate, drawn by a keyed hash and shaped like the entity: digits for digits, a name of the
same gender and script, a card number with a right check digit, a valid address. Surrogates are
checked over the whole corpus: where two entities drew one surrogate, or one drew a string that
is an entity itself, it draws again until none is left; after some draws a surrogate may be longer than
its entity, so that no shape runs out. So equal entities stay equal, different
ones stay different, and none is replaced by another real one.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha512

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillstrata.llm.common import stored, without

EMAIL, CARD, SSN, IP, IPV6, IBAN, PHONE, SECRET, NAME = "email", "card", "ssn", "ip", "ipv6", "iban", "phone", "secret", "name"

# Forms of address and the gender they tell.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Mme", "Madame", "Mlle", "Frau", "Señora", "Sra", "Signora", "Госпожа", "Κυρία")
MALE_TITLES = ("Mr", "Mister", "Sir", "Monsieur", "Herr", "Señor", "Sr", "Signor", "Господин", "Κύριος")
OPEN_TITLES = ("Dr", "Prof", "Professor", "Doctor", "Docteur", "Doktor")
# Syllables of invented names by script, and endings of given names by gender.
SYLLABLES = {
    "Latin": ("ba", "cor", "del", "fen", "gar", "hol", "jes", "kam", "lor", "mir", "nal", "pel", "ros", "sten", "tor", "val"),
    "Cyrillic": ("ба", "вол", "гор", "дан", "жел", "зор", "кар", "лес", "мир", "нов", "пет", "рад", "сол", "тим", "фед", "юр"),
    "Greek": ("βα", "γορ", "δελ", "ζην", "θαν", "καλ", "λορ", "μιρ", "νικ", "παλ", "ροδ", "σελ", "τιμ", "φιλ", "χαρ", "ψαλ"),
}
ENDINGS = {
    "Latin": {"f": "ina", "m": "ert", "": "ey"},
    "Cyrillic": {"f": "ина", "m": "ор", "": "ай"},
    "Greek": {"f": "ίνα", "m": "ίδης", "": "ου"},
}

_TITLES = "|".join(sorted((*FEMALE_TITLES, *MALE_TITLES, *OPEN_TITLES), key=len, reverse=True))
# In order: where several fit at a place the first does.
PATTERNS = {
    EMAIL: r"(?<![\p{L}\p{N}_%+\-])[\p{L}\p{N}_%+\-]+(?:\.[\p{L}\p{N}_%+\-]+)*@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}",
    SECRET: r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_\-]{16,}[\"']?",
    IP: r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    IPV6: r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    IBAN: r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    SSN: r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    CARD: r"(?<!\d)(?<!\d[.,])(?:\d{4}(?:[ ]\d{4}){3}|\d{4}(?:-\d{4}){3}|\d{13,19})(?!\d)",
    # International with its plus; pairs after a zero; a North American number with its one; groups of two
    # to four digits of which a bracket, a dash, a zero or a second gap tells that they are no year or decimal.
    PHONE: r"(?:(?<![\w+])\+\d{1,3}(?:[ .\-]?\(?\d{1,4}\)?){2,6}(?!\d)"
    r"|(?<![\d.,])0\d(?:[ .\-]\d{2}){4}(?!\d)"
    r"|(?<![\d.,+])1[2-9]\d{2}[2-9]\d{6}(?![\d.,]\d|\d)"
    r"|(?<![\d.,])\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)"
    r"|(?<![\d.,])\d{2,4}-\d{3,4}[ .\-]?\d{3,4}(?!\d)"
    r"|(?<![\d.,])\d{2,4}[ .]\d{3,4}[ .\-]\d{3,4}(?![\d.]\d|\d)"
    r"|(?<![\d.,])0\d{1,4}[ ]\d{3,4}[ ]?\d{3,4}(?!\d))",
    NAME: rf"\b(?:{_TITLES})\b\.?\s(?:\p{{Lu}}[\p{{L}}'’\-]+)(?:\s\p{{Lu}}[\p{{Ll}}'’\-]+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
SAME_SHAPE = 8  # draws of an entity's own length

# What an entity cannot do without, in patterns that are quick to try.
_LABEL = r"(?i)(?:token|secret|passw|key)"


def pattern_of(text: Column) -> Column:
    """What to look for in a text: the patterns, and after them the names that it gives with a form of address."""
    given = F.regexp_extract_all(text, F.lit(PATTERNS[NAME]), F.lit(0))
    names = F.transform(given, lambda match: F.regexp_replace(match, rf"^(?:{_TITLES})\b\.?\s", ""))
    family = F.filter(F.transform(names, lambda name: F.regexp_extract(name, r"\S+$", 0)), lambda name: F.length(name) > 2)
    # Longest first, so that a whole name is not taken for a family name.
    known = F.array_sort(F.array_distinct(F.concat(names, family)), lambda a, b: F.length(b) - F.length(a))
    again = F.concat(F.lit(rf"{ANY}|(?<![\p{{L}}\p{{N}}])(?:"), F.array_join(known, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(text.rlike(rf"\b(?:{_TITLES})\b") & (F.size(given) > 0), again).otherwise(F.lit(ANY))


def may_hold(text: Column) -> Column:
    """False only for texts without any entity, most of which this tells at little cost."""
    return text.rlike("[@0-9]") | (text.rlike("[=:]") & text.rlike(_LABEL)) | text.rlike(rf"\b(?:{_TITLES})\b")




def type_of(match: Column) -> Column:
    """The first type whose pattern the whole match fits; what fits none is a name without its form of address."""
    kind = F.lit(NAME)
    for name in reversed(PATTERNS):
        kind = F.when(match.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(kind)
    return kind


def _value(match: Column, kind: Column) -> Column:
    """What of a match is the entity: a secret without its label, a name without its title."""
    secret = F.regexp_extract(match, r"[=:]\s*[\"']?([A-Za-z0-9_\-]+)", 1)
    name = F.regexp_replace(match, rf"^(?:{_TITLES})\b\.?\s", "")
    return F.when(kind == SECRET, secret).when(kind == NAME, name).otherwise(match)


def _canonical(value: Column, kind: Column) -> Column:
    """The form that is the same for all ways to write an entity."""
    digits = F.regexp_replace(value, r"\D", "")
    together = F.when(kind == IBAN, F.replace(value, F.lit(" "), F.lit(""))).otherwise(value)
    return F.when(kind.isin(CARD, SSN, PHONE), digits).otherwise(F.lower(together))


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "Cyrillic").when(value.rlike(r"\p{IsGreek}"), "Greek").otherwise("Latin")


def _gender(match: Column) -> Column:
    return F.when(match.rlike(rf"^(?:{'|'.join(FEMALE_TITLES)})\b"), "f").when(match.rlike(rf"^(?:{'|'.join(MALE_TITLES)})\b"), "m").otherwise("")


def found(text: Column, pattern: Column) -> Column:
    """The entities of a text in order, as structs of what is needed to name and replace each."""

    def parts(match: Column) -> Column:
        kind = type_of(match)
        value = _value(match, kind)
        return F.struct(
            match.alias("match"),
            kind.alias("kind"),
            value.alias("value"),
            _canonical(value, kind).alias("entity"),
            F.when(kind == NAME, _gender(match)).otherwise("").alias("gender"),
        )

    return F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), parts)


def _padded(key: str, byte: int) -> Column:
    """The key filled up to a block of 128 bytes, each combined with a byte, as an HMAC takes it."""
    block = key.encode() if len(key.encode()) <= 128 else sha512(key.encode()).digest()
    return F.lit(bytearray(b ^ byte for b in block.ljust(128, b"\0")))


def _noise(key: str, *of: Column | str) -> Column:
    """128 hexadecimal digits: the HMAC-SHA-512 of some columns."""
    inner = F.sha2(F.concat(_padded(key, 0x36), F.encode(F.concat_ws("\x1f", *of), "utf-8")), 512)
    return F.sha2(F.concat(_padded(key, 0x5C), F.unhex(inner)), 512)


def _byte(noise: Column, i: Column) -> Column:
    """The i-th of 64 values from 0 to 255, from 1 on and over again."""
    return F.conv(F.substring(noise, (F.pmod(i - 1, F.lit(64)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _reshaped(value: Column, noise: Column, is_hash: Column) -> Column:
    """Each digit by a digit, each letter by an ASCII letter of its case, of a hexadecimal string each by such a digit; the rest stays."""
    hexadecimal = is_hash & value.rlike("^[0-9a-f:]{3,}$") & value.rlike("[a-f:]")

    def one(c: Column, i: Column) -> Column:
        at = _byte(noise, i + 1)
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (at % 26 + 1).cast("int"), F.lit(1))
        return (
            F.when(c.rlike(r"^[0-9a-f]$") & hexadecimal, F.lower(F.hex((at % 16).cast("long"))))
            .when(c.rlike(r"^\d$"), (at % 10).cast("string")).when(c.rlike(r"^\p{Lu}$"), F.upper(letter)).when(c.rlike(r"^\p{L}$"), letter).otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _checked(digits: Column) -> Column:
    """The digits with the last one set to the Luhn check digit."""
    body = F.reverse(F.substring(digits, F.lit(1), (F.length(digits) - 1).cast("int")))

    def add(total: Column, c: Column) -> Column:
        n = c["d"].try_cast("int") * F.when(c["i"] % 2 == 0, 2).otherwise(1)
        return total + F.when(n > 9, n - 9).otherwise(n)

    numbered = F.transform(F.split(body, ""), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    total = F.aggregate(numbered, F.lit(0), add)
    return F.concat(F.reverse(body), ((10 - total % 10) % 10).cast("string"))


def _iban(entity: Column, reshaped: Column, extra: Column) -> Column:
    """Country of the entity, check digits that fit, and a new account."""
    country = F.substring(entity, 1, 2)
    account = F.concat(F.substring(reshaped, F.lit(5), F.length(entity)), extra)

    def add(rest: Column, c: Column) -> Column:
        digit = c.try_cast("int")
        return F.when(digit.isNotNull(), (rest * 10 + digit) % 97).otherwise((rest * 100 + F.ascii(c) - 87) % 97)

    rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), add)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def _invented(noise: Column, offset: int, script: Column, draws: Column) -> Column:
    """A word of three syllables of a script, one more for each ten draws."""
    size = F.sequence(F.lit(1), (F.lit(3) + F.floor(draws / 10)).cast("int"))
    out = F.lit(None).cast("string")
    for name, syllables in SYLLABLES.items():
        table = F.array(*map(F.lit, syllables))
        word = F.transform(size, lambda i: F.element_at(table, (_byte(noise, i + offset) % len(syllables) + 1).cast("int")))  # noqa: B023
        out = F.when(script == name, F.array_join(word, "")).otherwise(out)
    return out


def _ending(script: Column, gender: Column) -> Column:
    out = F.lit("")
    for name, endings in ENDINGS.items():
        for g, ending in endings.items():
            out = F.when((script == name) & (gender == g), ending).otherwise(out)
    return out


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, entity, gender, draws)`` with ``surrogate`` in canonical form. Step by step, so that a hash is made once."""
    kind, entity, draws, noise = F.col("kind"), F.col("entity"), F.col("draws"), F.col("noise")
    at = F.instr(entity, "@").cast("int")
    domain = F.substring(entity, at + 1, F.length(entity))
    shared = F.when(kind == EMAIL, domain).when(kind == NAME, F.element_at(F.split(entity, r"\s"), -1))
    # What several entities share, a domain or a family name, is drawn for itself at first.
    steps = entities.withColumn("noise", _noise(key, kind, entity, draws.cast("string")))
    steps = steps.withColumn("common", F.when(kind.isin(EMAIL, NAME), F.when(draws < 10, _noise(key, kind, shared)).otherwise(noise)))
    steps = steps.withColumn("reshaped", _reshaped(entity, noise, (kind == IPV6) | ((kind == SECRET) & (F.length(entity) >= 16))))
    # A character more for each draw beyond those of the entity's own length.
    surplus = F.greatest(draws - (SAME_SHAPE - 1), F.lit(0)).cast("int")
    letters = F.substring(F.repeat(noise, 2), F.lit(65), surplus)
    digits = F.translate(letters, "abcdef", "012345")
    rest = F.concat(F.substring(entity, 1, 1), F.substring("reshaped", F.lit(2), F.length(entity)), digits)

    stem, ending = F.regexp_replace(domain, r"\.\p{L}+$", ""), F.regexp_extract(domain, r"\.\p{L}+$", 0)
    email = F.concat(F.substring("reshaped", F.lit(1), at - 1), letters, F.lit("@"), _reshaped(stem, F.col("common"), F.lit(False)), ending)
    octets = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_byte(noise, i) % 254 + 1).cast("string"))
    script = _script(entity)
    family = _invented(F.when((draws > 0) & (F.size(F.split(entity, r"\s")) == 1), noise).otherwise(F.col("common")), 20, script, F.when(draws < 10, 0).otherwise(draws))
    given = F.concat(_invented(noise, 0, script, draws), _ending(script, F.col("gender")))
    name = F.when(entity.rlike(r"\s"), F.concat(given, F.lit(" "), family)).otherwise(family)
    surrogate = (
        F.when(kind == EMAIL, email)
        .when((kind == IP) & (surplus == 0), F.array_join(octets, "."))
        .when(kind.isin(IP, IPV6) & (surplus > 0), F.regexp_replace(F.substring(noise, 1, 32), "(....)(?=.)", "$1:"))
        .when(kind == IBAN, _iban(entity, F.col("reshaped"), digits))
        .when(kind == CARD, _checked(rest))
        .when(kind == PHONE, rest)  # the first digit stays, of the country or the area
        .when(kind == NAME, name)
        .when(kind == SSN, F.concat("reshaped", digits))
        .when(kind == SECRET, F.concat("reshaped", letters))
        .otherwise(F.col("reshaped"))
    )
    return steps.select("kind", "entity", "gender", "draws", surrogate.alias("surrogate"))


def surrogates(places: DataFrame, key: str) -> DataFrame:
    """``(kind, entity, surrogate)`` for the distinct entities, no two of a kind alike and none a real one.

    A name's gender is what any of its places tells, none where they differ.
    """
    told = F.when(F.col("gender") != "", F.col("gender"))
    real = places.groupBy("kind", "entity").agg(F.min(told).alias("least"), F.max(told).alias("most"))
    gender = F.when(F.col("least") == F.col("most"), F.col("least")).otherwise("")
    real = stored(real.select("kind", "entity", gender.alias("gender")), "entities")
    known = real.select("kind", F.col("entity").alias("surrogate"))
    open_, done = real.withColumn("draws", F.lit(0)), []
    while True:
        drawn = stored(_drawn(open_, key), "drawn")
        # Of those that drew one string, the first keeps it, if it is not taken yet.
        first = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        done.append(stored(first.join(known, ["kind", "surrogate"], "left_anti"), "named"))
        known = known.unionByName(done[-1].select("kind", "surrogate"))
        again = drawn.join(done[-1].select("kind", "entity"), ["kind", "entity"], "left_anti")
        open_ = stored(again.select("kind", "entity", "gender", (F.col("draws") + 1).alias("draws")), "again")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)


def _like(match: Column, kind: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate written as the match is: its separators, case, label or title."""

    def placed(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(value, F.lit(1), i.cast("int")), r"\D", ""))
        return F.when(c.rlike(r"^\d$"), F.substring(surrogate, (before + 1).cast("int"), F.lit(1))).otherwise(c)

    def spaced(c: Column, i: Column) -> Column:
        before = F.length(F.replace(F.substring(value, F.lit(1), i.cast("int")), F.lit(" "), F.lit("")))
        return F.when(c != " ", F.upper(F.substring(surrogate, (before + 1).cast("int"), F.lit(1)))).otherwise(c)

    def longer(size: Column) -> Column:
        return F.upper(F.substring(surrogate, (size + 1).cast("int"), F.length(surrogate)))

    n_digits = F.length(F.regexp_replace(value, r"\D", ""))
    digits = F.concat(F.array_join(F.transform(F.split(value, ""), placed), ""), longer(n_digits))
    account = F.concat(F.array_join(F.transform(F.split(value, ""), spaced), ""), longer(F.length(F.replace(value, F.lit(" "), F.lit("")))))
    upper = F.upper(value)
    cased = F.when((value == upper) & (value != F.lower(value)), F.upper(surrogate)).otherwise(surrogate)
    name = F.when((value == upper) & (F.length(value) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    new = F.when(kind.isin(CARD, SSN, PHONE), digits).when(kind == IBAN, account).when(kind == NAME, name).otherwise(cased)
    start = F.instr(match, value).cast("int")
    return F.concat(F.substring(match, F.lit(1), start - 1), new, F.substring(match, start + F.length(value), F.length(match)))


def replace_pii(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its text's entities replaced, and ``n_entities``.

    The same ``key`` and corpus give the same surrogates; without it they cannot be traced back.
    NULL texts stay NULL and hold 0 entities. Rows with one text are replaced alike; repeated
    rows stay. Input columns named ``n_entities`` or with a leading ``_pii`` are replaced.
    """
    df = without(df, "n_entities", "_pii_id", "_pii_found", "_pii_new")
    text = F.col(text_col)
    has = F.coalesce(may_hold(text) & text.rlike(ANY), F.lit(False))
    plain = df.where(~has).withColumn("n_entities", F.lit(0).cast("long"))
    with_pii = df.where(has).withColumn("_pii_id", F.md5(text))
    # Each different text once: its entities, of which there are few, without the text.
    texts = stored(with_pii.select("_pii_id", found(text, pattern_of(text)).alias("found")).groupBy("_pii_id").agg(F.first("found").alias("found")), "found")
    places = texts.select("_pii_id", F.posexplode("found").alias("at", "e")).select("_pii_id", "at", "e.*")
    names = stored(surrogates(places, key), "surrogates")
    new = places.join(names, ["kind", "entity"]).select("_pii_id", "at", _like(F.col("match"), F.col("kind"), F.col("value"), F.col("surrogate")).alias("new"))
    new = new.groupBy("_pii_id").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("_pii_new"))
    new = stored(new.select("_pii_id", F.col("_pii_new.new").alias("_pii_new")), "new")
    rows = with_pii.join(new, "_pii_id")
    between = F.split(text, pattern_of(text), -1)
    joined = F.array_join(F.transform(between, lambda piece, i: F.concat(piece, F.coalesce(F.get("_pii_new", i), F.lit("")))), "")
    n = F.size("_pii_new").cast("long")
    rows = rows.withColumns({text_col: joined, "n_entities": n})
    return plain.unionByName(rows.select(plain.columns))

"""Personal data in texts replaced by keyed surrogates, with DataFrame functions only.

Detected are e-mail and IP addresses, payment cards (by prefix and check digit), phone numbers, account and social
security numbers, and names after a form of address. Each distinct entity of the corpus gets one surrogate, derived from a key:
of the same type, format and length (digits for digits, letters for letters, valid octets and check digits), names of
the same gender as the form of address says and in the same script. All occurrences of an entity get the same surrogate,
in their own spelling; so references stay, also those between documents.

Surrogates are checked for collisions over the corpus: one that another entity has, or that is itself an entity of the
corpus, is derived anew with the next attempt, until all differ. What is left after a number of attempts, because its
format has few free values or none, gets a surrogate with more digits or letters (octets of any length).

Null text stays null, and text without personal data stays as it is. Equal rows give equal results, an empty table an
empty one. All columns of the input are kept, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.session import stage

# Patterns, forms of address by gender, first names by script and gender.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{13,19})(?![0-9])"
CARD_PREFIX = "^(4|5[1-5]|22(2[1-9]|[3-9])|2[3-6]|27([01]|20)|3[47]|30[0-5]|3[68]|35(2[89]|[3-8])|6011|64[4-9]|65)"
PHONE = (
    r"\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|\+[0-9]{1,3}(?<separator>[ .-])[0-9]{2,4}(?:\k<separator>[0-9]{2,4}){1,3}(?![0-9]|\.[0-9])|\+[0-9]{9,14}(?![0-9])"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])"
)
FEMALE, MALE, NEUTRAL = "Mrs|Ms|Miss|Madame|Mme|Frau|Señora|Sra|Госпожа", "Mr|Monsieur|Herr|Señor|Sr|Господин", "Dr|Prof"
NAME = rf"\b(?:{FEMALE}|{MALE}|{NEUTRAL})\.? \p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+)?"
ALL = "|".join((EMAIL, IBAN, IP, SSN, CARD, PHONE, NAME))
FIRST_NAMES = {
    "latin": {
        "f": "Anna Clara Elena Emma Eva Ida Irene Julia Laura Lena Maria Marta Nina Nora Olga Paula Rosa Sara Sofia Vera".split(),
        "m": "Adam Albert Bruno Carl David Emil Felix Franz Hugo Ivan Jan Leo Lucas Martin Oscar Paul Peter Simon Thomas Victor".split(),
        "n": "Alex Andrea Ariel Chris Dana Dominique Eden Jamie Jean Jordan Kim Lee Lou Luca Max Noa Robin Sam Sasha Toni".split(),
    },
    "cyrillic": {
        "f": "Анна Вера Галина Дарья Елена Зоя Ирина Лидия Мария Нина Ольга Полина София Тамара Юлия".split(),
        "m": "Антон Борис Виктор Глеб Денис Егор Иван Игорь Лев Максим Олег Павел Роман Семён Фёдор".split(),
        "n": "Женя Саша Валя".split(),
    },
}
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe fi ga ka ko la le li lo ma me mi mo na ne no ra re ri ro sa se so ta te ti to va ve vi".split(),
    "cyrillic": "ба бе бо да де до ва ве ви га ка ко ла ле ли ло ма ме ми мо на не но ра ре ри ро са се со та те ти то".split(),
}
# Attempts in the entity's own length, and attempts until one more character is added; those after which too few values
# can be left only if most of all addresses are taken.
ATTEMPTS, GROW, MOST = 40, 2, 200


def _hash(key: str, *parts) -> Column:
    """64 hexadecimal digits that cannot be told without the key."""
    inner = F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)
    return F.sha2(F.concat_ws("|", F.lit(key), inner), 256)


def _number(hexes: Column, place, digits: int = 6) -> Column:
    """A number from ``digits`` of the hexadecimal digits; places beyond the end begin anew."""
    start = F.pmod(F.lit(place) if isinstance(place, int) else place, F.lit(64 - digits)) + 1
    return F.conv(F.substring(hexes, start, F.lit(digits)), 16, 10).cast("long")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the check-digit rule over all digits, the last one not doubled."""
    places = F.split(F.reverse(digits), "")
    doubled = F.transform(
        F.filter(places, lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _kind(raw: Column) -> Column:
    """The type of a match; null for numbers that only look like a card."""
    digits = _digits(raw)
    card = raw.rlike(rf"^(?:{CARD})$")
    prefix = digits.rlike(CARD_PREFIX)
    return (
        F.when(raw.contains("@"), "email")
        .when(raw.rlike(rf"^(?:{FEMALE})\b"), "name_f")
        .when(raw.rlike(rf"^(?:{MALE})\b"), "name_m")
        .when(raw.rlike(rf"^(?:{NEUTRAL})\b"), "name_n")
        .when(raw.rlike(rf"^(?:{IP})$"), "ip")
        .when(raw.rlike(rf"^(?:{SSN})$"), "ssn")
        .when(card, F.when(prefix & (_luhn(digits) % 10 == 0), "card"))
        .when(raw.rlike(rf"^(?:{IBAN})$"), "iban")
        .otherwise("phone")
    )


def _canonical(kind: Column, raw: Column) -> Column:
    """What spellings of one entity have in common."""
    words = F.regexp_replace(raw, r"^\S+ ", "")
    return (
        F.when(kind.isin("email", "ip"), F.lower(raw))
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind.startswith("name"), F.lower(words))
        .otherwise(_digits(raw))
    )


def _same_shape(value: Column, hexes: Column) -> Column:
    """Letters for letters and digits for digits; all else stays."""
    def one(c, i):
        n = _number(hexes, i * 3)
        letter = F.char((F.lit(97) + n % 26).cast("long"))
        return F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")


def _surrogate(key: str, kind: Column, canonical: Column, attempt: int, more: int = 0) -> Column:
    """Surrogate of an entity in its common spelling, with ``more`` characters than the entity has."""
    salt = F.lit(str(attempt))
    h = _hash(key, kind, canonical, salt)
    name = _name(key, kind, canonical, attempt)
    if more:
        canonical = F.when(kind == "email", F.concat(F.lit("a" * more), canonical)).when(kind == "ip", canonical).otherwise(F.concat(canonical, F.lit("0" * more)))
    # The top-level domain of an address stays, so that the result is an address.
    last = F.regexp_extract(canonical, r"\.[a-z]+$", 0)
    email = F.concat(_same_shape(F.regexp_replace(canonical, r"\.[a-z]+$", ""), h), last)
    octet = lambda c, i: (
        F.when(F.length(c) == 1, F.when(i == 0, 1 + _number(h, i * 7) % 9).otherwise(_number(h, i * 7) % 10))
        .when(F.length(c) == 2, 10 + _number(h, i * 7) % 90).otherwise(100 + _number(h, i * 7) % 156).cast("string")
    )
    if more:
        octet = lambda c, i: F.when(i == 0, 1 + _number(h, i * 7) % 255).otherwise(_number(h, i * 7) % 256).cast("string")
    ip = F.array_join(F.transform(F.split(canonical, r"\."), octet), ".")
    # The first digit of a card names its brand; the last one is the check digit.
    body = F.concat(F.substring(canonical, 1, 1), _same_shape(F.substring(canonical, F.lit(2), F.length(canonical) - 2), h))
    card = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    # Country code or first digit stays.
    number = F.concat(F.substring(canonical, 1, 1), _same_shape(F.substring(canonical, F.lit(2), F.length(canonical)), h))
    iban = F.concat(F.substring(canonical, 1, 2), _same_shape(F.substring(canonical, F.lit(3), F.length(canonical)), h))
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban)
        .when(kind.startswith("name"), name).otherwise(number)
    )


def _name(key: str, kind: Column, canonical: Column, attempt: int) -> Column:
    """First name by gender and script, surname of syllables of the script; equal surnames get equal surnames."""
    words = F.split(canonical, " ")
    salt = F.lit(str(attempt))
    first, last = _hash(key, F.lit("first"), F.element_at(words, 1), salt), _hash(key, F.lit("last"), F.element_at(words, -1), salt)

    def of(script: str) -> Column:
        syllables = F.array(*map(F.lit, _SYLLABLES[script]))
        count = F.lit(3 + attempt // 4)
        surname = F.array_join(
            F.transform(F.sequence(F.lit(1), count), lambda i: F.element_at(syllables, (_number(last, i * 5) % len(_SYLLABLES[script]) + 1).cast("int"))), ""
        )
        lists = FIRST_NAMES[script]
        chosen = [F.when(kind == f"name_{g}", F.element_at(F.array(*map(F.lit, n)), (_number(first, 0) % len(n) + 1).cast("int"))) for g, n in lists.items()]
        return F.when(F.size(words) == 1, surname).otherwise(F.concat_ws(" ", F.lower(F.coalesce(*chosen)), surname))

    return F.when(canonical.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def _spelled(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the spelling of one occurrence: its separators, capitals and form of address."""
    at = lambda i: F.length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    plain = F.when(kind == "iban", surrogate).otherwise(_digits(surrogate))
    grouped = F.array_join(
        F.transform(F.filter(F.split(raw, ""), lambda c: c != ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(plain, at(i), F.lit(1))).otherwise(c)), ""
    )
    cased = F.array_join(
        F.transform(
            F.filter(F.split(raw, ""), lambda c: c != ""),
            lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substring(surrogate, i + 1, F.lit(1)))).otherwise(F.substring(surrogate, i + 1, F.lit(1))),
        ),
        "",
    )
    # Characters that the entity does not have come last.
    grouped = F.concat(grouped, F.substring(plain, F.length(F.regexp_replace(raw, "[^0-9A-Za-z]", "")) + 1, F.length(plain)))
    cased = F.concat(cased, F.substring(surrogate, F.length(raw) + 1, F.length(surrogate)))
    words = F.regexp_replace(raw, r"^\S+ ", "")
    name = F.when((F.upper(words) == words) & (F.length(words) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    return (
        F.when(kind == "email", cased).when(kind == "ip", surrogate)
        .when(kind.startswith("name"), F.concat(F.regexp_extract(raw, r"^\S+ ", 0), name)).otherwise(grouped)
    )


def surrogate_table(entities: DataFrame, key: str, attempts: int = ATTEMPTS) -> DataFrame:
    """``kind``, ``canonical`` and ``surrogate`` for distinct entities; no two of a kind share a surrogate, and none is
    an entity itself. Names of either gender share one space."""
    space = lambda c: F.when(c.startswith("name"), "name").otherwise(c)
    open_ = stage(entities.select("kind", "canonical").distinct(), "entities")
    originals = open_.select(space(F.col("kind")).alias("space"), F.col("canonical").alias("surrogate")).distinct()
    settled: list[DataFrame] = []
    for attempt in range(attempts + MOST):
        if open_.isEmpty():
            break
        more = max(0, 1 + (attempt - attempts) // GROW)
        made = open_.select("*", space(F.col("kind")).alias("space"), _surrogate(key, F.col("kind"), F.col("canonical"), attempt, more).alias("surrogate"))
        first = made.groupBy("space", "surrogate").agg(F.min(F.struct("canonical", "kind")).alias("winner"))
        first = first.join(originals, ["space", "surrogate"], "left_anti")
        for before in settled:
            first = first.join(before.select("space", "surrogate"), ["space", "surrogate"], "left_anti")
        won = stage(first.select("space", "surrogate", "winner.kind", "winner.canonical"), "surrogates")
        settled.append(won)
        open_ = stage(open_.join(won.select("kind", "canonical"), ["kind", "canonical"], "left_anti"), "entities")
    else:
        if not open_.isEmpty():
            raise RuntimeError("too few different surrogates of a type")
    if not settled:
        return open_.withColumn("surrogate", F.lit(""))
    return reduce(DataFrame.unionByName, settled).select("kind", "canonical", "surrogate")


def replace_entities(df: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """``df`` with every entity of ``text_col`` replaced, and ``count_col``, the number of replacements.

    Only rows with something to replace are written aside, taken apart and put together again."""
    names = df.columns
    numbered = df.toDF(*[f"c{i}" for i in range(len(names))])
    text = F.col(f"c{names.index(text_col)}")
    found = F.coalesce(text.rlike(ALL), F.lit(False))
    apart = numbered.filter(found).select(
        "*",
        F.monotonically_increasing_id().alias("row"),
        F.regexp_extract_all(text, F.lit(ALL), F.lit(0)).alias("found"),
        F.split(text, ALL, -1).alias("between"),
    )
    apart = stage(apart, "entities-apart")
    each = apart.select("row", F.posexplode("found").alias("place", "raw")).withColumn("kind", _kind(F.col("raw")))
    each = each.withColumn("canonical", _canonical(F.col("kind"), F.col("raw")))
    table = surrogate_table(each.filter("kind IS NOT NULL"), key)
    joined = each.join(table, ["kind", "canonical"], "left")
    new = F.when(F.col("surrogate").isNull(), F.col("raw")).otherwise(_spelled(F.col("kind"), F.col("raw"), F.col("surrogate")))
    joined = joined.select("row", "place", new.alias("new"), F.col("surrogate").isNotNull().cast("long").alias("one"))
    by_row = joined.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "new"))).alias("new"), F.sum("one").alias("n"))
    whole = F.concat(
        F.array_join(F.transform("new", lambda s, i: F.concat(F.get("between", i), s["new"])), ""), F.element_at("between", -1)
    )
    replaced = apart.join(by_row, "row").select(
        *[whole.alias(c) if name == text_col else F.col(c) for c, name in zip(numbered.columns, names)], F.col("n")
    )
    clean = numbered.filter(~found).select("*", F.lit(0).cast("long").alias("n"))
    return clean.union(replaced).toDF(*names, count_col)

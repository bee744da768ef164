"""Surrogates for personal data, by DataFrame functions alone.

Entities are found by one pattern; each gets a keyed replacement of its own type and format, the same wherever the
entity occurs. Digits become digits and letters letters of the same case, card numbers and IBANs keep valid check
digits (numbers without them are no entities), addresses stay valid ones, names keep script and gender.

An entity consists of parts: each given name, the surname, the value of a named secret, or the whole entity. Parts
are what is replaced, so "Mr Ann Lee" and "Mr Lee" share their surname's replacement. The replacements of all
distinct parts are compared: of those that would share one, or meet a real part, all but one try again. Names of
later tries have more syllables; where another format has too few values, characters are added, so that all become
distinct.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.llm.common import free_name, scratch, small, stored

# Forms of entities (Java patterns), titles by gender and script, given names that new ones end in, syllables.
# Every form starts where no letter, digit or underscore stands before it, which ENTITY checks once for all.
EMAIL = r"[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IPV4 = rf"(?<!\.){OCTET}(?:\.{OCTET}){{3}}(?![\d]|\.\d)"
SSN = r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"
CARD = r"(?<![.-])\d(?:[ -]?\d){12,18}(?!\w)"
KEY = r"(?:AKIA|ASIA)[0-9A-Z]{16}\b|gh[pousr]_[A-Za-z0-9]{36}\b|sk-[A-Za-z0-9]{20,}+\b"
SECRET_NAME = r"(?:[Pp]assw(?:or)?d|[Ss]ecret|[Tt]oken|[Aa]pi[_-]?[Kk]ey|PASSWORD|SECRET|TOKEN|API_KEY)[ ]{0,2}[=:][ ]{0,2}[\"']?"
# a value without any letter or digit is a blank to fill in or a rule
SECRET = SECRET_NAME + r"(?=[_+/-]*+[A-Za-z0-9])[A-Za-z0-9_+/-]{6,}+"
IBAN = r"[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b"
TITLES = {
    ("m", "latin"): ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don"],
    ("f", "latin"): ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña"],
    ("m", "cyrillic"): ["Господин", "господин"],
    ("f", "cyrillic"): ["Госпожа", "госпожа"],
}
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Noah Oscar Paul Robert Simon Thomas Victor".split(),
    ("f", "latin"): "Alice Bella Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nora Olivia Paula Rosa Sofia Teresa Vera".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Сергей Тимур".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Мария Нина Ольга Полина Светлана Татьяна".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te".split(),
    "cyrillic": "ба бе бо да де до за зо ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве во".split(),
}
NAME = r"\p{Lu}\p{L}*+(?:['’-]\p{L}++)*+"
_TITLE = rf"(?:{'|'.join(t for ts in TITLES.values() for t in ts)})\.? "
# all names up to the next title
PERSON = rf"{_TITLE}{NAME}(?: (?!{_TITLE}\p{{Lu}}){NAME})*+"
_DIGITS, _LETTERS = "|".join((IPV4, SSN, PHONE, CARD)), "|".join((PERSON, KEY, SECRET, IBAN))
ENTITY = rf"(?<![\p{{L}}\p{{N}}_])(?:(?=[\d+(])(?:{_DIGITS}|{EMAIL})|(?=[^\d(\s])(?:{PERSON}|{EMAIL}|{KEY}|{SECRET}|{IBAN}))"
#: The same for texts without @: no address can match, and what can starts with few characters.
ENTITY_NO_AT = rf"(?=[\d+(A-ZГгagpst])(?<![\p{{L}}\p{{N}}_])(?:(?=[\d+(])(?:{_DIGITS})|{_LETTERS})"
#: Characters that mark found entities while a text is taken apart; texts' own are written as MARK_OWN or ESCAPE_OWN.
MARK, ESCAPE, MARK_OWN, ESCAPE_OWN = "\x01", "\x02", "\x02\x03", "\x02\x04"
#: Tries within an entity's format before characters are added: of secrets, phones and names, which may have few values; of others.
FEW, TRIES = 3, 16


def bound(value: Column, f) -> Column:
    """f(value) with the value worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def kind_of(e: Column) -> Column:
    """The type of a matched entity; null if its check digits say that it is none."""
    whole = lambda p: e.rlike(rf"^(?:{p})$")
    return (
        F.when(whole(SECRET), "secret").when(e.contains("@"), "email").when(whole(KEY), "key").when(whole(rf"{OCTET}(?:\.{OCTET}){{3}}"), "ip").when(whole(r"\d{3}-\d{2}-\d{4}"), "ssn")
        .when(whole(PERSON), "person").when(whole(IBAN), F.when(mod97(e) == 1, "iban")).when(whole(r"\d(?:[ -]?\d){12,18}"), F.when(luhn(F.regexp_replace(e, r"\D", "")) % 10 == 0, "card")).otherwise("phone")
    )


def digest(key: str, kind: Column, e: Column, attempt: Column) -> Column:
    """256 hex digits keyed by the type, the entity and the attempt."""
    base = F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), e)
    return F.concat(F.sha2(F.concat(F.lit("0"), base), 512), F.sha2(F.concat(F.lit("1"), base), 512))


def number(hexes: Column, at: Column | int, below: int) -> Column:
    """A number below `below` from 6 hex digits at place `at` (taken round the digest)."""
    start = (F.lit(at) if isinstance(at, int) else at) * 6 % 240 + 1
    return F.conv(hexes.substr(start, F.lit(6)), 16, 10).cast("long") % below


def like(e: Column, hexes: Column) -> Column:
    """Each digit a digit, each ASCII letter a letter of its case; hex strings stay hex; all else as it is."""
    hexed = e.rlike(r"^[0-9a-f]{8,}$") & e.rlike("[a-f]")
    letters = lambda base: lambda c, i: F.char(number(hexes, i, 26) + base)
    one = lambda c, i: F.when(hexed, hexes.substr(i % 256 + 1, F.lit(1))).when(c.rlike("[0-9]"), number(hexes, i, 10).cast("string")).when(c.rlike("[a-z]"), letters(97)(c, i)).when(c.rlike("[A-Z]"), letters(65)(c, i)).otherwise(c)
    return F.array_join(F.transform(F.split(e, ""), one), "")


def luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 0, F.try_element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def mod97(iban: Column) -> Column:
    """The number that an IBAN stands for (four characters moved to its end, letters as 10 to 35) modulo 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4)), "")
    return F.aggregate(moved, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def parts_of(e: Column) -> Column:
    """What an entity is replaced by part: array of (kind, value), empty if it is none. Kinds of names tell gender and script."""

    def names() -> Column:
        title = F.regexp_extract(e, r"^(\S+ )", 1)
        bare = F.regexp_replace(title, r"[. ]", "")
        group = reduce(lambda acc, g: acc.when(bare.isin(TITLES[g]), F.lit("/".join(g))), TITLES, F.when(F.lit(False), ""))
        words = F.split(F.substring(e, F.length(title) + 1, 1 << 20), " ")
        return F.transform(words, lambda w, i: F.struct(F.concat(F.when(i == F.size(words) - 1, "surname/").otherwise("given/"), group).alias("kind"), w.alias("value")))

    def made(kind: Column) -> Column:
        value = F.when(kind == "secret", F.regexp_replace(e, f"^{SECRET_NAME}", "")).otherwise(e)
        one = F.array(F.struct(kind.alias("kind"), value.alias("value")))
        return F.when(kind == "person", names()).when(kind.isNotNull(), one).otherwise(F.slice(one, 1, 0))

    return bound(kind_of(e), made)


def surrogate(kind: Column, x: Column, attempt: Column, key: str) -> Column:
    """The replacement of a part at an attempt."""
    # a surname's replacement doesn't depend on the title's gender
    family = F.when(kind.startswith("surname/"), F.concat(F.lit("surname/"), F.substring_index(kind, "/", -1))).otherwise(kind)

    def of_kind(h: Column) -> Column:
        return F.concat(bound(like(x, h), lambda same: shaped(h, same)), added(h))

    def added(h: Column) -> Column:
        """Four more digits with each attempt after those within the format; names grow by themselves, check digits stay valid."""
        more = attempt - F.when(kind.isin("secret", "phone"), FEW).otherwise(TRIES)
        digits = F.array_join(F.transform(F.sequence(F.lit(1), more * 4), lambda i: number(h, 40 - i, 10).cast("string")), "")
        return F.when(~kind.contains("/") & (more > 0), digits).otherwise("")

    def shaped(h: Column, same: Column) -> Column:
        rest = lambda head: F.concat(head, same.substr(F.length(head) + 1, F.length(x)))
        email = F.concat(like(F.regexp_extract(x, r"^([^@]+)@", 1), h), F.lit("@"), F.lower(F.substring(F.translate(h, "0123456789", "ghijklmnop"), 150, 10)), F.lit(".example"))
        ip = F.concat_ws(".", *[(number(h, i, 254) + 1).cast("string") for i in range(4)])
        # the last digit keeps the Luhn sum modulo 10
        body = F.concat(F.substring(x, 1, 1), same.substr(F.lit(2), F.length(x) - 2))
        plain = lambda y: F.regexp_replace(y, r"\D", "")
        card = F.concat(body, F.pmod(luhn(plain(x)) - luhn(F.concat(plain(body), F.lit("0"))), F.lit(10)).cast("string"))
        account = same.substr(F.lit(5), F.length(x))
        iban = F.concat(F.substring(x, 1, 2), F.lpad((98 - mod97(F.concat(F.substring(x, 1, 2), F.lit("00"), account))).cast("string"), 2, "0"), account)
        names = reduce(lambda acc, g: acc.when(kind == f"given/{'/'.join(g)}", named(h, g, True)).when(kind == f"surname/{'/'.join(g)}", named(h, g, False)), TITLES, F.when(F.lit(False), ""))
        return (
            F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", rest(F.regexp_extract(x, r"^(\+\d{1,3})?", 0))).when(kind == "key", rest(F.regexp_extract(x, r"^(AKIA|ASIA|gh._|sk-)?", 0)))
            .when(kind == "iban", iban).when(kind.contains("/"), names).otherwise(same)
        )

    def named(h: Column, group: tuple[str, str], given: bool) -> Column:
        """Syllables, more with each attempt; a given name ends in one of its gender's and script's."""
        syllables, ends = (F.array(*[F.lit(v) for v in vs]) for vs in (SYLLABLES[group[1]], GIVEN[group]))
        start = F.array_join(F.transform(F.sequence(F.lit(1), attempt + (2 if given else 4)), lambda i: F.element_at(syllables, (number(h, i, len(SYLLABLES[group[1]])) + 1).cast("int"))), "")
        return F.initcap(F.concat(start, F.lower(F.element_at(ends, (number(h, 0, len(GIVEN[group])) + 1).cast("int"))))) if given else F.initcap(start)

    return bound(digest(key, family, x, attempt), of_kind)


def whole_of(e: Column, parts: Column, new: Column) -> Column:
    """The entity with its parts replaced: its title or the secret's name stays."""
    kind = parts[0]["kind"]
    head = F.when(kind.contains("/"), F.regexp_extract(e, r"^(\S+ )", 1)).when(kind == "secret", F.regexp_extract(e, f"^{SECRET_NAME}", 0)).otherwise("")
    return F.concat(head, F.array_join(new, " "))


def taken_apart(text: Column) -> Column:
    """Pieces of a text, at even places what lies between entities, at odd ones the entities: one pass of the pattern."""
    own = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE_OWN)), F.lit(MARK), F.lit(MARK_OWN))
    marked = lambda pattern: F.regexp_replace(own, pattern, f"{MARK}$0{MARK}")
    return F.split(F.when(text.contains("@"), marked(ENTITY)).otherwise(marked(ENTITY_NO_AT)), MARK, -1)


def put_together(pieces: Column) -> Column:
    return F.replace(F.replace(F.array_join(pieces, ""), F.lit(MARK_OWN), F.lit(MARK)), F.lit(ESCAPE_OWN), F.lit(ESCAPE))


def entities(pieces: Column) -> Column:
    """What the pattern found, check digits not looked at."""
    return F.filter(pieces, lambda x, i: i % 2 == 1)


def colliding(docs: DataFrame, key: str, path: str) -> DataFrame | None:
    """(kind, value, attempt) of the parts whose first replacement another one has or that is a real part; None if there are none.

    Each round compares all parts' replacements; of those that share one the smallest keeps it. Rounds end when
    none collide: replacements of later attempts grow, so that soon there are enough of them. A given name may be
    replaced by another real one: the surname tells the persons apart.
    """
    found = docs.select(F.explode(entities(taken_apart(F.col("text")))).alias("entity")).distinct()
    every = found.select(F.explode(parts_of(F.col("entity"))).alias("part")).select(F.col("part.kind").alias("kind"), F.col("part.value").alias("value")).distinct()
    # one name of either gender: surnames are compared by script, given names within their list
    scope = F.when(F.col("kind").startswith("surname/"), F.substring_index("kind", "/", -1)).when(F.col("kind").contains("/"), F.col("kind")).otherwise("")
    tried = lambda df, t: df.select("scope", "kind", "value", F.lit(t).alias("attempt"), surrogate(F.col("kind"), F.col("value"), F.lit(t), key).alias("new"))
    now = stored(tried(every.withColumn("scope", scope), 0), f"{path}/try0")
    real = now.where("kind not like 'given/%'").select("scope", F.col("value").alias("new")).distinct()
    for t in count(1):
        shared = now.groupBy("scope", "new").agg(F.countDistinct("value").alias("n"), F.min("value").alias("first")).where("n > 1")
        losers = now.join(shared, ["scope", "new"]).where("value <> first").select("scope", "value").union(now.join(real, ["scope", "new"], "left_semi").select("scope", "value")).distinct()
        losers = stored(losers, f"{path}/losers{t}")
        if losers.isEmpty():
            moved = now.where("attempt > 0").select("kind", "value", "attempt")
            return None if moved.isEmpty() else moved
        again = tried(now.join(losers, ["scope", "value"], "left_semi"), t)
        now = stored(now.join(losers, ["scope", "value"], "left_anti").unionByName(again), f"{path}/try{t}")


def replace_entities(docs: DataFrame, key: str = "kvloom", text_col: str = "text", count_col: str | None = "n_entities") -> DataFrame:
    """docs with its text replaced and the number of entities added as count_col (replacing a column of that name; None: not added).

    Equal entities get equal replacements in all rows (coreference), different ones different replacements, none
    of which is an entity of the input. Null text stays null with no entities; rows without an entity keep their
    text. Repeated rows and null ids make no difference; other columns stay as they were, whatever their names; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    path = scratch(spark, "pii")
    moved = colliding(docs.select(F.col(text_col).alias("text")), key, path)
    pieces, same, tries = (free_name(docs, x) for x in ("pii_pieces", "pii_same", "pii_tries"))
    base = docs.withColumn(pieces, taken_apart(F.col(text_col)))
    if moved is None:
        attempt = lambda kind, value: F.lit(0)
    else:
        # texts with a moved part get a table of attempts, found again by their digest; other texts meet none
        base = base.withColumn(same, F.when(F.size(pieces) > 1, F.sha2(F.col(text_col), 256)).otherwise(F.hex(F.xxhash64(text_col))))
        held = base.where(F.size(pieces) > 1).select(F.col(same).alias("same"), F.explode(entities(F.col(pieces))).alias("entity")).select("same", F.explode(parts_of(F.col("entity"))).alias("part")).select("same", "part.*").distinct()
        own = held.join(small(stored(moved, f"{path}/moved"), 100_000), ["kind", "value"])
        own = own.groupBy("same").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "value"), "attempt"))).alias(tries)).withColumnRenamed("same", same)
        base = base.join(small(stored(own, f"{path}/own"), 100_000), same, "left")
        attempt = lambda kind, value: F.coalesce(F.try_element_at(F.col(tries), F.concat_ws("\x1f", kind, value)), F.lit(0))

    def new(e: Column) -> Column:
        replaced = lambda parts: F.transform(parts, lambda p: surrogate(p["kind"], p["value"], attempt(p["kind"], p["value"]), key))
        return bound(parts_of(e), lambda parts: F.when(F.size(parts) > 0, whole_of(e, parts, replaced(parts))).otherwise(e))

    found = F.size(F.filter(entities(F.col(pieces)), lambda e: kind_of(e).isNotNull()))
    n = F.when(F.size(pieces) > 1, found).otherwise(0).cast("long")
    made = F.transform(pieces, lambda x, i: F.when(i % 2 == 1, new(x)).otherwise(x))
    counted = {count_col: n} if count_col else {}
    return base.withColumns(counted | {text_col: F.when(F.size(pieces) > 1, put_together(made)).otherwise(F.col(text_col))}).drop(same, tries, pieces)

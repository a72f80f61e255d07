"""Keyed surrogates for personal data, with DataFrame functions only.

One pattern finds all entities of a text. Distinct entities (type and normal form) get a surrogate made from
a keyed digest: digits become digits, letters letters of the same case and script, separators stay; cards
keep a valid check digit if they had one, addresses stay addresses, keys keep their prefix. Names are built
from syllables, not from the names that are looked for, in the script, case and number of parts of the
original; a given name keeps its gender, which all its mentions in the corpus decide, and is neutral where
none tells. The same entity gets the same surrogate in the whole corpus, whatever its separators. An e-mail
address is its domain, an entity of its own, and the box in it. A surrogate that another entity has, or that
is itself an entity of the corpus, is drawn anew for the later entity until all are distinct; draws get longer
where formats allow, so there is always another one. In a document that names a person, each of the name's parts that
stands alone elsewhere is a mention of that person and gets the same surrogate. Texts are cut at their entities and put together with
the surrogates; texts without entities are passed through and never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import delete_table, materialize

#: Given names that are known by gender (fixed values). Surrogates are never drawn from them.
FEMALE = "Anna Maria Clara Elena Julia Laura Sofia Emma Alice Nora Eva Ida Marta Lucia Ines Paula Irene Helena Diana Sara Lena Greta Mary Jane Susan Linda Karen Sarah Emily Jessica".split()
MALE = "John James Robert Michael David Thomas Peter Paul Martin Daniel Felix Oscar Hugo Victor Anton Simon Lukas Jonas Karl Henri Louis Pablo Diego Carlos Miguel Marco Bruno Stefan Erik Adam".split()
FEMALE_CYRILLIC = "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Вера Дарья".split()
MALE_CYRILLIC = "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Павел Олег".split()
#: Syllables that surrogate names are built from (fixed values): a head, middles, an end that tells the gender.
GIVEN_HEADS = "Bren Cal Dar Fen Gal Hal Jor Kel Lor Nel Per Quil Sel Tam Vel Wil Xan Yor Zel Orv Ulm Ilv Esk Ath Rhe".split()
GIVEN_MIDS = "a e i o u ar el in or an er il on ul".split()
FEMALE_ENDS = "delia lina nelle dette nora rissa sena myra".split()
MALE_ENDS = "dus dric mund bert von wyn dor nard".split()
NEUTRAL_ENDS = "lin ley ren ry dey vin bel sky".split()
GIVEN_HEADS_CYRILLIC = "Бел Вар Гал Дор Жел Зор Кел Лор Мил Нор Рад Сев Тор Яр".split()
GIVEN_MIDS_CYRILLIC = "а е и о у ар ел ин ор ан".split()
FEMALE_ENDS_CYRILLIC = "дея лина нела дина сана рия".split()
MALE_ENDS_CYRILLIC = "дор мир слав бор вид рик".split()
NEUTRAL_ENDS_CYRILLIC = "лин рен вей дель ри сай".split()
SURNAME_HEADS = "Al Ber Cor Dal Em Far Gar Hol Is Jan Kel Lor Mor Nor Ol Par Quin Ros Sel Tor Ul Ver Wel Yor Zan".split()
SURNAME_MIDS = "a e i o u ken den rin sel mar ten vil dor lan".split()
SURNAME_TAILS = "bach berg dale den feld ford gren ham hart holm ins ley lin man mond ner ridge son stad stein ton vale ville well wood".split()
SURNAME_HEADS_CYRILLIC = "Бел Вол Гор Дан Ерм Жар Зор Кал Лаз Мед".split()
SURNAME_MIDS_CYRILLIC = "а е и о у ен ор ал ин ас".split()
SURNAME_TAILS_CYRILLIC = "гин ров ский ренко шев ланов ных чук дян вич".split()
HAN_SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗"
HAN_GIVEN = "安宁明华文德清远嘉瑞雪梅兰芳静婷伟强军杰"
HAN_TITLES = "先生|女士|小姐"
FEMALE_TITLES = "Mrs Ms Miss Madame Mme Mlle Frau Fräulein Señora Sra Señorita Госпожа".split()
MALE_TITLES = "Mr Monsieur Herr Señor Sr Господин".split()
OTHER_TITLES = "Dr Prof".split()
#: Further given names that are looked for (fixed values); their gender is told by titles only.
MORE_GIVEN = (
    "Olga Natasha Ivan Dmitri Sergei Alexei Nikolai Aisha Fatima Leila Amina Omar Ahmed Hassan Yusuf Ibrahim Mohammed Muhammad Karim Tariq Priya Anjali Lakshmi Arjun Ravi Sanjay Rahul Vikram "
    "Kenji Hiroshi Yuki Akira Sakura Haruto Wei Ming Mei Xiaoming Nguyen Linh Kwame Chidi Ngozi Amara Giulia Matteo Luca Francesca Chiara Elodie Camille Margaux Thierry Olivier Benoit "
    "Jürgen Günter Heike Ingrid Astrid Sven Björn Ewa Agnieszka Katarzyna Piotr Tomasz Zofia Joana Rodrigo Thiago Beatriz Fernanda Guillermo Alejandro Javier Raquel Elizabeth William Richard "
    "Joseph Charles Christopher Matthew Anthony Andrew Joshua Kenneth Kevin Brian George Timothy Ronald Edward Jeffrey Jacob Nicholas Jonathan Stephen Patricia Jennifer Barbara Margaret Lisa "
    "Nancy Betty Sandra Ashley Kimberly Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Angela Nicole Samantha Katherine Christine Rachel Catherine"
).split()
#: Words between a title or given name and a surname (fixed values).
PARTICLES = "de la|de las|de los|de|del|della|di|da|dos|du|van der|van den|van|von der|von|zu|der|ter|ten|la|le|bin|ibn|al|el"

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CYRILLIC_LOWER, _CYRILLIC_UPPER = "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"
_GREEK_LOWER, _GREEK_UPPER = "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"

TITLES = [*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES]
GIVEN = [*FEMALE, *MALE, *FEMALE_CYRILLIC, *MALE_CYRILLIC, *MORE_GIVEN]
_TITLES, _TITLES_UPPER = "|".join(TITLES), "|".join(t.upper() for t in TITLES)
#: Given names that need no title before them: all listed ones, as a capitalised word must follow.
_GIVEN, _GIVEN_UPPER = "|".join(GIVEN), "|".join(g.upper() for g in GIVEN)
#: A name may have capitals inside (McDonald) or begin with one letter (O'Brien).
_NAME = r"\p{Lu}(?:[\p{Ll}\p{M}]++|(?=['’]\p{Lu}\p{Ll}))(?:[-'’]?\p{Lu}[\p{Ll}\p{M}]++)*+"
_AHEAD = rf"(?:(?:{PARTICLES}) )?\p{{Lu}}"
_CAPS = r"\p{Lu}{2,}+(?:[-'’]\p{Lu}{2,}+)*+"

#: Entity types in the order in which the pattern tries them. Each begins at a border, so a run is scanned once.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*+)\.)+[\p{L}]{2,}+",
    "key": r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36,}+|sk-[0-9A-Za-z_-]{20,}+|xox[abprs]-[0-9A-Za-z-]{10,}+)(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    # whole, or with :: for a run of zeros, two groups and a digit at least
    "ip6": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*\d)[0-9A-Fa-f]{2,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]{32})(?:(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{32,}+|(?=[0-9A-F]*\d)(?=[0-9A-F]*[A-F])[0-9A-F]{32,}+)(?![0-9A-Za-z])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\p{L}\d])\d(?:[ -]?\d){12,18}+(?![\p{L}\d])",
    "phone": r"(?<![\p{L}\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}|0\d{2,4}[ -]\d{6,8}|0\d{2,4}[ -]\d{3,4}[ -]\d{3,4})(?![\p{L}\d])",
    # a capitalised word before another one, which is looked at first
    "person": rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}}\p{{L}}*+\.? {_AHEAD})(?:(?:(?:{_TITLES})\.? )+(?:\p{{Lu}}\. ?)*+(?:(?:{PARTICLES}) )?{_NAME}(?: (?:(?:{PARTICLES}) )?{_NAME}){{0,2}}"
    rf"|(?:{_GIVEN}) (?:\p{{Lu}}\. )*+(?:(?:{PARTICLES}) )?{_NAME}(?: {_NAME})?"
    # in capitals: after a title, or a listed name and one word that stand alone among other text
    rf"|(?:(?:{_TITLES_UPPER})\.? )+{_CAPS}(?: {_CAPS})?|(?<!\p{{Lu}}\p{{Lu}} )(?:{_GIVEN_UPPER}) {_CAPS}(?! \p{{Lu}}{{2}}))(?![\p{{L}}\p{{N}}])",
    "han": rf"[{HAN_SURNAMES}]\p{{IsHan}}{{0,2}}?(?:{HAN_TITLES})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has; texts without it are not scanned further. Names begin with a capital, which is looked at first.
MARKS = "[@0-9]"
RARE_MARKS = ["AKIA", "gho_", "ghp_", "ghs_", "ghu_", "sk-", "xox", *HAN_TITLES.split("|")]
NAME_MARK = rf"[A-ZА-Я](?<=(?<![\p{{L}}\p{{N}}]).)(?=\p{{L}}*+\.? {_AHEAD})(?<=(?=(?:{_TITLES}|{_GIVEN}|{_TITLES_UPPER}|{_GIVEN_UPPER})[. ]).)"
#: Redraws after which the table is written as a whole; and how many collisions may be sent to every task.
REDRAWS_A_TABLE, FEW_COLLISIONS = 8, 10_000
#: Borders of capitalised words, names with hyphens and apostrophes as one.
WORD_BORDERS = r"(?<![\p{L}\p{M}\p{N}])(?<![\p{L}\p{M}][-'’])(?=\p{Lu})|(?<=[\p{L}\p{M}])(?![\p{L}\p{M}\p{N}])(?![-'’]\p{Lu})"
#: Beyond how many mentions, or which share of all, an entity is hot: its surrogate is broadcast. No more than 1 / HOT_SHARE are.
HOT_MENTIONS, HOT_SHARE = 50_000, 1e-4


def _hint(text: Column) -> Column:
    out = text.rlike(MARKS)
    for mark in RARE_MARKS:
        out = out | F.contains(text, F.lit(mark))
    return out | text.rlike(NAME_MARK)


def _entity_type(value: Column) -> Column:
    out = None
    for name, pattern in PATTERNS.items():
        test = value.rlike(f"^(?:{pattern})$")
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def _draw(seed: Column, index: Column) -> Column:
    """A number of 0..65535 for each index, from the digest of the seed and the index's block of 16."""
    block = F.sha2(F.concat_ws("\u0002", seed, F.floor(index / 16).cast("string")), 256)
    return F.conv(F.substring(block, (index % 16 * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _pick(alphabet: str, number: Column) -> Column:
    return F.substring(F.lit(alphabet), number % len(alphabet) + 1, F.lit(1))


def _same_classes(value: Column, seed: Column, hexadecimal: bool = False) -> Column:
    """Each digit a digit, each letter a letter of its case and script, all else kept."""

    def one(c: Column, i: Column) -> Column:
        n = _draw(seed, i)
        if hexadecimal:
            return F.when(c.rlike("[0-9a-f]"), _pick("0123456789abcdef", n)).when(c.rlike("[A-F]"), _pick("ABCDEF", n)).otherwise(c)
        out = F.when(c.rlike("[0-9]"), _pick("0123456789", n)).when(c.rlike("[a-z]"), _pick(_LOWER, n)).when(c.rlike("[A-Z]"), _pick(_UPPER, n))
        out = out.when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), _pick(_CYRILLIC_UPPER, n)).otherwise(_pick(_CYRILLIC_LOWER, n)))
        out = out.when(c.rlike(r"\p{IsGreek}"), F.when(c.rlike(r"\p{Lu}"), _pick(_GREEK_UPPER, n)).otherwise(_pick(_GREEK_LOWER, n)))
        return out.when(c.rlike(r"\p{Lu}"), _pick(_UPPER, n)).when(c.rlike(r"\p{Ll}"), _pick(_LOWER, n)).otherwise(c)

    return F.array_join(F.transform(F.split(value, "(?!^)(?!$)"), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one undoubled."""
    n = F.length(digits)

    def term(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, "(?!^)(?!$)"), term), F.lit(0), lambda a, b: a + b)


def _laid(value: Column, drawn: Column) -> Column:
    """drawn's characters, one by one, at the places of value's letters and digits; the separators stay."""

    def step(d: Column):
        def one(done: Column, c: Column) -> Column:
            n = F.length(d) - F.length(done["left"])
            used = F.struct(F.concat(done["out"], F.substring(d, n + 1, F.lit(1))).alias("out"), F.substring(done["left"], F.lit(2), F.length(d)).alias("left"))
            return F.when(c.rlike("[0-9A-Za-z]"), used).otherwise(F.struct(F.concat(done["out"], c).alias("out"), done["left"].alias("left")))

        return F.aggregate(F.split(value, "(?!^)(?!$)"), F.struct(F.lit("").alias("out"), d.alias("left")), one, lambda done: done["out"])

    return _let(drawn, step)


def _card(digits: Column, seed: Column) -> Column:
    """Same length and first digit; a valid check digit if the original had one."""
    body = F.concat(F.substring(digits, 1, 1), F.substring(_same_classes(digits, seed), F.lit(2), F.length(digits) - 2))
    last = F.substring(_same_classes(digits, seed), -1, 1)
    check = lambda b: ((10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")
    return _let(body, lambda b: F.concat(b, F.when(_luhn_sum(digits) % 10 == 0, check(b)).otherwise(last)))


def _ip(seed: Column) -> Column:
    """An address with four octets of 1..254; the first is of a public unicast range."""
    octet = lambda k, lo, span: (_draw(seed, F.lit(k)) % span + lo).cast("string")
    return F.concat_ws(".", octet(0, 11, 112), octet(1, 1, 254), octet(2, 1, 254), octet(3, 1, 254))


def _kept(value: Column, pattern: str, seed: Column, hexadecimal: bool = False) -> Column:
    """What the pattern finds at the start stays, the rest keeps its classes."""
    start = F.regexp_extract(value, f"^(?:{pattern})", 0)
    return F.concat(start, _same_classes(F.substring(value, F.length(start) + 1, F.length(value)), seed, hexadecimal))


def _from(values: list[str] | str, number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), number % len(values) + 1)


def _name(value: Column, kind: Column, gender: Column, seed: Column, attempt: Column) -> Column:
    """A name of the same script, gender, case and number of hyphened parts; every second attempt adds a syllable to each."""
    cyrillic, latin = value.rlike(r"^[\p{IsCyrillic}'’-]+$"), value.rlike(r"^[\p{IsLatin}\p{M}'’-]+$")
    mids = F.floor(attempt / 2).cast("int") + 1

    def part(k: Column) -> Column:
        base = k * 64

        def of(heads: list[str], middles: list[str], ends: Column) -> Column:
            inner = F.transform(F.sequence(F.lit(0), mids - 1), lambda j: _from(middles, _draw(seed, base + j + 2)))
            return F.concat(_from(heads, _draw(seed, base)), F.array_join(inner, ""), ends)

        end = _draw(seed, base + 1)
        by_gender = lambda f, m, n: F.when(gender == "female", _from(f, end)).when(gender == "male", _from(m, end)).otherwise(_from(n, end))
        given = F.when(cyrillic, of(GIVEN_HEADS_CYRILLIC, GIVEN_MIDS_CYRILLIC, by_gender(FEMALE_ENDS_CYRILLIC, MALE_ENDS_CYRILLIC, NEUTRAL_ENDS_CYRILLIC)))
        given = given.otherwise(of(GIVEN_HEADS, GIVEN_MIDS, by_gender(FEMALE_ENDS, MALE_ENDS, NEUTRAL_ENDS)))
        surname = F.when(cyrillic, of(SURNAME_HEADS_CYRILLIC, SURNAME_MIDS_CYRILLIC, _from(SURNAME_TAILS_CYRILLIC, end)))
        surname = surname.otherwise(of(SURNAME_HEADS, SURNAME_MIDS, _from(SURNAME_TAILS, end)))
        return F.when(kind == "surname", surname).otherwise(given)

    built = F.array_join(F.transform(F.sequence(F.lit(0), F.size(F.split(value, "-")) - 1), part), "-")
    upper = (value == F.upper(value)) & (F.length(value) > 1)
    # other scripts: letters of the same script, more of them with the attempts
    other = F.concat(_same_classes(value, seed), _same_classes(F.repeat(F.lower(F.substring(value, -1, 1)), mids - 1), _digest(seed, F.lit("more"))))
    return F.when(cyrillic | latin, F.when(upper, F.upper(built)).otherwise(built)).otherwise(other)


def _han(value: Column, seed: Column, attempt: Column) -> Column:
    """A surname and as many given characters as there were (one at least), more with the attempts; the title stays."""
    title = F.regexp_extract(value, f"({HAN_TITLES})$", 1)
    n = F.greatest(F.lit(1), F.length(value) - F.length(title) - 1) + F.floor(attempt / 2).cast("int")
    given = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: _from(HAN_GIVEN, _draw(seed, k))), "")
    return F.concat(_from(HAN_SURNAMES, _draw(seed, F.lit(0))), given, title)


def _surrogate(key: str) -> Column:
    """Of (type, value, norm, gender, attempt); a mailbox's is its local part, a domain's its labels without the top level."""
    return _let(_digest(F.lit(key), F.col("type"), F.col("norm"), F.col("attempt").cast("string")), _drawn)


def _drawn(seed: Column) -> Column:
    value, kind, norm, attempt = F.col("value"), F.col("type"), F.col("norm"), F.col("attempt")
    longer = _same_classes(F.repeat(F.lit("a"), F.greatest(F.lit(0), attempt - 3)), _digest(seed, F.lit("more")))  # short ones run out of draws
    out = F.when(kind == "mailbox", F.concat(_same_classes(F.regexp_extract(value, "^(.*)@", 1), seed), longer)).when(kind == "domain", F.concat(_same_classes(value, seed), longer))
    out = out.when(kind == "ip", _ip(seed)).when(kind == "card", _laid(value, _card(norm, seed))).when(kind == "ssn", _laid(value, _same_classes(norm, seed)))
    code = F.length(F.regexp_extract(value, r"^\+(\d{1,3})", 1))  # a country code stays
    phone = F.concat(F.substring(norm, F.lit(1), code), F.substring(_same_classes(norm, seed), code + 1, F.length(norm)))
    out = out.when(kind == "phone", _laid(value, phone)).when(kind == "iban", _laid(value, _kept(norm, ".{2}", seed)))
    out = out.when(kind.isin("ip6", "secret"), _same_classes(value, seed, hexadecimal=True)).when(kind == "key", _kept(value, "AKIA|gh._|sk-|xox.-", seed))
    out = out.when(kind.isin("given", "surname"), _name(value, kind, F.col("gender"), seed, attempt)).when(kind == "han", _han(value, seed, attempt))
    return out.otherwise(_same_classes(value, seed))


def _domain(email: Column) -> Column:
    """Labels of an address's domain without the top level."""
    return F.regexp_extract(email, r"@(.*)\.[^.]+$", 1)


def _parts(kind: Column, value: Column) -> Column:
    """An entity as array of (type, value, gender): itself, an address's box and domain, or a person's title-free name parts."""
    words = F.split(value, " ")
    bare = lambda w: F.lower(F.regexp_replace(w, r"\.$", ""))
    of = lambda *lists: [x.lower() for each in lists for x in each]
    none = F.lit("")
    entry = lambda t, v, g: F.struct(t.alias("type"), v.alias("value"), g.alias("gender"))

    def person(names: Column) -> Column:
        titled = lambda titles: F.exists(words, lambda w: bare(w).isin(of(titles)))
        first = F.lower(names[0])
        gender = F.when(titled(FEMALE_TITLES), "female").when(titled(MALE_TITLES), "male")
        gender = gender.when(first.isin(of(FEMALE, FEMALE_CYRILLIC)), "female").when(first.isin(of(MALE, MALE_CYRILLIC)), "male").otherwise("")
        given = (F.size(names) > 1) | first.isin(of(GIVEN))
        head = entry(F.when(given, "given").otherwise("surname"), names[0], F.when(given, gender).otherwise(none))
        rest = F.transform(F.slice(names, F.lit(2), F.size(names)), lambda w: entry(F.lit("surname"), w, none))
        return F.concat(F.array(head), rest)

    box = F.array(entry(F.lit("mailbox"), value, none), entry(F.lit("domain"), _domain(value), none))
    # particles and initials stay as they are
    names = F.filter(words, lambda w: w.rlike(r"^\p{Lu}[^.]") & ~bare(w).isin(of(TITLES)))
    return F.when(kind == "person", _let(names, person)).when(kind == "email", box).otherwise(F.array(entry(kind, value, none)))


def _norm(kind: Column, value: Column) -> Column:
    """What makes two spellings one entity: digits of numbers, lower case elsewhere; names in Han without their title."""
    digits = F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(value, r"\D", "")).when(kind == "iban", F.regexp_replace(value, " ", ""))
    return digits.when(kind == "han", F.regexp_replace(value, f"(?:{HAN_TITLES})$", "")).otherwise(F.lower(value))


def _spread(df: DataFrame) -> DataFrame:
    """By entity over all tasks: drawing costs digests, and a small table would else be one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "type", "norm")


def surrogate_table(found: DataFrame, key: str) -> DataFrame:
    """(type, value, surrogate, mentions) for every distinct spelling in found (doc rows with `found` arrays).

    Spellings of one normal form share their draw. Surrogates are distinct per type and normal form, differ
    from their entity, and are no entity of the corpus; ties go to the lesser normal form. A given name's
    gender is the one that its mentions agree on.
    """
    each = found.select(F.explode("found").alias("value")).groupBy("value").agg(F.count("*").alias("n")).withColumn("type", _entity_type(F.col("value")))
    parts = each.select("n", F.explode(_parts(F.col("type"), F.col("value"))).alias("p")).select("n", "p.*")
    spelled = parts.groupBy("type", "value", _norm(F.col("type"), F.col("value")).alias("norm")).agg(
        F.sum("n").alias("mentions"), F.bool_or(F.col("gender") == "female").alias("f"), F.bool_or(F.col("gender") == "male").alias("m")
    )
    told = spelled.where("f OR m").groupBy("type", "norm").agg(F.when(F.bool_and(~F.col("m")), "female").when(F.bool_and(~F.col("f")), "male").otherwise("").alias("gender"))
    spelled = spelled.select("type", "value", "norm", "mentions").join(told, ["type", "norm"], "left").withColumns({"gender": F.coalesce("gender", F.lit("")), "attempt": F.lit(0)})
    table = materialize(_spread(spelled).withColumn("surrogate", _surrogate(key)), "surrogates")
    written = [table]
    boxed = F.col("type") == "mailbox"
    while True:
        # boxes are told apart within their domain, whose surrogate is none of the corpus
        drawn = F.when(boxed, F.concat(F.lower("surrogate"), F.lit("@"), F.lower(F.regexp_extract("value", "@(.*)$", 1)))).otherwise(_norm(F.col("type"), F.col("surrogate")))
        real = table.select(F.col("norm").alias("taken")).distinct()
        keyed = table.select("type", "norm", drawn.alias("taken")).distinct()
        first = Window.partitionBy("type", "taken").orderBy("norm")
        twice = keyed.withColumn("place", F.row_number().over(first)).where("place > 1").select("type", "norm")
        used = keyed.where(~boxed).join(real, "taken", "left_semi").select("type", "norm")
        kept = table.where(boxed & (F.lower("surrogate") == F.lower(F.regexp_extract("value", "^(.*)@", 1)))).select("type", "norm")
        again = materialize(twice.unionByName(used).unionByName(kept).distinct(), "collisions")
        if again.isEmpty():
            return table.select("type", "value", "surrogate", "mentions")
        # only what is drawn anew is written anew
        redo = materialize(table.join(again, ["type", "norm"], "left_semi").withColumn("attempt", F.col("attempt") + 1).withColumn("surrogate", _surrogate(key)), "surrogates")
        table = table.join(F.broadcast(again) if again.count() < FEW_COLLISIONS else again, ["type", "norm"], "left_anti").unionByName(redo)
        written.append(redo)
        if len(written) > REDRAWS_A_TABLE:
            whole = materialize(table, "surrogates")
            for each in written:
                delete_table(each)
            table, written = whole, [whole]


def _with_surrogates(parts: DataFrame, table: DataFrame) -> DataFrame:
    """parts with their surrogates. Hot entities, no more than 1 / HOT_SHARE, are looked up in a broadcast list; the others meet by a shuffle."""
    total = table.agg(F.coalesce(F.sum("mentions"), F.lit(0))).first()[0]
    hot = table.where(F.col("mentions") > max(HOT_MENTIONS, total * HOT_SHARE)).select("type", "value", F.col("surrogate").alias("known"))
    if hot.isEmpty():
        return parts.join(table.select("type", "value", "surrogate"), ["type", "value"])
    seen = parts.join(F.broadcast(hot), ["type", "value"], "left")
    ready = seen.where("known IS NOT NULL").withColumnRenamed("known", "surrogate")
    rest = seen.where("known IS NULL").drop("known").join(table.select("type", "value", "surrogate"), ["type", "value"])
    return ready.unionByName(rest)


def _mentions(piece: Column, names: Column) -> Column:
    """A text's capitalised words that are name parts of its persons (map names), replaced like these."""
    words = F.transform(F.split(piece, WORD_BORDERS, -1), lambda w: F.coalesce(F.try_element_at(names, w), w))
    return F.when(names.isNull() | ~piece.rlike(r"\p{Lu}"), piece).otherwise(F.array_join(words, ""))


def _assembled(text: Column, replaced: Column, names: Column) -> Column:
    pieces = F.transform(F.split(text, ANY, -1), lambda p: _mentions(p, names))
    return F.array_join(F.zip_with(pieces, replaced, lambda p, r: F.concat(F.coalesce(p, F.lit("")), F.coalesce(r, F.lit("")))), "")


def replace_entities(docs: DataFrame, key: str = "corpus-key-1") -> DataFrame:
    """docs with surrogates in text, and n_entities and entity_types (sorted, comma-joined) beside its columns.

    Null and empty texts stay and have no entities. Rows without entities are returned as they are and are
    not shuffled. Rows that repeat, and columns of any name, are kept; equal entities get equal surrogates
    everywhere. An empty table gives no rows.
    """
    mark = lambda name: f"_surrogates_{name}"
    text = F.col("text")
    has = F.coalesce(_hint(text) & text.rlike(ANY), F.lit(False))
    clean = docs.where(~has).withColumns({"n_entities": F.lit(0), "entity_types": F.lit("")})
    dirty = materialize(docs.where(has).withColumns({mark("row"): F.monotonically_increasing_id(), mark("found"): F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))}), "with-entities")
    table = surrogate_table(dirty.select(F.col(mark("found")).alias("found")), key)
    each = dirty.select(F.col(mark("row")).alias("row"), F.posexplode(mark("found")).alias("place", "entity")).withColumn("kind", _entity_type(F.col("entity")))
    parts = each.select("row", "place", "kind", "entity", F.posexplode(_parts(F.col("kind"), F.col("entity"))).alias("at", "p")).select("row", "place", "kind", "entity", "at", "p.*")
    ready = _with_surrogates(parts.drop("gender"), table)
    drawn = ready.groupBy("row", "place", "kind", "entity").agg(F.array_sort(F.collect_list(F.struct("at", "value", "surrogate"))).alias("names"))
    # a person's words are replaced one by one, titles stay
    words = F.transform(F.split("entity", " "), lambda w: F.coalesce(F.get(F.filter("names", lambda x: x["value"] == w), F.lit(0))["surrogate"], w))
    only = F.col("names")[0]["surrogate"]
    mail = F.concat(only, F.lit("@"), F.col("names")[1]["surrogate"], F.regexp_extract("entity", r"\.[^.]+$", 0))
    spelled = F.when(F.col("kind") == "person", F.array_join(words, " ")).when(F.col("kind") == "email", mail).otherwise(only)
    # a document's later mentions of a person by one name
    known = ready.where("kind = 'person'").groupBy("row", "value").agg(F.min_by("surrogate", F.struct("place", "at")).alias("surrogate"))
    known = known.groupBy(F.col("row").alias(mark("row"))).agg(F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias(mark("names")))
    rows = drawn.select("row", "place", "kind", spelled.alias("surrogate")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "surrogate"))).alias("s"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    joined = dirty.join(rows.select(F.col("row").alias(mark("row")), F.col("s").alias(mark("s")), F.col("kinds").alias(mark("kinds"))), mark("row")).join(known, mark("row"), "left")
    done = joined.withColumn("text", _assembled(text, F.transform(mark("s"), lambda x: x["surrogate"]), F.col(mark("names")))).withColumns({"n_entities": F.size(mark("found")), "entity_types": F.col(mark("kinds"))})
    return clean.unionByName(done.select(*clean.columns))

"""Surrogates for personal data and secrets.

Entities are found by one pattern. Mentions of an entity share a canonical form
(case, spacing and separators folded), and that form has one surrogate in the
whole corpus, drawn from a digest of type and form under the caller's key:
numbers and codes digit by digit and letter by letter within their case and
script, so length, format and type stay. Names go word by word: a surname has
one surrogate, whoever bears it, and so has a given name of a gender, so "Mr
John Smith" and "Mr Smith" stay one family, and two persons who differ in either
word still differ. A name that a text mentions with a title is also replaced
where the text repeats it, or its surname, without one. Two entities that would
get the same surrogate, or a surrogate that is itself an entity of the corpus,
are found by grouping; all but one of them go on to their next digest until none
is left. Later digests give longer surrogates, so that distinct ones never run
out: names, e-mails, secrets and keys grow with every turn, formats of fixed
length only after ROUNDS turns. A text is then rebuilt from the pieces between
its mentions.

Only documents that may hold an entity leave the scan; the rest pass through.

Edge cases: null and empty texts stay; repeated rows and rows of equal ids are
rebuilt each by its own text; columns other than the text pass unread, under
any name and of any type; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm._session import cut, named, unpacked, whole_rows

#: Turns in which types of fixed length keep it; later candidates are longer.
ROUNDS = 12

#: Patterns of entity types, tried in this order.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}",
    "awskey": r"\bA(?:KIA|SIA)[0-9A-Z]{16}\b",
    "secret": r"(?<=[=:\"'\s])(?<=[=:]\s{0,3}[\"']?)(?<=(?i:password|passwd|pwd|token|secret|api_key|apikey)\s{0,3}[=:]\s{0,3}[\"']?)(?![\"'\s])[^\s\"']{6,}+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ipv6": r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])",
    "key": r"\b(?:gh[pousr]|xox[abpr]|sk|pk|rk)[-_](?=[A-Za-z0-9_-]*\d)[A-Za-z0-9_-]{16,}+",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "man": r"(?<= )(?=\p{Lu})(?<=\b(?:Mr\.?|Mister|Sir|Herr|Monsieur|Señor|Sr\.|г-н|господин) )\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?",
    "woman": r"(?<= )(?=\p{Lu})(?<=\b(?:Mrs\.?|Ms\.?|Miss|Frau|Madame|Mme|Señora|Sra\.|г-жа|госпожа) )\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?",
}
#: Names follow one of these titles, secrets one of these words in any case.
TITLES = ("Mr", "Ms", "Mis", "Sir ", "Herr ", "Frau ", "Monsieur ", "Madame ", "Mme ", "Señor", "Sr. ", "Sra. ", "г-н", "г-жа", "господин", "госпожа")
SECRETS = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey")

#: Given names by script and gender.
GIVEN = {
    "latin": {"man": ["Adam", "Bruno", "Carl", "Daniel", "Edgar", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leon", "Martin", "Nils", "Oscar", "Paul"],
              "woman": ["Alma", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Hanna", "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Olivia", "Paula"]},
    "cyrillic": {"man": ["Андрей", "Борис", "Виктор", "Денис", "Егор", "Иван", "Максим", "Олег"],
                 "woman": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"]},
}
#: Letters that surrogate letters are drawn from, by script.
LETTERS = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

#: Types of the words of a name.
NAMES = ("given-man", "given-woman", "surname")

EVERY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def kind_of(value: Column) -> Column:
    """Type of a mention; the lookbehind of a pattern is not part of it, so names and secrets are told by what is left."""
    out = F.when(value.rlike(f"^(?:{PATTERNS['email']})$"), "email").when(value.rlike(r"^A(?:KIA|SIA)[0-9A-Z]{16}$"), "awskey")
    for kind in ("ip", "ipv6", "key", "iban", "ssn", "phone", "card"):
        out = out.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return out.otherwise("secret")


def canonical(kind: Column, value: Column) -> Column:
    """What mentions of one entity have in common."""
    compact = F.regexp_replace(value, r"[^0-9A-Za-z]", "")
    return F.when(kind.isin("ssn", "phone", "card", "iban"), F.upper(compact)).when(kind == "email", F.lower(value)).when(kind.isin(*NAMES), F.lower(value)).otherwise(value)


def digest(key: str, kind: Column, form: Column, turn: Column) -> Column:
    """Numbers 0 to 255, as many as the form has characters, in blocks of 32."""
    block = lambda i: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, form, turn.cast("string"), i.cast("string")), 256)
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(form) / 32).cast("int")), block)


def number(digits: Column, i: Column) -> Column:
    """The i-th number of a digest."""
    return F.conv(F.substring(F.get(digits, F.floor(i / 32).cast("int")), i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def bound(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def characters(form: Column, digits: Column, start: Column, stop: Column) -> Column:
    """The form with its letters and digits replaced in class; characters before start and from stop on stay."""

    def one(c: Column, i: Column, x: Column, hexadecimal: Column) -> Column:
        drawn = lambda letters: F.substring(F.lit(letters), x % len(letters) + 1, F.lit(1))
        cased = lambda letters: F.when(c.rlike(r"\p{Lu}"), F.upper(drawn(letters))).otherwise(drawn(letters))
        return (
            F.when((i < start) | (i >= stop), c)
            .when(c.rlike("[0-9]"), F.when((i == start) & (c != "0"), drawn("123456789")).otherwise(drawn("0123456789")))  # a number does not begin to start with 0
            .when(c.rlike("[a-f]") & hexadecimal, drawn("abcdef"))
            .when(c.rlike("[A-Z]"), drawn(LETTERS["upper"]))
            .when(c.rlike("[a-z]"), drawn(LETTERS["lower"]))
            .when(c.rlike(r"\p{IsCyrillic}"), cased(LETTERS["cyrillic"]))
            .when(c.rlike(r"\p{IsGreek}"), cased(LETTERS["greek"]))
            .when(c.rlike(r"\p{L}"), drawn(LETTERS["lower"]))
            .otherwise(c)
        )

    return bound(form.rlike("^[0-9a-f]+$"), lambda h: F.array_join(F.transform(F.split(form, ""), lambda c, i: bound(number(digits, i), lambda x: one(c, i, x, h))), ""))


def grown(key: str, kind: Column, form: Column, turn: Column) -> Column:
    """Further characters of this turn, 32 at most: letters for e-mails, digits for others."""
    drawn = F.when(kind == "email", LETTERS["lower"]).otherwise("0123456789")
    n = F.when(kind.isin("email", "secret", "key"), turn).otherwise(turn - ROUNDS)
    more = F.array(F.sha2(F.concat_ws("\x1f", F.lit(key), kind, form, turn.cast("string"), F.lit("more")), 256))
    pick = lambda i: F.substring(drawn, number(more, i) % F.length(drawn) + 1, F.lit(1))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.least(n, F.lit(32)) - 1), pick), "")).otherwise("")


def of_script(word: Column, cyrillic, greek, latin) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), cyrillic).when(word.rlike(r"\p{IsGreek}"), greek).otherwise(latin)


def syllables(key: str, kind: Column, form: Column, turn: Column, n: Column) -> Column:
    """n syllables of the form's script, 16 at most a turn's digest."""
    d = F.array(F.sha2(F.concat_ws("\x1f", F.lit(key), kind, form, turn.cast("string"), F.lit("syllables")), 256))
    even, odd = of_script(form, "бвгдклмнпрст", "βγδκλμνπρστχ", "bdfgklmnprst"), of_script(form, "аеиоу", "αειου", "aeiou")
    pick = lambda i, x: F.substring(x, number(d, i) % F.length(x) + 1, F.lit(1))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.least(n, F.lit(16)) * 2 - 1), lambda i: pick(i, F.when(i % 2 == 0, even).otherwise(odd))), "")).otherwise("")


def name_word(key: str, kind: Column, form: Column, turn: Column) -> Column:
    """Candidate for a word of a name: a given name of its gender and script, longer by a syllable each turn; a surname of three syllables and more, with the parts and the ending of its form."""
    d = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), kind, form, turn.cast("string")), 256), 1, 8), 16, 10).cast("long")
    one = lambda names: F.element_at(F.array(*map(F.lit, names)), (d % len(names) + 1).cast("int"))
    of = lambda script: F.when(kind == "given-man", one(GIVEN[script]["man"])).otherwise(one(GIVEN[script]["woman"]))
    fresh = lambda x, n: F.initcap(syllables(key, kind, x, turn, n))
    given = F.concat(of_script(form, of("cyrillic"), fresh(form, F.lit(3)), of("latin")), F.when(turn > 0, syllables(key, kind, form, turn, turn)).otherwise(""))
    feminine = form.rlike("[аяη]$")
    ending = of_script(form, F.when(feminine, "ова").otherwise("ов"), F.when(feminine, "η").otherwise("ς"), F.substring(F.lit("klmnrst"), (d % 7 + 1).cast("int"), F.lit(1)))
    part = lambda x, i: bound(F.concat_ws("/", x, i.cast("string")), lambda y: F.concat(fresh(y, F.when(i == 0, turn + 3).otherwise(F.lit(2))), ending))
    return F.when(kind == "surname", F.array_join(F.transform(F.split(form, "-"), part), "-")).otherwise(given)


def luhn(number: Column) -> Column:
    """The number with its last digit set so that the checksum holds."""
    n = F.length(number)

    def part(i: Column) -> Column:
        d = F.substring(number, i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 2), part), F.lit(0), lambda a, b: a + b)
    return F.concat(F.substring(number, F.lit(1), n - 1), F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string"))


def surrogate(key: str, kind: Column, form: Column, turn: Column) -> Column:
    """Candidate of this turn in canonical form; the space it is drawn from grows with the turn."""

    def made(d: Column, more: Column) -> Column:
        octet = lambda i: (number(d, i) % 254 + 1).cast("string")
        after = lambda mark: F.when(more != "", F.concat(F.lit(mark), more)).otherwise("")
        start = F.when(kind.isin("awskey", "key"), 4).when(kind == "phone", 1).when(kind == "iban", 2).otherwise(0)
        stop = F.when(kind == "email", F.length(form) - F.length(F.substring_index(form, ".", -1)) - 1).otherwise(F.length(form))
        return (
            F.when(kind == "ip", F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), octet), "."), after(":")))
            .otherwise(bound(characters(form, d, start, stop), lambda x: (
                F.when(kind == "email", F.concat(more, x))
                .when(kind == "ipv6", F.concat(F.regexp_replace(x, "[g-zG-Z]", "a"), after("%")))
                .when(kind == "card", bound(F.concat(x, more), luhn))
                .otherwise(F.concat(x, more)))))
        )

    coded = bound(digest(key, kind, form, turn), lambda d: bound(grown(key, kind, form, turn), lambda more: made(d, more)))
    return F.when(kind.isin(*NAMES), name_word(key, kind, form, turn)).otherwise(coded)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, form, surrogate: distinct entities with distinct surrogates, none of which is an entity.

    Each round groups the candidates; of those that clash, all but the first
    turn to their next candidate. Only clashes cost a further round, and as
    candidates grow with the turn, the rounds end when none is left.
    """
    held = cut(entities.select("kind", "form", F.lit(0).alias("turn")).withColumn("surrogate", surrogate(key, F.col("kind"), F.col("form"), F.col("turn"))))
    while True:
        firsts = held.groupBy("kind", "surrogate").agg(F.min(F.struct("turn", "form")).alias("first"), F.count(F.lit(1)).alias("n"))
        taken = entities.select(F.col("kind").alias("k_"), F.col("form").alias("f_"))
        real = (F.col("kind") == F.col("k_")) & (canonical(F.col("kind"), F.col("surrogate")) == F.col("f_"))
        bad = firsts.join(taken, real, "left").where("n > 1 or f_ is not null")
        bad = bad.select(F.col("kind").alias("k_"), F.col("surrogate").alias("s_"), F.when(F.col("f_").isNull(), F.col("first.form")).alias("stays"))
        if bad.isEmpty():
            return held.select("kind", "form", "surrogate")
        clash = held.join(bad, (F.col("kind") == F.col("k_")) & (F.col("surrogate") == F.col("s_")), "left")
        moves = F.col("s_").isNotNull() & (F.col("stays").isNull() | (F.col("stays") != F.col("form")))
        turned = clash.select("kind", "form", F.when(moves, F.col("turn") + 1).otherwise(F.col("turn")).alias("turn"), F.when(~moves, F.col("surrogate")).alias("old"))
        held = cut(turned.select("kind", "form", "turn", F.coalesce("old", surrogate(key, F.col("kind"), F.col("form"), F.col("turn"))).alias("surrogate")))


def rendered(kind: Column, value: Column, made: Column) -> Column:
    """The surrogate in the format of this mention."""
    place = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i), r"[^0-9A-Za-z]", ""))
    spaced = F.array_join(
        F.transform(F.sequence(F.lit(0), F.length(value) - 1), lambda i: bound(F.substring(value, i + 1, F.lit(1)), lambda c: F.when(c.rlike("[0-9A-Za-z]"), F.substring(made, place(i + 1), F.lit(1))).otherwise(c))),
        "",
    )
    spaced = F.concat(spaced, F.substring(made, place(F.length(value)) + 1, F.length(made)))
    upper = (F.upper(value) == value) & (F.lower(value) != value)
    return F.when(kind.isin("ssn", "phone", "card", "iban"), spaced).when((kind == "email") & upper, F.upper(made)).when(kind.isin(*NAMES) & upper & (F.length(value) > 1), F.upper(made)).otherwise(made)


def mentioned(text: Column) -> Column:
    """Mentions of a text in reading order: value and, for names, the gender that their title tells."""
    titled = lambda p: F.when(has_any(text, TITLES), F.regexp_extract_all(text, F.lit(f"({PATTERNS[p]})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    kind = lambda v, men, women: F.when(v.rlike(r"^\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?$") & F.array_contains(men, v), "man").when(v.rlike(r"^\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?$") & F.array_contains(women, v), "woman").otherwise(kind_of(v))
    found = F.regexp_extract_all(text, F.lit(f"({EVERY})"), F.lit(1))
    return bound(titled("man"), lambda men: bound(titled("woman"), lambda women: F.transform(found, lambda v: F.struct(v.alias("value"), kind(v, men, women).alias("kind")))))


def parts(value: Column, kind: Column) -> Column:
    """What a mention consists of: the words of a name (the last one is the surname), or the whole."""
    words = F.split(value, " ")
    of_name = F.transform(words, lambda w, j: F.struct(F.when(j == F.size(words) - 1, "surname").otherwise(F.concat(F.lit("given-"), kind)).alias("kind"), w.alias("value")))
    return F.when(kind.isin("man", "woman"), of_name).otherwise(F.array(F.struct(kind.alias("kind"), value.alias("value"))))


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out |= F.contains(text, F.lit(word))
    return out


def may_hold(text: Column) -> Column:
    """Cheap test that no text with an entity fails."""
    return F.coalesce(text.rlike("[0-9@]") | has_any(text, TITLES) | has_any(F.lower(text), SECRETS), F.lit(False))


def hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return hashable(kind.elementType)
    return all(hashable(f.dataType) for f in kind) if isinstance(kind, T.StructType) else not isinstance(kind, (T.MapType, T.VariantType))


def untitled(piece: Column, names: Column) -> Column:
    """A piece between mentions, with the names that its text mentions elsewhere replaced: whole names first, then surnames."""
    word = lambda x: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), x, F.lit(r"\E(?![\p{L}\p{N}])"))
    once = lambda p, n: F.when(F.contains(p, n["value"]), F.regexp_replace(p, word(n["value"]), n["s"])).otherwise(p)
    return F.aggregate(names, piece, once)


def replace(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """The table with surrogates in its text column; with `count`, also a column of how many mentions were replaced.

    The same key gives the same surrogates; whoever does not know it cannot
    tell which entity a surrogate stands for.
    """
    body = named(text).cast("string")
    hinted = may_hold(body)
    rest = docs.where(~hinted)
    own = [named(f.name) for f in docs.schema if hashable(f.dataType)]
    some = docs.where(hinted).select(whole_rows(docs), F.xxhash64(*own).alias("k"), body.alias("t"))
    mentions = some.select("k", F.xxhash64("t").alias("h"), F.posexplode(mentioned(F.col("t"))).alias("i", "m")).select("k", "h", "i", "m.*")
    mentions = mentions.distinct().select("k", "h", "i", F.col("kind").isin("man", "woman").alias("person"), F.posexplode(parts(F.col("value"), F.col("kind"))).alias("j", "p")).select("k", "h", "i", "person", "j", "p.*")
    mentions = cut(mentions.withColumn("form", canonical(F.col("kind"), F.col("value"))))
    made = assign(mentions.select("kind", "form").distinct(), key)
    shown = rendered(F.col("kind"), F.col("value"), F.col("surrogate"))
    found = mentions.join(made, ["kind", "form"]).select("k", "h", F.struct("i", "j", shown.alias("s"), "value", "person").alias("x"))
    found = found.groupBy("k", "h").agg(F.sort_array(F.collect_list("x")).alias("x"))
    # mentions in order, their words joined again; names, longest first, for untitled repeats
    ends = lambda x: F.filter(x, lambda m, at: F.coalesce(F.get(x, at + 1)["i"] != m["i"], F.lit(True)))
    whole = lambda x: F.transform(ends(x), lambda m: bound(F.filter(x, lambda y: y["i"] == m["i"]), lambda w: F.struct(F.array_join(F.transform(w, lambda y: y["s"]), " ").alias("s"), F.array_join(F.transform(w, lambda y: y["value"]), " ").alias("value"), m["person"].alias("person"))))
    surnames = lambda x: F.transform(ends(x), lambda m: F.struct(m["s"].alias("s"), m["value"].alias("value"), m["person"].alias("person")))
    people = lambda x: F.filter(x, lambda m: m["person"])
    longest = lambda x: F.array_sort(F.array_distinct(x), lambda a, b: F.when(F.length(a["value"]) != F.length(b["value"]), F.length(b["value"]) - F.length(a["value"])).when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0))
    found = found.select("k", "h", whole(F.col("x")).alias("found"), "x")
    found = found.select("k", "h", F.transform("found", lambda m: m["s"]).alias("found"), longest(F.concat(people(F.col("found")), people(surnames(F.col("x"))))).alias("names"))
    out = some.withColumn("h", F.xxhash64("t")).join(found, ["k", "h"], "left")
    pieces = F.split("t", EVERY, -1)
    plain = lambda p: F.when(F.size("names") > 0, untitled(p, F.col("names"))).otherwise(p)
    new = F.array_join(F.transform(pieces, lambda p, i: F.concat(plain(p), F.coalesce(F.get(F.col("found"), i), F.lit("")))), "")
    out = out.select("row", F.when(F.col("found").isNull(), F.col("t")).otherwise(new).alias("t"), F.coalesce(F.size("found"), F.lit(0)).alias("n"))
    more = [F.greatest(F.col("n"), F.lit(0)).cast("long").alias(count)] if count else []
    none = [F.lit(0).cast("long").alias(count)] if count else []
    return out.select(*unpacked(docs.columns, **{text: F.col("t")}), *more).unionByName(rest.select(*[named(c).alias(c) for c in docs.columns], *none))

"""Personal data replaced by surrogates that keep type, format, script and gender.

Entities are found by patterns: e-mail addresses, IPv4 and IPv6 addresses, telephone numbers with a
country's code or in the grouping 3-3-4, card numbers in the usual groups or of 13 to 19 digits that
pass the Luhn check, social security and account numbers, quoted, named and cloud-access secrets, and
names behind a title. A name that was found is also replaced where the same text has it without the
title, whole or the surname alone. An entity is its type and canonical
form (lower case, digits without separators), so mentions in another case or grouping are the same
entity. Its surrogate comes from a keyed hash of both: digits give digits, letters give letters of
their script, given names keep the gender of the title, hexadecimal secrets stay hexadecimal, card
numbers keep a valid check digit, mail hosts become hosts below example.com, .net or .org.

Distinctness is checked over the table of all distinct entities: a surrogate that two entities
share, or that is itself an entity of the corpus, is drawn again for the later entity with a higher
attempt number, until none is left. So equal entities get equal surrogates everywhere, different
ones different surrogates, and none is mistaken for a real one. A mention is then written in its
own case and grouping.

All steps are DataFrame operations. Texts without a match are passed on without a shuffle. Texts
with one are keyed by digest, equal texts are worked on once, and the tables that are joined are
stored first, so keys that many rows share are split among tasks. Null and empty texts stay as
they are. Extra columns stay; repeated rows stay repeated. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import fresh, stored

# Titles, scripts and syllables.
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа")
TITLES_M = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н")
TITLES_N = ("Dr", "Prof", "Professor", "Doctor")
LATIN = "abcdefghijklmnopqrstuvwxyz"
ACCENTED = "àáâäçèéêëíîïñóôöùúûü"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"
SYLLABLES_LATIN = ("ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "re", "si", "to", "va", "we", "zi", "du")
SYLLABLES_CYRILLIC = ("ба", "де", "фи", "го", "ка", "ле", "ми", "но", "па", "ре", "си", "то", "ва", "же", "зи", "ду")

#: Draws until the search for distinct surrogates is given up, and after which forms grow by a letter.
ROUNDS = 40
GROW = 4

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_TITLE = "|".join((*TITLES_F, *TITLES_M, *TITLES_N))
_FIRST = "[DFHMPSГ]"  # a title's first letter
# what a secret is assigned to
_KEYED = r"(?i:passwords?|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key)"
_HEX = "[0-9A-Fa-f]{1,4}"
# what may stand between the groups of a number
_GAP = r"[^\p{L}\p{N}(+]{0,8}"
# a part of a name, to its last letter: inner capitals, apostrophes and hyphens, without a possessive s
_PART = r"\p{Lu}(?:['’]?\p{L}++)(?:['’-](?!s(?!\p{L}))\p{L}++)*+"
#: Every pattern begins with what a rare first character rules out, so most positions cost one test.
PATTERNS = {
    "secret": r"=[^\p{L}\p{N}\"]{0,8}\"[0-9A-Za-z+/_-]{16,}\"",
    "keyed": rf"(?=[PpSsTtAa])(?<!\p{{L}}){_KEYED}\"?[ ]{{0,2}}[:=][ ]{{0,2}}[\"']?(?=[A-Za-z+/_-]*[0-9])[0-9A-Za-z+/_-]{{8,}}+[\"']?",
    "access": r"(?=A[KS]IA)(?<![\p{L}\p{N}])A[KS]IA[0-9A-Z]{16}(?![\p{L}\p{N}])",
    "ip6": (
        r"(?=[0-9A-Fa-f]{0,4}:)(?<![\p{L}\p{N}:.])(?:"
        rf"(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}"
        r")(?![\p{L}\p{N}:])"
    ),
    "number": (
        r"(?=[+(0-9])(?:"
        rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])"
        rf"|\+[0-9]{{1,3}}{_GAP}\([0-9]{{2,4}}\){_GAP}[0-9]{{3}}[ .-]?[0-9]{{4}}(?![0-9])"
        r"|(?<![\p{L}\p{N}])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}|[ .-]?\([0-9]{1,4}\)){2,4}(?![0-9])"
        r"|(?<![\p{L}\p{N}+(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9-])"
        r"|(?<![0-9.+-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![0-9-])"
        r"|(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
        r"|(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])"
        r"|(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])"
        r"|(?<![\p{L}\p{N}.,-])[0-9]{13,19}(?![\p{L}\p{N}-])"
        r")"
    ),
    "account": r"(?=[A-Z]{2}[0-9]{2})(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[A-Z0-9]{1,3}|[ ](?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "name": rf"(?={_FIRST})(?<!\p{{L}})(?:{_TITLE})\.? {_PART}(?: {_PART})?",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every match needs; texts without it are not searched any further.
HINT = rf"[0-9@=]|(?={_FIRST})(?:{_TITLE})\.? \p{{Lu}}"


def mentions(text: Column) -> Column:
    """All matches of a text, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def kind(m: Column) -> Column:
    """Type of a match. The order settles what could be read as two types."""
    return (
        F.when(m.startswith("=") | m.rlike(rf"^{_KEYED}") & m.rlike("[:=]") | m.rlike("^A[KS]IA[0-9A-Z]{16}$"), "secret")
        .when(m.contains("@"), "email")
        .when(m.rlike(rf"^(?:{_TITLE})\.? "), "name")
        .when(m.contains(":"), "ip6")
        .when(m.rlike(r"^[+(]|^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$"), "phone")
        .when(m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), "ip")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike(r"^[0-9 -]+$"), "card")
        .otherwise("account")
    )


def _inner(m: Column) -> Column:
    """What a secret's quotes hold, or what follows its name."""
    return F.when(m.startswith("="), F.regexp_extract(m, '"([^"]+)"', 1)).otherwise(F.regexp_extract(m, "([0-9A-Za-z+/_-]+)[\"']?$", 1))


def entities(m: Column) -> Column:
    """The one or two entities of a mention: array of (part, type, canon)."""

    def one(part: int, name: Column | str, canon: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), (F.lit(name) if isinstance(name, str) else name).alias("type"), canon.alias("canon"))

    digits = F.regexp_replace(m, "[^0-9]", "")
    names = F.split(F.regexp_replace(m, r"^\S+ ", ""), " ")
    given = F.when(m.rlike(rf"^(?:{'|'.join(TITLES_F)})\.? "), "given_f").when(m.rlike(rf"^(?:{'|'.join(TITLES_N)})\.? "), "given_n").otherwise("given_m")
    # the country's code: digits up to a separator, else two; none in a national number
    code = F.when(m.rlike(r"^\+[0-9]{1,3}[^0-9]"), F.regexp_extract(m, r"^\+([0-9]+)", 1)).otherwise(F.regexp_extract(m, r"^\+([0-9]{2})", 1))
    # long runs of digits are cards only if they pass the check; those in the usual groups always
    loose = ~m.rlike(r"^[0-9]{4}(?:[ -]?[0-9]{4}){3}$|^3[47]") & (luhn(digits) % 10 != 0)
    which = kind(m)
    return (
        F.when(which == "email", F.array(one(0, "email", F.lower(m)), one(1, "host", F.lower(F.substring_index(m, "@", -1)))))
        .when((which == "name") & (F.size(names) == 2), F.array(one(0, given, F.lower(names[0])), one(1, "surname", F.lower(names[1]))))
        .when(which == "name", F.array(one(0, "surname", F.lower(names[0]))))
        .when(which == "phone", F.array(one(0, "phone", F.concat(code, F.lit("|"), F.substring(digits, F.length(code) + 1, F.length(digits))))))
        .when((which == "card") & loose, F.array().cast("array<struct<part:int,type:string,canon:string>>"))
        .when(which == "ip6", F.array(one(0, "ip6", F.lower(m))))
        .when(which.isin("ssn", "card"), F.array(one(0, which, digits)))
        .when(which == "account", F.array(one(0, "account", F.regexp_replace(m, " ", ""))))
        .when(which == "ip", F.array(one(0, "ip", m)))
        .otherwise(F.array(one(0, "secret", F.when(_inner(m).rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lower(_inner(m))).otherwise(_inner(m)))))
    )


def _byte(h: Column, i: Column) -> Column:
    return F.conv(F.substring(h, (i * 2) % 126 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, b: Column) -> Column:
    return F.substring(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1))


def _letters(text: Column, h: Column, hexadecimal: Column | bool = False) -> Column:
    """Every letter and digit replaced by one of its script and case; the rest stays."""

    def sub(c: Column, i: Column) -> Column:
        b = _byte(h, i)
        low = F.lower(c)
        small = (
            F.when(c.rlike("^[0-9]$"), (b % 10).cast("string"))
            .when(low.rlike("^[a-z]$"), F.when(F.lit(hexadecimal) if isinstance(hexadecimal, bool) else hexadecimal, _pick("abcdef", b)).otherwise(_pick(LATIN, b)))
            .when(low.rlike("^[à-öø-ÿ]$"), _pick(ACCENTED, b))
            .when(low.rlike("^[α-ω]$"), _pick(GREEK, b))
            .when(low.rlike("^[а-я]$"), _pick(CYRILLIC, b))
            .when(low.rlike(r"^\p{L}$"), _pick(LATIN, b))
            .when(low.rlike(r"^\p{N}$"), (b % 10).cast("string"))
            .otherwise(c)
        )
        return F.when(c == low, small).otherwise(F.upper(small))

    return F.array_join(F.transform(F.split(text, ""), sub), "")


def _name(canon: Column, h: Column, attempt: Column, end: tuple[str, str]) -> Column:
    """A made-up name of two to four syllables, more at high attempts, in the script of the original."""

    def of(syllables: tuple[str, ...], last: str) -> Column:
        n = F.greatest(F.lit(2), F.least(F.lit(4), F.ceil(F.length(canon) / 2))) + (attempt / GROW).cast("int")
        chosen = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.element_at(F.array(*map(F.lit, syllables)), _byte(h, i) % len(syllables) + 1))
        return F.concat(F.array_join(chosen, ""), F.lit(last))

    return F.when(canon.rlike("[а-яё]"), of(SYLLABLES_CYRILLIC, end[1])).otherwise(of(SYLLABLES_LATIN, end[0]))


def luhn(digits: Column) -> Column:
    """The Luhn sum of a number: every second digit from the right but one is doubled."""

    def add(acc: Column, c: Column) -> Column:
        d = F.coalesce(c.try_cast("int"), F.lit(0)) * F.when(acc["k"] % 2 == 1, 2).otherwise(1)
        return F.struct((acc["s"] + F.when(d > 9, d - 9).otherwise(d)).alias("s"), (acc["k"] + 1).alias("k"))

    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("s"), F.lit(0).alias("k")), add, lambda a: a["s"])


def _checked(digits: Column, original: Column) -> Column:
    """Last digit set so that the number passes the Luhn check, where the original does."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    last = F.pmod(-luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(luhn(original) % 10 == 0, F.concat(body, last)).otherwise(digits)


def surrogate(name: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate's canonical form, from the key and the attempt number."""
    message = F.concat_ws("\x1f", name, canon, attempt.cast("string"))
    inner = F.sha2(F.concat(F.lit(key + "\x1f"), message), 512)
    h = F.sha2(F.concat(F.lit(key + "\x1e"), inner), 512)
    labels = F.split(canon, r"\.")
    below = F.array_join(F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(1))), lambda x, i: _letters(x, F.sha2(F.concat(h, i.cast("string")), 512))), ".")
    host = F.concat(below, F.lit(".example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), _byte(h, F.lit(60)) % 3 + 1))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(h, i) % 223 + 1).cast("string")), ".")
    code = F.substring_index(canon, "|", 1)
    rest = F.substring_index(canon, "|", -1)
    # where draws go on colliding, forms that can grow get longer
    more = F.substring(F.translate(h, "0123456789", "ghijklmnop"), F.lit(100), (attempt / GROW).cast("int"))
    return (
        F.when(name == "email", F.concat(_letters(F.substring_index(canon, "@", 1), h), more))
        .when(name == "host", F.concat(more, host))
        .when(name == "ip", octets)
        .when(name == "phone", F.concat(code, F.lit("|"), _letters(rest, h)))
        .when(name == "card", _checked(F.concat(F.substring(canon, 1, 1), F.substring(_letters(canon, h), 2, 99)), canon))
        .when(name == "account", F.concat(F.substring(canon, 1, 2), F.substring(_letters(canon, h), 3, 99)))
        .when(name == "given_f", _name(canon, h, attempt, ("na", "на")))
        .when(name == "given_m", _name(canon, h, attempt, ("n", "н")))
        .when(name == "given_n", _name(canon, h, attempt, ("s", "с")))
        .when(name == "ip6", _letters(canon, h, True))
        .when(name == "surname", _name(canon, h, attempt, ("r", "р")))
        .otherwise(_letters(canon, h, canon.rlike("^[0-9a-f]+$")))
    )


def surrogate_table(found: DataFrame, key: str) -> DataFrame:
    """type, canon, surrogate, attempt for all distinct entities of `found`; no two alike, none real.

    The surrogate of an address is its local part alone, because its host is an entity of its own:
    local parts have to differ within a host only, and no surrogate host is a real one.
    """
    scope = F.when(F.col("type") == "email", F.substring_index("canon", "@", -1)).otherwise(F.lit(""))
    every = stored(found.select("type", "canon").distinct().select("type", scope.alias("scope"), "canon", F.lit(0).alias("attempt")), "entities")
    real = every.filter("type <> 'email'").select("type", F.col("canon").alias("surrogate"))
    for _ in range(ROUNDS):
        made = stored(every.withColumn("surrogate", surrogate(F.col("type"), F.col("canon"), F.col("attempt"), key)), "surrogates")
        # the entity of the lowest attempt, then the first, keeps a shared surrogate
        at = ["type", "scope", "surrogate"]
        keeper = stored(made.groupBy(*at).agg(F.min(F.struct("attempt", "canon")).alias("k"), F.count("*").alias("n")).filter("n > 1"), "shared")
        shared = made.join(keeper, at).filter(F.col("canon") != F.col("k.canon")).select("type", "canon")
        mistaken = made.join(real, ["type", "surrogate"], "left_semi").select("type", "canon")
        again = stored(shared.union(mistaken).distinct().withColumn("again", F.lit(1)), "drawn-again")
        if again.isEmpty():
            return made.drop("scope")
        every = made.join(again, ["type", "canon"], "left").select("type", "scope", "canon", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
    raise RuntimeError("entities are too many for their format: no distinct surrogates were found")


def _fill(m: Column, digits: Column) -> Column:
    """The mention with its letters and digits replaced, one after the other; separators stay."""

    def put(acc: Column, c: Column) -> Column:
        taken = c.rlike(r"^[\p{L}\p{N}]$")
        return F.struct(
            F.concat(acc["s"], F.when(taken, F.substring(digits, acc["k"], F.lit(1))).otherwise(c)).alias("s"), (acc["k"] + taken.cast("int")).alias("k")
        )

    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), put, lambda a: a["s"])


def written(m: Column, first: Column, second: Column) -> Column:
    """A mention's replacement in the mention's own case and grouping."""
    which = kind(m)
    title = F.regexp_extract(m, r"^(\S+ )", 1)
    name = F.concat(title, F.initcap(first), F.when(second.isNotNull(), F.concat(F.lit(" "), F.initcap(second))).otherwise(F.lit("")))
    plain = (
        F.when(which == "email", F.concat(first, F.lit("@"), second))
        .when(which == "name", name)
        .when(which == "phone", _fill(m, F.regexp_replace(first, r"\|", "")))
        .when(which.isin("card", "ssn", "account"), _fill(m, first))
        .otherwise(first)
    )
    own = F.when(which == "secret", _inner(m)).otherwise(m)
    loud = (own == F.upper(own)) & (own != F.lower(own)) & which.isin("email", "secret")
    cased = F.when(loud, F.upper(plain)).otherwise(plain)
    # around a secret: what stands before and behind its value
    value = F.length(own)
    behind = F.when(m.rlike("[\"']$"), 1).otherwise(0)
    around = F.concat(F.substring(m, F.lit(1), F.length(m) - value - behind), cased, F.substring(m, F.length(m) - behind + 1, behind))
    return F.when(which == "secret", around).otherwise(cased)


def _again(gap: Column, names: Column) -> Column:
    """Text between mentions with the names of the text's mentions replaced, where they stand without a title."""

    def put(acc: Column, x: Column) -> Column:
        return F.regexp_replace(acc, F.concat(F.lit(r"(?<!\p{L})"), x["known"], F.lit(r"(?![\p{L}])")), x["new"])

    return F.when(F.size(names) == 0, gap).otherwise(F.aggregate(names, gap, put))


def _names(found: Column, new: Column) -> Column:
    """Names of a text's mentions with their surrogates: whole ones first, then surnames."""
    bare = lambda m: F.regexp_replace(m, r"^\S+ ", "")
    last = lambda m: F.substring_index(m, " ", -1)
    pairs = F.filter(F.zip_with(found, new, lambda m, n: F.struct(m.alias("known"), n.alias("new"))), lambda x: kind(x["known"]) == "name")
    both = F.transform(pairs, lambda x: F.struct(bare(x["known"]).alias("known"), bare(x["new"]).alias("new")))
    one = F.transform(pairs, lambda x: F.struct(last(x["known"]).alias("known"), last(x["new"]).alias("new")))
    return F.array_distinct(F.concat(F.filter(both, lambda x: x["known"].contains(" ")), one))


def replaced(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """The documents with every entity replaced by its surrogate; all other columns as they are.

    `count` names a column for the number of replaced mentions (one of that name is replaced).
    """
    docs = docs.drop(count) if count else docs
    digest, at, parts, found_at, new_at, names_at = fresh(docs, "_digest", "_key", "_parts", "_mentions", "_replaced", "_names")
    body = F.col(f"`{text}`")
    has = F.coalesce(body.rlike(HINT) & body.rlike(PATTERN), F.lit(False))
    clean = docs.filter(~has)
    dirty = docs.filter(has)
    every = dirty.select(F.md5(body.cast("binary")).alias("digest"), body.alias("text"))
    found = (
        every.select("digest", mentions(F.col("text")).alias("m"))
        .groupBy("digest")
        .agg(F.first("m").alias("m"))
        .select("digest", F.posexplode("m").alias("pos", "mention"))
        .select("digest", "pos", F.explode(entities(F.col("mention"))).alias("e"))
        .select("digest", "pos", "e.part", "e.type", "e.canon")
    )
    found = stored(found, "mentions")
    table = surrogate_table(found, key)
    named = found.join(table, ["type", "canon"]).select("digest", F.concat_ws(":", "pos", "part").alias("at"), "surrogate")
    by_text = named.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("at", "surrogate"))).alias(parts))
    by_text = stored(by_text.withColumnRenamed("digest", at), "replacements")
    joined = dirty.withColumn(digest, F.md5(body.cast("binary"))).join(by_text, F.col(digest) == F.col(at), "left")
    spot = lambda i, part: F.col(parts)[F.concat(i.cast("string"), F.lit(f":{part}"))]
    # a match that is no entity after all has no surrogate and stays
    new = F.transform(F.col(found_at), lambda m, i: F.when(spot(i, 0).isNull(), m).otherwise(written(m, spot(i, 0), spot(i, 1))))
    gaps = F.split(body, PATTERN, -1)
    pieces = F.zip_with(gaps, F.col(new_at), lambda g, n: F.concat(_again(g, F.col(names_at)), F.coalesce(n, F.lit(""))))
    columns = [F.array_join(pieces, "").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    is_one = F.transform(F.col(found_at), lambda m, i: spot(i, 0).isNotNull())
    number = [F.size(F.filter(is_one, lambda x: x)).cast("long").alias(count)] if count else []
    made = joined.withColumn(found_at, mentions(body)).withColumn(new_at, new)
    changed = made.withColumn(names_at, _names(F.col(found_at), F.col(new_at))).select(*columns, *number)
    return (clean.withColumn(count, F.lit(0).cast("long")) if count else clean).unionByName(changed)

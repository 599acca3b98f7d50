"""Personal data is replaced by surrogates of the same type and format, the same one for the same person or number in all documents.

Entities are found by patterns, brought to a canonical form (an email in lower case, the last ten digits of a phone number) and
mapped, once for the whole corpus, by a keyed hash; every mention is then rendered in its own format: digits stay digits,
separators and case stay, names keep title, gender and script, a valid check digit stays valid. Two entities never
share a surrogate and no surrogate is an entity of the corpus: the candidates are checked by grouping and joining, and those
that collide are derived again with the next attempt number.

Surrogates have the shape of their entity (its digits, letters and separators) while the shape has room for four times the
entities of that shape. Where it has less, which is counted before the first attempt, surrogates are longer: emails and phone numbers
grow by letters and digits, names by syllables, numbers of an IPv4 address get three digits, and a social security number any
first digit instead of 9. An attempt number that rises widens them too; what isn't settled after ATTEMPTS is an error, never a loop.

The key is the caller's: who has it can derive the surrogates. ``session_key`` takes it from the session's configuration,
and without one draws a key that is kept nowhere, so that replacements can't be derived again, and differ from run to run.

DataFrame functions only. Documents that can't hold an entity are passed through by the scan; of the others the text is shuffled once.
Persons are found by a title before the name; a name without one isn't found.

Defined cases: a null text stays null, an empty one empty; repeated rows get equal replacements; overlapping candidates
are resolved by the leftmost match and then the order of KINDS; of entities that want the same surrogate the one of the earlier attempt, then
the smallest keeps it; texts of any length are searched whole; other columns are kept, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checkpoint, free_names

KEY_SETTING = "spark.galena.surrogates.key"
ATTEMPTS = 64
#: Type -> pattern, in order of precedence. Quantifiers that could meet long runs are possessive, so that matching stays linear.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._+\-])[\p{L}\p{N}._+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*+(?<=\.[A-Za-z]{2,24})",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+)(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\d.\-])\d(?:[ \-]?\d){12,18}(?![\d\-]|\.\d)",
    "person": r"(?<!\p{L})(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sr|Sra|Srta|Mme|Mlle)\. |(?:Herr|Frau|Monsieur|Madame|Señora|Señor|Господин|Госпожа|господин|госпожа) )\p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: A text without a digit, an @ and any of these holds no entity.
TITLES = ("Mr. ", "Mrs. ", "Ms. ", "Miss. ", "Dr. ", "Prof. ", "Sr. ", "Sra. ", "Srta. ", "Mme. ", "Mlle. ", "Herr ", "Frau ", "Monsieur ", "Madame ", "Señor", "осподин ", "оспожа ")
FEMALE = r"^(?:Mrs|Ms|Miss|Sra|Srta|Mme|Mlle|Frau|Madame|Señora|Госпожа|госпожа)"
MALE = r"^(?:Mr|Sr|Herr|Monsieur|Señor |Господин|господин)"
LATIN, CYRILLIC = ("ba de fi go lu ma ne pi ro su ta ve ki lo na ri".split(), "ба де фи го лу ма не пи ро су та ве ки ло на ри".split())
ENDINGS = {"f": ("na", "на"), "m": ("n", "н"), "x": ("l", "л")}


def kind_of(entity: Column) -> Column:
    out = F.when(entity.rlike(f"^(?:{KINDS['email']})$"), "email")
    for name, pattern in list(KINDS.items())[1:]:
        out = out.when(entity.rlike(f"^(?:{pattern})$"), name)
    return out


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D+", "")


def parts_of(entity: Column, kind: Column) -> Column:
    """The parts of a mention that are mapped: (type, canonical form). A name's words are mapped one by one, so that a family name
    is the same with and without a given name; all else is one part."""
    words = F.split(F.regexp_replace(entity, r"^\S+ ", ""), " ")
    gender = F.when(entity.rlike(FEMALE), "f").when(entity.rlike(MALE), "m").otherwise("x")
    name = F.transform(words, lambda w, i: F.struct(F.when((F.size(words) == 2) & (i == 0), F.concat(F.lit("given-"), gender)).otherwise(F.lit("family")).alias("kind"), F.lower(w).alias("canon")))
    canon = (
        F.when(kind.isin("card", "ssn"), digits(entity))
        .when(kind == "phone", F.expr("right(regexp_replace(entity, '[^0-9]+', ''), 10)"))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .otherwise(F.lower(entity))
    )
    return F.when(kind == "person", name).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"))))


def number(h: Column, i, below: int) -> Column:
    """The i-th number below a limit from a hexadecimal digest of 256 digits."""
    at = (F.lit(i) if isinstance(i, int) else i) % 63 * 4 + 1
    return F.conv(F.substr(h, at.cast("int"), F.lit(4)), 16, 10).cast("int") % below


def shaped(canon: Column, h: Column, keep=None) -> Column:
    """Digits for digits, letters for letters of the same script, the rest as it is."""

    def letter(first: str, n: int, i: Column) -> Column:
        return F.chr((number(h, i, n) + ord(first)).cast("long")) if ord(first) < 128 else F.substr(F.lit("".join(chr(ord(first) + k) for k in range(n))), number(h, i, n) + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), number(h, i, 10).cast("string")).when(c.rlike("[a-z]"), letter("a", 26, i)).when(c.rlike("[A-Z]"), letter("A", 26, i))
        out = out.when(c.rlike(r"\p{IsCyrillic}"), letter("а", 32, i)).when(c.rlike(r"\p{IsGreek}"), letter("α", 17, i)).when(c.rlike(r"\p{L}"), letter("a", 26, i)).otherwise(c)
        return out if keep is None else F.when(keep(i), c).otherwise(out)

    return F.array_join(F.transform(F.split(canon, ""), one), "")


def luhn(number_: Column) -> Column:
    """The sum of the check that card numbers pass when it is a multiple of ten."""
    doubled = F.transform(F.split(F.reverse(number_), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def session_key(spark: SparkSession) -> str:
    """The key of the session's configuration, or one that is drawn now."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def varying(canon: Column, kind: Column) -> Column:
    """What changes of an email: the local part and the first label. Of all else, everything."""
    return F.when(kind == "email", F.regexp_replace(canon, r"(@[^.]*)\..*$", "$1")).otherwise(canon)


def shape_of(kind: Column, canon: Column) -> Column:
    """What surrogates of a shape share: entities of one shape draw from the same room."""
    plain = canon
    for pattern, mark in ((r"[0-9]", "0"), (r"\p{IsCyrillic}", "я"), (r"\p{IsGreek}", "α"), (r"[\p{L}&&[^яα]]", "a")):
        plain = F.regexp_replace(plain, pattern, mark)
    email = F.concat(varying(plain, kind), F.regexp_extract(canon, r"@[^.]*(\..*)$", 1))
    name = F.when(canon.rlike(r"\p{IsCyrillic}"), "я").otherwise("a")
    return F.when(kind == "email", email).when(kind.isin("phone", "ipv4"), plain).when(kind == "ssn", "0").when((kind == "family") | kind.startswith("given-"), name)


def room_of(kind: Column, shape: Column) -> tuple[Column, Column]:
    """The decimal logarithms of the room of a shape and of what one more letter, digit or syllable adds."""
    own = varying(shape, kind)
    marks = lambda c: F.length(own) - F.length(F.replace(own, F.lit(c), F.lit("")))
    letters = marks("0") + 1.415 * marks("a") + 1.505 * marks("я") + 1.23 * marks("α")
    octets = F.aggregate(F.split(shape, r"\."), F.lit(0.0), lambda a, p: a + F.when(F.length(p) == 3, 2.193).when(F.length(p) == 2, 1.954).otherwise(0.954))
    room = F.when(kind == "ipv4", octets).when(kind == "ssn", 8.0).when(kind.isin("email", "phone"), letters).otherwise(4 * 1.204)
    return room, F.when(kind == "email", 1.415).when(kind.isin("phone", "ssn", "ipv4"), 1.0).otherwise(1.204)


def widened(known: DataFrame, scratch: Scratch) -> DataFrame:
    """kind, canon, level: by how much the surrogates are longer, from the number of entities of each shape."""
    shaped_ = known.withColumn("shape", shape_of(F.col("kind"), F.col("canon")))
    room, step = room_of(F.col("kind"), F.col("shape"))
    counts = shaped_.filter("shape is not null").groupBy("kind", "shape").agg(F.count("*").alias("n"))
    level = F.ceil((F.log10(4 * F.col("n")) - room) / step).cast("int")
    # of shapes short of room there are few, however many entities they have
    short = scratch.write(counts.withColumn("level", level).filter("level > 0").select(F.col("kind").alias("k"), F.col("shape").alias("s"), "level"))
    return shaped_.join(short, (F.col("kind") == F.col("k")) & (F.col("shape") == F.col("s")), "left").select("kind", "canon", F.coalesce("level", F.lit(0)).alias("level"))


def surrogate(kind: Column, canon: Column, attempt: Column, level: Column, key: str) -> Column:
    """The canonical form of the surrogate."""
    longer = level + F.floor(attempt / 4).cast("int")
    h = F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(f"{key}/{half}"), kind, canon, attempt.cast("string")), 512) for half in (1, 2)])
    # email: the local part and the first label change, the rest of the domain stays
    rest = F.regexp_extract(canon, r"@[^.]*(\..*)$", 1)
    email = F.concat(shaped(F.concat(F.repeat(F.lit("a"), longer), F.expr("substring(canon, 1, length(canon) - length(regexp_extract(canon, '@[^.]*([.].*)$', 1)))")), h), rest)
    # numbers of an address keep their length and stay below 256
    octet = lambda p, i: F.when((F.length(p) == 3) | (longer > 0), 100 + number(h, i, 156)).when(F.length(p) == 2, 10 + number(h, i, 90)).otherwise(1 + number(h, i, 9)).cast("string")
    ipv4 = F.array_join(F.transform(F.split(canon, r"\."), octet), ".")
    hexes = lambda c, i: F.when(c == ":", c).otherwise(F.substr(F.lit("0123456789abcdef"), number(h, i, 16) + 1, F.lit(1)))
    secret = F.array_join(F.transform(F.split(canon, ""), hexes), "")
    card = shaped(canon, h, lambda i: i == 0)
    body = F.expr("length(canon) - 1")
    stem = F.concat(F.substr(card, F.lit(1), body), F.lit("0"))
    check = F.concat(F.substr(card, F.lit(1), body), ((10 - luhn(stem) % 10) % 10).cast("string"))
    cyrillic = canon.rlike(r"\p{IsCyrillic}")
    syllable = lambda i: F.when(cyrillic, F.element_at(F.array(*map(F.lit, CYRILLIC)), number(h, i, 16) + 1)).otherwise(F.element_at(F.array(*map(F.lit, LATIN)), number(h, i, 16) + 1))
    end = lambda g: F.when(cyrillic, ENDINGS[g][1]).otherwise(ENDINGS[g][0])
    stem_of_name = F.concat(*[syllable(i) for i in range(4)], *[F.when(level + attempt > i, syllable(4 + i)).otherwise(F.lit("")) for i in range(8)])
    name = F.concat(stem_of_name, F.when(kind == "given-f", end("f")).when(kind == "given-m", end("m")).otherwise(end("x")))
    return (
        F.when(kind == "email", email).when(kind == "ipv4", ipv4).when(kind.isin("secret", "ipv6"), secret)
        .when(kind == "card", F.when(luhn(canon) % 10 == 0, check).otherwise(card))
        .when(kind == "ssn", F.concat(F.when(longer > 0, number(h, 20, 10).cast("string")).otherwise("9"), F.substr(shaped(canon, h), F.lit(2), F.lit(8))))
        .when(kind == "iban", shaped(canon, h, lambda i: i < 2))
        .when(kind == "phone", shaped(F.concat(F.repeat(F.lit("0"), longer), canon), h))
        .otherwise(name)
    )


def assign(entities: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """kind, canon, core: a surrogate for each distinct (kind, canon), no two alike and none an entity itself."""
    known = scratch.write(entities.distinct())
    taken = known.select(F.col("kind").alias("k"), F.col("canon").alias("c"))
    pending, done = widened(known, scratch).withColumn("attempt", F.lit(0)), None
    for _ in range(ATTEMPTS):
        tried = scratch.write(pending.withColumn("core", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), F.col("level"), key)))
        settled = tried if done is None else tried.unionByName(done)
        # of equal surrogates an earlier attempt's comes first, then the smallest entity's
        owner = settled.groupBy("kind", "core").agg(F.min(F.struct("attempt", "canon")).alias("o")).select(F.col("kind").alias("k"), F.col("core").alias("s"), F.col("o.canon").alias("owner"))
        good = tried.join(owner, (F.col("kind") == F.col("k")) & (F.col("core") == F.col("s")) & (F.col("canon") == F.col("owner")), "left_semi")
        good = good.join(taken, (F.col("kind") == F.col("k")) & (F.col("core") == F.col("c")), "left_anti")
        fresh = scratch.write(good)
        done = fresh if done is None else scratch.write(done.unionByName(fresh))
        g = fresh.select(F.col("kind").alias("k"), F.col("canon").alias("c"))
        pending = scratch.write(tried.join(g, (F.col("kind") == F.col("k")) & (F.col("canon") == F.col("c")), "left_anti").select("kind", "canon", "level", (F.col("attempt") + 1).alias("attempt")))
        if pending.isEmpty():
            return done.select("kind", "canon", "core")
    left = pending.groupBy("kind").agg(F.count("*")).collect()  # a row for each kind
    raise RuntimeError(f"no surrogates found in {ATTEMPTS} attempts for {dict(map(tuple, left))}")


def rendered(entity: Column, kind: Column, cores: Column) -> Column:
    """A mention with its own separators, prefix and case; cores: the surrogates of its parts in order."""
    core = F.element_at(cores, 1)
    # the k-th last digit of the mention becomes the k-th last of the surrogate; digits beyond (a country code) stay, and what
    # the surrogate has more than the canonical form stands before the first that changes
    left = lambda i: F.length(digits(F.substr(entity, i + 1, F.length(entity))))
    own = F.when(kind == "phone", F.least(F.length(digits(entity)), F.lit(10))).otherwise(F.length(digits(entity)))
    more = F.when(kind == "phone", F.substr(core, F.lit(1), F.length(core) - own)).otherwise("")
    digit = lambda c, i: F.concat(F.when(left(i) == own, more).otherwise(""), F.substr(core, F.length(core) - left(i) + 1, F.lit(1)))
    numeric = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[0-9]") & (left(i) <= own), digit(c, i)).otherwise(c)), "")
    spaced = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(core, F.length(F.replace(F.substr(entity, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    cased = F.when(entity == F.lower(entity), core).when(entity == F.upper(entity), F.upper(core)).otherwise(core)
    person = F.concat(F.regexp_extract(entity, r"^(\S+ )", 1), F.array_join(F.transform(cores, lambda c: F.initcap(c)), " "))
    return F.when(kind.isin("phone", "card", "ssn"), numeric).when(kind == "iban", spaced).when(kind == "person", person).otherwise(cased)


def may_hold(text: Column) -> Column:
    """Whether the patterns need to look at the text at all. False for null."""
    out = text.rlike("[0-9@]")
    for title in TITLES:
        out = out | F.contains(text, F.lit(title))
    return F.coalesce(out, F.lit(False))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with their entities replaced, and n_entities, the number of mentions."""
    spark, shape = docs.sparkSession, docs.drop("n_entities")
    row, of, new_ = free_names(shape, "__row", "__of", "__new")
    body = F.col(text)
    found = F.regexp_extract_all(body, F.lit(ANY), F.lit(0))
    holders = shape.filter(may_hold(body)).withColumn(row, F.sha2(body, 256))
    with Scratch(spark) as scratch:
        mentions = holders.select(F.col(row).alias("__row"), F.explode(F.array_distinct(found)).alias("entity")).withColumn("what", kind_of(F.col("entity"))).filter("what is not null")
        mentions = scratch.write(mentions.withColumn("parts", parts_of(F.col("entity"), F.col("what"))).distinct())
        parts = mentions.select("__row", "entity", "what", F.posexplode("parts").alias("nth", "part")).select("__row", "entity", "what", "nth", "part.kind", "part.canon")
        table = assign(parts.select("kind", "canon"), scratch, key)
        mapped = parts.join(table.select(F.col("kind").alias("k"), F.col("canon").alias("c"), "core"), (F.col("kind") == F.col("k")) & (F.col("canon") == F.col("c")))
        cores = mapped.groupBy("__row", "entity", "what").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "core"))), lambda x: x["core"]).alias("cores"))
        changed = cores.select("__row", "entity", rendered(F.col("entity"), F.col("what"), F.col("cores")).alias("new"))
        of_row = checkpoint(changed.groupBy(F.col("__row").alias(of)).agg(F.map_from_entries(F.collect_list(F.struct("entity", "new"))).alias(new_)))
    joined = holders.join(of_row, F.col(row) == F.col(of), "left")
    new = F.transform(found, lambda e: F.coalesce(F.element_at(new_, e), e))
    rebuilt = F.array_join(F.zip_with(F.split(body, ANY, -1), F.concat(new, F.array(F.lit(""))), lambda gap, e: F.concat(gap, e)), "")
    columns = [c for c in shape.columns if c != text]
    replaced = joined.select(*columns, F.when(F.col(of).isNull(), body).otherwise(rebuilt).alias(text), F.when(F.col(of).isNull(), 0).otherwise(F.size(found)).cast("long").alias("n_entities"))
    same = shape.filter(~may_hold(body)).select(*columns, text, F.lit(0).cast("long").alias("n_entities"))
    return same.unionByName(replaced).select(*shape.columns, "n_entities")

"""Surrogates for personal data, in DataFrame functions only.

Entities (e-mail, card, account, address and phone numbers, secrets, names after a form of address) are found by one pattern. Each
distinct entity gets one surrogate of its type from a keyed hash: digits stay digits in the same places, card numbers keep a
valid check digit, letters keep case and script, given names keep the gender that the form of address tells. The
same entity in any spelling of its format gets the same surrogate in all documents (coreference). Rounds of collision checks keep
surrogates distinct from one another and from every entity of the corpus (distinctness); whoever collides draws again with the next round.
After the last round a longer surrogate with hash digits is distinct without a draw.

Only rows with entities are shuffled; a hot entity is split by the adaptive join.

Defined results: null text stays null with no entities, empty text stays empty; rows that repeat id and text get the same
text; a null id is no hindrance; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import staged

#: Patterns in order of preference.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|[0-9a-f]{40}(?:[0-9a-f]{24})?|[0-9a-f]{32})(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = (
    r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])"
)
HE = r"Mr\.?|Herrn?|M\.|Monsieur|Sr\.|Señor|Sig\.|г-н|господин"
SHE = r"Mrs\.?|Ms\.?|Miss|Frau|Mme\.?|Madame|Mlle\.?|Sra\.|Señora|Srta\.|Señorita|г-жа|госпожа"
ANY = r"Dr\.|Prof\.|Doctor|Professor"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{SHE}|{HE}|{ANY}) \p{{Lu}}[\p{{Ll}}'’-]+(?: \p{{Lu}}[\p{{Ll}}'’-]+)?(?![\p{{L}}\p{{N}}])"
TYPES = (("email", EMAIL), ("secret", SECRET), ("iban", IBAN), ("ip", IP), ("card", CARD), ("ssn", SSN), ("phone", PHONE), ("name", NAME))
PATTERN = "|".join(p for _, p in TYPES)
#: What every match of the pattern holds: a digit or @, hexadecimal letters, the start of a secret or a form of address.
CHEAP = ("[0-9@]", "[a-f]{32}")
LITERALS = (
    "AKIA ghp_ gho_ ghu_ ghs_ ghr_ sk- Mr Ms Miss Herr Monsieur Sr Señor Sig. г-н г-жа господин госпожа Frau Mme Madame Mlle Dr. Prof Doctor".split()
    + ["M. "]
)
#: Syllables of made-up names.
LATIN = "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo".split()
CYRILLIC = "ба бе бо да де до фа га го ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ва ве во".split()


def holds_entity(text: Column) -> Column:
    """Whether the pattern matches; most texts are told by cheap tests, which no match fails."""
    may = text.rlike(CHEAP[0]) | text.rlike(CHEAP[1])
    for literal in LITERALS:
        may = may | F.contains(text, F.lit(literal))
    return F.coalesce(may & text.rlike(PATTERN), F.lit(False))


def kind_of(mention: Column) -> Column:
    out = None
    for name, pattern in TYPES[:-1]:
        test = mention.rlike(f"^(?:{pattern})$")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("name")


def references(kind: Column, mention: Column) -> Column:
    """Array of (kind, entity, lead, ord): what the mention names, free of its format; names have one or two parts."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    tokens = F.split(F.regexp_replace(mention, rf"^(?:{SHE}|{HE}|{ANY}) ", ""), " ")
    address = F.regexp_extract(mention, rf"^({SHE}|{HE}|{ANY}) ", 1)
    gender = F.when(address.rlike(f"^(?:{SHE})$"), "given-f").when(address.rlike(f"^(?:{HE})$"), "given-m").otherwise("given")
    plain = (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.concat(F.when(mention.startswith("+"), "+").otherwise(""), digits))
        .when(kind == "email", F.lower(mention))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .otherwise(mention)
    )

    def ref(kind: Column, entity: Column, lead: Column, order: int) -> Column:
        return F.struct(kind.alias("kind"), entity.alias("entity"), lead.alias("lead"), F.lit(order).alias("ord"))

    family = F.element_at(tokens, -1)
    lead = F.concat(address, F.lit(" "))
    named = F.when(F.size(tokens) > 1, F.array(ref(gender, F.lower(tokens[0]), lead, 0), ref(F.lit("family"), F.lower(family), F.lit(" "), 1))).otherwise(
        F.array(ref(F.lit("family"), F.lower(family), lead, 1))
    )
    return F.when(kind == "name", named).otherwise(F.array(ref(kind, plain, F.lit(""), 0)))


def _byte(stream: Column, i: Column | int) -> Column:
    return F.conv(F.substr(stream, F.lit(1) + F.lit(2) * i, F.lit(2)), 16, 10).cast("int")


def _stream(key: str, kind: Column, entity: Column, draw: Column) -> Column:
    """Enough hex digits of the keyed hash for the entity's length."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, entity, draw.cast("string"))
    blocks = F.sequence(F.lit(0), F.shiftright(F.length(entity) + 24, 5))
    return F.array_join(F.transform(blocks, lambda i: F.sha2(F.concat_ws("\x1f", seed, i.cast("string")), 256)), "")


def _shaped(entity: Column, stream: Column, kept: Column) -> Column:
    """Each digit by a digit, each letter by one of its case and script, from place ``kept`` on; the rest stays."""
    alphabets = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ")

    def swap(c: Column, i: Column) -> Column:
        out = F.when(i < kept, c)
        for a in alphabets:
            pick = F.substr(F.lit(a), (_byte(stream, i) % len(a)) + 1, F.lit(1))
            out = out.when(F.lit(a).contains(c), pick)
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(entity, ""), swap), "")


def _check_digit(body: Column) -> Column:
    """Digit that makes the number pass the card checksum."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when((F.length(body) - 1 - i) % 2 == 0, doubled).otherwise(d)

    total = F.aggregate(F.transform(F.split(body, ""), worth), F.lit(0), lambda a, x: a + x)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _passes(number: Column) -> Column:
    return _check_digit(F.substr(number, F.lit(1), F.length(number) - 1)) == F.substr(number, F.length(number), F.lit(1))


def _name(kind: Column, entity: Column, stream: Column) -> Column:
    """Made-up name in the script of the entity; women's given names end in a, men's in n."""

    def build(syllables: list[str], she: str, he: str) -> Column:
        table = F.array(*[F.lit(s) for s in syllables])
        parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.element_at(table, _byte(stream, i) % len(syllables) + 1))
        return F.concat(F.initcap(F.array_join(parts, "")), F.when(kind == "given-f", she).when(kind == "given-m", he).otherwise("l" if she == "na" else "л"))

    return F.when(entity.rlike(r"\p{IsCyrillic}"), build(CYRILLIC, "на", "н")).otherwise(build(LATIN, "na", "n"))


def surrogate(kind: Column, entity: Column, stream: Column, domain: Column) -> Column:
    """Surrogate of an entity in its plain form from its hash digits, and those of its e-mail domain."""
    octet = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(stream, i) % 223 + 1).cast("string")), ".")
    local = F.substring_index(entity, "@", 1)
    label = _shaped(F.lit("abcdefghij"), domain, F.lit(0))
    shaped = _shaped(entity, stream, F.lit(0))
    body = F.substr(shaped, F.lit(1), F.length(shaped) - 1)
    return (
        F.when(kind == "email", F.concat(_shaped(local, stream, F.lit(0)), F.lit("@"), label, F.lit(".example")))
        .when(kind == "ip", octet)
        .when(kind == "card", F.when(_passes(entity), F.concat(body, _check_digit(body))).otherwise(shaped))
        .when(kind == "iban", _shaped(entity, stream, F.lit(2)))
        .when(kind == "phone", _shaped(entity, stream, F.when(entity.startswith("+"), 2).otherwise(0)))
        .when(kind == "secret", F.when(entity.rlike("^[0-9a-f]+$"), F.substr(stream, F.lit(1), F.length(entity))).otherwise(_shaped(entity, stream, F.lit(4))))
        .when(kind.isin("given-f", "given-m", "given", "family"), _name(kind, entity, stream))
        .otherwise(shaped)
    )


def drawn_once(entities: DataFrame, key: str, draw: int) -> DataFrame:
    """Add ``surrogate`` for one draw."""
    kind, entity = F.col("kind"), F.col("entity")
    hashed = entities.withColumn("stream", _stream(key, kind, entity, F.lit(draw)))
    hashed = hashed.withColumn("domain", F.sha2(F.concat_ws("\x1f", F.lit(key), F.substring_index(entity, "@", -1)), 256))
    return hashed.withColumn("surrogate", surrogate(kind, entity, F.col("stream"), F.col("domain"))).drop("stream", "domain")


def assign(entities: DataFrame, key: str, draws: int = 12) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity); written in rounds, of which each takes what collided before."""
    taken = None
    pending = entities
    for draw in range(draws):
        drawn = staged(drawn_once(pending, key, draw), "pii-drawn")
        first = drawn.groupBy("kind", F.col("surrogate").alias("won")).agg(F.min("entity").alias("winner"))
        first = first.select(F.col("kind").alias("won_kind"), "won", "winner")
        won = (F.col("kind") == F.col("won_kind")) & (F.col("surrogate") == F.col("won")) & (F.col("entity") == F.col("winner"))
        fresh = drawn.join(first, won, "left_semi")
        real = entities.select(F.col("kind").alias("real_kind"), F.lower("entity").alias("real"))
        fresh = fresh.join(real, (F.col("kind") == F.col("real_kind")) & (F.lower("surrogate") == F.col("real")), "left_anti")
        if taken is not None:
            used = taken.select(F.col("kind").alias("used_kind"), F.col("surrogate").alias("used"))
            fresh = fresh.join(used, (F.col("kind") == F.col("used_kind")) & (F.col("surrogate") == F.col("used")), "left_anti")
        fresh = staged(fresh.select("kind", "entity", "surrogate"), "pii-round")
        taken = fresh if taken is None else taken.unionAll(fresh)
        pending = staged(pending.join(fresh.select("kind", "entity"), ["kind", "entity"], "left_anti"), "pii-pending")
        if pending.isEmpty():
            return taken
    digits = F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "entity"), 256), 1, 24)
    longer = drawn_once(pending, key, draws).withColumn("surrogate", F.concat_ws("-", "surrogate", digits))
    return taken.unionAll(longer.select("kind", "entity", "surrogate"))


def formatted(mention: Column, plain: Column) -> Column:
    """The mention with its letters and digits taken from the plain surrogate in turn; other characters stay."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    fill = F.aggregate(
        F.split(mention, ""),
        start,
        lambda acc, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(acc["out"], F.substr(plain, acc["n"] + 1, F.lit(1))).alias("out"), (acc["n"] + 1).alias("n"))).otherwise(
            F.struct(F.concat(acc["out"], c).alias("out"), acc["n"].alias("n"))
        ),
    )
    return F.concat(fill["out"], F.substr(plain, fill["n"] + 1, F.length(plain)))


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text with surrogates, n_entities (mentions), entities (array of kind, first mentions' surrogates not shown)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    has = holds_entity(F.col("text"))
    clean = rows.filter(~has)
    marked = rows.filter(has).withColumn("row", F.xxhash64(F.col("id").cast("string"), "text"))
    mentions = marked.select("row", F.posexplode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("pos", "mention")).distinct()
    mentions = mentions.withColumn("type", kind_of(F.col("mention")))
    refs = staged(mentions.withColumn("ref", F.explode(references(F.col("type"), F.col("mention")))).select("row", "pos", "mention", "type", "ref.*"), "pii-mentions")
    table = staged(assign(refs.select("kind", "entity").distinct(), key), "pii-surrogates")
    named = refs.join(table, ["kind", "entity"])
    plain = F.regexp_replace("surrogate", r"^\+", "")
    piece = F.when(F.col("type").isin("card", "ssn", "phone", "iban"), formatted(F.col("mention"), plain)).otherwise(F.concat("lead", "surrogate"))
    pieces = named.select("row", "pos", "type", F.struct(F.col("ord"), piece.alias("piece")).alias("p"))
    spans = pieces.groupBy("row", "pos", "type").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "").alias("new"))
    filled = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "new", "type"))).alias("spans"))
    whole = marked.join(filled.withColumnRenamed("row", "filled_row"), F.col("row") == F.col("filled_row"))
    between = F.split("text", PATTERN, -1)
    new = F.concat(F.transform("spans", lambda s: s["new"]), F.array(F.lit("")))
    text = F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    done = whole.select("id", text.alias("text"), F.size("spans").cast("long").alias("n_entities"), F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["type"]))).alias("kinds"))
    return done.unionAll(clean.select("id", "text", F.lit(0).cast("long"), F.array().cast("array<string>")))

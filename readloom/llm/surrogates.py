"""Surrogates for personal data, in SQL functions only.

Entities are found by pattern and checksum. Each distinct entity gets a
replacement drawn by a keyed hash: of its own kind, with its format, and for
names with the gender and script of the original. Mentions of one entity get
one replacement, each in the mention's own writing. What a document says of a
name holds in all of it: a name found after a title is replaced where it stands
alone too, a lone name after a title is a given name if the document has it as
one, and a title that tells no gender takes that of the others. A collision check over all
entities of the corpus moves an entity on to its next draw as long as another
holds the same replacement, or the replacement is a real entity; so distinct
entities stay distinct. Only entities that were moved are looked up when texts
are rewritten; every other replacement is computed in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .line_quality import let

_D, _AN = "[0-9]", "[0-9A-Za-z]"
#: Titles before names. Fixed values.
MALE = "Mr|Herr|Señor|Sr|Monsieur|господин"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|госпожа"
NEUTRAL = "Dr|Prof"
_TITLE = f"(?:{MALE}|{FEMALE}|{NEUTRAL})"
#: Prefixes of access tokens. Fixed values.
_PREFIX = "AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|AIza"
_TOKEN = r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,100}|sk-[0-9A-Za-z]{20,100}|xox[abprs]-[0-9A-Za-z\-]{10,100}|AIza[0-9A-Za-z_\-]{35})"
_PARTS = [
    # e-mail addresses: a local part is tried only from its first character
    r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}",
    # bank account numbers
    rf"(?<!{_AN})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?!{_AN})",
    # payment cards
    rf"(?<![0-9A-Za-z+]){_D}(?:[ \-]?{_D}){{12,18}}(?!{_AN})",
    # social security numbers
    rf"(?<!{_AN}){_D}{{3}}-{_D}{{2}}-{_D}{{4}}(?!{_AN})",
    # IPv4 addresses
    rf"(?<![0-9A-Za-z.]){_D}{{1,3}}(?:\.{_D}{{1,3}}){{3}}(?!{_AN})(?!\.{_D})",
    # telephone numbers
    rf"(?<![0-9A-Za-z+])\+{_D}{{1,3}}[ .\-]?(?:\({_D}{{1,4}}\)[ .\-]?)?{_D}{{2,4}}(?:[ .\-]?{_D}{{2,4}}){{1,4}}(?!{_AN})",
    rf"(?<![0-9A-Za-z+])(?:\({_D}{{3}}\) ?|{_D}{{3}}[ .\-]){_D}{{3}}[ .\-]{_D}{{4}}(?!{_AN})",
    rf"(?<![0-9A-Za-z+.])[2-9]{_D}{{2}}[2-9]{_D}{{6}}(?!{_AN})(?!\.{_D})",
    # IPv6 addresses
    r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])",
    # access tokens with the prefixes of their issuers
    rf"(?<![0-9A-Za-z_\-]){_TOKEN}(?![0-9A-Za-z])",
    # keys and tokens in hex
    rf"(?<!{_AN})(?:[0-9a-f]{{32,64}}|[0-9A-F]{{32,64}})(?!{_AN})",
    # names after a title
    rf"(?<![\p{{L}}]){_TITLE}\.? \p{{Lu}}\p{{L}}{{1,30}}(?: \p{{Lu}}\p{{L}}{{1,30}}){{0,2}}",
]
PATTERN = "|".join(_PARTS)
TRIGGER = rf"[0-9@]|(?<![\p{{L}}]){_TITLE}\.? \p{{Lu}}|(?<![0-9A-Za-z_\-])(?:{_PREFIX})"

#: Syllables of made-up names, endings of male and of female given names.
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe fi fo ga ge gi go ka ke ki ko la le li lo ma me mi mo na ne ni no", "n r s l", "na"),
    "cyrillic": ("ба бе би бо да де ди до фа фе фи фо га ге ги го ка ке ки ко ла ле ли ло ма ме ми мо на не ни но", "н р с л", "на"),
    "greek": ("βα βε βι βο δα δε δι δο φα φε φι φο γα γε γι γο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο", "ς ν ρ λ", "να"),
}
_ENTITY = "struct<kind:string,canon:string,raw:string>"
#: Draws after which a replacement is made unique by a part of its hash.
LAST_DRAW = 16


def _rx(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0))))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of an account number read in ISO 13616 order."""
    moved = F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))
    value = lambda x: F.when(_rx(x, "[0-9]"), F.try_to_number(x, F.lit("9")).cast("int")).otherwise(F.ascii(x) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, x: (a * F.when(_rx(x, "[0-9]"), 10).otherwise(100) + value(x)) % 97)


def _script(word: Column) -> Column:
    return F.when(_rx(word, r"\p{IsCyrillic}"), "cyrillic").when(_rx(word, r"\p{IsGreek}"), "greek").otherwise("latin")


def entities(match: Column) -> Column:
    """array<struct<kind, canon, raw>> of a match: one for most kinds, one per
    word of a name, none for what fails its checksum or range. Names are as
    their title has them: ``given-m-``, ``given-f-``, ``given-?-`` after a title
    without gender, ``family-``, and ``lone-`` and the gender if there is but one."""
    one = lambda kind, canon: F.array(F.struct(F.lit(kind).alias("kind"), canon.alias("canon"), match.alias("raw")))
    none = F.array().cast(f"array<{_ENTITY}>")
    title = F.regexp_extract(match, r"^(\p{L}+)", 1)
    words = F.split(F.regexp_replace(match, r"^\p{L}+\.? ", ""), " ")

    def name(w: Column) -> Column:
        gender = F.when(_rx(title, f"^(?:{MALE})$"), "m").when(_rx(title, f"^(?:{FEMALE})$"), "f").otherwise("?")
        kind = lambda i: F.when(F.size(w) == 1, F.concat(F.lit("lone-"), gender)).when(i == F.size(w) - 1, "family").otherwise(F.concat(F.lit("given-"), gender))
        return F.transform(w, lambda x, i: F.struct(F.concat(kind(i), F.lit("-"), _script(x)).alias("kind"), F.lower(x).alias("canon"), x.alias("raw")))

    in_range = _rx(match, r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$")
    bare = F.replace(match, F.lit(" "), F.lit(""))
    return (
        F.when(F.contains(match, F.lit("@")), one("email", F.lower(match)))
        .when(_rx(match, r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), F.when(in_range, one("ip", match)).otherwise(none))
        .when(_rx(match, "^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), one("ssn", _digits(match)))
        .when(_rx(match, "^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), F.when(_rx(match, "[0-9]") & (F.size(F.filter(F.split(match, ":"), lambda x: x != "")) > 2), one("ipv6", F.lower(match))).otherwise(none))
        .when(_rx(match, f"^{_TOKEN}$"), one("token", match))
        .when(_rx(match, r"^(?:\+|\(?[0-9]{3}\)?[ .\-]{1,2}[0-9]{3}[ .\-][0-9]{4}$|\(|[0-9]{10}$)"), one("phone", F.concat(F.when(F.startswith(match, F.lit("+")), "+").otherwise(""), _digits(match))))
        .when(_rx(match, r"^[0-9](?:[ \-]?[0-9]){12,18}$"), F.when(_luhn(_digits(match)) % 10 == 0, one("card", _digits(match))).otherwise(none))
        .when(_rx(match, "^(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})$"), F.when(_rx(match, "[a-fA-F]"), one("secret", F.lower(match))).otherwise(none))
        .when(_rx(match, "^[A-Z]{2}[0-9]{2}[ A-Z0-9]+$"), F.when(_mod97(bare) == 1, one("iban", bare)).otherwise(none))
        .otherwise(let(words, name))
    )


def of_document(matches: Column) -> Column:
    """For each match of a document its entities, names as the document as a
    whole tells them: all are ``given-m-``, ``given-f-`` or ``family-``. A lone
    name is a family name, unless the document has it as a given name only;
    where it does not tell a gender either, an a at the end makes it female."""

    def resolved(found: Column) -> Column:
        names = F.filter(F.flatten(found), lambda e: _rx(e["kind"], "^(?:given|family|lone)-"))

        def with_names(known: Column) -> Column:
            def one(e: Column) -> Column:
                has = lambda kind: F.array_contains(known, F.concat(F.lit(kind + "-"), F.substring_index(e["kind"], "-", -1), F.lit("|"), e["canon"]))
                said = F.regexp_extract(e["kind"], "^(?:given|lone)-(.)-", 1)
                male, female = has("given-m") | has("lone-m"), has("given-f") | has("lone-f")
                gender = F.when(said.isin("m", "f"), said).when(male & ~female, "m").when(female & ~male, "f").otherwise(F.when(_rx(e["canon"], "[aаα]$"), "f").otherwise("m"))
                given = F.concat(F.lit("given-"), gender, F.lit("-"), F.substring_index(e["kind"], "-", -1))
                family = F.concat(F.lit("family-"), F.substring_index(e["kind"], "-", -1))
                lone = F.when(~has("family") & (has("given-m") | has("given-f") | has("given-?")), given).otherwise(family)
                kind = F.when(F.startswith(e["kind"], F.lit("given-")), given).when(F.startswith(e["kind"], F.lit("lone-")), lone).otherwise(e["kind"])
                return F.struct(kind.alias("kind"), e["canon"].alias("canon"), e["raw"].alias("raw"))

            return F.when(F.size(known) == 0, found).otherwise(F.transform(found, lambda es: F.transform(es, one)))

        return let(F.transform(names, lambda e: F.concat_ws("|", e["kind"], e["canon"])), with_names)

    return let(F.transform(matches, entities), resolved)


def _keyed(key: str, kind: Column, canon: Column, draw: Column) -> Column:
    inner = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, draw.cast("string")), 512)
    return F.sha2(F.concat(F.lit(key), inner), 512)


def _to_digits(hexed: Column) -> Column:
    return F.translate(hexed, "abcdef", "012345")


def _shaped(canon: Column, hexed: Column) -> Column:
    """A letter for each letter, a digit for each digit, the rest as it is."""
    nth = lambda i: F.substr(hexed, i % 120 + 1, F.lit(1))
    letters = lambda c: F.translate(c, "0123456789abcdef", "ghijklmnopqrstuv")
    change = lambda x, i: F.when(_rx(x, "^[0-9]$"), _to_digits(nth(i))).when(_rx(x, "^[a-z]$"), letters(nth(i))).when(_rx(x, "^[A-Z]$"), F.upper(letters(nth(i)))).otherwise(x)
    return F.array_join(F.transform(F.split(canon, ""), change), "")


def surrogate(key: str, kind: Column, canon: Column, draw: Column) -> Column:
    """The replacement of an entity in canonical form at its draw-th draw."""

    def of(h: Column) -> Column:
        n = F.length(canon)
        dig = _to_digits(h)
        local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
        longer = F.when(draw > 0, F.translate(F.substr(h, F.lit(101), F.lit(4)), "0123456789", "ghijklmnop")).otherwise("")
        email = F.concat(_shaped(local, h), longer, F.lit("@m"), F.substr(_keyed(key, F.lit("domain"), domain, F.lit(0)), F.lit(1), F.lit(10)), F.lit(".example."), F.substring_index(domain, ".", -1))
        octet = lambda i: (F.conv(F.substr(h, F.lit(8 * i + 1), F.lit(6)), 16, 10).cast("int") % 254 + 1).cast("string")
        ip = F.concat_ws(".", *[octet(i) for i in range(4)])
        kept = F.when(F.startswith(canon, F.lit("+")), F.when(_rx(canon, r"^\+[17]"), 2).otherwise(3)).otherwise(0)
        lead = F.when(kept < 3, (F.conv(F.substr(h, F.lit(121), F.lit(2)), 16, 10).cast("int") % 8 + 2).cast("string")).otherwise(F.substr(dig, F.lit(100), F.lit(1)))
        phone = F.concat(F.substr(canon, F.lit(1), kept), lead, F.substr(dig, F.lit(1), n - kept - 1))
        body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(dig, F.lit(1), n - 2))
        card = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
        ssn = F.concat(F.lit("9"), F.substr(dig, F.lit(1), F.lit(8)))
        country, account = F.substr(canon, F.lit(1), F.lit(2)), _shaped(F.substr(canon, F.lit(5)), h)
        iban = F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account)
        secret = F.substr(h, F.lit(1), n)
        ipv6 = F.array_join(F.transform(F.split(canon, ""), lambda x, i: F.when(x == ":", x).otherwise(F.substr(h, i + 1, F.lit(1)))), "")
        prefix = F.regexp_extract(canon, f"^(?:{_PREFIX})", 0)
        token = F.concat(prefix, _shaped(F.substr(canon, F.length(prefix) + 1), h))
        word = lambda script: F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), F.least(F.greatest(F.floor(n / 2) - 1, F.lit(1)), F.lit(3)) + F.when(draw > 4, 1).otherwise(0)), lambda i: F.element_at(_words(SYLLABLES[script][0]), _pick(h, i, 32))), ""))
        ending = lambda script: F.element_at(_words(SYLLABLES[script][1]), _pick(h, F.lit(9), 4))
        named = F.lit(None).cast("string")
        for script in SYLLABLES:
            named = F.when(kind == f"family-{script}", word(script)).when(kind == f"given-m-{script}", F.concat(word(script), ending(script))).when(kind == f"given-f-{script}", F.concat(word(script), F.lit(SYLLABLES[script][2]))).otherwise(named)
        plain = (
            F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card)
            .when(kind == "ssn", ssn).when(kind == "iban", iban).when(kind == "secret", secret).when(kind == "ipv6", ipv6).when(kind == "token", token).otherwise(named)
        )
        return F.concat(plain, F.when(draw >= LAST_DRAW, F.concat(F.lit("-"), F.substr(h, F.lit(60), F.lit(16)))).otherwise(""))

    return let(_keyed(key, kind, canon, draw), of)


def _words(text: str) -> Column:
    return F.split(F.lit(text), " ")


def _pick(hexed: Column, i: Column, n: int) -> Column:
    return (F.conv(F.substr(hexed, i * 6 + 1, F.lit(4)), 16, 10).cast("int") % n + 1).cast("int")


def written_like(raw: Column, kind: Column, value: Column) -> Column:
    """A replacement in the mention's writing: its separators, its case."""

    def digits(v: Column) -> Column:
        ordinal = lambda i: F.length(_digits(F.substr(raw, F.lit(1), i + 1)))
        marks = F.array_join(F.transform(F.split(raw, ""), lambda x, i: F.when(_rx(x, "[0-9]"), F.substr(v, ordinal(i), F.lit(1))).otherwise(x)), "")
        return F.concat(marks, F.substr(v, F.length(_digits(raw)) + 1))

    def spaced(v: Column) -> Column:
        solid = lambda i: F.length(F.replace(F.substr(raw, F.lit(1), i + 1), F.lit(" "), F.lit("")))
        return F.concat(F.array_join(F.transform(F.split(raw, ""), lambda x, i: F.when(x == " ", x).otherwise(F.substr(v, solid(i), F.lit(1)))), ""), F.substr(v, F.length(F.replace(raw, F.lit(" "), F.lit(""))) + 1))

    upper = (F.upper(raw) == raw) & (F.length(raw) > 1)
    return (
        F.when(kind.isin("phone", "card", "ssn"), let(F.regexp_replace(value, r"^\+", ""), digits))
        .when(kind == "iban", let(value, spaced))
        .when(kind.isin("ip", "token"), value)
        .otherwise(F.when(upper & _rx(raw, r"\p{Lu}"), F.upper(value)).otherwise(value))
    )


def _matches(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(_rx(text, TRIGGER), F.lit(False)), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)


def moved_entities(scratch: Scratch, found: DataFrame, key: str) -> DataFrame | None:
    """(kind, canon, draw) of the entities whose first draw collides, with the
    draw at which none does; None if there is none. found: distinct (kind,
    canon). An entity keeps its draw against those that are at a later one."""
    moved = None
    while True:
        state = found.withColumn("draw", F.lit(0)) if moved is None else found.join(moved, ["kind", "canon"], "left").withColumn("draw", F.coalesce("draw", F.lit(0)))
        drawn = scratch.cut(state.withColumn("s", F.lower(surrogate(key, F.col("kind"), F.col("canon"), F.col("draw")))))
        first = drawn.groupBy("kind", "s").agg(F.min(F.struct("draw", "canon")).alias("keeps"), F.count("*").alias("n")).where("n > 1").select("kind", "s", "keeps")
        shared = drawn.join(first, ["kind", "s"]).where(F.struct("draw", "canon") != F.col("keeps")).select("kind", "canon")
        real = drawn.join(found.select("kind", F.col("canon").alias("s")), ["kind", "s"], "left_semi").select("kind", "canon")
        again = scratch.cut(shared.unionByName(real).distinct().withColumn("more", F.lit(1)))
        if again.isEmpty():
            scratch.drop(drawn)
            return moved
        after = drawn.select("kind", "canon", "draw").join(again, ["kind", "canon"], "left").withColumn("draw", F.col("draw") + F.coalesce("more", F.lit(0)))
        last, moved = moved, scratch.cut(after.where("draw > 0").select("kind", "canon", "draw"))
        for old in (drawn, again, last):
            if old is not None:
                scratch.drop(old)


#: Moved entities that are looked up by broadcast; more are joined.
MOVED_LIMIT = 20_000


def with_surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """docs with personal data in text_col replaced, and count_col (long), the
    mentions replaced, which takes the place of a column of that name.

    Kinds: e-mail, IPv4 and IPv6, telephone, payment card (Luhn), IBAN (mod
    97), US social security number, hex keys of 32 to 64 digits with a letter,
    access tokens with a known prefix, names after a title and, in the same
    document, alone with a capital. What fails its check is left alone, as is a
    name that no title introduces. key is a secret: who has it can try out
    originals; the same key gives the same replacements. Null texts stay null
    with 0 entities; every row of docs is kept, repeated and null ids included.
    An empty table gives an empty result; other columns pass through.
    """
    if not key:
        raise ValueError("surrogates need a key")
    scratch = Scratch(docs.sparkSession)
    said = docs.select(F.explode(F.flatten(of_document(_matches(F.col(text_col))))).alias("e")).select("e.kind", "e.canon")
    found = scratch.cut(said.distinct())
    moved = moved_entities(scratch, found, key)
    own = [c for c in docs.columns if c != count_col]
    rows = docs.select(F.struct(*own).alias("_row"), F.col(text_col).alias("_t")).withColumn("_m", _matches(F.col("_t"))).withColumn("_es", of_document(F.col("_m")))
    if moved is None:
        rows = rows.withColumn("_draws", F.lit(None).cast("map<string,int>"))
    else:
        rows = _with_draws(scratch, rows, docs, text_col, moved)
    draw = lambda e: F.coalesce(F.element_at(F.col("_draws"), F.concat_ws("|", e["kind"], e["canon"])), F.lit(0))
    new = lambda e: let(surrogate(key, e["kind"], e["canon"], draw(e)), lambda v: written_like(e["raw"], e["kind"], v))
    head = lambda m: F.regexp_extract(m, rf"^({_TITLE}\.? )\p{{Lu}}", 1)
    render = lambda m, es: F.when(F.size(es) == 0, m).otherwise(F.concat(head(m), F.array_join(F.transform(es, new), " ")))
    rows = rows.withColumn("_names", F.filter(F.flatten("_es"), lambda e: _rx(e["kind"], "^(?:given|family)-")))
    words = lambda g: F.when(F.size("_names") == 0, F.array(g)).otherwise(F.regexp_extract_all(g, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)))
    rows = rows.withColumn("_gaps", F.when(F.size("_m") > 0, F.transform(F.split("_t", PATTERN, -1), words)))
    bare = lambda x: F.when(_rx(x, r"^\p{Lu}"), F.get(F.filter("_names", lambda e: e["canon"] == F.lower(x)), F.lit(0)))
    again = lambda x: let(bare(x), lambda e: F.when(e.isNull(), x).otherwise(new(F.struct(e["kind"].alias("kind"), e["canon"].alias("canon"), x.alias("raw")))))
    gap = lambda g: F.when(F.size("_names") == 0, g).otherwise(F.transform(g, again))
    joined = F.array_join(F.transform("_gaps", lambda g, i: F.concat(F.array_join(gap(g), ""), F.coalesce(F.when(i < F.size("_m"), render(F.get(F.col("_m"), i), F.get(F.col("_es"), i))), F.lit("")))), "")
    mentions = F.when(F.size("_names") == 0, F.lit(0)).otherwise(F.aggregate("_gaps", F.lit(0), lambda a, g: a + F.size(F.filter(g, lambda x: F.coalesce(bare(x).isNotNull(), F.lit(False))))))
    count = F.when(F.size("_m") == 0, F.lit(0)).otherwise(F.size(F.flatten("_es")) + mentions).cast("long")
    text = F.when(F.size("_m") == 0, F.col("_t")).otherwise(joined)
    return rows.select(*[(text if c == text_col else F.col("_row")[c]).alias(c) for c in own], count.alias(count_col))


def _with_draws(scratch: Scratch, rows: DataFrame, docs: DataFrame, text_col: str, moved: DataFrame) -> DataFrame:
    """Adds _draws, kind|canon: draw, for the texts that name moved entities."""
    keyed = F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "canon"), "draw")))
    if moved.count() <= MOVED_LIMIT:
        return rows.crossJoin(F.broadcast(moved.agg(keyed.alias("_draws"))))  # one row
    said = docs.select(F.xxhash64(text_col).alias("_h"), F.explode(F.flatten(of_document(_matches(F.col(text_col))))).alias("e")).select("_h", "e.kind", "e.canon")
    draws = said.distinct().join(moved, ["kind", "canon"]).groupBy("_h").agg(keyed.alias("_draws"))
    return rows.withColumn("_h", F.xxhash64("_t")).join(draws, "_h", "left")

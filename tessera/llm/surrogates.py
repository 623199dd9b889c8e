"""Surrogates for personal data and secrets, in DataFrame functions only.

One pattern finds mentions: e-mail, IPv4 and IPv6 addresses, phone, card, bank
account and social security numbers, names behind a title, access keys and
tokens, passwords and long hexadecimal secrets. A mention's normal form is its
entity (an address in lower case, a number's digits, a part of a name), so
mentions of one entity that are written differently share a surrogate:
coreference survives. A name that a title has shown is found again in the same
text without one. Gender isn't part of a name's identity: a name has the gender
that its titles in the whole corpus speak for.

A surrogate comes from a keyed hash and is of its entity's type: card and
account numbers pass their checks and keep their network's digit or country,
phone numbers their country code's first digit, tokens their prefix, names
their gender and script; where a mention has separators or capitals, so has
what replaces it. All entities of the corpus are checked against each other: a
surrogate that another entity has taken, or that is itself an entity of the
corpus, is drawn anew until none is left, so different entities stay different
and nobody gets another's data.

Texts are searched once; what was found is kept beside them in a table. Only
texts with mentions are shuffled, to meet the surrogates of their entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The key of the query below. Whoever shares results keeps theirs secret.
QUERY_KEY = "key of op2_pii_surrogates"
#: Draws after which a type's surrogates are taken to be used up.
ROUNDS = 40

# Titles that tell a name's gender, and its script's syllables.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа")
NEUTRAL = ("Dr", "Prof")
LATIN = "ba be da do ka la le ma mi na no ra re ri sa so ta ti va vi".split()
CYRILLIC = "ба бе да до ка ла ле ма ми на но ра ре ри са со та ти ва ви".split()
_ENDS = {"m": ("n", "н"), "f": ("na", "на"), "n": ("l", "л"), "s": ("r", "р")}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_NAME = r"\p{Lu}\p{L}*+(?:['’-]\p{L}++)*+"
_TITLE = "(?:" + "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True)) + r")\.?"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Type, pattern. A mention begins where no letter or digit stands before it; the first type that fits has it.
TYPES = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "key": r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "token": r"(?:(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{8,}+|gh[opsur]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)",
    "password": r"(?<=(?:[Pp]assword|[Pp]asswd|PASSWORD|[Pp]wd)\s?[=:]\s?)[^\s\"']{4,}+",
    "hex": r"(?=[A-Fa-f]*+\d)(?=\d*+[A-Fa-f])[A-Fa-f0-9]{32,}+(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": rf"(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![A-Za-z0-9:])",
    "ip": rf"(?<!\d\.)(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "phone": rf"(?:\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:(?! {_OCTET}\.{_OCTET}\.)[ .-]?\d{{2,4}}){{1,4}}|\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}|\d{{3}}[.-]\d{{3}}[.-]\d{{4}})(?!\d)",
    "name": rf"{_TITLE} {_NAME}(?: {_NAME})?",
}
#: A part of a name, and one where it may stand without a title.
_PART, _CAPITAL = r"\p{L}{2,}+", r"(?<![\p{L}\p{N}])\p{Lu}\p{L}++"
MENTION = r"(?<![\p{L}\p{N}])(?:" + "|".join(TYPES.values()) + ")"
_DIGITS = ("ssn", "card", "phone")


def _text(x: str) -> Column:
    return F.lit(x)


def _is(v: Column, kind: str) -> Column:
    return F.rlike(v, _text(f"^(?:{TYPES[kind]})$"))


def _kind(v: Column) -> Column:
    """A mention's type; a password is told by the words before it, so it is what fits no other."""
    out = F.when(_is(v, "email"), "email")
    for k in TYPES:
        if k not in ("email", "password"):
            out = out.when(_is(v, k), k)
    return out.otherwise("password")


def _title(v: Column) -> Column:
    """The title of a name, with the space behind it."""
    return F.regexp_extract(v, f"^{_TITLE} ", 0)


def _name_type(part: Column) -> Column:
    return F.when(F.rlike(part, _text(r"\p{IsCyrillic}")), "name-cyrillic").otherwise("name-latin")


def _names(v: Column) -> Column:
    """A name's parts as entities, each with what the mention says of it: s for one of the last word, else the title's gender."""
    bare = F.regexp_replace(_title(v), r"[. ]", "")
    gender = F.when(bare.isin(*MALE), "m").when(bare.isin(*FEMALE), "f").otherwise("n")
    words = F.split(F.substr(v, F.length(_title(v)) + 1), " ")
    of = lambda w, i: F.transform(F.regexp_extract_all(w, _text(_PART), F.lit(0)), lambda p: F.struct(_name_type(p).alias("type"), F.lower(p).alias("norm"), F.when(i == F.size(words) - 1, "s").otherwise(gender).alias("said")))
    return F.flatten(F.transform(words, of))


def _phone(v: Column) -> Column:
    """A number's digits with its country code; one without is of the code 1, as its formats are."""
    digits = F.regexp_replace(v, "[^0-9]", "")
    return F.when(F.startswith(v, _text("+")), F.concat(_text("+"), digits)).otherwise(F.concat(_text("+1"), digits))


def _entities(v: Column) -> Column:
    """A mention's entities: (type, norm, said)."""
    kind = _kind(v)
    norm = F.when(kind.isin("email", "hex", "ipv6"), F.lower(v)).when(kind == "phone", _phone(v)).when(kind.isin(*_DIGITS), F.regexp_replace(v, "[^0-9]", "")).when(kind == "iban", F.replace(v, _text(" "), _text(""))).otherwise(v)
    one = F.array(F.struct(kind.alias("type"), norm.alias("norm"), _text("").alias("said")))
    return F.when(kind == "name", _names(v)).otherwise(one)


def _byte(seed: Column, i: Column) -> Column:
    """The i-th number from 0 to 255 of a seed of 128 hexadecimal digits."""
    return F.conv(F.substr(seed, 1 + 2 * F.pmod(i, F.lit(64)), F.lit(2)), 16, 10).cast("int")


def _masked(v: Column, seed: Column, letters: int = 26) -> Column:
    """``v`` with other digits for its digits and other letters of the same case for its ASCII letters."""
    at = F.transform(F.sequence(F.lit(0), F.length(v) - 1), lambda i: F.struct(F.substr(v, i + 1, F.lit(1)).alias("c"), _byte(seed, i).alias("b")))
    put = lambda s: F.when(s.c.between("0", "9"), F.chr(48 + s.b % 10)).when(s.c.between("a", "z"), F.chr(97 + s.b % letters)).when(s.c.between("A", "Z"), F.chr(65 + s.b % letters)).otherwise(s.c)
    return F.when(F.length(v) > 0, F.array_join(F.transform(at, put), "")).otherwise(v)


def _spoken(syllables: list[str], seed: Column, n: Column) -> Column:
    """``n`` of the syllables, in an array."""
    known = F.array(*map(F.lit, syllables))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(known, 1 + _byte(seed, i) % len(syllables)))


def _luhn(body: Column) -> Column:
    """``body`` with its Luhn check digit behind it."""
    n = F.length(body)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(body, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1))
    total = F.aggregate(F.transform(each, lambda x: F.when(x > 9, x - 9).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def _iban(country: Column, body: Column) -> Column:
    """An account number with its two check digits."""
    digits = F.transform(F.split(F.concat(body, country, _text("00")), ""), lambda c: F.when(c.between("A", "Z"), (F.ascii(c) - 55).cast("string")).otherwise(c))
    rest = F.aggregate(F.split(F.array_join(digits, ""), ""), F.lit(0), lambda a, c: (a * 10 + F.coalesce(F.try_to_number(c, _text("9")).cast("int"), F.lit(0))) % 97)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _drawn(kind: Column, norm: Column, attempt: Column, key: str, role: Column | None = None) -> Column:
    """The surrogate of an entity at its ``attempt``-th draw; ``role``: m, f, n or s of a name."""
    said = F.concat_ws("\x1f", _text(key), kind, norm, attempt.cast("string"))
    seed = F.concat(F.sha2(said, 256), F.sha2(F.concat(said, _text("\x1f")), 256))
    more = F.sha2(seed, 256)
    local = F.split_part(norm, _text("@"), F.lit(1))
    email = F.concat(_masked(local, seed), _text("@"), _masked(_text("aaaaaa"), F.concat(more, more)), _text(".example"))
    octets = F.concat_ws(".", (240 + _byte(seed, F.lit(0)) % 16).cast("string"), *(_byte(seed, F.lit(i)).cast("string") for i in (1, 2, 3)))
    first = F.substr(norm, F.lit(1), F.lit(1))
    card = _luhn(F.concat(first, _masked(F.substr(norm, F.lit(2), F.length(norm) - 2), seed)))
    phone = F.concat(F.substr(norm, F.lit(1), F.lit(2)), _masked(F.substr(norm, F.lit(3)), seed))
    groups = F.concat_ws(":", _text("2001:db8"), *(F.substr(seed, F.lit(1 + 4 * i), F.lit(4)) for i in range(6)))
    prefix = F.regexp_extract(norm, "^(?:[a-z]{2}_(?:live|test)_|gh[a-z]_|xox[a-z]-)", 0)
    token = F.concat(prefix, _masked(F.substr(norm, F.length(prefix) + 1), seed))
    out = F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ipv6", groups).when(kind == "token", token)
    out = out.when(kind == "iban", _iban(F.substr(norm, F.lit(1), F.lit(2)), _masked(F.substr(norm, F.lit(5)), seed)))
    out = out.when(kind == "ssn", F.concat(_text("9"), _masked(F.substr(norm, F.lit(2)), seed)))
    out = out.when(kind == "key", F.concat(F.substr(norm, F.lit(1), F.lit(4)), _masked(F.substr(norm, F.lit(5)), seed))).when(kind == "hex", _masked(norm, seed, 6))
    role = _text("n") if role is None else role
    for script, syllables in enumerate((LATIN, CYRILLIC)):
        pick = F.array_join(_spoken(syllables, seed, 3 + F.floor(attempt / 4).cast("int")), "")
        end = F.when(role == "m", _ENDS["m"][script]).when(role == "f", _ENDS["f"][script]).when(role == "s", _ENDS["s"][script]).otherwise(_ENDS["n"][script])
        out = out.when(kind == f"name-{('latin', 'cyrillic')[script]}", F.concat(pick, end))
    return out.otherwise(_masked(norm, seed))


def _renamed(s: Column, pattern: str, of: Column) -> Column:
    """``s`` with the parts of names that ``of`` knows replaced, in capitals where they are."""
    words, pieces = F.regexp_extract_all(s, _text(pattern), F.lit(0)), F.split(s, pattern, -1)

    def put(w: Column, rest: Column) -> Column:
        new = F.try_element_at(of, F.concat(_name_type(w), _text("|"), F.lower(w)))
        styled = F.when((F.length(w) > 1) & (w == F.upper(w)), F.upper(new)).when(w == F.lower(w), new).otherwise(F.initcap(new))
        return F.concat(F.coalesce(styled, w), rest)

    return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.zip_with(words, F.slice(pieces, 2, F.size(words)), put), ""))


def _rendered(v: Column, of: Column) -> Column:
    """What replaces a mention, ``of`` being the map of its text's entities to surrogates."""
    entities, kind = _entities(v), _kind(v)
    first = F.element_at(entities, 1)
    one = F.try_element_at(of, F.concat(first.type, _text("|"), first.norm))
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    figures = F.right(digits(one), F.length(digits(v)))  # a number without country code is the end of one with
    figure = lambda i: F.substr(figures, F.length(digits(F.substr(v, F.lit(1), i))), F.lit(1))
    number = F.array_join(F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.when(F.substr(v, i, F.lit(1)).between("0", "9"), figure(i)).otherwise(F.substr(v, i, F.lit(1)))), "")
    name = F.concat(_title(v), _renamed(F.substr(v, F.length(_title(v)) + 1), _PART, of))
    spaced = F.when(F.contains(v, _text(" ")), F.rtrim(F.regexp_replace(one, "(.{4})", "$1 "))).otherwise(one)
    return F.when(kind.isin(*_DIGITS), number).when(kind == "name", name).when(kind == "iban", spaced).when(kind.isin("email", "hex", "ipv6") & (v == F.upper(v)), F.upper(one)).otherwise(one)


def surrogates(entities: DataFrame, root: str, key: str) -> DataFrame:
    """Of ``entities`` (type, norm, role), each with a surrogate that no other entity of its type has or is."""
    open_ = entities.select("type", "norm", "role")
    done, left = open_.limit(0).select("type", "norm", F.lit("").alias("surrogate")), open_.count()
    for k in range(ROUNDS):
        drawn = open_.select("type", "norm", _drawn(F.col("type"), F.col("norm"), F.lit(k), key, F.col("role")).alias("surrogate"))
        # an entity has the place before a drawn surrogate has, and one drawn earlier before a later one
        claims = entities.select("type", F.col("norm").alias("surrogate"), F.lit(0).alias("rank"), "norm")
        claims = claims.union(done.select("type", "surrogate", F.lit(1), "norm")).union(drawn.select("type", "surrogate", F.lit(2), "norm"))
        held = claims.groupBy("type", "surrogate").agg(F.min(F.struct("rank", "norm")).alias("holder")).where("holder.rank = 2")
        won = common.materialize(held.select("type", F.col("holder.norm").alias("norm"), "surrogate"), root, f"surrogates-{k}")
        done, left = done.union(won), left - won.count()
        if not left:
            return done
        open_ = common.materialize(open_.join(won.select("type", "norm"), ["type", "norm"], "left_anti"), root, f"open-{k}")
    raise ValueError(f"a type of entity has too many members for its surrogates: {open_.first()}")


def pseudonymize(docs: DataFrame, key: str, root: str | None = None) -> DataFrame:
    """``docs`` with mentions in ``text`` replaced, and n_mentions.

    Equal entities get equal surrogates in the whole of ``docs`` and different
    ones different surrogates; another ``key`` gives others. n_mentions counts
    what the pattern finds; names that are found again without a title are
    replaced, too, but not counted. A null text stays null and has no mention
    (0), an empty one stays empty. Repeated rows and rows without doc_id are
    treated as all others. Other columns stay, whatever their names; one called
    n_mentions is replaced. An empty table gives no row.
    """
    root = root or common.shared_dir(docs.sparkSession)
    kept = [c for c in docs.columns if c != "n_mentions"]
    text = docs["text"].cast("string")
    # the columns travel in a struct, so none can clash with those of the join
    others = [docs[c] for c in kept if c != "text"] or [F.lit(0).alias("none")]
    marked = docs.select(F.struct(*others).alias("row"), text.alias("text"), F.regexp_extract_all(text, _text(MENTION), F.lit(0)).alias("found"))
    marked = common.materialize(marked.withColumn("found", F.when(F.size("found") > 0, F.col("found"))), root, "marked")
    back = lambda of: [of.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in kept]
    hit = marked.where("found is not null").select("*", F.xxhash64("text").alias("_x"), F.xxhash64(F.lit(2), "text").alias("_y"))
    found = hit.select("_x", "_y", F.explode(F.array_distinct(F.flatten(F.transform("found", _entities)))).alias("e")).select("_x", "_y", "e.*")
    found = common.materialize(found, root, "found")
    votes = [F.sum((F.col("said") == r).cast("long")).alias(r) for r in ("m", "f", "s")]
    role = F.expr("case when s > m + f then 's' when m > f then 'm' when f > m then 'f' when s > 0 then 's' else 'n' end").alias("role")
    entities = common.materialize(found.groupBy("type", "norm").agg(*votes).select("type", "norm", role), root, "entities")
    given = surrogates(entities, root, key)
    met = found.select("_x", "_y", "type", "norm").distinct().join(given, ["type", "norm"])
    swaps = met.groupBy("_x", "_y").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("type", F.lit("|"), "norm"), "surrogate"))).alias("_of"), F.bool_or(F.startswith("type", F.lit("name"))).alias("_named"))
    swaps = common.materialize(swaps, root, "swaps")
    clean = marked.where("found is null").select(*back(F.col("text")), F.lit(0).cast("long").alias("n_mentions"))
    packed = hit.join(swaps, ["_x", "_y"]).select("row", "text", "_of", "_named", "found")
    again = lambda rest: F.when(F.col("_named"), _renamed(rest, _CAPITAL, F.col("_of"))).otherwise(rest)
    pieces = F.split("text", MENTION, -1)
    put = F.zip_with(F.transform("found", lambda v: _rendered(v, F.col("_of"))), F.slice(pieces, 2, F.size("found")), lambda v, rest: F.concat(v, again(rest)))
    whole = F.concat(again(pieces[0]), F.array_join(put, ""))
    some = packed.select("row", whole.alias("whole"), F.size("found").cast("long").alias("n_mentions"))
    return clean.union(some.select(*back(F.col("whole")), "n_mentions"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates; nulls and repeats as in ``pseudonymize``."""
    return pseudonymize(common.table(spark, sf_dir, "documents"), QUERY_KEY).select("doc_id", "text", "n_mentions")

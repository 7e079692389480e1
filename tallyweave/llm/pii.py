"""Personal data: entities get keyed, type-consistent surrogates. DataFrame functions only."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import discard, materialize, skewed_join

#: Titles by the gender they tell, for the names behind them (fixed values).
TITLES = {
    "m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Dra"),
    "n": ("Dr", "Prof", "Doctor", "Professor"),
}
#: Characters of an account number by country, as the public register gives them (fixed values).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Two letters and two check digits, then as many characters as the country has, plain or in groups of four."""
    each = [f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(size - 4) // 4}}}" + (f" ?[A-Z0-9]{{{(size - 4) % 4}}}" if size % 4 else "") for size, names in IBAN_LENGTHS.items()]
    return rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(each)})(?![A-Za-z0-9])"


_TITLE = "|".join(t for titles in TITLES.values() for t in titles)
#: Kinds and their patterns, in the order in which they are tried at a place. Runs are possessive and groups repeat a bounded number of
#: times or possessively, so that the engine neither recurses nor goes back over a long run.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?[^\s\"',;]{6,}+",
    "access_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9_])",
    "api_token": r"(?:sk|pk|rk|ghp|gho|ghs|github_pat|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}+",
    "hex_key": r"(?=[a-f]*+[0-9])[0-9a-f]{32,}+(?![A-Za-z0-9_])",
    "ipv6": r"(?=[0-9A-Fa-f:]{0,38}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}(?::[0-9A-Fa-f]{1,4}){1,6})(?![A-Za-z0-9_:])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "iban": _iban(),
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d+-])(?:[2-6]\d{3}(?:\d{12}|(?: \d{4}){3}|(?:-\d{4}){3})|3[47]\d{2}(?:\d{11}| \d{6} \d{5}|-\d{6}-\d{5})|3[068]\d{2}(?:\d{10}| \d{6} \d{4}|-\d{6}-\d{4})|4\d{12}|[456]\d{16,18})(?!\d)",
    "phone": r"(?<![\w.])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)|(?=\+(?:[ .-]?\d){8,15}(?!\d))\+\d{1,3}(?:[ .-]?\d{1,4}){2,6}(?!\d)"
    r"|(?<![\w.-])(?:(?=0(?: ?\d){8,11}(?!\d))0\d{1,4}(?: \d{2,4}){2,5}|(?=0(?:\.?\d){8,11}(?!\.?\d))0\d{1,4}(?:\.\d{2,4}){2,5}|(?=0(?:[ /-]?\d){8,11}(?!\d))0\d{2,4}[/-]\d{2,8}(?:[ -]\d{2,4}){0,3})(?!\d))",
}
#: A titled name: the words behind the title (initials between them are passed over).
TITLED = rf"(?:{_TITLE})(?!\p{{L}})\.? (?:(?:{_TITLE})\.? ){{0,2}}(?:\p{{Lu}}\. ){{0,2}}{(WORD := rf"(?!(?:{_TITLE})(?!\p{{L}}))\p{{Lu}}\p{{L}}++(?:['’-]\p{{Lu}}\p{{L}}*+){{0,3}}+")}(?: {WORD})?"
#: Entities start where no word goes on before them.
START = r"(?<![A-Za-z0-9_])"
KNOWN = START + "(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: The same, and titled names.
EVERY = START + "(?:" + "|".join(f"(?:{p})" for p in (*PATTERNS.values(), TITLED)) + ")"
#: Kinds that start with a digit, mark or capital, which few places of a text do: the look behind comes second.
_SIGNED = "|".join(f"(?=[{first}]){START}(?:{'|'.join(f'(?:{p})' for p in patterns)})" for first, patterns in (("0-9+(", [PATTERNS[k] for k in ("hex_key", "ipv6", "ip", "ssn", "card", "phone")]), ("A-Z", [PATTERNS["access_key"], PATTERNS["ipv6"], PATTERNS["iban"], TITLED])))
#: What a text with an entity of a kind that starts with any letter must hold (in lower case for secrets), fixed by the patterns.
_HELD = {"email": ("@",), "secret": ("passw", "pwd", "secret", "token", "key"), "api_token": ("sk-", "sk_", "pk-", "pk_", "rk-", "rk_", "ghp", "gho", "ghs", "github_pat", "xoxb", "xoxp"), "ipv6": (":",)}


def has_entity(text: Column) -> Column:
    """Whether EVERY is found in a text: kinds behind what such a text must hold, so that most texts are seen by one pattern only."""
    out = text.rlike(_SIGNED) | (text.rlike("[a-f][0-9]") & text.rlike(START + PATTERNS["hex_key"]))
    for kind, held in _HELD.items():
        own = F.lower(text) if kind == "secret" else text
        some = own.contains(held[0])
        for part in held[1:]:
            some = some | own.contains(part)
        out = out | (some & text.rlike(f"{START}(?:{PATTERNS[kind]})"))
    return F.coalesce(out, F.lit(False))


#: Endings of invented given names, and syllables of invented names (fixed values).
MALE_ENDS, FEMALE_ENDS, OTHER_ENDS = ("on", "ar", "us", "en"), ("a", "ia", "ine", "elle"), ("i", "is", "y", "el")
SYLLABLES = ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ha", "he", "ja", "jo", "ka", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "ra", "re", "ro", "sa", "so", "ta", "to")
#: Letters that a letter is replaced among, by script and case (fixed values).
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "àâäçèéêëíîïñóôöùûüáú", "ÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÛÜÁÚ")
#: Tries that keep an entity's format (from WIDER on with longer names); later ones add a tag, so that even a full domain stays distinct.
TRIES, WIDER = 12, 4
#: Where the key of a session is looked for.
SECRET = "spark.tallyweave.pii.secret"


def session_secret(spark: SparkSession) -> str:
    """The key in ``spark.tallyweave.pii.secret``; without it one drawn at random for the application, so surrogates are equal within it and tell nothing outside."""
    own = spark.conf.get(SECRET, None)
    if own:
        return own
    context = spark.sparkContext
    if not hasattr(context, "_tallyweave_secret"):
        context._tallyweave_secret = secrets.token_hex(32)
    return context._tallyweave_secret


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _luhn(digits: Column) -> Column:
    """The sum of digits, every other one from the second from the end on doubled, mod 10: 0 for a right number."""
    double = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
    return F.aggregate(F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 1, double(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda s, d: s + d) % 10


def _mod97(text: Column) -> Column:
    """Digits, and letters as 10 to 35, read as one number mod 97."""
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(_chars(text), F.lit(0), lambda r, c: ((r * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97).cast("int"))


def _checks(kind: Column, entity: Column) -> Column:
    """Whether the check digits of a card or account number are right; true for other kinds."""
    plain = F.regexp_replace(entity, " ", "")
    account = _mod97(F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(1, 4))) == 1
    return F.when(kind == "card", _luhn(_digits(entity)) == 0).when(kind == "iban", account).otherwise(True)


def _kind(entity: Column) -> Column:
    """The first kind whose pattern the whole entity fits; a name if none; null if its check digits are wrong."""
    out = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _lead(kind: Column, entity: Column) -> Column:
    """What an entity keeps at its start: the label of a secret, the prefix of a key, the country of a phone or account."""
    country = F.regexp_extract(entity, r"^\+\d{1,3}[ .-]?(?=[ .(-]?\d|\()", 0)
    phone = F.when(entity.rlike(r"^\+\d{1,3}[ .(-]"), country).when(entity.startswith("0"), "0").otherwise(F.regexp_extract(entity, r"^(.*?)(?:\D*\d){1,10}$", 1))
    return (
        F.when(kind == "secret", F.regexp_extract(entity, r"^.*?[=:]\s{0,3}[\"']?", 0))
        .when(kind == "access_key", F.substring(entity, 1, 4))
        .when(kind == "api_token", F.regexp_extract(entity, r"^[A-Za-z]+[-_]", 0))
        .when(kind == "iban", F.substring(entity, 1, 2))
        .when(kind == "phone", phone)
        .otherwise("")
    )


def _rest(entity: Column, lead: Column) -> Column:
    return entity.substr(F.length(lead) + 1, F.length(entity))


def _groups(address: Column) -> Column:
    """The eight groups of an IPv6 address without leading zeros, ``::`` written out."""
    part = lambda k: F.filter(F.split(F.coalesce(F.get(F.split(address, "::"), F.lit(k)), F.lit("")), ":"), lambda g: g != "")
    left, right = part(0), part(1)
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    return F.transform(F.concat(left, zeros, right), lambda g: F.regexp_replace(F.lower(g), "^0{1,3}(?=.)", ""))


def _mark(kind: Column, entity: Column, lead: Column) -> Column:
    """One value for all spellings of an entity, whoever it belongs to."""
    rest = _rest(entity, lead)
    return (
        F.when(kind == "phone", F.substring(_digits(rest), -10, 10))
        .when(kind.isin("card", "ssn"), _digits(entity))
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind == "ipv6", F.array_join(_groups(entity), ":"))
        .when(kind.isin("email", "name"), F.lower(entity))
        .otherwise(rest)
    )


def _hexadecimal(text: Column) -> Column:
    return text.rlike("^[^a-zA-Z0-9]*+[0-9a-f][^g-zA-Z]*+$") & text.rlike("[0-9]")


def _like(text: Column, seed: Column, hexadecimal: Column) -> Column:
    """Each digit and letter becomes another of its kind, script and case, drawn by its place counted from the end; the rest stays."""
    pick = lambda letters, i: F.substring(F.lit(letters), F.pmod(F.xxhash64(seed, i), F.lit(len(letters))).cast("int") + 1, F.lit(1))

    def char(c: Column, i: Column) -> Column:
        out = F.when(c.between("0", "9"), pick("0123456789", i)).when(hexadecimal & c.between("a", "f"), pick("abcdef", i))
        for letters in ALPHABETS:
            out = out.when(F.instr(F.lit(letters), c) > 0, pick(letters, i))
        return out.otherwise(c)

    return F.array_join(F.reverse(F.transform(F.reverse(_chars(text)), char)), "")


def _made_up(seed: Column, ends: Column | None, n: int) -> Column:
    parts = [F.element_at(F.array(*(F.lit(s) for s in SYLLABLES)), F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(len(SYLLABLES))).cast("int") + 1) for k in range(n)]
    return F.initcap(F.concat(*parts, *([] if ends is None else [ends])))


def _shaped(shape: Column, made: Column) -> Column:
    """``shape`` with its digits and letters replaced by the characters of ``made``, from left to right."""
    inner = lambda c: c.rlike("[A-Za-z0-9]")
    put = F.aggregate(
        _chars(shape), F.struct(F.lit(1).alias("n"), F.lit("").alias("s")),
        lambda a, c: F.struct((a["n"] + inner(c).cast("int")).alias("n"), F.concat(a["s"], F.when(inner(c), made.substr(a["n"], F.lit(1))).otherwise(c)).alias("s")),
    )
    return put["s"]


def _card(digits: Column, like: Column) -> Column:
    """The issuer's first digit, drawn ones, and a right check digit."""
    body = F.concat(F.substring(digits, 1, 1), like.substr(F.lit(2), F.length(digits) - 2))
    return F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))


def _account(country: Column, like: Column) -> Column:
    """The same country, and drawn characters of the same kinds behind right check digits."""
    own = like.substr(F.lit(3), F.length(like))
    check = 98 - _mod97(F.concat(own, country, F.lit("00")))
    return F.concat(F.lpad(check.cast("string"), 2, "0"), own)


def _phone(like: Column, seed: Column) -> Column:
    """Where nine digits or more tell a whole number, its first is 0 or 1, with which no area or subscriber number starts."""
    first = F.pmod(F.xxhash64(seed, F.lit("first")), F.lit(2)).cast("string")
    return F.when(F.length(like) >= 9, F.concat(first, like.substr(F.lit(2), F.length(like)))).otherwise(like)


def _name(entity: Column, like: Column, role: Column, seed: Column, attempt: Column) -> Column:
    """An invented word: an ending by gender for a given name, none for a family name; other scripts keep theirs."""
    end = lambda ends: F.element_at(F.array(*(F.lit(e) for e in ends)), F.pmod(F.xxhash64(seed, F.lit("end")), F.lit(len(ends))).cast("int") + 1)
    ends = F.when(role == "m", end(MALE_ENDS)).when(role == "f", end(FEMALE_ENDS)).otherwise(end(OTHER_ENDS))
    long = _made_up(seed, None, 6)
    family = F.when(attempt < WIDER, F.substring(long, 1, 8)).otherwise(long)
    given = F.concat(F.when(attempt < WIDER, F.substring(long, 1, 4)).otherwise(F.substring(long, 1, 8)), ends)
    made = F.when(entity.rlike(r"^[\p{IsLatin}'’-]+$"), F.when(role == "family", family).otherwise(given)).otherwise(like)
    return F.when((F.upper(entity) == entity) & (F.length(entity) > 1), F.upper(made)).otherwise(made)


def surrogate(kind: Column, entity: Column, lead: Column, norm: Column, secret: str, attempt: Column) -> Column:
    """A replacement of the same kind and format, fixed by the secret, the kind, the normal form and the attempt.

    Addresses come from 240.0.0.0/4 and 2001:db8::/32, mail domains from example.com, phone numbers from those that nobody can have.
    """
    rest = _rest(entity, lead)
    plain = F.when(kind == "email", F.regexp_extract(entity, "^[^@]*", 0)).when(kind.isin("phone", "card"), _digits(rest)).when(kind == "iban", F.regexp_replace(rest, " ", "")).otherwise(rest)

    def made(x: Column) -> Column:
        seed, plain, like = x["seed"], x["plain"], x["like"]
        draw = lambda k, n: F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(n))
        octets = F.concat_ws(".", (draw(0, 16) + 240).cast("string"), *(draw(k, 256).cast("string") for k in (1, 2)), (draw(3, 254) + 1).cast("string"))
        mail = F.concat(like, F.lit("@"), F.lower(_made_up(seed, None, 4)), F.lit(".example.com"))
        ipv6 = F.concat(F.lit("2001:db8:"), F.concat_ws(":", *(F.lower(F.hex(draw(k, 65535) + 1)) for k in range(6))))
        inner = F.when(kind == "card", _card(plain, like)).when(kind == "iban", _account(lead, like)).when(kind == "phone", _phone(like, seed))
        of = F.when(kind == "ip", octets).when(kind == "email", mail).when(kind == "ipv6", ipv6).when(kind == "name", _name(entity, like, F.regexp_extract(norm, "^[^:]*", 0), seed, attempt))
        out = of.when(kind.isin("card", "iban", "phone"), F.concat(lead, _shaped(rest, inner))).otherwise(F.concat(lead, like))
        return F.when(attempt < TRIES, out).otherwise(F.concat(out, F.lit("-"), F.substring(seed, 1, 12)))

    seed = F.sha2(F.concat_ws("\x1f", F.lit(secret), kind, norm, attempt.cast("string")), 256)
    known = F.transform(F.array(plain), lambda p: F.struct(seed.alias("seed"), p.alias("plain"), _hexadecimal(p).alias("hex")))
    drawn = F.transform(known, lambda x: F.struct(x["seed"].alias("seed"), x["plain"].alias("plain"), _like(x["plain"], x["seed"], x["hex"]).alias("like")))
    return F.element_at(F.transform(drawn, made), 1)


def surrogate_table(entities: DataFrame, secret: str) -> DataFrame:
    """(entity, kind, role, made) for distinct (entity, kind, role). All spellings of one normal form use one attempt (coreference); an attempt is
    taken only if its result is no entity found in the corpus, of any kind, and no other's result (distinctness). The losers
    of a round try again; rounds end when none is left."""
    known = entities.withColumn("lead", _lead(F.col("kind"), F.col("entity"))).withColumn("mark", _mark(F.col("kind"), F.col("entity"), F.col("lead")))
    known = known.withColumn("norm", F.when(F.col("kind") == "name", F.concat_ws(":", "role", "mark")).otherwise(F.col("mark")))
    known = materialize(known, "entities")
    # One spelling stands for its normal form.
    first = lambda rows: rows.groupBy("kind", "norm").agg(F.min(F.struct("entity", "lead")).alias("x")).select("kind", "norm", "x.entity", "x.lead")
    left = first(known)
    taken, tables = None, [known]
    args = (F.col("kind"), F.col("entity"), F.col("lead"), F.col("norm"), secret)
    for attempt in range(4 * TRIES):
        tried = left.withColumn("made", surrogate(*args, F.lit(attempt)))
        result = F.when(F.col("kind") == "phone", F.expr("substring(regexp_replace(made, '[^0-9]', ''), -length(norm), length(norm))")).otherwise(_mark(F.col("kind"), F.col("made"), _lead(F.col("kind"), F.col("made"))))
        tried = materialize(tried.select("kind", "norm", result.alias("result")), "tried")
        tables.append(tried)
        used = known.select(F.col("mark").alias("result"))
        if taken is not None:
            used = used.union(taken.select("result"))
        won = tried.groupBy("result").agg(F.min(F.struct("kind", "norm")).alias("x")).join(used.distinct(), "result", "left_anti")
        won = materialize(won.select("x.kind", "x.norm", "result", F.lit(attempt).alias("attempt")), "won")
        tables.append(won)
        taken = won if taken is None else taken.union(won)
        lost = tried.join(won, ["kind", "norm"], "left_anti").select("kind", "norm")
        if lost.isEmpty():
            break
        left = first(known.join(lost, ["kind", "norm"]))
    else:
        raise RuntimeError("surrogates still collide after all attempts")
    out = known.join(taken.select("kind", "norm", "attempt"), ["kind", "norm"]).select("entity", "kind", "role", surrogate(*args, F.col("attempt")).alias("made"))
    out = materialize(out, "surrogates")
    discard(*tables)
    return out


def name_words(titled: Column) -> Column:
    """Word to role for the words of titled names: the role of a given name is its title's gender (m, f, n), the last word is a family name.

    A word has one role in a text: family if it is one anywhere, else the first in the order given.
    """
    doctor = rf"^(?:(?:{'|'.join(TITLES['n'])})(?!\p{{L}})\.? )?"
    heads = {g: rf"{doctor}(?:{'|'.join(TITLES[g])})(?!\p{{L}})" for g in "mf"}
    words = lambda x: F.split(F.regexp_replace(x, rf"^(?:(?:{_TITLE})(?!\p{{L}})\.? )+(?:\p{{Lu}}\. )*", ""), " ")
    of = {"family": F.transform(titled, lambda x: F.element_at(words(x), -1))}
    tells = {"m": lambda x: x.rlike(heads["m"]), "f": lambda x: x.rlike(heads["f"]), "n": lambda x: ~x.rlike(heads["m"]) & ~x.rlike(heads["f"])}
    for g, test in tells.items():
        of[g] = F.flatten(F.transform(F.filter(titled, test), lambda x: F.slice(words(x), 1, F.size(words(x)) - 1)))
    keys, roles = F.array().cast("array<string>"), F.array().cast("array<string>")
    for role, found in of.items():
        new = F.array_except(found, keys)
        keys, roles = F.concat(keys, new), F.concat(roles, F.array_repeat(F.lit(role), F.size(new)))
    return F.map_from_arrays(keys, roles)


def replace_entities(docs: DataFrame, *, secret: str, text: str = "text", count_column: str | None = "n_entities") -> DataFrame:
    """``docs`` with every detected entity of ``text`` replaced, and the number of replacements in ``count_column`` (none if it is None).

    Entities: e-mail addresses, phone, card (with a right Luhn digit), account (with right check digits) and social numbers, IP addresses,
    passwords, tokens and keys, and titled names; the words of a titled name are replaced wherever else they stand in the text. Replacements
    depend on ``secret``; equal entities get equal ones in all documents, different entities different ones, and none equals an entity of the corpus.
    Texts that fit no pattern pass in the scan and are not shuffled; the others are cut at
    their entities, these are looked up by a join, and the pieces put together again by the
    text's digest, so copies of a text are replaced once. Texts and entities that many rows share are salted in the joins.

    Null and empty texts stay as they are with 0 entities. Rows are kept one by one, whatever their
    keys; a column of the name ``count_column`` is replaced; an empty table gives an empty result. Long runs of one
    kind of character take time in proportion to their length.
    """
    rest = [c for c in docs.columns if c != count_column]
    hit = has_entity(F.col(text))
    untouched = docs.select(*rest).filter(~hit).withColumn("__n", F.lit(0).cast("long"))
    every = F.regexp_extract_all(F.col(text), F.lit(EVERY), F.lit(0))
    titled = F.filter(every, lambda x: x.rlike(f"^(?:{TITLED})$"))
    marked = docs.select(*rest).filter(hit).withColumn("__titled", titled)
    marked = marked.withColumn("__roles", F.when(F.size("__titled") > 0, name_words(F.col("__titled"))))
    # The words of a text's titled names become a pattern of that text; the longest first.
    words = F.concat(F.lit("(?:"), F.array_join(F.reverse(F.array_sort(F.map_keys("__roles"))), "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    own = F.concat(F.lit(KNOWN + r"|(?<![\p{L}\p{N}_])(?=\p{Lu})"), words, F.lit("(?: "), words, F.lit("){0,3}+"))
    cut = lambda pattern: F.struct(F.regexp_extract_all(F.col(text), pattern, F.lit(0)).alias("found"), F.split(F.col(text), pattern, -1).alias("parts"))
    marked = marked.withColumn("__cut", F.when(F.col("__roles").isNotNull(), cut(own)).otherwise(cut(F.lit(KNOWN))))
    marked = marked.select(*(c for c in rest if c != text), F.sha2(F.col(text), 256).alias("__digest"), "__roles", F.col("__cut.found").alias("__found"), F.col("__cut.parts").alias("__parts"))
    marked = materialize(marked, "marked")

    texts = marked.groupBy("__digest").agg(F.first("__found").alias("found"), F.first("__roles").alias("roles"))
    spots = texts.select("__digest", F.posexplode("found").alias("place", "whole"))
    spots = spots.withColumn("kind", _kind(F.col("whole"))).withColumn("kind", F.when(_checks(F.col("kind"), F.col("whole")), F.col("kind")))
    spots = spots.select("__digest", "place", "kind", F.posexplode(F.when(F.col("kind") == "name", F.split("whole", " ")).otherwise(F.array("whole"))).alias("sub", "entity"))
    words = texts.filter("roles is not null").select("__digest", F.explode("roles").alias("entity", "role")).withColumn("kind", F.lit("name"))
    # What only looks like an entity keeps its place, with no kind.
    spots = spots.join(words, ["__digest", "kind", "entity"], "left").select("__digest", "place", "sub", "entity", F.when((F.col("kind") != "name") | F.col("role").isNotNull(), F.col("kind")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"))
    spots = materialize(spots, "spots")
    made = surrogate_table(spots.filter("kind is not null").select("entity", "kind", "role").distinct(), secret)
    replaced = skewed_join(spots, made, ["entity", "kind", "role"], "left")
    by_place = replaced.groupBy("__digest", "place").agg(F.array_sort(F.collect_list(F.struct("sub", F.coalesce("made", "entity").alias("made")))).alias("m"), F.max(F.col("made").isNotNull()).alias("hit"))
    by_place = by_place.select("__digest", F.struct("place", F.array_join(F.transform("m", lambda x: x["made"]), " ").alias("made"), "hit").alias("x"))
    by_text = materialize(by_place.groupBy("__digest").agg(F.sort_array(F.collect_list("x")).alias("__made"), F.count_if("x.hit").alias("__n")), "replacements")
    joined = skewed_join(marked, by_text, ["__digest"], "left")
    put = F.transform(F.coalesce("__made", F.array().cast("array<struct<place:int,made:string,hit:boolean>>")), lambda x: x["made"])
    whole = F.concat(F.element_at("__parts", 1), F.array_join(F.zip_with(put, F.slice("__parts", 2, F.greatest(F.lit(0), F.size("__parts") - 1)), lambda m, p: F.concat(m, p)), ""))
    changed = joined.select(*(whole.alias(c) if c == text else F.col(c) for c in rest), F.coalesce("__n", F.lit(0)).cast("long").alias("__n"))
    out = untouched.union(changed)
    return out.drop("__n") if count_column is None else out.withColumnRenamed("__n", count_column)

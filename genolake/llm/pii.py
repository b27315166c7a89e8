"""Operator 6 (native): format-preserving Feistel pseudonyms. DataFrame functions only, no Python on the executors."""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genolake.llm.common import table

#: The setting that holds the key. Who knows the key can undo the pseudonyms, so none is kept in the code.
KEY_SETTING = "spark.genolake.pii.key"
ROUNDS = 8
FIRST_DAY, LAST_DAY = "1900-01-01", "2099-12-31"
DAYS = 73049

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: A text without any of these signs holds nothing that is looked for; most texts need no more than this one look.
SIGN = "[0-9@]|(?i:passw)|AKIA"
#: Put around matches for a moment; a code point that is no character. Texts that hold it are cut in another way.
EDGE = "\ufdd0"
#: What is looked for, in order of precedence. Dates must be days of the calendar, cards and long numbers must have a right
#: check digit, the other kinds must have their exact form; what doesn't validate stays.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "password": r"(?i:(?<![A-Za-z])passw(?:or)?d\s{0,2}[=:]\s{0,2})[A-Za-z0-9]{6,64}+",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "iso_date": r"(?<![0-9-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])",
    "us_date": r"(?<![0-9/])(?:0[1-9]|1[0-2])/(?:0[1-9]|[12][0-9]|3[01])/(?:19|20)[0-9]{2}(?![0-9/])",
    "de_date": r"(?<![0-9.])(?:0[1-9]|[12][0-9]|3[01])\.(?:0[1-9]|1[0-2])\.(?:19|20)[0-9]{2}(?![0-9])",
    "social": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?<gap>[ -])[0-9]{4}\k<gap>[0-9]{4}\k<gap>[0-9]{1,7}|3[47][0-9]{2}(?<sep>[ -])[0-9]{6}\k<sep>[0-9]{5})(?![0-9])",
    "number": r"(?<![A-Za-z0-9])[0-9]{12,19}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
}
PATTERN = "|".join(KINDS.values())


def keyed(key: str, *parts: Column | str) -> Column:
    """The keyed pseudo-random function: 60 bits of SHA-256 as a long."""
    joined = F.concat_ws("|", F.lit(key), *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 15), 16, 10).cast("long")


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def permuted(x: Column, n: Column | int, key: str, tag: str) -> Column:
    """A keyed permutation of 0 .. n-1 (n up to 10^18): a Feistel network over a grid of at least n cells; a value that
    leaves the range is permuted again until it is back (cycle walking), so no two values meet. The grid has at most
    3 * sqrt(n) + 2 cells too many; a walk of over 64 turns (its odds are below 10^-90 for the ranges used here) is an error."""
    n = F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.call_function("div", n + a - 1, a)

    def once(v: Column) -> Column:
        start = F.struct(F.call_function("div", v, b).alias("l"), (v % b).alias("r"))

        def turn(s: Column, i: Column) -> Column:
            even = F.struct(((s["l"] + keyed(key, tag, n, i, s["r"])) % a).alias("l"), s["r"].alias("r"))
            odd = F.struct(s["l"].alias("l"), ((s["r"] + keyed(key, tag, n, i, s["l"])) % b).alias("r"))
            return F.when(i % 2 == 0, even).otherwise(odd)

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])

    walk = F.sequence(F.lit(1), F.lit(64))
    end = F.aggregate(walk, once(x.cast("long")), lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return let(end, lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("the permutation's walk did not come back")).cast("long")))


def letter(s: Column, i: Column) -> Column:
    return F.substr(s, i.cast("int"), F.lit(1))


def letters(s: Column, f) -> Column:
    """s with f(letter, place from 1) in place of each letter."""
    places = F.sequence(F.lit(1), F.length(s))
    return F.when(F.length(s) == 0, "").otherwise(F.array_join(F.transform(places, lambda i: f(letter(s, i), i)), ""))


def permuted_text(s: Column, key: str, tag: str, hexadecimal: bool = False) -> Column:
    """A keyed permutation of texts of one shape: digits stay digits, small and capital Latin letters stay such, other
    signs stay. A Feistel network: each half in turn is shifted, letter by letter, by a function of the other half."""

    def shift(c: Column, by: Column) -> Column:
        def within(first: int, size: int) -> Column:
            return F.chr(F.lit(first) + F.pmod(F.ascii(c) - first + by, F.lit(size)))

        if hexadecimal:
            small, signs = c.rlike("[a-f]"), F.lit("0123456789abcdef")
            at = F.pmod(F.instr(signs, F.lower(c)) - 1 + by, F.lit(16)) + 1
            new = letter(signs, at)
            return F.when(small | c.rlike("[0-9]"), new).otherwise(F.upper(new))
        return (
            F.when(c.rlike("[0-9]"), within(48, 10)).when(c.rlike("[a-z]"), within(97, 26)).when(c.rlike("[A-Z]"), within(65, 26)).otherwise(c)
        )

    half = F.call_function("div", F.length(s) + 1, F.lit(2)).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s)).alias("r"))

    def turn(st: Column, k: Column) -> Column:
        even = F.struct(letters(st["l"], lambda c, i: shift(c, keyed(key, tag, k, i, st["r"]))).alias("l"), st["r"].alias("r"))
        odd = F.struct(st["l"].alias("l"), letters(st["r"], lambda c, i: shift(c, keyed(key, tag, k, i, st["l"]))).alias("r"))
        return F.when(k % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda st: F.concat(st["l"], st["r"]))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def refilled(shape: Column, new: Column) -> Column:
    """shape with its digits replaced by those of new, in order."""
    return letters(shape, lambda c, i: F.when(c.rlike("[0-9]"), letter(new, F.length(digits(F.substr(shape, F.lit(1), i.cast("int")))))).otherwise(c))


def luhn(payload: Column) -> Column:
    """The check digit that belongs after these digits."""

    def total(back: Column) -> Column:
        def worth(i: Column) -> Column:
            d = letter(back, i).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
            return F.when(d > 9, d - 9).otherwise(d)

        return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(back)), worth), F.lit(0), lambda s, d: s + d)

    return F.pmod(-let(F.reverse(payload), total), F.lit(10))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of PATTERN.

    Numbers with a right check digit get one with a right check digit, so the map is a permutation of right numbers; those
    with a wrong one stay, as do dates that are no days of the calendar.
    """

    def number(m: Column) -> Column:
        def of(d: Column) -> Column:
            size = F.length(d) - 1
            payload = F.substr(d, F.lit(1), size)
            new = F.lpad(permuted(payload.cast("long"), F.pow(F.lit(10.0), size).cast("long"), key, "number").cast("string"), size, F.lit("0"))
            whole = let(let(new, lambda v: F.concat(v, luhn(v).cast("string"))), lambda v: refilled(m, v))
            return F.when(letter(d, size + 1).cast("int") == luhn(payload), whole).otherwise(m)

        return let(digits(m), of)

    def phone(m: Column) -> Column:
        d = digits(m)
        last = F.substr(d, F.length(d) - 9, F.lit(10))
        new = F.lpad(permuted(last.cast("long"), 10**10, key, "phone").cast("string"), 10, "0")
        return let(F.concat(F.substr(d, F.lit(1), F.length(d) - 10), new), lambda v: refilled(m, v))

    def ip(m: Column) -> Column:
        parts = F.split(m, r"\.")
        v = reduce(lambda v, k: v * 256 + parts[k].cast("long"), range(4), F.lit(0).cast("long"))
        return let(permuted(v, 1 << 32, key, "ip"), lambda new: F.concat_ws(".", *[F.shiftright(new, 24 - 8 * k).bitwiseAND(255).cast("string") for k in range(4)]))

    def social(m: Column) -> Column:
        d = digits(m)
        area = F.substring(d, 1, 3).cast("long")
        area = area - F.when(area > 666, 2).otherwise(1)
        v = (area * 99 + F.substring(d, 4, 2).cast("long") - 1) * 9999 + F.substring(d, 6, 4).cast("long") - 1

        def text(new: Column) -> Column:
            serial, group, area = new % 9999 + 1, F.call_function("div", new, F.lit(9999)) % 99 + 1, F.call_function("div", new, F.lit(9999 * 99)) + 1
            area = F.when(area >= 666, area + 1).otherwise(area)
            return F.concat_ws("-", *[F.lpad(x.cast("string"), k, "0") for x, k in ((area, 3), (group, 2), (serial, 4))])

        return let(permuted(v, 898 * 99 * 9999, key, "social"), text)

    def date(shape: str):
        def f(m: Column) -> Column:
            day = F.try_to_date(m, shape)
            new = F.date_add(F.lit(FIRST_DAY).cast("date"), permuted(F.datediff(day, F.lit(FIRST_DAY).cast("date")), DAYS, key, "date").cast("int"))
            return F.when(day.isNull(), m).otherwise(F.date_format(new, shape))

        return f

    def email(m: Column) -> Column:
        domain = F.substring_index(m, "@", -1)
        top = F.substring_index(domain, ".", -1)
        host = F.substr(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
        return F.concat(permuted_text(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), permuted_text(host, key, "host"), F.lit("."), top)

    def password(m: Column) -> Column:
        front = F.regexp_extract(m, r"^(?i:passw(?:or)?d\s{0,2}[=:]\s{0,2})", 0)
        return F.concat(front, permuted_text(F.substr(m, F.length(front) + 1, F.length(m)), key, "password"))

    by_kind = {
        "email": email,
        "key": lambda m: F.concat(F.lit("AKIA"), permuted_text(F.substr(m, F.lit(5), F.lit(16)), key, "key")),
        "password": password,
        "ip": ip,
        "phone": phone,
        "iso_date": date("yyyy-MM-dd"),
        "us_date": date("MM/dd/yyyy"),
        "de_date": date("dd.MM.yyyy"),
        "social": social,
        "card": number,
        "number": number,
        "secret": lambda m: permuted_text(m, key, "secret", hexadecimal=True),
    }

    def of(k: Column) -> Column:
        out = F
        for name, f in by_kind.items():
            out = out.when(k == name, f(m))
        return out.otherwise(m)

    return let(kind(m), of)


def kind(m: Column) -> Column:
    """The kind of one match, told by its shape alone."""
    return (
        F.when(m.contains("@"), "email")
        .when(m.startswith("AKIA"), "key")
        .when(m.rlike("^(?i:passw)"), "password")
        .when(m.rlike("^[0-9]{1,3}(?:[.][0-9]{1,3}){3}$"), "ip")
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "social")
        .when(m.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "iso_date")
        .when(m.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), "us_date")
        .when(m.rlike("^[0-9]{2}[.][0-9]{2}[.][0-9]{4}$"), "de_date")
        .when(m.rlike("^[0-9]{12,19}$"), "number")
        .when(m.rlike("^[0-9A-Fa-f]{32,64}$"), "secret")
        .when(m.rlike("^[0-9]{4}[ -][0-9]{4,6}[ -][0-9]{4}"), "card")
        .otherwise("phone")
    )


def pieces(text: Column) -> Column:
    """The text cut at the matches: pieces 2, 4, 6, ... are matches. The pattern runs over the text once; a text without any
    sign, or null, is not run over at all and stays one piece."""
    marked = F.split(F.regexp_replace(text, F.lit(PATTERN), F.lit(f"{EDGE}$0{EDGE}")), EDGE, -1)
    rest, found = F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    both = F.flatten(F.zip_with(rest, found, lambda a, b: F.when(b.isNull(), F.array(a)).otherwise(F.array(a, b))))
    return F.when(~text.rlike(SIGN), F.array(text)).when(text.contains(EDGE), both).otherwise(marked)


def replaced(cut: Column, key: str) -> Column:
    """The pieces put together again, every match by its pseudonym."""
    new = F.transform(cut, lambda p, k: F.when(k % 2 == 1, pseudonym(p, key)).otherwise(p))
    return F.when(F.size(cut) > 1, F.array_join(new, "")).otherwise(cut[0])


def pseudonymised(text: Column, key: str) -> Column:
    """text with every validated number, date, address, mailbox and secret replaced; null stays null."""
    return replaced(pieces(text), key)


def key_of(spark: SparkSession) -> str:
    """The key in KEY_SETTING; without it a random one, so that pseudonyms link within this run alone."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with the column text replaced by its pseudonymised form; all other columns and all rows stay.

    Equal values get equal pseudonyms in every document under one key; a repeated row stays as often. Null and empty
    texts stay, very long texts are rewritten whole. No shuffle: each row is rewritten where it is read.
    """
    return docs.withColumn("text", pseudonymised(F.col("text").cast("string"), key))


def kinds_found(cut: Column) -> Column:
    """The kind of each match among pieces, in order of place; empty for null."""
    at = F.transform(cut, lambda p, k: F.when(k % 2 == 1, kind(p)))
    return F.filter(at, lambda k: k.isNotNull())


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, kinds) of every row of documents: the pseudonymised text and the kinds of its matches in order, those
    that didn't validate and stayed included. Null texts stay null without kinds; see pseudonymise()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", pieces(F.col("text").cast("string")).alias("cut"))
    return docs.select("doc_id", replaced(F.col("cut"), key_of(spark)).alias("text"), F.array_join(kinds_found(F.col("cut")), ",").alias("kinds"))

"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

What is found, and what of it a keyed permutation changes: account and card
numbers of 13-19 digits that pass Luhn's check (all digits but the last, which is made
anew), dates (the day, within 1800-2199, the pattern kept), phone numbers (digits after the country
code), social security numbers, IPv4 addresses (the 32 bits), bank account numbers with a
valid IBAN check (the digits; the check is made anew), hexadecimal
tokens of 16 digits or more with both letters and figures, in small or in capital letters, UUIDs, and the letters and
digits of an e-mail address, but for its last label: of the local part and of the domain each by itself, so
addresses of one domain stay together. Numbers that fail Luhn's check, with an impossible octet, and days that no calendar has, aren't such
data and stay. The permutations are Feistel networks whose round function is
SHA-512 of the key, the kind, the round and the other half: a bijection of each format,
so equal values get equal pseudonyms in all documents and different ones differ.
Values of more than BLOCK symbols are permuted in blocks of so many, each with its place as a part of the kind,
which costs time in proportion to the length. Length and punctuation stay, but for the length of an
address' octets. There is no default key: who knows it can undo the pseudonyms.

A phone number ends before a space that another kind follows; with country code 1 it
has ten digits. After other codes, whose numbers differ in length, a short plain number
behind a space can't be told from a last group and is taken as one.

A null text stays null, an empty one empty; texts with neither a digit nor an @ are
not searched. Rows are independent: repeated ones change alike, and other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, BLOCK = 8, 128
#: The setting that queries take their key from, and what they take where it is unset, as in tests: no secret.
KEY_SETTING, DEMONSTRATION_KEY = "spark.tessera.pii.key", "tessera demonstration key"
DIGITS, HEX, ALNUM = "0123456789", "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz"
#: 400 Gregorian years from 1800-01-01 have 146,097 = 189 * 773 days.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)

#: Repeated classes, not repeated groups: Java's expressions descend a call for each turn of a group.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,24}"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
YMD = r"(?<![0-9])[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}(?![0-9])"
DMY = r"(?<![0-9./-])[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ACCOUNT = r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
UUID = "|".join(rf"(?<![0-9A-Za-z-])[0-9{a}]{{8}}(?:-[0-9{a}]{{4}}){{3}}-[0-9{a}]{{12}}(?![0-9A-Za-z-])" for a in ("a-f", "A-F"))
TOKEN = "|".join(rf"(?<![0-9A-Za-z])(?=[0-9]*[{a}])(?=[{a}]*[0-9])[0-9{a}]{{16,}}+(?![0-9A-Za-z])" for a in ("a-f", "A-F"))
#: What a phone number doesn't go on into over a space: the beginning of another kind. Without groups to refer to, as these are counted in PATTERN.
DATE_AHEAD = "|".join(rf"[0-9]{{4}}{m}[0-9]{{2}}{m}[0-9]{{2}}(?![0-9])|[0-9]{{2}}{m}[0-9]{{2}}{m}[0-9]{{4}}(?![0-9])" for m in ("-", "/", r"\."))
US = r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}(?![0-9-])"
AHEAD = "|".join((EMAIL, UUID, TOKEN, DATE_AHEAD, IPV4, SSN, US))
#: An account number whose digits can't be the phone's own next groups, and any.
CARD_AHEAD = r"[0-9]{13,19}(?![0-9A-Za-z])|[0-9]{4}(?:[ -][0-9]{4}){3}(?! ?[0-9A-Za-z])|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?! ?[0-9A-Za-z])"
GROUP, LAST_GROUP = (rf"(?:[.-]?| (?!{AHEAD}|{card}))[0-9]{{2,4}}" for card in (CARD_AHEAD, ACCOUNT))
#: Country code 1 has ten digits after it, whatever follows.
PHONE = (
    r"(?<![0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    rf"|(?<![0-9+])\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}})(?:{GROUP}){{2}}(?:{LAST_GROUP})?(?![0-9])"
    rf"|(?<![0-9])\([0-9]{{3}}\) ?[0-9]{{3}}[-. ][0-9]{{4}}(?![0-9])|(?<![0-9.-]){US}"
)
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[0-9]{1,4})?(?![0-9A-Za-z])"
PATTERN = "|".join((EMAIL, IBAN, UUID, TOKEN, YMD, DMY, IPV4, SSN, PHONE, ACCOUNT))
KINDS = {"uuid": UUID, "token": TOKEN, "date": f"{YMD}|{DMY}", "ip": IPV4, "ssn": SSN, "phone": PHONE, "account": ACCOUNT, "iban": IBAN}


def _stream(key: str, kind: Column, round_: Column, half: Column) -> Column:
    """128 hexadecimal digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), kind, round_.cast("string"), half.cast("string")), 512)


def _once(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _added(half: Column, stream: Column, alphabet: str) -> Column:
    """half plus the stream, symbol by symbol, modulo the alphabet's size."""
    letters = F.lit(alphabet)
    def one(stream: Column) -> Column:
        def letter(i: Column) -> Column:
            step = F.conv(F.substr(stream, 2 * i - 1, F.lit(2)), 16, 10).cast("int")
            return F.substr(letters, (F.instr(letters, F.substr(half, i, F.lit(1))) - 1 + step) % len(alphabet) + 1, F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), letter), "")
    return _once(stream, one)


def permuted(symbols: Column, key: str, kind: str | Column, alphabet: str = DIGITS) -> Column:
    """A keyed permutation of the strings of one length, 1 to BLOCK, over the alphabet."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    def whole(symbols: Column) -> Column:
        cut = F.floor(F.length(symbols) / 2).cast("int")
        start = F.struct(F.substr(symbols, F.lit(1), cut).alias("a"), F.substr(symbols, cut + 1).alias("b"))
        turn = lambda s, i: F.struct(s["b"].alias("a"), _added(s["a"], _stream(key, kind, i, s["b"]), alphabet).alias("b"))
        both = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"]))
        return F.when(F.length(symbols) == 1, _added(symbols, _stream(key, kind, F.lit(0), F.lit("")), alphabet)).when(F.length(symbols) > 1, both).otherwise(symbols)
    return _once(symbols, whole)


def permuted_inside(value: Column, key: str, kind: str, inside: str, alphabet: str) -> Column:
    """value with its characters of the class inside permuted, in blocks of BLOCK of them, the rest as it is."""
    blocks = F.regexp_extract_all(value, F.lit(f"(?:[^{inside}]*+[{inside}]){{1,{BLOCK}}}|[^{inside}]++"), 0)
    def block(v: Column, i: Column) -> Column:
        name = F.when(i == 0, F.lit(kind)).otherwise(F.concat_ws("#", F.lit(kind), i.cast("string")))
        return refilled(v, permuted(only(v, inside), key, name, alphabet), f"[{inside}]")
    return F.array_join(F.transform(blocks, block), "")


def permuted_number(n: Column, key: str, kind: str, sizes: tuple[int, int]) -> Column:
    """A keyed permutation of 0 .. sizes[0] * sizes[1] - 1."""
    p, q = sizes
    draw = lambda i, half: F.conv(F.substr(_stream(key, F.lit(kind), i, half), F.lit(1), F.lit(12)), 16, 10).cast("long")
    start = F.struct(F.floor(n / q).cast("long").alias("a"), (n % q).cast("long").alias("b"))
    odd = lambda s, i: F.struct(((s["a"] + draw(i, s["b"])) % p).alias("a"), s["b"].alias("b"))
    even = lambda s, i: F.struct(s["a"].alias("a"), ((s["b"] + draw(i, s["a"])) % q).alias("b"))
    turn = lambda s, i: F.when(i % 2 == 1, odd(s, i)).otherwise(even(s, i))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["a"] * q + s["b"])


def refilled(value: Column, symbols: Column, pattern: str) -> Column:
    """value with its characters that fit the pattern replaced by the symbols, in order."""
    def whole(symbols: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            fits = c.rlike(pattern)
            return F.struct(F.concat(s["out"], F.when(fits, F.substr(symbols, s["i"], F.lit(1))).otherwise(c)).alias("out"), F.when(fits, s["i"] + 1).otherwise(s["i"]).alias("i"))
        return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), step, lambda s: s["out"])
    return _once(symbols, whole)


def only(value: Column, pattern: str) -> Column:
    return F.regexp_replace(value, f"[^{pattern}]", "")


def luhn_digit(digits: Column) -> Column:
    """The digit that makes digits + it pass Luhn's check."""
    def one(s: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return s + twice
    return (10 - F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), one) % 10) % 10


def _account(v: Column, key: str) -> Column:
    digits = only(v, "0-9")
    head, last = F.substr(digits, F.lit(1), F.length(digits) - 1), F.right(digits, F.lit(1)).cast("int")
    new = _once(permuted(head, key, "account"), lambda h: refilled(v, F.concat(h, luhn_digit(h).cast("string")), "[0-9]"))
    return F.when(last == luhn_digit(head), new).otherwise(v)


def _date(v: Column, key: str) -> Column:
    """Year first, else day first, else month first if only this is a day of the calendar."""
    part = lambda i, n: F.substr(v, F.lit(i), F.lit(n))
    first = v.rlike(r"^[0-9]{4}")
    mark = F.when(first, part(5, 1)).otherwise(part(3, 1))
    days = lambda *ymd: F.datediff(F.try_to_date(F.concat_ws("-", *ymd), "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
    dmy, mdy = days(part(7, 4), part(4, 2), part(1, 2)), days(part(7, 4), part(1, 2), part(4, 2))
    day = F.when(first, days(part(1, 4), part(6, 2), part(9, 2))).otherwise(F.coalesce(dmy, mdy))
    inside = day.isNotNull() & (day >= 0) & (day < DAYS[0] * DAYS[1])
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), permuted_number(day.cast("long"), key, "date", DAYS).cast("int"))
    form = lambda pattern: F.date_format(new, pattern)
    back = F.when(first, form("yyyy_MM_dd")).when(dmy.isNotNull(), form("dd_MM_yyyy")).otherwise(form("MM_dd_yyyy"))
    return F.when(inside, F.replace(back, F.lit("_"), mark)).otherwise(v)


def mod97(symbols: Column) -> Column:
    """The remainder by 97 of a number written with letters for 10-35."""
    def step(s: Column, c: Column) -> Column:
        n = F.instr(F.lit(ALNUM.upper()), c) - 1
        return (s * F.when(n > 9, 100).otherwise(10) + n) % 97
    return F.aggregate(F.split(symbols, ""), F.lit(0), step)


def _iban(v: Column, key: str) -> Column:
    plain = F.replace(v, F.lit(" "))
    country, account = F.left(plain, F.lit(2)), F.substr(plain, F.lit(5))
    valid = mod97(F.concat(account, F.left(plain, F.lit(4)))) == 1
    new = F.array(refilled(account, permuted(only(account, "0-9"), key, "iban"), "[0-9]"))
    whole = F.transform(new, lambda a: F.concat(country, F.lpad((98 - mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))
    return F.when(valid, refilled(v, F.get(whole, F.lit(0)), "[A-Z0-9]")).otherwise(v)


def _ip(v: Column, key: str) -> Column:
    octets = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    new = permuted_number(number, key, "ip", (65536, 65536))
    parts = F.transform(F.array(new), lambda n: F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0))))
    return F.when(F.forall(octets, lambda x: x < 256), F.get(parts, F.lit(0))).otherwise(v)


def _phone(v: Column, key: str) -> Column:
    head = F.regexp_extract(v, r"^\+[0-9]{1,3}(?=[ .(-])|^\+[0-9]", 0)
    rest = F.substr(v, F.length(head) + 1)
    return F.concat(head, refilled(rest, permuted(only(rest, "0-9"), key, "phone"), "[0-9]"))


def _token(v: Column, key: str) -> Column:
    return F.when(v.rlike("[a-f]"), permuted_inside(v, key, "token", "0-9a-f", HEX)).otherwise(permuted_inside(v, key, "token", "0-9A-F", HEX.upper()))


def _email(v: Column, key: str) -> Column:
    local, domain = F.lower(F.substring_index(v, "@", 1)), F.lower(F.substring_index(v, "@", -1))
    last = F.substring_index(domain, ".", -1)
    name = F.left(domain, F.length(domain) - F.length(last) - 1)
    return F.concat(permuted_inside(local, key, "email", "a-z0-9", ALNUM), F.lit("@"), permuted_inside(name, key, "domain", "a-z0-9", ALNUM), F.lit("."), last)


def pseudonym(v: Column, key: str) -> Column:
    """The pseudonym of one value that PATTERN found."""
    whole = {k: v.rlike(f"^(?:{p})$") for k, p in KINDS.items()}
    return (
        F.when(F.instr(v, "@") > 0, _email(v, key)).when(whole["uuid"] | whole["token"], _token(v, key)).when(whole["iban"], _iban(v, key)).when(whole["date"], _date(v, key)).when(whole["ip"], _ip(v, key))
        .when(whole["ssn"], refilled(v, permuted(only(v, "0-9"), key, "ssn"), "[0-9]")).when(whole["phone"], _phone(v, key)).when(whole["account"], _account(v, key)).otherwise(v)
    )


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with pseudonyms in its texts; all other columns pass."""
    text = F.col(text_col)
    found = F.regexp_extract_all(text, F.lit(PATTERN), 0)
    parts = F.zip_with(F.split(text, PATTERN, -1), F.transform(found, lambda v: pseudonym(v, key)), lambda s, p: F.concat(s, F.coalesce(p, F.lit(""))))
    return docs.withColumn(text_col, F.when(text.rlike("[0-9@]"), F.array_join(parts, "")).otherwise(text))


def key_of(spark) -> str:
    return spark.conf.get(KEY_SETTING, DEMONSTRATION_KEY)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymised(docs.withColumn("before", F.col("text")), key_of(spark)).select("doc_id", "text", (~F.col("text").eqNullSafe(F.col("before"))).alias("changed"))

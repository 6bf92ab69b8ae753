"""Format-preserving pseudonyms for personal data, by keyed Feistel networks in SQL expressions.

Each kind of value has its own domain, and a network permutes that domain under the key, so
a value gets the same pseudonym wherever it is written and two values never share one:

* numbers (cards, phones, social security numbers, IPv4 addresses): the domain is cut into two
  residues (a mod M, b mod N); the rounds add keyed digests of one to the other. Card numbers
  permute all digits but the last, which is the Luhn digit of the others; the separators stay.
* dates: the days of the 400 years from 1900-01-01 are 189 x 773, the two residues.
* mail addresses, account numbers (IBAN) and secrets: the characters are the residues; each
  moves within its class (digit, lower case, upper case, or hexadecimal digit).

All of it is a projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DEFAULT_KEY = "sightline"
#: The days of 400 years.
DAYS = (189, 773)

_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
_SECRET = r"\b(?i:password|passwd|pwd|token|secret|api_?key)\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9+/_-]{8,}"
_AWS = r"\bAKIA[0-9A-Z]{16}\b"
_IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
_IP = r"(?<![0-9.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?[0-9])"
_DATE = r"(?<![0-9./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![0-9]|[./-][0-9])"
_SSN = r"(?<![0-9-])\d{3}-\d{2}-\d{4}(?![0-9]|-[0-9])"
_CARD = r"(?<![0-9])\d(?:[ -]?\d){12,18}(?![0-9])"
_PHONE = r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}(?![0-9])|(?<![0-9])\(\d{3}\) ?\d{3}[ .-]\d{4}(?![0-9])|(?<![0-9.-])\d{3}[ .-]\d{3}[.-]\d{4}(?![0-9])"
#: How a card is written inside a longer row of digits: unbroken, or in the groups of a card.
_CARD_SHAPE = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5})$"
#: The country codes of one digit and of two; all others have three.
_CODE_1 = r"^\+[17]"
_CODE_2 = r"^\+(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Earlier kinds win where two could start at one place.
PATTERN = "|".join((_MAIL, _SECRET, _AWS, _IBAN, _IP, _DATE, _SSN, _CARD, _PHONE))
#: A text without any of these can hold no match.
HINT = r"[0-9@=:]"


def _digest(*parts) -> Column:
    """60 keyed bits as a bigint."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.lit(p) if not isinstance(p, Column) else p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("bigint")


def feistel(a: Column, b: Column, m: Column, n: Column, key: str, tweak: Column) -> Column:
    """A permutation of Z_m x Z_n as a struct (a, b)."""
    # A fold holds each half once; nested expressions would double with every round.
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")),
        lambda s, r: F.when(
            r % 2 == 1, F.struct(((s["a"] + _digest(key, tweak, r, s["b"])) % m).cast("bigint").alias("a"), s["b"].alias("b"))
        ).otherwise(F.struct(s["a"].alias("a"), ((s["b"] + _digest(key, tweak, r, s["a"])) % n).cast("bigint").alias("b"))),
    )


def _pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("bigint")


def permute_digits(digits: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of all digit strings of one length (up to 34)."""
    n = F.length(digits)
    u = (n / 2).cast("int")
    s = feistel(F.substr(digits, F.lit(1), u).cast("bigint"), F.substr(digits, u + 1, n - u).cast("bigint"), _pow10(u), _pow10(n - u), key, F.concat(tweak, n))
    return F.transform(F.array(s), lambda x: F.concat(F.lpad(x["a"], u, "0"), F.lpad(x["b"], n - u, "0")))[0]


def permute_chars(text: Column, key: str, tweak: Column, hexadecimal: Column) -> Column:
    """A keyed permutation of all texts whose characters have the same classes."""

    def alphabet(c):
        return (
            F.when(hexadecimal & F.rlike(c, F.lit("[0-9a-f]")), "0123456789abcdef")
            .when(F.rlike(c, F.lit("[0-9]")), "0123456789")
            .when(F.rlike(c, F.lit("[a-z]")), "abcdefghijklmnopqrstuvwxyz")
            .when(F.rlike(c, F.lit("[A-Z]")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
            .otherwise("")
        )

    def still(half):
        # A long half is hashed once for each round, so that the work grows with the length and not its square.
        return F.transform(F.array(F.array_join(half, "")), lambda t: F.when(F.length(t) > 64, F.sha2(t, 256)).otherwise(t))

    def moved(half, other, r):
        return F.transform(
            other,
            lambda o: F.transform(
                half,
                lambda c, i: F.when(alphabet(c) == "", c).otherwise(
                    F.substr(alphabet(c), ((F.instr(alphabet(c), c) - 1 + _digest(key, tweak, r, i, o)) % F.length(alphabet(c))).cast("int") + 1, F.lit(1))
                ),
            ),
        )[0]

    n = F.length(text)
    u = (n / 2).cast("int")
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    # Classes of the half that stands still don't change, so the rounds can be undone.
    out = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct(F.slice(chars, F.lit(1), u).alias("a"), F.slice(chars, u + 1, n - u).alias("b")),
        lambda s, r: F.when(r % 2 == 1, F.struct(moved(s["a"], still(s["b"]), r).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), moved(s["b"], still(s["a"]), r).alias("b"))
        ),
    )
    return F.transform(F.array(out), lambda x: F.array_join(F.concat(x["a"], x["b"]), ""))[0]


def _fill(shape: Column, digits: Column) -> Column:
    """Put ``digits`` in the places of the digits of ``shape``, in order."""
    return F.aggregate(
        F.filter(F.split(shape, ""), lambda c: c != ""),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, c: F.when(F.rlike(c, F.lit("[0-9]")), F.struct(F.concat(s["out"], F.substr(digits, s["at"] + 1, F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))
        ),
    )["out"]


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum, the last digit counting once."""
    return F.aggregate(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        F.struct(F.lit(0).alias("t"), F.lit(0).alias("i")),
        lambda s, c: F.struct(
            (s["t"] + F.when(s["i"] % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).alias("t"),
            (s["i"] + 1).alias("i"),
        ),
    )["t"]


def _mod97(account: Column) -> Column:
    """The IBAN remainder of an account number without spaces."""
    turned = F.concat(F.substr(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    return F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda s, c: F.when(F.rlike(c, F.lit("[0-9]")), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97).cast("int"),
    )


def _date_of(m: Column) -> Column:
    return F.when(F.rlike(m, F.lit(r"^\d{4}-")), F.try_to_timestamp(m, F.lit("yyyy-MM-dd"))).otherwise(
        F.try_to_timestamp(F.translate(m, "/", "."), F.lit("dd.MM.yyyy"))
    ).cast("date")


def kind_of(m: Column) -> Column:
    """The kind of a match that passes its kind's check, else null."""
    d = F.regexp_replace(m, "[^0-9]", "")
    is_like = lambda p: F.rlike(m, F.lit(f"^(?:{p})$"))
    return (
        F.when(F.contains(m, F.lit("@")), F.when(F.rlike(m, F.lit(r"\.[A-Za-z][A-Za-z0-9-]*$")), F.lit("mail")))
        .when(F.rlike(m, F.lit(r"(?i)^(?:password|passwd|pwd|token|secret|api_?key)\s*[=:]")), F.when(F.rlike(m, F.lit("[0-9]")), F.lit("secret")))
        .when(F.rlike(m, F.lit("^AKIA")) & (F.length(m) == 20), F.lit("secret"))
        .when(F.rlike(m, F.lit("^[A-Z]{2}")), F.when(_mod97(F.replace(m, F.lit(" "), F.lit(""))) == 1, F.lit("iban")))
        .when(is_like(_IP), F.when(F.forall(F.split(m, r"\."), lambda o: o.cast("int") < 256), F.lit("ip")))
        .when(is_like(r"\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4}"), F.when(F.year(_date_of(m)).between(1900, 2299), F.lit("date")))
        .when(is_like(r"\d{3}-\d{2}-\d{4}"), F.when(~F.rlike(m, F.lit("^(?:000|666|9)|-00-|-0000$")), F.lit("ssn")))
        .when(F.rlike(m, F.lit(r"^[0-9]")) & F.length(d).between(13, 19), F.when((luhn_sum(d) % 10 == 0) & (d.cast("decimal(20,0)") > 0), F.lit("card")))
        .when(F.length(d).between(8, 15), F.lit("phone"))
    )


def _core(m: Column) -> Column:
    """What of a match is a value, as a struct (pre, core, post).

    A row of digits or an account number that fails its check can hold a valid one: of all
    windows that begin and end at separators, the longest valid card or account, then the first.
    """

    def in_group(i):
        return F.rlike(F.substr(m, i, F.lit(1)), F.lit("[A-Z0-9]"))

    def valid(t):
        d, account = F.regexp_replace(t, "[^0-9]", ""), F.replace(t, F.lit(" "), F.lit(""))
        card = F.rlike(t, F.lit(_CARD_SHAPE)) & F.rlike(d, F.lit("[1-9]")) & (luhn_sum(d) % 10 == 0)
        return card | (F.rlike(t, F.lit(r"^[A-Z]{2}\d{2}")) & F.length(account).between(15, 34) & (_mod97(account) == 1))

    places = F.sequence(F.lit(1), F.length(m))
    starts = F.filter(places, lambda i: in_group(i) & ((i == 1) | ~in_group(i - 1)))
    ends = F.filter(places, lambda i: in_group(i) & ~in_group(i + 1))
    windows = F.flatten(F.transform(starts, lambda s: F.transform(F.filter(ends, lambda e: e > s + 11), lambda e: F.struct((e - s + 1).alias("n"), (-s).alias("s")))))
    best = F.array_max(F.filter(windows, lambda w: valid(F.substr(m, -w["s"], w["n"]))))
    whole = F.struct(F.lit("").alias("pre"), m.alias("core"), F.lit("").alias("post"))
    part = F.transform(
        F.array(best),
        lambda w: F.when(
            w.isNotNull(),
            F.struct(F.substr(m, F.lit(1), -w["s"] - 1).alias("pre"), F.substr(m, -w["s"], w["n"]).alias("core"), F.substr(m, w["n"] - w["s"], F.length(m)).alias("post")),
        ).otherwise(whole),
    )[0]
    return F.when(F.rlike(m, F.lit(f"^(?:{_IBAN}|{_CARD})$")) & kind_of(m).isNull(), part).otherwise(whole)


def _pseudonym(kind: Column, m: Column, key: str) -> Column:
    d = F.regexp_replace(m, "[^0-9]", "")
    # Card: all but the check digit.
    body = F.transform(F.array(permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, F.lit("card"))), lambda x: x)
    card = F.transform(body, lambda x: _fill(m, F.concat(x, ((F.lit(10) - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string"))))[0]
    # Phone: the country's digits stay; a number without them is one of +1.
    code = F.when(F.rlike(m, F.lit(_CODE_1)), 1).when(F.rlike(m, F.lit(_CODE_2)), 2).when(F.startswith(m, F.lit("+")), 3).otherwise(0)
    country = F.when(code == 0, "1").otherwise(F.substr(d, F.lit(1), code))
    phone = _fill(m, F.concat(F.substr(d, F.lit(1), code), permute_digits(F.substr(d, code + 1, F.length(d)), key, F.concat(F.lit("phone"), country))))
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("int"))
    address = F.transform(
        F.array(feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))),
        lambda s: F.concat_ws(".", (s["a"] / 256).cast("int"), s["a"] % 256, (s["b"] / 256).cast("int"), s["b"] % 256),
    )[0]
    # Social security number: areas 001-665 and 667-899, groups 01-99, serials 0001-9999.
    area, group, serial = F.substring(d, 1, 3).cast("int"), F.substring(d, 4, 2).cast("int"), F.substring(d, 6, 4).cast("int")
    number = F.transform(
        F.array(feistel(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))),
        lambda s: F.format_string(
            "%03d-%02d-%04d", F.when(s["a"] >= 665, s["a"] + 2).otherwise(s["a"] + 1).cast("int"), ((s["b"] / 9999).cast("int") + 1), (s["b"] % 9999 + 1).cast("int")
        ),
    )[0]
    day = F.datediff(_date_of(m), F.lit("1900-01-01").cast("date"))
    style = F.when(F.rlike(m, F.lit(r"^\d{4}-")), "yyyy-MM-dd").when(F.contains(m, F.lit("/")), "dd/MM/yyyy").otherwise("dd.MM.yyyy")
    date = F.transform(
        F.array(feistel((day / DAYS[1]).cast("int"), day % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, F.lit("date"))),
        lambda s: F.date_add(F.lit("1900-01-01").cast("date"), (s["a"] * DAYS[1] + s["b"]).cast("int")),
    )
    date = F.transform(date, lambda x: F.when(style == "yyyy-MM-dd", F.date_format(x, "yyyy-MM-dd")).when(style == "dd/MM/yyyy", F.date_format(x, "dd/MM/yyyy")).otherwise(F.date_format(x, "dd.MM.yyyy")))[0]
    local, domain = F.regexp_extract(m, "^([^@]*)@", 1), F.regexp_extract(m, "@(.*)$", 1)
    mail = F.concat(permute_chars(F.lower(local), key, F.concat(F.lit("mail"), F.lower(domain)), F.lit(False)), F.lit("@"), domain)
    # Secret: what stands before the value stays. Account: the country stays, the check digits are made anew.
    head = F.when(F.startswith(m, F.lit("AKIA")), F.lit("AKIA")).otherwise(F.regexp_extract(m, r"^([A-Za-z_]+\s*[=:]\s*[\"']?)", 1))
    value = F.substr(m, F.length(head) + 1, F.length(m))
    secret = F.concat(head, permute_chars(value, key, F.lit("secret"), F.rlike(value, F.lit("^[0-9a-f]+$"))))
    account = F.replace(m, F.lit(" "), F.lit(""))
    moved = F.transform(F.array(permute_chars(F.substr(account, F.lit(5), F.length(account)), key, F.concat(F.lit("iban"), F.substring(account, 1, 2)), F.lit(False))), lambda x: x)
    iban = F.transform(moved, lambda x: F.concat(F.substring(account, 1, 2), F.lpad((98 - _mod97(F.concat(F.substring(account, 1, 2), F.lit("00"), x))).cast("string"), 2, "0"), x))[0]
    return (
        F.when(kind == "card", card)
        .when(kind == "phone", phone)
        .when(kind == "ip", address)
        .when(kind == "ssn", number)
        .when(kind == "date", date)
        .when(kind == "mail", mail)
        .when(kind == "secret", secret)
        .when(kind == "iban", iban)
    )


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = DEFAULT_KEY) -> DataFrame:
    """``docs`` with the personal data in the text replaced, plus ``n_private`` and ``private_kinds``.

    A null text stays null with n_private 0; a text without valid values comes back unchanged.
    Values that fail their kind's check (Luhn, IBAN remainder, octets, calendar) stay as they
    are, but for a valid card or account number inside a longer row of groups. Spaces inside an account number are dropped; letters of a mail address come out in lower
    case. All other columns pass through; none may be named n_private or private_kinds (these are
    replaced). Rows are independent: repeated rows give repeated results.
    """
    docs = docs.drop("n_private", "private_kinds")
    may = F.rlike(F.col(text_col), F.lit(HINT))
    raw = F.when(may, F.regexp_extract_all(text_col, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = docs.withColumn("__raw", raw)
    found = found.withColumn("__parts", F.transform("__raw", _core))
    found = found.withColumn("__kinds", F.transform("__parts", lambda p: kind_of(p["core"])))
    found = found.withColumn("__new", F.zip_with("__parts", "__kinds", lambda p, k: F.concat(p["pre"], F.coalesce(_pseudonym(k, p["core"], key), p["core"]), p["post"])))
    # The pieces between the matches, and the matches, by turns.
    gaps = F.split(F.col(text_col), PATTERN, -1)
    joined = F.array_join(F.flatten(F.zip_with(gaps, F.concat("__new", F.array(F.lit(""))), lambda g, x: F.array(g, x))), "")
    kinds = F.filter("__kinds", lambda k: k.isNotNull())
    return found.select(
        *(F.when(F.size(kinds) > 0, joined).otherwise(F.col(text_col)).alias(c) if c == text_col else F.col(c) for c in docs.columns),
        F.coalesce(F.size(kinds), F.lit(0)).cast("bigint").alias("n_private"),
        F.array_sort(F.array_distinct(kinds)).alias("private_kinds"),
    )

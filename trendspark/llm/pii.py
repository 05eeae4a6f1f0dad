"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Method: Feistel networks keyed by ``key``. Found values are validated first
(card: Luhn; IBAN: remainder 97; social security number: its ranges; address
of four octets; calendar date; phone and mail by form) and then permuted
within their format (where a match as long as possible fails its check, the
values inside it are tried: IBANs by the length of their country, cards of 13 to
19 digits at every group), so a pseudonym is again a valid value of the same form,
equal values get equal pseudonyms in all documents, and different values
different ones. Two networks are used:

* numbers with a range (dates, octets, social security numbers): a value is a
  pair (l, r) of Z_a x Z_b; rounds add a keyed hash of one half to the other.
* strings (cards, IBANs, phones, mail): characters are shifted within their
  class (digit, small or capital letter; the first phone digit after a country
  code stays in 0-1 or 2-9) by a keyed hash of the other half of the string.
  Cards, IBANs and phones are permuted as bare digits and letters and then laid
  out like the value found, so all layouts of a value are linked. Check digits
  are computed again.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_DAY, DAYS = "1800-01-01", (189, 773)   # 189 * 773 days = 400 years
# fixed values: forms of values, tried in this order at each place
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ISO_DATE = r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DAY_DATE = r"(?<![0-9A-Za-z./-])[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4}(?![0-9]|[./][0-9])"
OCTETS = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
SOCIAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
PHONE = (r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])"
         r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])"
         r"|(?<![0-9A-Za-z.+-])[0-9]{3}([ .-])[0-9]{3}\2[0-9]{4}(?![0-9A-Za-z-])")
CARD = r"(?<![0-9A-Za-z-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z-])"
# fixed values: IBAN lengths by country
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban_of_length(n: int, countries: str) -> str:
    rest = f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else ""
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}{rest}"


KNOWN_IBAN = (r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(_iban_of_length(n, c) for n, c in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])")
# a value of another form, which no run of groups takes in
OTHER = (r"[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}@|[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}(?![0-9])"
         r"|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z])|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
         r"|[0-9]{3}(?: [0-9]{3} |\.[0-9]{3}\.|-[0-9]{3}-)[0-9]{4}(?![0-9A-Za-z-])")
DIGITS = r"[0-9]++(?:-[0-9]++)*+(?![0-9A-Za-z-])"
MORE_DIGITS = f"(?: (?!{OTHER}){DIGITS})*+"
CARDS = f"(?<![0-9A-Za-z-])(?=[0-9](?:[ -]?[0-9]){{12}}){DIGITS}{MORE_DIGITS}"
ANY_IBAN = (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}" f"(?:(?: (?!{OTHER}|{KNOWN_IBAN}))?[A-Z0-9]{{4}}){{2,7}}(?: (?!{OTHER})[A-Z0-9]{{1,3}}|[A-Z0-9]{{1,3}})?"
            r"(?![A-Za-z0-9])")
IBANS = f"(?:{KNOWN_IBAN}|{ANY_IBAN}){MORE_DIGITS}"
FORMS = "|".join(f"(?:{x})" for x in (MAIL, IBANS, ISO_DATE, DAY_DATE, OCTETS, SOCIAL, PHONE, CARDS))


def is_form(x: Column, form: str) -> Column:
    return F.regexp_like(x, F.lit(f"^(?:{form.replace(chr(92) + '2', chr(92) + '1')})$"))


def keyed(key: str, kind: str, turn: Column, half: Column) -> Column:
    """512 bits in hex of the key, the kind, the round and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string")), 512)


def feistel_pair(key: str, kind: str, left: Column, right: Column, a: int, b: int) -> Column:
    """The permuted pair as a struct (l, r)."""
    def turn(s: Column, i: Column) -> Column:
        def more(half: Column) -> Column:
            return F.conv(F.substring(keyed(key, kind, i, half), 1, 12), 16, 10).cast("long")
        odd = i % 2 == 1
        return F.struct(F.when(odd, s["l"]).otherwise(F.pmod(s["l"] + more(s["r"]), F.lit(a))).cast("long").alias("l"),
                        F.when(odd, F.pmod(s["r"] + more(s["l"]), F.lit(b))).otherwise(s["r"]).cast("long").alias("r"))
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def feistel_text(key: str, kind: str, chars: Column, base: Column, radix: Column) -> Column:
    """Characters (an array) shifted within [base, base + radix) of their code
    points; radix 1 keeps a character."""
    size = F.size(chars)
    codes = F.zip_with(chars, base, lambda c, b: F.ascii(c) - b)
    kept = F.zip_with(chars, radix, lambda c, r: F.when(r == 1, c).otherwise(F.lit("")))

    def turn(v: Column, i: Column) -> Column:
        half = F.floor(size / 2).cast("int")
        low = i % 2 == 0  # which half is shifted
        other = F.array_join(F.when(low, F.slice(v, half + 1, size)).otherwise(F.slice(v, F.lit(1), half)).cast("array<string>"), ",")
        hashed = F.array(keyed(key, kind, i, F.concat_ws("|", other, F.array_join(kept, ""))))

        def one(x: Column, k: Column) -> Column:
            add = F.conv(F.substr(hashed[0], (k % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            return F.when((k < half) == low, F.pmod(x + add, radix[k])).otherwise(x).cast("int")
        return F.transform(v, one)
    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), codes.cast("array<int>"), turn)
    moved = F.zip_with(out, base, lambda x, b: F.chr(x + b))
    return F.zip_with(F.zip_with(moved, kept, lambda m, k: F.struct(m.alias("m"), k.alias("k"))), radix,
                      lambda p, r: F.when(r == 1, p["k"]).otherwise(p["m"]))


def _class_base(c: Column) -> Column:
    return F.when(F.regexp_like(c, F.lit("[0-9]")), 48).when(F.regexp_like(c, F.lit("[a-z]")), 97).when(F.regexp_like(c, F.lit("[A-Z]")), 65).otherwise(0)


def _class_radix(c: Column) -> Column:
    return F.when(F.regexp_like(c, F.lit("[0-9]")), 10).when(F.regexp_like(c, F.lit("[A-Za-z]")), 26).otherwise(1)


def _chars(x: Column) -> Column:
    return F.split(x, "")  # the empty last string is dropped by Spark's split


def _luhn(digits: Column) -> Column:
    """Luhn sum of an array of digit strings, the last one the check digit."""
    back = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(back, F.lit(0), lambda s, d: s + d)


def _only(x: Column, keep: str) -> Column:
    return F.regexp_replace(x, f"[^{keep}]", "")


def mail(key: str, x: Column) -> Column:
    """All but the last label (the top-level domain) is permuted."""
    cut = F.length(x) - F.length(F.substring_index(x, ".", -1))
    c = _chars(x)
    base = F.transform(c, _class_base)
    radix = F.transform(c, lambda ch, i: F.when(i < cut, _class_radix(ch)).otherwise(1))
    return F.array_join(feistel_text(key, "mail", c, base, radix), "")


def laid_out(x: Column, bare: Column) -> Column:
    """Letters and digits (an array) at the places of those of ``x``; what
    separates them in ``x`` stays."""
    def place(c: Column, i: Column) -> Column:
        before = F.length(_only(F.substr(x, F.lit(1), i + 1), "0-9A-Za-z"))
        return F.when(F.regexp_like(c, F.lit("[0-9A-Za-z]")), F.get(bare, before - 1)).otherwise(c)
    return F.array_join(F.transform(_chars(x), place), "")


def card(key: str, x: Column) -> Column:
    """The digits alone are permuted, whatever separates them."""
    c = _chars(_only(x, "0-9"))
    last = F.size(c) - 1
    radix = F.transform(c, lambda ch, i: F.when(i == last, 1).otherwise(10))
    moved = feistel_text(key, "card", F.transform(c, lambda ch, i: F.when(i == last, F.lit("0")).otherwise(ch)), F.transform(c, lambda ch: F.lit(48)), radix)
    check = F.transform(F.array(moved), lambda m: F.concat(F.slice(m, F.lit(1), last), F.array(F.pmod(-_luhn(m), F.lit(10)).cast("string"))))[0]
    return F.when(_luhn(c) % 10 == 0, laid_out(x, check)).otherwise(x)


def _mod97(x: Column) -> Column:
    """Remainder of an IBAN without blanks, country and check digits moved to the end."""
    turned = F.concat(F.substr(x, F.lit(5), F.length(x)), F.substr(x, F.lit(1), F.lit(4)))
    return F.aggregate(_chars(turned), F.lit(0), lambda s, c: F.when(
        F.regexp_like(c, F.lit("[0-9]")), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97).cast("int"))


def iban(key: str, x: Column) -> Column:
    """The value without its blanks is permuted; country and classes stay."""
    plain = F.replace(x, F.lit(" "), F.lit(""))
    c = _chars(plain)
    base = F.transform(c, _class_base)
    radix = F.transform(c, lambda ch, i: F.when(i < 4, 1).otherwise(_class_radix(ch)))
    zeroed = F.transform(c, lambda ch, i: F.when((i == 2) | (i == 3), F.lit("0")).otherwise(ch))
    moved = feistel_text(key, "iban", zeroed, base, radix)
    check = F.transform(F.array(moved), lambda m: F.concat(
        F.slice(m, 1, 2), _chars(F.lpad((98 - _mod97(F.array_join(m, ""))).cast("string"), 2, "0")), F.slice(m, F.lit(5), F.size(m))))[0]
    return F.when(_mod97(plain) == 1, laid_out(x, check)).otherwise(x)


def phone(key: str, x: Column) -> Column:
    """The digits alone are permuted, whatever separates or groups them; a
    country code stays, and the first digit after it stays within 0-1 or 2-9."""
    c = _chars(_only(x, "0-9"))
    country = F.when(F.startswith(x, F.lit("+")), F.length(F.regexp_extract(x, r"^\+(?:1|7|[2-9][0-9])", 0)) - 1).otherwise(0)
    country = F.greatest(country, F.lit(0))
    kind = F.transform(c, lambda ch, i: F.when(i < country, 0).when(i > country, 1).when(ch < "2", 2).otherwise(3))
    base = F.transform(kind, lambda k: F.when(k == 3, 50).when(k == 0, 0).otherwise(48))
    radix = F.transform(kind, lambda k: F.when(k == 1, 10).when(k == 2, 2).when(k == 3, 8).otherwise(1))
    return laid_out(x, feistel_text(key, "phone", c, base, radix))


def octets(key: str, x: Column) -> Column:
    p = F.transform(F.split(x, r"\."), lambda o: o.cast("int"))
    moved = F.transform(F.array(feistel_pair(key, "octets", p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536)), lambda s: F.concat_ws(
        ".", F.floor(s["l"] / 256).cast("string"), (s["l"] % 256).cast("string"), F.floor(s["r"] / 256).cast("string"), (s["r"] % 256).cast("string")))[0]
    return F.when(F.forall(p, lambda o: o < 256), moved).otherwise(x)


def social(key: str, x: Column) -> Column:
    """Areas 001-665 and 667-899, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.split_part(x, F.lit("-"), F.lit(i)).cast("int") for i in (1, 2, 3))
    index = F.when(area > 666, area - 2).otherwise(area - 1)

    def show(s: Column) -> Column:
        a = F.floor(s["l"] / 99)
        return F.concat_ws("-", F.lpad((F.when(a > 664, a + 2).otherwise(a + 1)).cast("string"), 3, "0"),
                           F.lpad((s["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["r"] + 1).cast("string"), 4, "0"))
    moved = F.transform(F.array(feistel_pair(key, "social", index * 99 + group - 1, serial - 1, 898 * 99, 9999)), show)[0]
    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), moved).otherwise(x)


def _moved_day(key: str, day: Column) -> Column:
    """The pseudonym of a date: 1800-2199 is permuted in itself, and so are the
    other days of the years 0-9999 (24 times 400 years)."""
    first, zero = F.to_date(F.lit(FIRST_DAY)), F.to_date(F.lit("0000-01-01"))
    n = F.datediff(day, first)
    a, b = DAYS
    before = F.datediff(first, zero)
    near = F.transform(F.array(feistel_pair(key, "date", F.floor(n / b), F.pmod(n, F.lit(b)), a, b)),
                       lambda s: F.date_add(first, (s["l"] * b + s["r"]).cast("int")))[0]
    m = F.datediff(day, zero) - F.when(n < 0, 0).otherwise(a * b)
    far = F.transform(F.array(feistel_pair(key, "far date", F.floor(m / b), F.pmod(m, F.lit(b)), 24 * a, b)), lambda s: F.transform(
        F.array((s["l"] * b + s["r"]).cast("int")), lambda d: F.date_add(zero, d + F.when(d < before, 0).otherwise(a * b)))[0])[0]
    return F.when((n >= 0) & (n < a * b), near).otherwise(far)


def iso_date(key: str, x: Column) -> Column:
    return F.coalesce(F.date_format(_moved_day(key, F.try_to_date(x, "yyyy-MM-dd")), "yyyy-MM-dd"), x)


def day_date(key: str, x: Column) -> Column:
    """Day, month and year, or month, day and year where only that is a date;
    one-digit fields are allowed and stay without a zero where one was."""
    sep = F.substr(F.regexp_replace(x, "[0-9]", ""), F.lit(1), F.lit(1))
    part = [F.get(F.split(x, "[./]"), F.lit(i)) for i in range(3)]
    pad = lambda p: F.lpad(p.cast("string"), 2, "0")
    iso = [F.concat_ws("-", part[2], pad(part[i]), pad(part[1 - i])) for i in (1, 0)]  # day first, month first
    day = [F.try_to_date(s, "yyyy-MM-dd") for s in iso]
    day_first = day[0].isNotNull()
    wide = F.length(part[0]) + F.length(part[1]) == 4
    moved = _moved_day(key, F.coalesce(*day))
    text = F.transform(F.array(moved), lambda d: F.concat(
        F.when(day_first, F.date_format(d, "dd")).otherwise(F.date_format(d, "MM")), sep,
        F.when(day_first, F.date_format(d, "MM")).otherwise(F.date_format(d, "dd")), sep, F.date_format(d, "yyyy")))[0]
    return F.coalesce(F.when(wide, text).otherwise(F.regexp_replace(text, r"(^|[./])0", "$1")), x)


def pseudonym(key: str, x: Column) -> Column:
    """The pseudonym of a found value; the value itself where it is not valid."""
    return (F.when(is_form(x, MAIL), mail(key, x))
            .when(is_form(x, IBAN), iban(key, x))
            .when(is_form(x, ISO_DATE), iso_date(key, x))
            .when(is_form(x, DAY_DATE), day_date(key, x))
            .when(is_form(x, OCTETS), octets(key, x))
            .when(is_form(x, SOCIAL), social(key, x))
            .when(is_form(x, CARD) & ~is_form(x, PHONE), card(key, x))
            .when(is_form(x, PHONE), phone(key, x))
            .otherwise(x))


def inner_pseudonyms(key: str, x: Column) -> Column:
    """A struct (t, n) of a match that is no value itself: its text with the
    values inside it replaced, and their number. IBANs come first, then cards, long
    ones first; a value that overlaps one already replaced is no longer there. All
    groups of such a card but the last have three digits at least."""
    ibans = F.filter(F.regexp_extract_all(x, F.lit(f"(?=({KNOWN_IBAN}))"), F.lit(1)), lambda c: _mod97(F.replace(c, F.lit(" "), F.lit(""))) == 1)
    cards = F.flatten(F.array(*[F.regexp_extract_all(x, F.lit(f"(?=((?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9A-Za-z])))"), F.lit(1))
                                for n in range(19, 12, -1)]))
    cards = F.filter(cards, lambda c: ~F.regexp_like(c, F.lit("(?:^|[ -])[0-9]{1,2}[ -]")) & (_luhn(_chars(_only(c, "0-9"))) % 10 == 0))

    def put(s: Column, c: Column) -> Column:
        new = F.when(F.regexp_like(c, F.lit("^[A-Z]")), iban(key, c)).otherwise(card(key, c))
        place = F.concat(F.lit("(?<![0-9A-Za-z])"), c, F.lit("(?![0-9A-Za-z])"))
        return F.transform(F.array(F.regexp_replace(s["t"], place, new)),
                           lambda t: F.struct(t.alias("t"), (s["n"] + (t != s["t"]).cast("long")).alias("n")))[0]
    return F.aggregate(F.concat(ibans, cards), F.struct(x.alias("t"), F.lit(0).cast("long").alias("n")), put)


def replaced(key: str, x: Column) -> Column:
    """A struct (t, n): a match with its values replaced and their number."""
    def of(whole: Column) -> Column:
        may_hold = F.regexp_like(x, F.lit("^[A-Z]{2}[0-9]{2}|^[0-9](?:[ -]?[0-9]){12}"))
        return F.when(whole != x, F.struct(whole.alias("t"), F.lit(1).cast("long").alias("n"))).when(
            may_hold, inner_pseudonyms(key, x)).otherwise(F.struct(x.alias("t"), F.lit(0).cast("long").alias("n")))
    return F.transform(F.array(pseudonym(key, x)), of)[0]


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with its text replaced and a column ``n_pseudonyms``: how many
    values were changed.

    A null text stays null and an empty one empty (0 values). Texts of any
    length are scanned whole; texts without a digit and without an at sign
    are passed on as they are. Other columns, repeated rows and null ids are
    kept; a column ``n_pseudonyms`` of the input is replaced. An empty table
    gives no rows.
    """
    text = F.col(f"`{text_col}`")
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(FORMS), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = docs.withColumn("__found", found).withColumn("__moved", F.transform("__found", lambda x: replaced(key, x)))
    pieces = F.zip_with(F.split(text, FORMS, -1), F.concat(F.transform("__moved", lambda m: m["t"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    changed = F.aggregate("__moved", F.lit(0).cast("long"), lambda n, m: n + m["n"])
    rows = rows.withColumn("n_pseudonyms", F.coalesce(changed, F.lit(0).cast("long")))
    rows = rows.withColumn(text_col, F.when(F.size("__found") > 0, F.array_join(pieces, "")).otherwise(text))
    return rows.drop("__found", "__moved")

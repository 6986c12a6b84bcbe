"""Format-preserving pseudonyms for personal numbers and dates, in SQL expressions only.

Each validated value is a number below a bound that its format sets. A keyed Feistel network permutes the numbers below
that bound, so a pseudonym is valid in the same format, equal values get equal pseudonyms in every document, different
ones different pseudonyms, and the key's owner can restore them. Mail names and secrets, which are neither numbers nor
dates, get keyed aliases of their own shape instead; these aren't restored.

Valid means: a card's Luhn sum, an account number's check digits, a calendar day of 1800 to 2199, an area, group and serial
that social security numbers have, four numbers below 256. A ten-digit phone number's area and exchange start with 2 to 9;
one that +1 or brackets mark as a phone number is changed even where they don't, and then among such numbers. Left as they
are: bare runs of ten digits, and four numbers that are told to be a version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

#: What is looked for, in the order in which overlapping finds are decided. No pattern can look back over a long text:
#: each starts at a fixed kind of character and is anchored against what stands before.
PATTERNS = {
    "mail": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "aws": r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z])(?i:password|passwd|token|secret|api_?key)(?: ?[=:] ?\"?(?=[A-Za-z_+/-]*[0-9])|=| ?[=:] ?\")[A-Za-z0-9_+/-]{8,}+",
    "token": r"(?<![A-Za-z0-9_])(?:[spr]k_(?:live|test)_[A-Za-z0-9]{16,}+|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "abroad": r"(?<![\p{L}\p{N}+])\+[1-9](?:[ .-]?[0-9]){8,14}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![\p{L}0-9])(?<![0-9][.,-])(?:[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5}|[0-9]{13,19})(?![0-9])",
    "ip": r"(?<![\p{L}0-9])(?<![0-9][.])(?<!(?i:version|release|build|ver\.?) )(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "iso": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "us": r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])",
    "eu": r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9.])",
}
ANY = "|".join(PATTERNS.values())
#: No find is without one of these; most texts have none and aren't searched further.
HINT = '[0-9@=]|: ?"|A[KS]IA|_(live|test)_|gh[pousr]_|xox[abprs]-'
_DATES = {"iso": "yyyy-MM-dd", "us": "MM/dd/yyyy", "eu": "dd.MM.yyyy"}


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(kind: str, a: str, bound_a: str, b: str, bound_b: str, key: str, back: bool) -> str:
    """Struct (a, b): a below bound_a and b below bound_b, permuted among all such pairs.

    Odd rounds add a keyed hash of b to a, even rounds one of a to b, so any two bounds will do.
    """
    sign = "-" if back else "+"
    order = f"sequence({ROUNDS}, 1, -1)" if back else f"sequence(1, {ROUNDS})"
    tell = f"cast(conv(substr(sha2(concat({_quote(key)}, '|{kind}|', s.m, '|', i, '|', {{}}), 256), 1, 15), 16, 10) as bigint)"
    odd = f"named_struct('a', pmod(s.a {sign} {tell.format('s.b')} % s.m, s.m), 'b', s.b, 'm', s.m, 'n', s.n)"
    even = f"named_struct('a', s.a, 'b', pmod(s.b {sign} {tell.format('s.a')} % s.n, s.n), 'm', s.m, 'n', s.n)"
    start = f"named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint), 'm', cast({bound_a} as bigint), 'n', cast({bound_b} as bigint))"
    return f"aggregate({order}, {start}, (s, i) -> if(i % 2 = 1, {odd}, {even}))"


def _pad(x: str, n: str) -> str:
    return f"lpad(cast({x} as string), {n}, '0')"


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _fill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced, in order, by those of ``digits``."""
    return f"array_join(transform(sequence(1, length({shape})), p -> if(substr({shape}, p, 1) between '0' and '9', substr({digits}, length(regexp_replace(substr({shape}, 1, p), '[^0-9]', '')), 1), substr({shape}, p, 1))), '')"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(x: str, check: bool) -> str:
    """Luhn sum modulo 10 of a string of digits; with ``check`` its last digit is the check digit, else none is there."""
    odd = 1 if check else 0
    return f"(aggregate(transform(split(reverse({x}), ''), (c, i) -> if(i % 2 = {odd}, cast(c as int) * 2 - if(cast(c as int) > 4, 9, 0), cast(c as int))), 0, (t, v) -> t + v) % 10)"


def _card(key: str, back: bool) -> str:
    half = "cast((length(d) - 2) div 2 as int)"
    left, right = f"substr(d, 2, {half})", f"substr(d, 2 + {half}, length(d) - 2 - {half})"
    mixed = _feistel("card", f"cast({left} as bigint)", f"cast(pow(10, {half}) as bigint)", f"cast({right} as bigint)", f"cast(pow(10, length(d) - 2 - {half}) as bigint)", key, back)
    body = _let(mixed, "f", f"concat(substr(d, 1, 1), {_pad('f.a', half)}, {_pad('f.b', f'length(d) - 2 - {half}')})")
    whole = _let(body, "y", f"concat(y, pmod(10 - {_luhn('y', False)}, 10))")
    return _let(_digits("x"), "d", f"if({_luhn('d', True)} = 0, {_let(whole, 'z', _fill('x', 'z'))}, x)")


def _phone(key: str, back: bool) -> str:
    """Area and exchange keep the side of 200 that they are on, so valid numbers stay valid; unmarked ones must be valid."""
    lead = "length(d) - 10"
    area, exchange, line = (f"cast(substr(d, {lead} + {at}, {n}) as bigint)" for at, n in ((1, 3), (4, 3), (7, 4)))
    low, bound = "if({0} < 200, 0, 200)", "if({0} < 200, 200, 800)"
    mixed = _feistel("phone", f"{area} - {low.format(area)}", bound.format(area), f"({exchange} - {low.format(exchange)}) * 10000 + {line}", f"{bound.format(exchange)} * 10000", key, back)
    whole = _let(mixed, "f", f"concat(substr(d, 1, {lead}), {_pad(f'f.a + {low.format(area)}', '3')}, {_pad(f'f.b div 10000 + {low.format(exchange)}', '3')}, {_pad('f.b % 10000', '4')})")
    known = f"x rlike '^[+(]' or {area} >= 200 and {exchange} >= 200"
    return _let(_digits("x"), "d", f"if({known}, {_let(whole, 'z', _fill('x', 'z'))}, x)")


def _halves(kind: str, rest: str, key: str, back: bool) -> str:
    """A string of 2 to 30 digits, permuted among those of its length."""
    half = f"cast(length({rest}) div 2 as int)"
    left, right = f"cast(substr({rest}, 1, {half}) as bigint)", f"cast(substr({rest}, 1 + {half}) as bigint)"
    mixed = _feistel(kind, left, f"cast(pow(10, {half}) as bigint)", right, f"cast(pow(10, length({rest}) - {half}) as bigint)", key, back)
    return _let(mixed, "f", f"concat({_pad('f.a', half)}, {_pad('f.b', f'length({rest}) - {half}')})")


def _abroad(key: str, back: bool) -> str:
    """The country's code stays: up to three digits before the first separator, else one (1 and 7) or two."""
    apart = "regexp_extract(x, '^[+]([0-9]{1,3})[ .-]', 1)"
    lead = f"if({apart} <> '', {apart}, substr(d, 1, if(substr(d, 1, 1) in ('1', '7'), 1, 2)))"
    whole = _let(lead, "c", _let("substr(d, length(c) + 1)", "r", f"concat(c, {_halves('abroad', 'r', key, back)})"))
    return _let(_digits("x"), "d", _let(whole, "z", _fill("x", "z")))


def _mod97(x: str) -> str:
    """Remainder by 97 of a string of digits and letters, letters as 10 to 35."""
    return f"aggregate(split({x}, ''), 0, (t, c) -> if(c between '0' and '9', t * 10 + ascii(c) - 48, t * 100 + ascii(c) - 55) % 97)"


def _iban(key: str, back: bool) -> str:
    """Country and letters stay; the other digits are permuted, and the check digits, 02 to 98, follow from them."""
    valid = f"length(v) between 15 and 34 and length(r) > 1 and substr(v, 3, 2) between '02' and '98' and {_mod97('concat(substr(v, 5), substr(v, 1, 4))')} = 1"
    moved = "concat(substr(w, 5), substr(w, 1, 2), '00')"
    check = _pad(f"98 - {_mod97(moved)}", "2")
    whole = _let(_halves("iban", "r", key, back), "y", _let(_fill("v", "concat('00', y)"), "w", _let(f"concat({check}, y)", "z", _fill("x", "z"))))
    return _let("replace(x, ' ', '')", "v", _let("substr(regexp_replace(v, '[^0-9]', ''), 3)", "r", f"if({valid}, {whole}, x)"))


def _ssn(key: str, back: bool) -> str:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999; others aren't valid and stay."""
    area, group, serial = (f"cast(substr(x, {at}, {n}) as int)" for at, n in ((1, 3), (5, 2), (8, 4)))
    mixed = _feistel("ssn", f"{area} - if({area} > 666, 2, 1)", "898", f"({group} - 1) * 9999 + {serial} - 1", "989901", key, back)
    shown = f"concat({_pad('f.a + if(f.a >= 665, 2, 1)', '3')}, '-', {_pad('f.b div 9999 + 1', '2')}, '-', {_pad('f.b % 9999 + 1', '4')})"
    return f"if({area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0, {_let(mixed, 'f', shown)}, x)"


def _ip(key: str, back: bool) -> str:
    mixed = _feistel("ip", "o[0] * 256 + o[1]", "65536", "o[2] * 256 + o[3]", "65536", key, back)
    shown = _let(mixed, "f", "concat_ws('.', f.a div 256, f.a % 256, f.b div 256, f.b % 256)")
    return _let("transform(split(x, '[.]'), v -> cast(v as int))", "o", f"if(array_max(o) < 256 and x = array_join(transform(o, v -> cast(v as string)), '.'), {shown}, x)")


def _date(kind: str, key: str, back: bool) -> str:
    """Days of 1800 to 2199: 400 years, 146097 days, 27 times 5411. One day has one pseudonym in all formats."""
    day = "datediff(t, date'1800-01-01')"
    mixed = _feistel("date", f"{day} div 5411", "27", f"{day} % 5411", "5411", key, back)
    shown = _let(mixed, "f", f"date_format(date_add(date'1800-01-01', cast(f.a * 5411 + f.b as int)), '{_DATES[kind]}')")
    parts = {"iso": "x", "us": "concat(substr(x, 7), '-', substr(x, 1, 2), '-', substr(x, 4, 2))", "eu": "concat(substr(x, 7), '-', substr(x, 4, 2), '-', substr(x, 1, 2))"}[kind]
    return _let(f"try_cast({parts} as date)", "t", f"if(t between date'1800-01-01' and date'2199-12-31', {shown}, x)")


def _alias(kind: str, value: str, length: str, key: str, into: str) -> str:
    """``length`` characters of ``into`` (16) told by a keyed hash of the value."""
    one = f"sha2(concat({_quote(key)}, '|{kind}|', {{}}, '|', {value}), 256)"
    return f"substr(translate(array_join(transform(sequence(0, cast(({length} - 1) div 64 as int)), j -> {one.format('j')}), ''), '0123456789abcdef', '{into}'), 1, cast({length} as int))"


def _mail(key: str) -> str:
    name, host = "substring_index(x, '@', 1)", "substring_index(x, '@', -1)"
    return f"concat({_alias('mail', 'lower(x)', f'greatest(16, length({name}))', key, 'bcdfghjkmnpqrstv')}, '@', {host})"


def _secret(key: str) -> str:
    """The name before the secret stays."""
    value = "regexp_extract(x, '[A-Za-z0-9_+/-]+$', 0)"
    return _let(value, "v", f"concat(substr(x, 1, length(x) - length(v)), {_alias('secret', 'v', 'greatest(16, length(v))', key, '0123456789abcdef')})")


def _token(key: str) -> str:
    """The marker up to the last _ or - near the start, which tells whose token it is, stays."""
    lead = "regexp_extract(x, '^([spr]k_(live|test)_|gh[pousr]_|xox[abprs]-)', 1)"
    return _let(lead, "c", f"concat(c, {_alias('token', 'x', 'length(x) - length(c)', key, '0123456789abcdef')})")


def pseudonym(kind: str, key: str, back: bool = False) -> str:
    """SQL for the pseudonym of the find ``x``; a find that isn't valid in its format stays as it is."""
    if kind in _DATES:
        return _date(kind, key, back)
    if kind in ("mail", "aws", "secret", "token"):
        made = {"mail": _mail(key), "aws": f"concat(substr(x, 1, 4), {_alias('aws', 'x', '16', key, 'ABCDEFGHJKMNPQRS')})", "secret": _secret(key), "token": _token(key)}[kind]
        return "x" if back else made
    return {"card": _card, "phone": _phone, "abroad": _abroad, "iban": _iban, "ssn": _ssn, "ip": _ip}[kind](key, back)


def _finds(text: str) -> str:
    return f"regexp_extract_all({text}, {_quote(ANY)}, 0)"


def _replaced(text: str, key: str, back: bool) -> str:
    # Patterns look around, so a find alone can't be matched again by its own pattern: bare forms tell the kinds apart.
    bare = {
        "mail": "x like '%@%'", "aws": "x rlike '^A[KS]IA[A-Z0-9]{16}$'", "ssn": "x rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$'", "phone": "x rlike '^([+]1[ .-]?)?([(][0-9]{3}[)] ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$'",
        "abroad": "x rlike '^[+]'", "token": "x rlike '^([spr]k_(live|test)_|gh[pousr]_|xox[abprs]-)'", "iban": "x rlike '^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$'",
        "iso": "x rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'", "us": "x rlike '^[0-9]{2}/[0-9]{2}/[0-9]{4}$'", "eu": "x rlike '^[0-9]{2}[.][0-9]{2}[.][0-9]{4}$'", "ip": "x rlike '^([0-9]{1,3}[.]){3}[0-9]{1,3}$'", "card": "x rlike '^[0-9][0-9 -]+$'",
    }
    cases = " ".join(f"when {test} then {pseudonym(kind, key, back)}" for kind, test in bare.items())
    made = f"transform({_finds(text)}, x -> case {cases} else {pseudonym('secret', key, back)} end)"
    gaps = f"split({text}, {_quote(ANY)}, -1)"
    return f"array_join(flatten(zip_with({gaps}, {made}, (g, m) -> array(g, coalesce(m, '')))), '')"


def pseudonymize(df: DataFrame, key: str, text_col: str = "text", restore: bool = False, count_col: str | None = None) -> DataFrame:
    """``df`` with personal data in ``text_col`` replaced by pseudonyms under ``key``; ``restore`` undoes numbers and dates.

    Every row and column stays, in whole texts; null stays null, a text without a find stays as it is. ``count_col``
    gets the number of finds (replacing a column of that name). There is no shuffle: equal values agree since they are
    permuted alike wherever they stand. Repeated rows change alike, an empty table gives none, and other columns stay
    whatever their names.
    """
    text = f"`{text_col}`"
    hint = F.col(text_col).rlike(HINT)
    changed = F.when(hint, F.expr(_replaced(text, key, restore))).otherwise(F.col(text_col))
    if count_col:
        df = df.withColumns({count_col: F.when(hint, F.size(F.expr(_finds(text)))).otherwise(0).cast("long"), text_col: changed})
        return df
    return df.withColumn(text_col, changed)

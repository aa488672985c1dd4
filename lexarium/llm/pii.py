"""Format-preserving Feistel pseudonyms for personal data, in Spark SQL alone.

One pattern finds candidates; each is then validated by its kind: cards by the
Luhn sum, accounts (IBAN) modulo 97, social security numbers and addresses by
their ranges, dates by the calendar. A validated value is permuted within its
format by a Feistel network whose round function is a keyed SHA-256, so equal
values get equal pseudonyms in all documents, other values other ones, and
separators, letter case, length, check digits and calendar stay valid:

* cards: all digits but the last, which becomes the Luhn digit of the others; a
  run of groups of digits that is no card as a whole is searched for cards of
  13 to 19 digits that begin and end with groups (usual groupings first), and
  its rest for the other kinds
* dates: the day within its 400 years (146097 = 189 x 773 days, a Feistel
  network over the two residues); `a/b/yyyy` is read month first if a <= 12
* social security numbers: over the valid ones (898 areas x 99 x 9999)
* IPv4 addresses: over 2**32
* phone numbers (ten digits in the usual grouping, or 8 to 15 after a plus whose
  country code does not begin with 0): the digits after the country code
* e-mail addresses: letters and digits of the part before the @, and those of
  the domain but for its last label, by themselves, so one domain stays one
* long hexadecimal secrets (32 to 64 digits): over base 16
* accounts: the digits after the check digits, which are computed anew

What fails validation stays as it is. Null texts stay null, empty ones empty,
long ones are searched whole; other columns are handed on, but for those that
have the names of the two counts, which are replaced; rows are treated one by
one, whatever repeats; an empty table gives no rows.

Whoever has the key can invert the permutation, so there is no default: the
queries take it from the session's `spark.lexarium.pii.key`, or draw one for
the application, whose pseudonyms then link documents of that run only.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm._shared import spare, table

#: Digits of a run of cards: not of a word, an address, a date or a number with a point.
_GROUP = r"[0-9]++(?![A-Za-z_@]|\.[0-9]|/[0-9]{1,2}/[0-9]{4}|-[0-9]++[A-Za-z_]|[._%+-][A-Za-z0-9._%+-]{0,63}@)"
#: A date or a social security number ends the run.
_NEXT = r"(?!(?<!-)(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9A-Za-z_]|[./-][0-9]))"
#: One alternative a kind; the first that matches wins.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9_])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9_])",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])",
    "ip": r"(?<![0-9A-Za-z_.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z_]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z_./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([/.])[0-9]{1,2}\1[0-9]{4})(?![0-9A-Za-z_]|[./-][0-9])",
    "ssn": r"(?<![0-9A-Za-z_.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z_]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z_+])(?:\+[1-9][0-9]{0,2}[^0-9A-Za-z_\n(]{1,6})?(?:\([0-9]{3}\)[^0-9A-Za-z_\n]{0,6}|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z_]|-[0-9])|(?<![0-9A-Za-z_])\+[1-9][0-9]{7,14}(?![0-9A-Za-z_])",
    "card": r"(?<![0-9A-Za-z_.])(?=[0-9](?:[ -]?[0-9]){12})" + _GROUP + "(?:[ -]" + _NEXT + _GROUP + r")*+(?!-[0-9])",
}
#: Usual groupings of a card's digits, which are taken before others.
GROUPED = r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})[ -]?$"
_DIGITS, _HELD = "0123456789", "".join(chr(0xE000 + i) for i in range(10))
ROUNDS = 8


def _q(s: str) -> str:
    return "r'" + s.replace("'", r"\x27") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with a name for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _round(key: str, tag: str, i: str, x: str, modulus: str) -> str:
    return f"pmod(cast(conv(substr(sha2(concat_ws('|', {_q(key)}, '{tag}', {i}, {x}), 256), 1, 15), 16, 10) as bigint), {modulus})"


def _network(key: str, tag: str, a: str, b: str, ma: str, mb: str, done: str) -> str:
    """SQL: a Feistel network over Z_ma x Z_mb; `done` makes the result of s.a, s.b."""
    even = f"named_struct('a', pmod(s.a + {_round(key, tag, 'i', 's.b', ma)}, {ma}), 'b', s.b)"
    odd = f"named_struct('a', s.a, 'b', pmod(s.b + {_round(key, tag, 'i', 's.a', mb)}, {mb}))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, i) -> if(i % 2 = 0, {even}, {odd}), s -> {done})"


def _string(key: str, tag: str, s: str, radix: int) -> str:
    """SQL: a string of numerals of this radix, permuted in blocks of 24."""
    up, down = ("0123456789abcdefghijklmnop", "abcdefghijklmnopqrstuvwxyz") if radix == 26 else ("", "")
    number = (lambda x: f"conv(translate({x}, '{down}', '{up}'), 26, 10)") if radix == 26 else (lambda x: f"conv({x}, {radix}, 10)")
    written = lambda x, n: f"lpad(lower(conv({x}, 10, {radix})), {n}, '0')"
    done = f"concat({written('s.a', 'n div 2')}, {written('s.b', 'n - n div 2')})"
    done = f"translate({done}, '{up}', '{down}')" if radix == 26 else done
    power = lambda n: f"cast(round(pow({radix}, {n})) as bigint)"
    left = f"if(n div 2 = 0, '0', {number('substr(p, 1, n div 2)')})"
    done = f"if(n = 1, substr({done}, -1), {done})"
    body = _network(key, f"{tag}{radix}", left, number("substr(p, n div 2 + 1)"), power("n div 2"), power("(n - n div 2)"), done)
    block = _let("length(p)", "n", body)
    return f"array_join(transform(filter(transform(sequence(0, greatest(length({s}) - 1, 0) div 24), k -> substr({s}, k * 24 + 1, 24)), p -> p <> ''), p -> {block}), '')"


def _merge(m: str, digits: str, letters: str | None = None) -> str:
    """SQL: m with its digits (and letters) replaced in order, all else kept."""
    nth = lambda of, kind: f"substr({of}, length(regexp_replace(substr({m}, 1, j), '[^{kind}]', '')), 1)"
    c = f"substr({m}, j, 1)"
    other = c if letters is None else f"when {c} rlike '[a-z]' then {nth(letters, 'A-Za-z')} when {c} rlike '[A-Z]' then upper({nth(letters, 'A-Za-z')}) else {c}"
    case = f"case when {c} rlike '[0-9]' then {nth(digits, '0-9')} " + (f"else {c} end" if letters is None else f"{other} end")
    return f"array_join(transform(sequence(1, length({m})), j -> {case}), '')"


def _luhn(digits: str, shift: int) -> str:
    """SQL: the Luhn sum of digits; shift 0: the last is the check digit."""
    d = f"cast(substr({digits}, -x, 1) as int)"
    twice = f"if((x + {shift}) % 2 = 0, if({d} > 4, 2 * {d} - 9, 2 * {d}), {d})"
    return f"aggregate(sequence(1, length({digits})), 0, (t, x) -> t + {twice})"


def _mod97(s: str) -> str:
    """SQL: letters and digits, read as in ISO 7064, modulo 97."""
    v = f"cast(conv(substr({s}, x, 1), 36, 10) as int)"
    return f"aggregate(sequence(1, length({s})), 0, (t, x) -> (t * if({v} > 9, 100, 10) + {v}) % 97)"


def _card(key: str, m: str = "m") -> str:
    """SQL: m with its digits permuted, whatever their Luhn sum was."""
    fresh = _let(_string(key, "card", "substr(d, 1, length(d) - 1)", 10), "b", f"concat(b, cast(pmod(10 - {_luhn('b', 1)} % 10, 10) as string))")
    return _let(m, "m", _let("regexp_replace(m, '[^0-9]', '')", "d", _let(fresh, "e", _merge("m", "e"))))


def _is_card(d: str) -> str:
    return f"(length({d}) between 13 and 19 and {_luhn(d, 0)} % 10 = 0)"


def _run(key: str) -> str:
    """SQL: struct (v, found, changed) of a run m that is no card as a whole. Its
    groups are g, and h the counts of groups of the cards that begin at each; u has
    the largest of usual grouping, w of any. From left to right the usual ones are
    taken, and others if no usual one begins inside. Their digits are held back as
    other characters while the rest is searched."""
    joined = lambda at, n: f"array_join(slice(g, {at}, {n}), '')"
    valid = _let(f"regexp_replace({joined('i', 'n')}, '[^0-9]', '')", "d", _is_card("d"))
    held = f"transform(sequence(1, size(g)), i -> filter(sequence(1, least(19, size(g) - i + 1)), n -> {valid}))"
    usual = f"transform(h, (l, i) -> coalesce(array_max(filter(l, n -> {joined('i + 1', 'n')} rlike {_q(GROUPED)})), 0))"
    taken = "if(i < s.next, 0, if(u[i - 1] > 0, u[i - 1], if(w[i - 1] > 0 and not exists(slice(u, i + 1, w[i - 1] - 1), y -> y > 0), w[i - 1], 0)))"
    step = _let(taken, "n", "if(n = 0, s, named_struct('next', i + n, 'c', concat(s.c, array(named_struct('at', i, 'n', n)))))")
    cards = f"aggregate(sequence(1, size(g)), named_struct('next', 1, 'c', cast(array() as array<struct<at: int, n: int>>)), (s, i) -> {step}, s -> s.c)"
    after = lambda k: f"if({k} < 0, 1, c[greatest({k}, 0)].at + c[greatest({k}, 0)].n)"
    one = f"concat({_let(after('k - 1'), 'o', joined('o', 'q.at - o'))}, translate({_card(key, joined('q.at', 'q.n'))}, '{_DIGITS}', '{_HELD}'))"
    tail = _let("if(size(c) = 0, 1, element_at(c, -1).at + element_at(c, -1).n)", "o", joined("o", "size(g)"))
    text = f"concat(array_join(transform(c, (q, k) -> {one}), ''), {tail})"
    others = [k for k in PATTERNS if k != "card"]
    pattern = _q("|".join(PATTERNS[k] for k in others))
    new = f"transform(regexp_extract_all(t, {pattern}, 0), m -> named_struct('m', m, 'v', {_kinds(key, others, 'm')}))"
    rest = f"array_join(zip_with(split(t, {pattern}, -1), r, (a, b) -> concat(a, coalesce(b.v, ''))), '')"
    out = f"named_struct('v', translate({rest}, '{_HELD}', '{_DIGITS}'), 'found', greatest(if(length(m) < 13, 0, 1), size(c) + size(r)), 'changed', size(c) + size(filter(r, x -> x.m <> x.v)))"
    out = _let(cards, "c", _let(text, "t", _let(new, "r", out)))
    return _let("regexp_extract_all(m, '[0-9]+[ -]?', 0)", "g", _let(held, "h", _let(usual, "u", _let("transform(h, l -> coalesce(array_max(l), 0))", "w", out))))


def _ip(key: str) -> str:
    done = "concat_ws('.', s.a div 256, s.a % 256, s.b div 256, s.b % 256)"
    part = lambda i: f"cast(o[{i}] as bigint)"
    net = _network(key, "ip", f"{part(0)} * 256 + {part(1)}", f"{part(2)} * 256 + {part(3)}", "65536", "65536", done)
    return _let("split(m, '[.]')", "o", f"if(exists(o, x -> cast(x as int) > 255), m, {net})")


def _ssn(key: str) -> str:
    area, group, serial = (f"cast(substr(m, {i}, {n}) as bigint)" for i, n in ((1, 3), (5, 2), (8, 4)))
    good = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
    done = "concat_ws('-', lpad(s.a + 1 + if(s.a >= 665, 1, 0), 3, '0'), lpad(s.b div 9999 + 1, 2, '0'), lpad(s.b % 9999 + 1, 4, '0'))"
    return f"if({good}, {_network(key, 'ssn', f'{area} - 1 - if({area} > 666, 1, 0)', f'({group} - 1) * 9999 + {serial} - 1', '898', '989901', done)}, m)"


def _date(key: str) -> str:
    iso = "if(substr(m, 5, 1) = '-', m, if(cast(p[0] as int) > 12, concat_ws('-', p[2], lpad(p[1], 2, '0'), lpad(p[0], 2, '0')), concat_ws('-', p[2], lpad(p[0], 2, '0'), lpad(p[1], 2, '0'))))"
    us = "substr(m, 5, 1) <> '-' and instr(m, '/') > 0 and cast(p[0] as int) <= 12"
    iso = f"if(instr(m, '.') > 0, concat_ws('-', p[2], lpad(p[1], 2, '0'), lpad(p[0], 2, '0')), {iso})"
    start = "make_date(cast(year(d) - pmod(year(d), 400) as int), 1, 1)"
    new = _network(key, "date", f"datediff(d, {start}) div 773", f"datediff(d, {start}) % 773", "189", "773", f"date_add({start}, cast(s.a * 773 + s.b as int))")
    short = lambda part, i: f"lpad(cast({part}(e) as string), greatest(length(p[{i}]), length(cast({part}(e) as string))), '0')"
    wide = "lpad(cast(year(e) as string), 4, '0')"
    out = f"case when substr(m, 5, 1) = '-' then concat_ws('-', {wide}, lpad(month(e), 2, '0'), lpad(day(e), 2, '0')) when {us} then concat_ws('/', {short('month', 0)}, {short('day', 1)}, {wide}) else concat_ws(substr(regexp_replace(m, '[0-9]', ''), 1, 1), {short('day', 0)}, {short('month', 1)}, {wide}) end"
    body = f"if(d is null or year(d) < 400, m, {_let(new, 'e', out)})"
    return _let("split(m, '[-/.]')", "p", _let(f"try_cast({iso} as date)", "d", body))


def _phone(key: str) -> str:
    head = "regexp_extract(m, '^[+][0-9]{1,3}(?=[^0-9])|^[+][0-9]', 0)"
    rest = _let("substr(m, length(h) + 1)", "r", _let(_string(key, "phone", "regexp_replace(r, '[^0-9]', '')", 10), "e", f"concat(h, {_merge('r', 'e')})"))
    return _let(head, "h", rest)


def _email(key: str) -> str:
    def part(tag: str, of: str) -> str:
        letters = _string(key, tag, "lower(regexp_replace(u, '[^A-Za-z]', ''))", 26)
        digits = _string(key, tag, "regexp_replace(u, '[^0-9]', '')", 10)
        return _let(of, "u", _let(letters, "l", _let(digits, "e", _merge("u", "e", "l"))))

    local, host = part("email", "substring_index(m, '@', 1)"), part("domain", "regexp_extract(m, '@(.*)[.]', 1)")
    return f"concat({local}, '@', {host}, '.', substring_index(m, '.', -1))"


def _hex(key: str) -> str:
    return _let(_string(key, "hex", "lower(m)", 16), "e", "if(m = lower(m), e, if(m = upper(m), upper(e), e))")


def _iban(key: str) -> str:
    body = _let(_string(key, "iban", "regexp_replace(substr(z, 5), '[^0-9]', '')", 10), "e", _let(_merge("substr(z, 5)", "e"), "w", f"concat(substr(z, 1, 2), lpad(cast(98 - {_mod97('concat(w, substr(z, 1, 2), 0, 0)')} as string), 2, '0'), w)"))
    spread = "array_join(transform(sequence(1, length(m)), j -> if(substr(m, j, 1) = ' ', ' ', substr(f, length(replace(substr(m, 1, j), ' ', '')), 1))), '')"
    return _let("replace(m, ' ', '')", "z", f"if({_mod97('concat(substr(z, 5), substr(z, 1, 4))')} = 1, {_let(body, 'f', spread)}, m)")


_PERMUTE = {"email": _email, "hex": _hex, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _kinds(key: str, kinds: list[str], other: str) -> str:
    """SQL of the pseudonym of m; a kind is told by matching all of m."""
    return "case " + " ".join(f"when m rlike {_q('^(?:' + PATTERNS[k] + ')$')} then {_PERMUTE[k](key)}" for k in kinds) + f" else {other} end"


def _value_sql(key: str) -> str:
    """SQL: struct (v, found, changed) of a candidate m: its pseudonym, the
    candidates in it, and how many of them were permuted."""
    whole = _let("regexp_replace(m, '[^0-9]', '')", "d", _is_card("d"))
    kinds = [k for k in PATTERNS if k != "card"]
    digits = f"m rlike '^[0-9][0-9 -]*$' and not m rlike {_q('^(?:' + '|'.join(PATTERNS[k] for k in kinds) + ')$')}"
    plain = _let(f"if({digits}, {_card(key)}, {_kinds(key, kinds, 'm')})", "v", "named_struct('v', v, 'found', 1, 'changed', if(m <> v, 1, 0))")
    return f"if({digits} and not {whole}, {_run(key)}, {plain})"


def configured_key(spark: SparkSession) -> str:
    """The session's spark.lexarium.pii.key, else one drawn for the application."""
    sc = spark.sparkContext
    if named := spark.conf.get("spark.lexarium.pii.key", None):
        return named
    if not hasattr(sc, "_lexarium_key"):
        sc._lexarium_key = secrets.token_hex(16)
    return sc._lexarium_key


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", names: tuple[str, str] = ("pii_found", "pii_changed")) -> DataFrame:
    """df with pseudonyms in the text, and two counts: of candidates, and of
    those that were validated and permuted."""
    if not key:
        raise ValueError("a key is needed")
    df = df.drop(*names)
    hits_col, new_col = spare(df, "hits", "pseudonyms")
    # the date pattern's back reference is the only group of the whole pattern
    pattern = _q("|".join(PATTERNS.values()))
    t = f"`{text_col}`"
    hits = f"if({t} rlike '[0-9@]|[A-Fa-f]{{32}}', regexp_extract_all({t}, {pattern}, 0), cast(array() as array<string>))"
    out = df.withColumn(hits_col, F.expr(hits)).withColumn(new_col, F.expr(f"transform(`{hits_col}`, m -> {_value_sql(key)})"))
    rest = f"zip_with(split({t}, {pattern}, -1), `{new_col}`, (a, b) -> concat(a, coalesce(b.v, '')))"
    total = lambda name: F.expr(f"if({t} is null, 0, aggregate(`{new_col}`, 0, (s, x) -> s + x.{name}))").cast("bigint")
    out = out.withColumn(names[0], total("found")).withColumn(names[1], total("changed"))
    return out.withColumn(text_col, F.expr(f"if(size(`{hits_col}`) > 0, array_join({rest}, ''), {t})")).drop(hits_col, new_col)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms in their texts."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), configured_key(spark))

"""Surrogate generation for personal data, in SQL expressions only.

One regular expression finds the entities, and a person of several words found in a text is found again
wherever the same words stand in it without a title. All different entities of the table make a table of their
own with one surrogate each, of the entity's type and format. Numbers (cards, phones, social security numbers,
addresses, account numbers) go through a keyed permutation of their digits (a Feistel network), so different
numbers can never meet. Names, mail addresses and secrets get surrogates from keyed hashes; those that meet
another surrogate or an entity that occurs are drawn anew, as often as it takes. A person's gender is that of most
of its titles in the table. The texts then take their surrogates from the table of entities by a join, so
an entity reads the same in every document, whatever stands in front of it.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.shared import free_name, heavy_join, materialize

# Given names by script and gender; titles by gender.
GIVEN = {
    ("Latin", "m"): "Adam Andrew Anton Bernard Carlos Charles Daniel David Diego Edward Felix Frank George Hans Henry Hugo Jack James Jean John Jorge José Juan Karl Klaus Louis Luis Mark Martin Michael Miguel Nicolas Otto Paul Pedro Peter Philippe Pierre Richard Robert Stefan Thomas Walter William".split(),
    ("Latin", "f"): "Alice Amélie Ana Anna Barbara Carmen Charlotte Claire Clara Dorothy Elena Elizabeth Emma Eva Frieda Greta Hannah Heidi Helen Ingrid Isabel Jane Jennifer Julia Karin Laura Linda Lucía Maria Marie María Martha Mary Monique Nora Olivia Patricia Paula Petra Rosa Sarah Sophie Susan Ursula".split(),
    ("Cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей Юрий".split(),
    ("Cyrillic", "f"): "Анна Вера Галина Елена Ирина Людмила Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("Greek", "m"): "Γιάννης Γιώργος Δημήτρης Κώστας Νίκος Παύλος Πέτρος Σταύρος".split(),
    ("Greek", "f"): "Άννα Ειρήνη Ελένη Ζωή Κατερίνα Μαρία Σοφία Χριστίνα".split(),
}
TITLES = {
    "m": ["Mr.", "Herr", "Monsieur", "Señor", "Sr.", "г-н", "κ."],
    "f": ["Mrs.", "Ms.", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra.", "г-жа", "κα."],
    "n": ["Dr.", "Prof."],
}
#: The letters and digits of secrets' surrogates by what they stand for; anything else becomes a symbol.
SECRET_ALPHABETS = {
    "^[0-9]": "0123456789", "^[a-z]": "abcdefghijklmnopqrstuvwxyz", "^[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"^(?=\p{IsCyrillic})\p{Lu}": "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", r"^(?=\p{IsCyrillic})\p{L}": "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    r"^(?=\p{IsGreek})\p{Lu}": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", r"^(?=\p{IsGreek})\p{L}": "αβγδεζηθικλμνξοπρστυφχψω",
    r"^\p{Lu}": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"^\p{L}": "abcdefghijklmnopqrstuvwxyz", r"^\p{N}": "0123456789",
}
SECRET_SYMBOLS = "-_.~!*$%&+#?/@^:"
SYLLABLES = {
    "Latin": "ba be bo bra da de do dri fa fe ga go ha he jo ka ke ki la le li lo ma mi na no pa ra ro sa ti va".split(),
    "Cyrillic": "ба бе бо бра да де до дри фа фе га го ха хе жо ка ке ки ла ле ли ло ма ми на но па ра ро са ти ва".split(),
    "Greek": "βα βε βο βρα δα δε δο δρι φα φε γα γο χα χε ζο κα κε κι λα λε λι λο μα μι να νο πα ρα ρο σα τι βα".split(),
}

# How streets end.
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Court Ct".split()

NAME = r"\p{Lu}[\p{L}'’-]{1,40}"
KNOWN = {n for names in GIVEN.values() for n in names}
_ALL_GIVEN = "|".join(sorted(KNOWN))
_INITIALS = "".join(sorted({n[0] for names in GIVEN.values() for n in names}))
_TITLE_INITIALS = "".join(sorted({t[0] for kind in TITLES.values() for t in kind}))
_ALL_TITLES = "|".join(t.replace(".", r"\.") for kind in TITLES.values() for t in kind)
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
_KEYWORD = r"(?:(?<![\p{L}\p{N}])|(?<=\p{Ll})(?=\p{Lu}))(?i:token|secret(?:[_-]?key)?|password|passwd|api[_-]?key|access[_-]?key)[\x22']? {0,2}[:=] {0,2}[\x22']?"
_GROUP = "[0-9A-Fa-f]{1,4}"
_LONE_SECRET = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+|[0-9a-f]{40}|[0-9a-f]{64}"
#: In the order in which they are tried at one place. Every pattern is bounded or possessive and looks first at the
#: character it starts with, so no text makes it backtrack far.
PATTERNS = {
    "SECRET": rf"(?<=[\x22'=:]|[=:] |[=:]  )(?=[^\s\x22'|]{{8}})(?<={_KEYWORD})[^\s\x22'|]{{8,}}+|(?:{_LONE_SECRET})(?![\p{{L}}\p{{N}}])",
    "EMAIL": r"(?<![._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,6}\p{L}{2,24}",
    "MAC": r"(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![\p{L}\p{N}])",
    "IPV6": rf"(?:{_GROUP}:){{7}}{_GROUP}(?![\p{{L}}\p{{N}}])|(?=[0-9A-Fa-f:])(?<!:)(?!(?:[0-9A-Fa-f]{{0,4}}:){{9}})(?:(?:{_GROUP}:){{1,7}}:(?:{_GROUP}(?::{_GROUP}){{0,6}})?|::{_GROUP}(?::{_GROUP}){{0,6}})(?![\p{{L}}\p{{N}}]|:[0-9A-Fa-f:]|\.\d)",
    "IPV4": rf"(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{N}}\p{{L}}]|\.\d)",
    "IBAN": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "SSN": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\p{N}-])|(?=\d)(?<=(?i:ssn|social security(?: number| no\.)?)[:#]? ?)\d{9}(?!\p{N})",
    "ADDRESS": rf"(?=\d)(?<![-.,])\d{{1,5}} (?:{NAME} ){{1,3}}(?:{'|'.join(STREETS)})(?!\p{{L}})",
    "PHONE": r"(?<!\+)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\p{N})|(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?!\p{N})",
    "CARD": r"(?<!-)(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{4,5})(?!\p{N})",
    "PERSON": rf"(?=\p{{Lu}})(?<=(?<!\p{{L}})(?:{_ALL_TITLES}) ){NAME}(?: {NAME}){{0,2}}|(?=[{_INITIALS}])(?:{_ALL_GIVEN}) {NAME}(?!\p{{L}})",
}
#: All entities start behind something that is no letter or digit.
ENTITY = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: Any text with an entity matches one of these cheap ones: its characters, or a name's beginning.
GUARD = r"[0-9@=:]|AKIA|gh[pousr]_|sk-|[a-f]{40}"
NAME_GUARD = rf"(?<!\p{{L}})(?:(?=[{_INITIALS}])(?:{_ALL_GIVEN})|(?=[{_TITLE_INITIALS}])(?:{_ALL_TITLES})) \p{{Lu}}"
NUMBERS = ("CARD", "PHONE", "SSN", "IPV4", "IBAN", "MAC", "IPV6")


def _q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(words: list[str]) -> str:
    return "array(" + ", ".join(map(_q, words)) + ")"


class _Sql:
    """Builds the expressions over a table of entities: ``kind, entity, gender``, how often drawn ``again``, and the kind's ``__key``.

    The key is a column, so that no plan, which others can see, holds it.
    """

    def number(self, *parts: str) -> str:
        """A keyed 60-bit number of the parts."""
        return f"cast(conv(substring(sha2(concat_ws('\\u0001', __key, {', '.join(parts)}), 256), 1, 15), 16, 10) as bigint)"

    def feistel(self, kind: str, a: str, b: str, most_a: str, most_b: str) -> str:
        """A keyed permutation of the pairs (a, b) with 0 <= a < most_a, 0 <= b < most_b, as a struct."""
        fa, fb = (self.number(_q(kind), f"cast({n} as string)", "cast(r as string)", f"cast({x} as string)") for n, x in ((most_a, "s.b"), (most_b, "s.a")))
        return (
            f"aggregate(sequence(0, 5), named_struct('a', {a}, 'b', {b}), (s, r) -> if(r % 2 = 0,"
            f" named_struct('a', pmod(s.a + {fa}, {most_a}), 'b', s.b), named_struct('a', s.a, 'b', pmod(s.b + {fb}, {most_b}))))"
        )

    def permuted(self, kind: str, digits: str) -> str:
        """The digits (at most 36) under a permutation of the strings of their length."""
        half, rest = f"(length({digits}) div 2)", f"(length({digits}) - length({digits}) div 2)"
        ten = lambda n: f"cast(rpad('1', {n} + 1, '0') as bigint)"
        pair = self.feistel(
            kind, f"coalesce(cast(substring({digits}, 1, {half}) as bigint), 0L)", f"cast(substring({digits}, {half} + 1) as bigint)", ten(half), ten(rest)
        )
        return f"element_at(transform(array({pair}), p -> concat(if({half} = 0, '', lpad(cast(p.a as string), {half}, '0')), lpad(cast(p.b as string), {rest}, '0'))), 1)"

    @staticmethod
    def poured(form: str, digits: str) -> str:
        """``form`` with its digits replaced in turn by ``digits``."""
        k = f"length(regexp_replace(substring({form}, 1, i), '[^0-9]', ''))"
        c = f"substring({form}, i, 1)"
        return f"array_join(transform(sequence(1, length({form})), i -> if({c} between '0' and '9', substring({digits}, {k}, 1), {c})), '')"

    @staticmethod
    def luhn(digits: str) -> str:
        """The check digit that would follow the digits."""
        d = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
        twice = f"(2 * {d} - if({d} > 4, 9, 0))"
        return f"pmod(10 - aggregate(transform(sequence(0, length({digits}) - 1), i -> if(i % 2 = 0, {twice}, {d})), 0, (x, y) -> x + y) % 10, 10)"

    def card(self, e: str) -> str:
        """Valid check digits stay valid, others stay as far off as they were."""
        d = f"regexp_replace({e}, '[^0-9]', '')"
        head, last = f"substring({d}, 1, length({d}) - 1)", f"cast(right({d}, 1) as int)"
        new = self.permuted("CARD", head)
        digits = f"element_at(transform(array({new}), h -> concat(h, cast(pmod({self.luhn('h')} + {last} - {self.luhn(head)}, 10) as string))), 1)"
        return f"element_at(transform(array({digits}), z -> {self.poured(e, 'z')}), 1)"

    def phone(self, e: str) -> str:
        """A leading plus keeps the digit behind it."""
        d = f"regexp_replace({e}, '[^0-9]', '')"
        kept = f"if({e} like '+%', substring({d}, 1, 1), '')"
        digits = f"concat({kept}, {self.permuted('PHONE', f'substring({d}, length({kept}) + 1)')})"
        return f"element_at(transform(array({digits}), z -> {self.poured(e, 'z')}), 1)"

    def plain(self, kind: str, e: str) -> str:
        return f"element_at(transform(array({self.permuted(kind, f'''regexp_replace({e}, '[^0-9]', '')''')}), z -> {self.poured(e, 'z')}), 1)"

    def ipv4(self, e: str) -> str:
        part = lambda i: f"cast(split({e}, '[.]')[{i}] as bigint)"
        pair = self.feistel("IPV4", f"{part(0)} * 256 + {part(1)}", f"{part(2)} * 256 + {part(3)}", "65536L", "65536L")
        return f"element_at(transform(array({pair}), p -> concat_ws('.', cast(p.a div 256 as string), cast(p.a % 256 as string), cast(p.b div 256 as string), cast(p.b % 256 as string))), 1)"

    def hexes(self, kind: str, e: str) -> str:
        """Hexadecimal groups: each half of at most 16 digits is added a keyed number of the other, then the same back."""
        groups = f"split(lower({e}), ':')"
        if kind == "IPV6":  # a double colon stands for the groups that are missing
            side = lambda k: f"filter(split(substring_index(lower({e}), '::', {k}), ':'), g -> g <> '')"
            groups = f"if({e} like '%::%', concat({side(1)}, array_repeat('0', 8 - size({side(1)}) - size({side(-1)})), {side(-1)}), {groups})"
        full = f"array_join(transform({groups}, g -> lpad(g, {4 if kind == 'IPV6' else 2}, '0')), '')"
        base = 16**8 if kind == "IPV6" else 16**6
        n = 8 if kind == "IPV6" else 6
        val = lambda i: f"cast(conv(substring(f, {i * n + 1}, {n}), 16, 10) as bigint)"
        hexed = lambda x: f"lower(lpad(hex({x}), {n}, '0'))"
        joined = "concat(" + ", ".join(
            f"element_at(transform(array({self.feistel(kind + str(i), val(i), val(i + 1), f'{base}L', f'{base}L')}), p -> concat({hexed('p.a')}, {hexed('p.b')})), 1)"
            for i in range(0, 4 if kind == "IPV6" else 2, 2)
        ) + ")"
        step = 4 if kind == "IPV6" else 2
        joined = f"element_at(transform(array({full}), f -> {joined}), 1)"
        return f"element_at(transform(array({joined}), z -> array_join(transform(sequence(0, {7 if kind == 'IPV6' else 5}), i -> substring(z, i * {step} + 1, {step})), ':')), 1)"

    def iban(self, e: str) -> str:
        """The country stays; digits are permuted and letters turned by a keyed number of the digits."""
        d = f"regexp_replace({e}, '[^0-9]', '')"
        turn = self.number("'IBAN'", d, "cast(i as string)")
        turned = f"array_join(transform(sequence(1, length({e})), i -> if(i > 2 and substring({e}, i, 1) between 'A' and 'Z', char(65 + cast(pmod(ascii(substring({e}, i, 1)) - 65 + {turn}, 26) as int)), substring({e}, i, 1))), '')"
        return f"element_at(transform(array(named_struct('t', {turned}, 'z', {self.permuted('IBAN', d)})), y -> {self.poured('y.t', 'y.z')}), 1)"

    def secret(self, e: str) -> str:
        """Characters of the same classes, from a keyed hash; hexadecimal stays hexadecimal. A third draw and later ones make it longer."""
        seed = f"sha2(concat_ws('\\u0001', __key, 'SECRET', {e}, cast(again as string)), 256)"
        start = f"named_struct('h', {e} rlike '^[0-9a-f]+$', 'seed', {seed}, 'extra', greatest(0, again - 2))"
        blocks = "transform(sequence(0, (length({e}) - 1) div 16), b -> sha2(concat_ws('\\u0001', y.seed, cast(b as string)), 256))".format(e=e)
        bits = "cast(conv(substring(bs[i div 16], 1 + 4 * cast(i % 16 as int), 4), 16, 10) as int)"
        of = lambda alphabet: f"substring({_q(alphabet)}, {bits} % {len(alphabet)} + 1, 1)"
        new = f"case when y.h then {of('0123456789abcdef')}" + "".join(f" when c rlike {_q(p)} then {of(a)}" for p, a in SECRET_ALPHABETS.items()) + f" else {of(SECRET_SYMBOLS)} end"
        chars = f"array_join(flatten(transform(array({blocks}), bs -> transform(split({e}, ''), (c, i) -> {new}))), '')"
        return f"element_at(transform(array({start}), y -> concat({chars}, substring(sha2(concat(y.seed, 'MORE'), 256), 1, y.extra))), 1)"

    def email(self, e: str) -> str:
        """A name and a keyed number, longer with every draw, at a domain of the reserved kind; the same domain stays the same."""
        local, domain = f"substring_index({e}, '@', 1)", f"lower(substring_index({e}, '@', -1))"
        names = _words([n.lower() for n in GIVEN["Latin", "f"] + GIVEN["Latin", "m"] if n.isascii()])
        n = self.number("'EMAIL'", f"lower({local})", domain)
        tail = f"substring(sha2(concat_ws('\\u0001', __key, 'EMAILTAIL', lower({e}), cast(again as string)), 256), 1, 8 + 4 * again)"
        host = f"substring(sha2(concat_ws('\\u0001', __key, 'HOST', {domain}), 256), 1, 12)"
        return f"concat(element_at({names}, cast({n} % size({names}) as int) + 1), '.', {tail}, '@h', {host}, '.example')"

    @staticmethod
    def script(w: str) -> str:
        return f"case when {w} rlike '\\\\p{{IsCyrillic}}' then 'Cyrillic' when {w} rlike '\\\\p{{IsGreek}}' then 'Greek' else 'Latin' end"

    def surname(self, w: str) -> str:
        """Syllables of the word's script, more with every draw, the same for a word in capitals; any other change of case makes another word."""
        of = lambda t: f"element_at({_words(SYLLABLES[t])}, cast(pmod(shiftright(n[i div 12], cast(5 * (i % 12) as int)), 32) as int) + 1)"
        pick = f"case {self.script(w)} when 'Cyrillic' then {of('Cyrillic')} when 'Greek' then {of('Greek')} else {of('Latin')} end"
        word = f"if({w} = initcap(lower({w})) or {w} = upper(lower({w})), lower({w}), {w})"
        salt = "if(again = 0, '', cast(again as string))"
        numbers = f"transform(sequence(0, (4 + 2 * again) div 12), b -> {self.number(_q('NAME'), word, salt, 'cast(b as string)')})"
        made = f"element_at(transform(array({numbers}), n -> initcap(array_join(transform(sequence(0, 4 + 2 * again), i -> {pick}), ''))), 1)"
        return f"if({w} rlike '^[^\\\\p{{Ll}}]{{2,}}$', upper({made}), {made})"

    def given(self, w: str, surname: str) -> str:
        """A known name takes the next one in the keyed order of its script's and gender's names at the first draw; others end as the person's gender does."""
        known = f"when again = 0 and element_at(__given, {w}) is not null then element_at(__given, {w})"
        ending = "case gender when 'f' then 'a' when 'm' then 'o' else 'e' end"
        return f"case {known} when {self.script(w)} = 'Latin' then concat({surname}, {ending}) else {surname} end"

    def person(self, e: str) -> str:
        """The last word is a surname, so it reads the same with and without given names in front of it."""
        words = f"split({e}, ' ')"
        new = f"element_at(transform(array({self.surname('w')}), m -> if(k < size({words}) - 1, {self.given('w', 'm')}, m)), 1)"
        return f"array_join(transform({words}, (w, k) -> {new}), ' ')"

    def address(self, e: str) -> str:
        """Another number and other names; the kind of street stays."""
        words = f"split({e}, ' ')"
        return f"array_join(transform({words}, (w, k) -> case when k = 0 then {self.permuted('ADDRESS', 'w')} when k = size({words}) - 1 then w else {self.surname('w')} end), ' ')"

    def surrogate(self, kind: str = "kind", e: str = "entity") -> str:
        made = {
            "CARD": self.card(e), "PHONE": self.phone(e), "SSN": self.plain("SSN", e), "IPV4": self.ipv4(e), "IBAN": self.iban(e), "MAC": self.hexes("MAC", e),
            "IPV6": self.hexes("IPV6", e), "SECRET": self.secret(e), "EMAIL": self.email(e), "ADDRESS": self.address(e), "PERSON": self.person(e),
        }
        return f"coalesce(case {kind} " + " ".join(f"when '{k}' then {v}" for k, v in made.items()) + f" end, concat('[', {kind}, ']'))"


def kind_of(e: str, before: str) -> str:
    """The type of a found entity, tried in the order of PATTERNS; ``before`` is the text in front of it."""
    whole = {k: f"^(?:{p})$" for k, p in PATTERNS.items() if k not in ("SECRET", "PERSON")}
    whole["SSN"] = r"^(?:\d{3}-\d{2}-\d{4}|\d{9})$"  # the second form is found behind a word only
    after_key, lone = f"{_KEYWORD}$", f"^(?:{_LONE_SECRET})$"
    cases = [f"when {before} rlike {_q(after_key)} or {e} rlike {_q(lone)} then 'SECRET'"]
    cases += [f"when {e} rlike {_q(p)} then '{k}'" for k, p in whole.items()]
    return f"case {' '.join(cases)} else 'PERSON' end"


def gender_of(before: str) -> str:
    """The gender of the title at the end of ``before``; none is empty."""
    ends = lambda g: "(" + " or ".join(f"endswith({before}, {_q(t + ' ')})" for t in TITLES[g]) + ")"
    return f"case when {ends('f')} then 'f' when {ends('m')} then 'm' else '' end"


_SEGMENTS = "array<struct<kind: string, entity: string, gender: string, behind: string>>"


def _cut(text: str, pattern: str, lead: str, each: str) -> str:
    """Segments of a text at the matches of a pattern: ``lead`` before the first match, ``each`` from ``e, i`` on."""
    pieces = f"named_struct('m', regexp_extract_all({text}, {pattern}, 0), 'g', split({text}, {pattern}, -1))"
    return f"element_at(transform(array({pieces}), x -> concat(array({lead}), transform(x.m, (e, i) -> {each}))), 1)"


def found(text: str = "text") -> Column:
    """The text as segments ``kind, entity, gender`` (of the title) and the text ``behind`` up to the next; the first has no entity.

    Empty where nothing is found. Persons of several words are found again wherever the same words stand.
    """
    segment = "named_struct('kind', {}, 'entity', {}, 'gender', {}, 'behind', {})".format
    first = _cut(text, _q(ENTITY), segment("''", "''", "''", "x.g[0]"), segment(kind_of("e", "right(x.g[i], 40)"), "e", gender_of("right(x.g[i], 40)"), "x.g[i + 1]"))
    names = "array_sort(array_distinct(transform(filter({s}, y -> y.kind = 'PERSON' and y.entity like '% %'), y -> y.entity)), (a, b) -> length(b) - length(a))"
    either = "concat('(?<![\\\\p{L}\\\\p{N}])(?:', array_join(transform(ns, n -> concat('\\\\Q', n, '\\\\E')), '|'), ')(?![\\\\p{L}\\\\p{N}])')"
    again = _cut("y.behind", "p", segment("y.kind", "y.entity", "y.gender", "x.g[0]"), segment("'PERSON'", "e", "''", "x.g[i + 1]"))
    more = f"element_at(transform(array({names.format(s='s')}), ns -> if(size(ns) = 0, s, element_at(transform(array({either}), p -> flatten(transform(s, y -> {again}))), 1))), 1)"
    whole = f"element_at(transform(array({first}), s -> {more}), 1)"
    return F.expr(f"if({text} rlike {_q(GUARD)} or {text} rlike {_q(NAME_GUARD)}, {whole}, cast(array() as {_SEGMENTS}))")


def next_given(key: str) -> dict[str, str]:
    """Every known given name and the one behind it in the keyed order of its list, the first behind the last."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda name: hmac.new(key.encode(), f"GIVEN {name}".encode(), hashlib.sha256).digest())
        out |= zip(order, order[1:] + order[:1])
    return out


def surrogates(mentions: DataFrame, key: str) -> DataFrame:
    """``kind, entity, s, n``: one surrogate for each entity of ``mentions (kind, entity, gender)``, and how often it occurs.

    No two entities of a kind share a surrogate, and none is an entity that occurs. Those that collide, and only
    those and persons of the same surname, are drawn anew until none does; every draw makes them longer or another. The key is a table of a row for each kind.
    """
    spark = mentions.sparkSession
    each = mentions.groupBy("kind", "entity").agg(F.count("*").alias("n"), *[F.count_if(F.col("gender") == g).alias(g) for g in "mf"])
    # a name in capitals is the same person
    same = F.when(F.col("kind") == "PERSON", F.lower("entity")).otherwise(F.col("entity"))
    people = each.groupBy("kind", same.alias("same")).agg(F.sum("m").alias("m"), F.sum("f").alias("f"), F.collect_list(F.struct("entity", "n")).alias("e"))
    gender = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n")
    table = materialize(people.select("kind", F.explode("e").alias("e"), gender.alias("gender")).select("kind", "e.entity", "e.n", "gender", F.lit(0).alias("again")), "entities")
    given = next_given(key)
    keys = [(k, hmac.new(key.encode(), k.encode(), hashlib.sha256).hexdigest(), given if k == "PERSON" else None) for k in PATTERNS]
    keys = F.broadcast(spark.createDataFrame(keys, "kind string, __key string, __given map<string,string>"))  # one row a kind
    new = F.expr(_Sql().surrogate())
    columns = ["kind", "entity", "n", "gender", "again", "s"]
    # all persons of a surname are drawn anew together, so they go on sharing one
    surname = F.when(F.col("kind") == "PERSON", F.lower(F.substring_index("entity", " ", -1))).otherwise(F.col("entity"))
    table = materialize(table.join(keys, "kind").withColumn("s", new).select(*columns), "entities")
    while True:
        hashed = table.where(~F.col("kind").isin(*NUMBERS))
        taken = hashed.groupBy("kind", "s").count().where("count > 1").select("kind", "s").unionByName(hashed.select("kind", F.col("entity").alias("s")))
        bad = hashed.join(taken, ["kind", "s"], "left_semi").select("kind", surname.alias("drawn_by"), F.lit(1).alias("bad"))
        bad = materialize(bad.dropDuplicates(["kind", "drawn_by"]), "collisions", 1)
        if bad.isEmpty():
            return table.select("kind", "entity", "s", "n")
        drawn = table.withColumn("drawn_by", surname).join(bad, ["kind", "drawn_by"], "left").withColumn("again", F.col("again") + F.coalesce("bad", F.lit(0)))
        table = materialize(drawn.join(keys, "kind").withColumn("s", F.when(F.col("bad") == 1, new).otherwise(F.col("s"))).select(*columns), "entities")


def replace_pii(df: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_entities") -> DataFrame:
    """``df`` with every entity in ``text_col`` replaced by its surrogate; ``count_col`` gets the number replaced.

    A null text stays null with 0 entities, an empty one stays empty; every other column and row is kept
    as it is, repeated rows too, whatever their names; a column named as ``count_col`` is replaced. An empty table
    gives an empty table. A text of any length is cut once, and its segments are put together again.
    """
    seg, row = free_name(df, "segments"), free_name(df, "row")
    text = f"`{text_col}`"
    marked = df.withColumn(seg, found(text)).withColumn(row, F.monotonically_increasing_id())
    some = F.size(seg) > 1
    # written once, so the numbers of rows stay; the text of a row with entities lies in its segments
    marked = marked.withColumn(text_col, F.when(~some | F.col(seg).isNull(), F.col(text))).withColumn(seg, F.when(some, F.col(seg)))
    marked = materialize(marked, "segments")
    mentions = (
        marked.where(F.col(seg).isNotNull()).select(F.col(row).alias("row"), F.posexplode(seg).alias("at", "x")).where("at > 0")
        .select("row", "at", "x.kind", F.when(F.col("x.kind") == "EMAIL", F.lower("x.entity")).otherwise(F.col("x.entity")).alias("entity"), "x.gender")
    )
    table = surrogates(mentions, key)
    named = heavy_join(mentions.drop("gender"), table, ["kind", "entity"], "n")
    subs = named.groupBy("row").agg(F.expr("transform(array_sort(collect_list(struct(at, s))), x -> x.s)").alias("subs"))
    subs = subs.select(F.col("row").alias(row), F.col("subs").alias(sub := free_name(df, "subs")))
    whole = F.expr(f"array_join(transform(`{seg}`, (x, i) -> concat(if(i = 0, '', `{sub}`[i - 1]), x.behind)), '')")
    count = (lambda d, c: d.withColumn(count_col, c)) if count_col else (lambda d, c: d)
    fixed = count(marked.where(F.col(seg).isNotNull()).join(subs, row).withColumn(text_col, whole), F.size(seg) - 1)
    rest = count(marked.where(F.col(seg).isNull()), F.lit(0))
    columns = [f"`{c}`" for c in df.columns] + [f"`{count_col}`"] * bool(count_col and count_col not in df.columns)
    return fixed.select(*columns).unionByName(rest.select(*columns))

"""Text rules as columns. Nothing here runs Python on rows unless the docstring says so."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters that references are compared without.
ACCENTED, PLAIN = "áéíóúüñ", "aeiouun"


def human_over_machine(human: Column, machine: Column) -> Column:
    """The person's value unless it is null or empty."""
    return F.coalesce(F.nullif(human, F.lit("")), machine)


def matching(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def without_accents(text: Column) -> Column:
    """Letters of ACCENTED as those of PLAIN; translating takes each letter on its own, so only texts that hold one are translated."""
    return F.when(text.rlike(f"[{ACCENTED}]"), F.translate(text, ACCENTED, PLAIN)).otherwise(text)


def count_of(text: Column, others: str) -> Column:
    """How many characters a text has but for those that the class `others` (with its repetition, as `\\s+`) matches: runs are dropped, which takes fewer matches than counting."""
    return F.length(F.regexp_replace(text, others, ""))


def any_pattern(patterns: tuple[str, ...]) -> str:
    """One pattern that is found where any of them is; what begins at a word's edge is looked for only there."""
    edge = [p[2:] for p in patterns if p.startswith(r"\b")]
    rest = [p for p in patterns if not p.startswith(r"\b")]
    return "|".join(([r"\b(?:" + "|".join(f"(?:{p})" for p in edge) + ")"] if edge else []) + [f"(?:{p})" for p in rest])


def any_literal(terms: tuple[str, ...]) -> str:
    """One pattern that is found in just the texts that hold one of the terms: a tree by letters, without terms that hold another."""
    least = sorted(t for t in set(terms) if not any(u != t and u in t for u in terms))

    def tree(tails: list[str]) -> str:
        if "" in tails:
            return ""
        heads = sorted({t[0] for t in tails})
        parts = [re.escape(h) + tree([t[1:] for t in tails if t[0] == h]) for h in heads]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return tree(least)


def nfc(text: Column) -> Column:
    """Unicode NFC, which Spark lacks; in Python, by Arrow batch."""

    @F.pandas_udf("string")
    def normalised(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return normalised(text)


def folded(text: Column) -> Column:
    """Case-folded NFKD without combining marks, white space collapsed; in Python, by Arrow batch."""

    def fold(t: str | None) -> str | None:
        if t is None:
            return None
        kept = "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c))
        return " ".join(kept.split())

    @F.pandas_udf("string")
    def fold_all(texts: pd.Series) -> pd.Series:
        return texts.map(fold)

    return fold_all(text)


def tidy_lines(text: Column) -> Column:
    """NFC, CRLF and CR as LF, no white space at line ends, at most one empty line in a row, no character of category C but line ends, trimmed; null is empty.

    In Python, by Arrow batch, for NFC and for white space as Unicode has it.
    """

    def tidy(t: str | None) -> str:
        t = unicodedata.normalize("NFC", t or "").replace("\r\n", "\n").replace("\r", "\n")
        t = re.sub(r"\n{3,}", "\n\n", "\n".join(map(str.rstrip, t.split("\n"))).strip())
        odd = {c for c in set(t) if c != "\n" and unicodedata.category(c)[0] == "C"}
        return t.translate(dict.fromkeys(map(ord, odd))).strip() if odd else t

    @F.pandas_udf("string")
    def tidied(texts: pd.Series) -> pd.Series:
        return texts.map(tidy)

    return tidied(text)


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a pipe; null parts are empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def name_uuid(namespace: str, name: Column) -> Column:
    """UUID version 5 of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def has_term(text: Column, term: str) -> Column:
    """Whether the term stands in the text as whole words, in any case."""
    quoted = "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in term.lower())
    return F.lower(text).rlike(rf"(?:^|[^\p{{L}}\p{{N}}_]){quoted}(?:[^\p{{L}}\p{{N}}_]|$)")


def upper_ratio(line: Column) -> Column:
    """Upper-case letters / letters; 0 without letters."""
    letters = F.regexp_count(line, F.lit(r"\p{L}"))
    return F.when(letters == 0, 0.0).otherwise(F.regexp_count(line, F.lit(r"\p{Lu}")) / letters)


def excerpt(text: Column, at: Column, before: int, after: int) -> Column:
    """Characters around a 1-based place, cut at the text's ends."""
    start = F.greatest(at - before, F.lit(1))
    return F.substring(text, start, at + after - start)


def item_number(raw: Column) -> Column:
    """`01.2.` -> `1.2`: dotted numbers without leading zeros; null for anything else."""
    parts = F.split(F.regexp_replace(F.trim(raw), r"\.$", ""), r"\.")
    plain = F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"^0+(?=.)", "")), ".")
    return F.when(F.trim(raw).rlike(r"^\d+(\.\d+)*\.?$"), plain)


def item_parent(number: Column) -> Column:
    return F.when(number.contains("."), F.regexp_replace(number, r"\.[^.]*$", ""))


def item_depth(number: Column) -> Column:
    return F.size(F.split(number, r"\."))


#: Characters in which words are looked for first.
BEGINNING = 400


def readable(text: Column) -> Column:
    """At least four distinct alphabetic words, letters 45 % of visible characters, no U+FFFD, no odd control characters."""
    tokens = lambda x: F.size(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"(\p{L}+)"), F.lit(1))))
    # most texts show their words in the beginning, of which the last may be cut
    many = (tokens(F.substring(text, 1, BEGINNING)) > 4) | (tokens(text) >= 4)
    visible, letters = count_of(text, r"\s+"), count_of(text, r"\P{L}+")
    clean = ~text.rlike("[�\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]")
    return many & (letters >= visible * 0.45) & clean


def html_text(html: Column) -> Column:
    """Text of a page: no script, style or comment, tags as spaces, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


#: What a plain number in a sheet looks like.
NUMBER = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"


def csv_safe(cell: Column, numeric: bool = False) -> Column:
    """Cells that a spreadsheet would run as a formula get an apostrophe before them: such as begin with = + - @, a tab or a CR. Plain numbers in a numeric column stay."""
    risky = cell.rlike(r"^[=+\-@\t\r]")
    risky = risky & ~cell.rlike(NUMBER) if numeric else risky
    return F.when(risky, F.concat(F.lit("'"), cell)).otherwise(cell)


def locator_identity(text: Column) -> Column:
    """By what places are told apart: NFKC, white space collapsed, case-folded; in Python, by Arrow batch."""

    @F.pandas_udf("string")
    def identity(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())

    return identity(text)


def locator(text: Column) -> Column:
    """`page:3|lines:4-9` as a map."""
    return F.str_to_map(text, F.lit(r"\|"), F.lit(":"))


#: What units measure.
UNIT_KINDS = {
    "PIEZA": "COUNT", "PIEZAS": "COUNT", "PZA": "COUNT", "PZAS": "COUNT", "UNIDAD": "COUNT", "UNIDADES": "COUNT", "EQUIPO": "COUNT", "EQUIPOS": "COUNT", "JUEGO": "COUNT", "JUEGOS": "COUNT",
    "SERVICIO": "SERVICE", "SERVICIOS": "SERVICE", "LOTE": "LOT", "LOTES": "LOT", "PERSONA": "PERSONNEL", "PERSONAS": "PERSONNEL", "TECNICO": "PERSONNEL", "TECNICOS": "PERSONNEL",
    "DIA": "DURATION", "DIAS": "DURATION", "HORA": "DURATION", "HORAS": "DURATION", "METRO": "LENGTH", "METROS": "LENGTH", "M": "LENGTH", "M2": "AREA", "M3": "VOLUME", "KG": "MASS", "TON": "MASS",
}


def terminal_quantity(text: Column) -> tuple[Column, Column]:
    """Amount and unit, as they are written, of a final `(12 piezas)`; null without one."""
    pattern = r"\((\d+(?:\.\d+)?)\s+([^()]+?)\)\.?\s*$"
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    part = lambda k: F.nullif(F.trim(F.regexp_extract(plain, pattern, k)), F.lit(""))
    return F.when(part(2).isNotNull(), part(1)), F.when(part(1).isNotNull(), part(2))


def measure_kind(unit: Column) -> Column:
    """What a unit measures, however it is cased or dotted; null for unknown ones."""
    plain = F.replace(F.upper(F.trim(F.regexp_replace(unit, r"\s+", " "))), F.lit("."), F.lit(""))
    return F.element_at(F.create_map(*[F.lit(x) for kv in UNIT_KINDS.items() for x in kv]), plain)


#: Month names in dates.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def spanish_date(text: Column) -> tuple[Column, Column]:
    """(date, precision) of the first date written in Spanish or as dd/mm/yyyy: DAY, MONTH, YEAR, or UNKNOWN and null.

    Impossible dates are UNKNOWN.
    """
    t = without_accents(F.lower(text))
    names = "|".join(MONTHS)
    written, joined, slashes = rf"(\d{{1,2}})\s+de\s+({names})\s+(?:de|del)\s+(\d{{4}})", rf"(\d{{1,2}})-({names})-(\d{{4}})", r"(\d{1,2})/(\d{1,2})/(\d{4})"
    number = lambda name: F.nullif(F.array_position(F.lit(list(MONTHS)), name), F.lit(0)).cast("string")
    part = lambda p, k: F.nullif(F.regexp_extract(t, p, k), F.lit(""))
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    month, year = rf"({names})\s+(?:de\s+|del\s+)?(\d{{4}})", r"\b((?:19|20)\d{2})\b"
    full = F.when(t.rlike(written), day(part(written, 3), number(part(written, 2)), part(written, 1)))
    full = full.when(t.rlike(joined), day(part(joined, 3), number(part(joined, 2)), part(joined, 1)))
    full = full.when(t.rlike(slashes), day(part(slashes, 3), part(slashes, 2), part(slashes, 1)))
    has_day = t.rlike(written) | t.rlike(joined) | t.rlike(slashes)
    rest = F.when(t.rlike(month), day(part(month, 2), number(part(month, 1)), F.lit("1"))).when(t.rlike(year), day(part(year, 1), F.lit("1"), F.lit("1")))
    value = F.when(has_day, full).otherwise(rest)
    kind = F.when(value.isNull(), "UNKNOWN").when(has_day, "DAY").when(t.rlike(month), "MONTH").otherwise("YEAR")
    return value, kind

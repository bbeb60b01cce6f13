"""Items of catalogues: rows of tables, headings and numbered blocks in the lines of a page."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import without_accents

ANY_CASE = "(?iu)"
#: Labels of items, and the lines that are items or parts of them.
LABEL, NUMBER, AMOUNT, WORDS = r"(?:PARTIDA|CONCEPTO|I[TÍ]EM|ITEM|NO\.?)", r"[A-Z]?[- ]?\d+(?:\.\d+)*", r"\d+(?:[\.,]\d+)?", r"[A-ZÁÉÍÓÚÑa-záéíóúñ\./ ]"
ROW = rf"^({NUMBER}|PARTIDA\s+\d+)\s*\|\s*([^|]+?)\s*\|\s*({AMOUNT})\s*\|\s*([^|]{{2,}})$"
HEADING, INLINE = rf"^{LABEL}\s*:?\s*({NUMBER})\s*$", rf"^{LABEL}\s*:?\s*({NUMBER})\s*[-:]\s*(.+)$"
BARE, AMOUNT_ONLY = r"^(\d+(?:\.\d+)*)\.?$", rf"^{AMOUNT}$"
AMOUNT_LINE, UNIT_LINE = rf"^(?:CANTIDAD|CANT\.?|QTY)\s*:?\s*({AMOUNT})$", rf"^(?:UNIDAD|U\.?M\.?|UNIT)\s*:?\s*({WORDS}{{2,40}})$"
HEADER_ONLY = r"^(PARTIDA|CONCEPTO|DESCRIPCION|DESCRIPCI[OÓ]N|CANTIDAD|UNIDAD|NO\.?|ITEM|I[TÍ]EM|LICITACI[OÓ]N\s+P[UÚ]BLICA|ANEXO\s+[A-Z0-9\-]+)$"
#: Texts that ask something of bidders, codes and words of norms, a word that says something.
ASKING = r"\b(licitante|participante|oferente|interesado)\b.*\b(deber[aá]|debe|presentar|acreditar|cumplir|entregar)\b"
NORM_CODE, NORM_WORDS, NORM_NUMBER = r"\b(?:NOM|NMX|ISO|IEC|API|ASME|NFPA)[-\s]?[A-Z0-9\-/\.]*\b", ("norma", "normativo", "referencia", "estandar", "standard", "especificacion normativa"), r"^[A-Z]-\d{2,4}$"
TELLING = "[A-Za-zÁÉÍÓÚÑáéíóúñ]{4,}"
#: Words that head a catalogue; lines before an item that may hold them; how many make a catalogue; lines of the longest numbered block.
HEADS, CONTEXT, ENOUGH, LONGEST = ("partida", "concepto", "cantidad", "unidad"), 14, 2, 8
#: Units, in capitals and without dots, as they are counted.
UNITS = {
    "PZA": "PZA", "PIEZA": "PIEZA", "PIEZAS": "PIEZA", "SERVICIO": "SERVICIO", "SERVICIOS": "SERVICIO", "LOTE": "LOTE", "LOTES": "LOTE", "JUEGO": "JUEGO", "JUEGOS": "JUEGO", "KIT": "KIT", "KITS": "KIT", "MES": "MES", "MESES": "MES",
    "DIA": "DIA", "DIAS": "DIA", "DÍA": "DIA", "DÍAS": "DIA", "HORA": "HORA", "HORAS": "HORA", "EVENTO": "EVENTO", "EVENTOS": "EVENTO", "PAQUETE": "PAQUETE", "PAQUETES": "PAQUETE", "UNIDAD": "UNIDAD", "UNIDADES": "UNIDAD",
}
#: Document types in which a numbered block needs an amount and a unit; how sure each kind of item is.
PENALISED = ("NOTICE", "BIDDING_RULES", "ADDENDUM_MODIFICATION", "ADMINISTRATIVE_LEGAL_REQUIREMENTS", "FORM_TEMPLATE")
SURE = {"ROW": 0.95, "INLINE": 0.9, "HEADING": 0.9, "BARE": 0.88}


def clean(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def is_(x: Column, pattern: str) -> Column:
    return x.rlike(ANY_CASE + pattern)


def part(x: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(x, ANY_CASE + pattern, group)


def unit_of(x: Column) -> Column:
    """The unit's name, null for header words and unknown units."""
    known = F.element_at(F.create_map(*[F.lit(v) for kv in UNITS.items() for v in kv]), F.replace(F.upper(x), F.lit("."), F.lit("")))
    return F.when(~is_(x, HEADER_ONLY), known)


def amount_of(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit(".")).try_cast("decimal(28,6)")


def key(x: Column) -> Column:
    return without_accents(F.lower(clean(x)))


def _columns_drift(x: Column) -> Column:
    """Whether a last line is what another column left: up to three words in capitals that are no unit and no amount."""
    return unit_of(x).isNull() & ~x.rlike(AMOUNT_ONLY) & (F.size(F.split(x, " ")) <= 3) & (F.upper(x) == x)


def _numbered(lines: Column) -> tuple[Column, Column, Column]:
    """(description, amount, unit) of the lines under a number: an amount and a unit at the end, in either order of columns."""
    n = F.size(lines)
    last, second = F.get(lines, n - 1), F.get(lines, n - 2)
    at_end, before = F.coalesce(last.rlike(AMOUNT_ONLY), F.lit(False)), (n >= 2) & second.rlike(AMOUNT_ONLY) & unit_of(last).isNull()
    amount = F.when(at_end, last).when(before, second)
    rest = F.when(at_end, F.slice(lines, F.lit(1), F.greatest(n - 1, F.lit(0)))).when(before, F.concat(F.slice(lines, F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(last))).otherwise(lines)
    tail = F.get(rest, F.size(rest) - 1)
    unit = unit_of(tail)
    drop = F.coalesce(unit.isNotNull() | _columns_drift(tail), F.lit(False))
    kept = F.when(drop, F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
    return F.array_join(kept, " "), amount_of(amount), unit


def credible(kind: Column, number: Column, description: Column, amount: Column, unit: Column, context: Column, penalised: Column, lines: Column) -> Column:
    """Whether an item found in this way stands: it says something that isn't asked of bidders and no bare norm, and fits its page."""
    k = key(description)
    norm = (reduce(lambda a, b: a | b, [F.contains(k, F.lit(w)) for w in NORM_WORDS]) | is_(description, NORM_CODE)) & number.rlike(NORM_NUMBER)
    neither = amount.isNull() & unit.isNull()
    bare = (lines > LONGEST) | (context < ENOUGH) | (penalised & (amount.isNull() | unit.isNull())) | ~description.rlike(TELLING)
    return (description != "") & ~is_(description, ASKING) & ~(norm & neither) & ~((kind == "ROW") & neither) & ~((kind == "BARE") & bare)


def items(pages: DataFrame, keys: list[str], text: str, penalised: Column) -> DataFrame:
    """(keys, index, kind, number, description, quantity, unit, first, last, confidence) of pages' items, numbered from 1 in a page.

    Lines are numbered from 1; CR and LF end one each. A ROW has cells between bars; an
    INLINE item stands behind its label and number; a HEADING has its lines below, up to
    the next item, with labelled amount and unit; a BARE number has its lines below, on
    pages that look like a catalogue, unless a heading is open. `penalised` tells
    documents in which a bare item needs an amount and a unit. Null pages have none;
    keys must tell pages apart.
    """
    page = Window.partitionBy(*keys).orderBy("__n")
    # the words of HEADS are found in a text as it is cleaned or not
    held = lambda x: F.transform(F.array(without_accents(F.lower(x))), lambda y: F.transform(F.lit(list(HEADS)), lambda w: F.contains(y, w)))[0]
    catalogue = F.size(F.filter(held(F.col(text)), lambda there: there)) >= ENOUGH
    lines = F.transform(F.split(text, r"[\r\n]"), clean)
    rows = pages.where(F.col(text).isNotNull()).select(*keys, catalogue.alias("__catalogue"), penalised.alias("__penalised"), F.posexplode(lines).alias("__n", "__x")).withColumn("__n", F.col("__n") + 1)
    rows = rows.withColumn("__held", held(F.col("__x")))
    x = F.col("__x")
    number = lambda p: clean(F.regexp_replace(part(x, p, 1), ANY_CASE + rf"^{LABEL}\s*:?\s*", ""))
    row = is_(x, ROW) & ~is_(part(x, ROW, 1), HEADER_ONLY) & ~is_(part(x, ROW, 2), HEADER_ONLY) & ~is_(part(x, ROW, 2), ASKING)
    bare = F.col("__catalogue") & x.rlike(BARE) & F.contains(x, F.lit("."))
    sort = F.when(row, "ROW").when(is_(x, INLINE), "INLINE").when(bare, "BARE").when(is_(x, HEADING), "HEADING")
    seen = reduce(add, [F.coalesce(F.max(F.col("__held")[k].cast("int")).over(page.rowsBetween(-CONTEXT, -1)), F.lit(0)) for k in range(len(HEADS))])
    rows = rows.withColumns({"__sort": sort, "__context": seen})
    open_ = F.last(F.when(F.col("__sort") != "BARE", F.col("__sort")), ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__sort", F.when(~((F.col("__sort") == "BARE") & F.coalesce(open_ == "HEADING", F.lit(False))), F.col("__sort")))
    rows = rows.withColumn("__item", F.count("__sort").over(page)).where("__item > 0")
    header = is_(x, HEADER_ONLY)
    told = rows.groupBy(*keys, "__item").agg(
        F.min("__n").alias("first"), F.max("__n").alias("__end"), F.max(F.when(F.col("__sort").isNotNull() | ~header, F.col("__n"))).alias("__last"), F.max("__sort").alias("kind"), F.max(F.when(F.col("__sort").isNotNull(), x)).alias("__x"),
        F.max(F.when(F.col("__sort").isNotNull(), F.col("__context"))).alias("__context"), F.bool_or("__penalised").alias("__penalised"),
        F.sort_array(F.collect_list(F.when(F.col("__sort").isNull() & (x != "") & ~header, F.struct("__n", "__x"))))["__x"].alias("__lines"),
    )
    kind, lines = F.col("kind"), F.col("__lines")
    # a heading's labelled lines: the first amount, and units up to the first known one
    amounts = F.filter(lines, lambda y: is_(y, AMOUNT_LINE))
    first_amount = F.array_position(lines, F.get(amounts, F.lit(0)))
    known = F.filter(lines, lambda y: is_(y, UNIT_LINE) & unit_of(clean(part(y, UNIT_LINE, 1))).isNotNull())
    first_unit = F.when(F.size(known) > 0, F.array_position(lines, F.get(known, F.lit(0))))
    left = F.filter(lines, lambda y, i: ~((i + 1 == first_amount) & is_(y, AMOUNT_LINE)) & ~(is_(y, UNIT_LINE) & ((i + 1 <= first_unit) | first_unit.isNull())))
    bare_text, bare_amount, bare_unit = _numbered(lines)
    told = told.select(
        *keys, "__item", "kind", "first", "__context", "__penalised",
        F.when(kind == "ROW", number(ROW)).when(kind == "INLINE", number(INLINE)).when(kind == "HEADING", number(HEADING)).otherwise(part(x, BARE, 1)).alias("number"),
        F.when(kind == "ROW", clean(part(x, ROW, 2))).when(kind == "INLINE", clean(part(x, INLINE, 2))).when(kind == "HEADING", F.array_join(left, " ")).otherwise(bare_text).alias("description"),
        F.when(kind == "ROW", amount_of(part(x, ROW, 3))).when(kind == "HEADING", amount_of(part(F.get(amounts, F.lit(0)), AMOUNT_LINE, 1))).when(kind == "BARE", bare_amount).alias("quantity"),
        F.when(kind == "ROW", unit_of(clean(part(x, ROW, 4)))).when(kind == "HEADING", unit_of(clean(part(F.get(known, F.lit(0)), UNIT_LINE, 1)))).when(kind == "BARE", bare_unit).alias("unit"),
        F.when(kind == "BARE", F.col("__end")).when(kind == "HEADING", F.col("__last")).otherwise(F.col("first")).alias("last"),
    )
    lone = (kind == "INLINE") & is_(F.col("description"), HEADER_ONLY)
    fine = credible(kind, F.col("number"), F.col("description"), F.col("quantity"), F.col("unit"), F.col("__context"), F.col("__penalised"), F.col("last") - F.col("first") + 1)
    told = told.where(fine & ~lone)
    index = F.row_number().over(Window.partitionBy(*keys).orderBy("__item"))
    sure = F.element_at(F.create_map(*[F.lit(v) for kv in SURE.items() for v in kv]), kind)
    return told.select(*keys, index.alias("index"), "kind", "number", "description", "quantity", "unit", "first", "last", sure.alias("confidence"))

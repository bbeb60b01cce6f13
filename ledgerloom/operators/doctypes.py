"""What kind of document a text is, by signals in its lines; and the names by which documents refer to each other."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import any_literal, matching, without_accents

#: Signals of each type, in order; the first that a line holds counts for the type.
SIGNALS = {
    "NOTICE": ("convocatoria", "aviso de convocatoria", "aviso de licitacion", "publicacion"),
    "BIDDING_RULES": ("bases de contratacion", "bases de contratación", "pliego de condiciones", "pliego de bases", "bases del proceso"),
    "CLARIFICATION": ("junta de aclaraciones", "aclaraciones", "preguntas y respuestas", "respuestas de aclaracion", "respuestas de aclaraciones"),
    "ADDENDUM_MODIFICATION": ("modificacion", "modificación", "adenda", "adicion", "reforma", "amendment"),
    "TECHNICAL_SPECIFICATION": ("especificaciones técnicas", "especificaciones tecnicas", "especificacion tecnica", "especificaciones particulares", "alcance tecnico"),
    "SCOPE_OF_WORK": ("alcance de los servicios", "alcance del trabajo", "alcance de la obra", "alcance de servicios", "alcance del servicio"),
    "EXECUTION_SCHEDULE": ("programa de ejecucion", "programa de ejecución", "cronograma", "programa general de ejecucion", "programa general de ejecución"),
    "PRICING_SCHEDULE_CATALOG": ("catalogo de conceptos", "catálogo de conceptos", "lista de partidas", "partidas economicas", "partidas económicas", "propuesta economica", "propuesta económica"),
    "QUALIFICATION_REQUIREMENTS": ("requisitos de calificacion", "requisitos de calificación", "experiencia", "perfil profesional", "personal profesional", "perfil tecnico"),
    "ADMINISTRATIVE_LEGAL_REQUIREMENTS": ("requisitos administrativos", "requisitos legales", "cumplimiento legal", "requisitos legales y administrativos"),
    "CONTRACT_DRAFT": ("modelo de contrato", "contrato modelo", "documento contractual", "formato de contrato"),
    "GENERAL_TERMS_CONDITIONS": ("condiciones generales", "terminos y condiciones", "términos y condiciones", "condiciones contractuales"),
    "GUARANTEE_BOND": ("fianza", "garantia", "garantía", "amparo financiero"),
    "FORM_TEMPLATE": ("formato", "modelo de formato", "anexo de formato", "formato de entrega"),
    "INSTRUCTION_GUIDE": ("instructivo", "guia de participacion", "guía de participación", "guia de presentacion", "guía de presentación"),
    "DOCUMENT_PACKAGE": ("paquete documental", "anexos de bases", "anexos de contratación", "documentos del paquete"),
}
#: Weights of a signal by where it stands, the least score of a type, and how many types of their own make a package.
ANCHOR, HEADING_BONUS, EARLY_BONUS, REFERENCE, REFERENCE_LIST, FILENAME, LEAST, PACKAGE = 35, 10, 10, 8, 4, 12, 35, 3
EARLY_PAGES, HEADING_WORDS, SHORT_HEADING, TIGHT, UPPER = 3, 14, 8, 35, 0.6
#: Types that stand on their own in a package.
AUTONOMOUS = (
    "TECHNICAL_SPECIFICATION", "SCOPE_OF_WORK", "EXECUTION_SCHEDULE", "PRICING_SCHEDULE_CATALOG",
    "QUALIFICATION_REQUIREMENTS", "ADMINISTRATIVE_LEGAL_REQUIREMENTS", "CONTRACT_DRAFT", "FORM_TEMPLATE",
)
#: Cues of a mere reference, of a list of contents, and of lines that list.
REFERENCE_CUES = (
    "de acuerdo con", "conforme a", "consulte", "se anexa", "se anexara", "se anexará", "se presentara", "se presentará",
    "debera presentar", "deberá presentar", "ver anexo", "incluye", "incluyen",
)
CONTENTS_CUES = ("indice", "índice", "contenido", "anexos", "tabla de contenido", "relacion de anexos", "relación de anexos")
LISTING = r"^(anexo|anexos|apendice|apéndice|seccion|sección|[0-9]+[.)]|[ivxlcdm]+\.)"
LISTED = (" - ", " : ", "...")
#: Cues that a reference modifies what it names.
MODIFICATION_CUES = ("se modifica", "se sustituye", "se reemplaza", "modificar", "modifica", "sustituye")


def holds_any(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(t)) for t in terms])


def relation_cue(line: Column) -> Column:
    """MODIFIES if the line speaks of a change, else REFERENCES."""
    return F.when(holds_any(without_accents(matching(line)), MODIFICATION_CUES), "MODIFIES").otherwise("REFERENCES")


def occurrences(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, page, type, signal, kind, weight) of every signal of a line.

    REFERENCE_LIST on a page of contents; ANCHOR in a heading that refers to nothing,
    more in short headings and on early pages; else REFERENCE.
    """
    every = [(kind, t) for kind, terms in SIGNALS.items() for t in terms]
    table = F.array(*[F.struct(F.lit(kind).alias("type"), F.lit(t).alias("signal"), F.lit(k).alias("k")) for k, (kind, t) in enumerate(every)])
    # what a line holds is found while the line is at hand: one look for any signal, and for each signal only in lines that hold one
    trimmed = F.filter(F.transform(F.split(text, r"\r\n|[\r\n]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    lines = F.transform(trimmed, lambda x, i: F.struct(i.alias("at"), x.alias("line"), matching(x).alias("norm")))
    listing = lambda x: x["norm"].rlike(LISTING) | holds_any(x["line"], LISTED)
    signal = any_literal(tuple(t for _, t in every))
    rows = pages.select(doc, page, lines.alias("__lines"), holds_any(matching(F.col(text)), CONTENTS_CUES).alias("__cued"))
    rows = rows.select(doc, page, F.filter("__lines", lambda x: x["norm"].rlike(signal)).alias("__some"), (F.col("__cued") & (F.size(F.filter("__lines", listing)) >= 3)).alias("__contents"))
    some = rows.select(doc, page, "__contents", F.explode("__some").alias("l")).select(doc, page, "__contents", "l.at", "l.line", "l.norm")
    held = some.withColumn("__held", F.filter(table, lambda m: F.contains(F.col("norm"), m["signal"])))
    firsts = F.filter("__held", lambda m: ~F.exists("__held", lambda n: (n["type"] == m["type"]) & (n["k"] < m["k"])))
    hits = held.withColumn("m", F.explode(firsts)).select(doc, page, "__contents", "at", "line", "norm", "m.type", "m.signal")

    words = F.size(F.split("norm", " "))
    letters = F.regexp_count("line", F.lit(r"\p{L}"))
    upper = (letters > 0) & (F.regexp_count("line", F.lit(r"\p{Lu}")) >= UPPER * letters)
    shape = F.col("norm").startswith(F.col("signal")) | upper | (F.length("norm") <= F.length("signal") + TIGHT)
    heading = (words <= HEADING_WORDS) & shape & ((F.col("at") <= 2) | (F.col(page) <= EARLY_PAGES) | upper)
    before = F.trim(F.call_function("substring_index", F.col("norm"), F.col("signal"), F.lit(1)))
    refers = holds_any(F.col("norm"), REFERENCE_CUES) | ((before != "") & (F.size(F.split(before, " ")) >= 2))
    kind = F.when(F.col("__contents"), "REFERENCE_LIST").when(heading & ~refers, "ANCHOR").otherwise("REFERENCE")
    anchored = F.lit(ANCHOR) + F.when(words <= SHORT_HEADING, HEADING_BONUS).otherwise(0) + F.when(F.col(page) <= EARLY_PAGES, EARLY_BONUS).otherwise(0)
    weight = F.when(kind == "ANCHOR", anchored).when(kind == "REFERENCE", REFERENCE).otherwise(REFERENCE_LIST)
    return hits.select(doc, page, "type", "signal", kind.alias("kind"), weight.alias("weight"))


def classify(found: DataFrame, docs: DataFrame, doc: str, filename: Column) -> DataFrame:
    """(doc, type, score) of docs, from their occurrences and file names.

    Of the occurrences of a signal the best counts, an anchor before a reference before
    a list, then the heaviest; a type's score is the sum over its signals. The highest
    of LEAST or more wins, ties by name; three anchored types that stand on their own
    make a DOCUMENT_PACKAGE of their scores' sum; else UNKNOWN and 0.
    """
    rank = F.when(F.col("kind") == "ANCHOR", 3).when(F.col("kind") == "REFERENCE", 2).otherwise(1)
    best = found.groupBy(doc, "type", "signal").agg(F.max(F.struct(rank.alias("rank"), "weight")).alias("b"))
    sums = best.groupBy(doc, "type").agg(F.sum("b.weight").alias("score"), F.sum(F.when(F.col("b.rank") == 3, F.col("b.weight")).otherwise(0)).alias("anchored"))
    name = matching(filename)
    named = docs.select(doc, F.explode(F.array_compact(F.array(*[F.when(holds_any(name, terms), F.lit(kind)) for kind, terms in SIGNALS.items()]))).alias("type"))
    both = sums.unionByName(named.withColumns({"score": F.lit(FILENAME).cast("long"), "anchored": F.lit(0).cast("long")})).groupBy(doc, "type").agg(F.sum("score").alias("score"), F.sum("anchored").alias("anchored"))
    strong = (F.col("score") >= LEAST) & (F.col("type") != "DOCUMENT_PACKAGE")
    own = F.col("type").isin(*AUTONOMOUS) & (F.col("anchored") >= LEAST)
    told = both.groupBy(doc).agg(
        F.min(F.when(strong, F.struct((-F.col("score")).alias("s"), "type"))).alias("top"), F.sum(own.cast("int")).alias("own"), F.sum(F.when(own, F.col("anchored")).otherwise(0)).alias("whole")
    )
    package = F.coalesce(F.col("own"), F.lit(0)) >= PACKAGE
    kind = F.when(package, "DOCUMENT_PACKAGE").otherwise(F.coalesce("top.type", F.lit("UNKNOWN")))
    score = F.when(package, F.col("whole")).otherwise(F.coalesce(-F.col("top.s"), F.lit(0)))
    return docs.select(doc).join(told, doc, "left").select(doc, kind.alias("type"), score.cast("long").alias("score"))


def slug(filename: Column) -> Column:
    """A file's name without its ending, lower-cased, without accents; letters, digits and hyphens remain, single spaces between."""
    stem = F.regexp_replace(filename, r"(?<=[^.])\.[^.]*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(without_accents(matching(stem)), r"[^a-z0-9\s-]", " "), r"\s+", " "))


def alias_variants(filename: Column) -> Column:
    """Names under which a file may be cited: its slug, without a leading number, and without a final identifier of three parts or more with a digit."""
    base = slug(filename)
    plain = F.trim(F.regexp_replace(base, r"^\s*\d+[\s.)_-]*", ""))
    tail = F.substring_index(plain, " ", -1)
    identifier = F.contains(plain, F.lit(" ")) & tail.rlike(r"^[a-z0-9]+(-[a-z0-9]+){2,}$") & tail.rlike(r"\d")
    short = F.when(identifier, F.trim(F.regexp_replace(plain, r" [^ ]*$", ""))).otherwise(plain)
    return F.array_distinct(F.filter(F.array(base, plain, short), lambda x: x != ""))


def effective_reference(decision: Column, human_target: Column, status: Column, target: Column) -> tuple[Column, Column]:
    """(status, target) of a reference: a person's decision before the machine's; IGNORED and UNRESOLVED have no target of a person's."""
    human = (decision == "RESOLVE_TO_DOCUMENT") & human_target.isNotNull()
    known = status.isin("AUTO_RESOLVED", "AMBIGUOUS", "UNRESOLVED", "IGNORED")
    told = F.when(decision == "IGNORE_REFERENCE", "IGNORED").when(decision == "MARK_UNRESOLVED", "UNRESOLVED").when(human, "HUMAN_RESOLVED").when(known, status).otherwise("UNRESOLVED")
    none = decision.isin("IGNORE_REFERENCE", "MARK_UNRESOLVED")
    return told, F.when(F.coalesce(none, F.lit(False)), None).when(human, human_target).when(known, target)

"""Rule tables over texts. Rules are few and fixed, so they are expressions, not joins."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import has_term


def classify(docs: DataFrame, id_col: str, text_col: str, rules: tuple[tuple[str, str, int], ...], least: int) -> DataFrame:
    """id, kind, score: weights of contained terms summed by kind; the highest of at least `least`, ties by name, else UNKNOWN and 0.

    One pass over the text, and no shuffle.
    """
    t = F.lower(text_col)
    kinds = sorted({k for k, _, _ in rules})
    scores = [F.struct((-sum((F.when(F.contains(t, F.lit(term)), w).otherwise(0) for kind, term, w in rules if kind == k), F.lit(0))).alias("s"), F.lit(k).alias("k")) for k in kinds]
    best = F.array_min(F.array(*scores))
    known = -best["s"] >= least
    return docs.select(id_col, F.when(known, best["k"]).otherwise("UNKNOWN").alias("kind"), F.when(known, -best["s"]).otherwise(0).cast("long").alias("score"))


def references(docs: DataFrame, id_col: str, text: Column, pattern: str) -> DataFrame:
    """(id, alias): every match of the pattern's group."""
    return docs.select(id_col, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("alias"))


def profile(text: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """Some include term (or none asked for) and no exclude term, as whole words."""
    hit = reduce(or_, [has_term(text, t) for t in include]) if include else F.lit(True)
    bad = reduce(or_, [has_term(text, t) for t in exclude]) if exclude else F.lit(False)
    return hit & ~bad


def url_verdict(url: Column, hosts: tuple[str, ...]) -> Column:
    """SCHEME, HOST, PATH or QUERY, whichever rule an address breaks first; ALLOWED if none."""
    names = "|".join(h.replace(".", r"\.") for h in hosts)
    host = url.rlike(rf"^https://([^/?#]*\.)?({names})([/?#]|$)")
    odd = F.contains(url, F.lit("..")) | url.rlike(r"[\x00-\x20\\]")
    return F.when(~url.startswith("https://"), "SCHEME").when(~host, "HOST").when(odd, "PATH").when(F.contains(url, F.lit("?")), "QUERY").otherwise("ALLOWED")


def cascade(text: Column, steps: tuple[tuple[str, str], ...], default: str = "UNKNOWN") -> Column:
    """The first code whose pattern the text meets."""
    out = F.lit(default)
    for code, pattern in reversed(steps):
        out = F.when(text.rlike(pattern), code).otherwise(out)
    return out


def profile_hits(fields: dict[str, Column], terms: tuple[str, ...], synonyms: dict[str, tuple[str, ...]]) -> Column:
    """(term, matched, field, kind) of every term that a field holds as whole words: EXACT, or SYNONYM by way of a group that the term belongs to."""
    hits = []
    for term in terms:
        group = [term]
        for canonical, related in synonyms.items():
            if term.lower() in {t.lower() for t in (canonical, *related)}:
                group += [canonical, *related]
        for candidate in dict.fromkeys(group):
            kind = "EXACT" if candidate.lower() == term.lower() else "SYNONYM"
            for name, text in fields.items():
                hit = F.struct(F.lit(term).alias("term"), F.lit(candidate).alias("matched"), F.lit(name).alias("field"), F.lit(kind).alias("kind"))
                hits.append(F.when(has_term(F.coalesce(text, F.lit("")), candidate), hit))
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<struct<term:string,matched:string,field:string,kind:string>>")


def profile_match(fields: dict[str, Column], include: tuple[str, ...], exclude: tuple[str, ...], synonyms: dict[str, tuple[str, ...]], *restrictions: tuple[Column, str]) -> Column:
    """struct(matched, included, excluded, restrictions): matched without a restriction and an excluded term, and with an included one if any is asked for."""
    yes, no = profile_hits(fields, include, synonyms), profile_hits(fields, exclude, synonyms)
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for bad, code in restrictions])) if restrictions else F.array().cast("array<string>")
    matched = (F.size(broken) == 0) & (F.size(no) == 0) & ((F.size(yes) > 0) | F.lit(not include))
    return F.struct(matched.alias("matched"), yes.alias("included"), no.alias("excluded"), broken.alias("restrictions"))

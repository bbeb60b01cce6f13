"""Records as they are kept and shown: overlays, snapshots, lookups, backfills, audits and scores against what was expected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.rollup import ratio


def shown(df: DataFrame, active: str, include_historical: bool = False) -> DataFrame:
    """Active rows, or all if history is asked for."""
    return df if include_historical else df.where(F.coalesce(active, F.lit(False)))


def with_status(rows: DataFrame, reviews: DataFrame, key: str, status: str, wanted: list[str] | None = None, default: str = "PENDING") -> DataFrame:
    """rows with their review's status, `default` without one; only such as have a wanted status, if any is wanted."""
    r = reviews.select(F.col(key).alias("__k"), F.col(status).alias("__s"))
    told = rows.join(r, F.col(key) == F.col("__k"), "left").withColumn(status, F.coalesce("__s", F.lit(default))).drop("__k", "__s")
    return told.where(F.col(status).isin(wanted)) if wanted else told


def overlaid(prior: dict[str, Column], defaults: dict[str, Column], changes: dict[str, Column], known: Column) -> dict[str, Column]:
    """Each field's value: a change, else what was there before; on the first write a default comes before nothing. Null changes change nothing."""
    return {f: F.coalesce(changes.get(f, F.lit(None)), F.when(known, old).otherwise(F.coalesce(defaults.get(f, F.lit(None)), old))) for f, old in prior.items()}


def canonical(fields: dict[str, Column]) -> Column:
    """JSON of the fields in order of their names, nulls included: the same for the same values in whatever order they come."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def sealed(df: DataFrame, fields: list[str], name: str = "seal") -> DataFrame:
    """df with the SHA-256 of the fields' canonical JSON."""
    return df.withColumn(name, F.sha2(canonical({f: F.col(f) for f in fields}), 256))


def broken_seals(df: DataFrame, fields: list[str], name: str = "seal") -> DataFrame:
    """Rows whose payload no longer gives the seal they were stored with, which every read should look for."""
    return sealed(df, fields, "__seal").where(~F.col("__seal").eqNullSafe(F.col(name))).drop("__seal")


def conflicts(rows: DataFrame, page: str, kind: str, value: str) -> DataFrame:
    """(page, kind, a, b, rows) of every two different values of one kind on one page; equal values are one, with their rows counted, so copies make no pairs."""
    once = rows.where(F.col(value).isNotNull()).groupBy(page, kind, value).agg(F.count("*").alias("__n"))
    a, b = once.select(page, kind, F.col(value).alias("a"), F.col("__n").alias("__x")), once.select(page, kind, F.col(value).alias("b"), F.col("__n").alias("__y"))
    return a.join(b, [page, kind]).where("a < b").select(page, kind, "a", "b", (F.col("__x") + F.col("__y")).alias("rows"))


def latest_artifact(artifacts: DataFrame, lineage: list[str], times: list[str], key: str) -> DataFrame:
    """One artifact a lineage, the latest by its times (none before any), then by key; artifacts without a whole lineage all stay."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in lineage])
    order = [*[F.desc_nulls_last(t) for t in times], F.desc(key)]
    place = F.row_number().over(Window.partitionBy(*lineage).orderBy(*order))
    return artifacts.where(whole).withColumn("__p", place).where("__p = 1").drop("__p").unionByName(artifacts.where(~whole))


def best_by(rows: DataFrame, keys: list[str], primary: str, *quality: Column) -> DataFrame:
    """(keys, primary): of each group the row whose quality is highest, part by part; ties to the smallest id."""
    return rows.groupBy(*keys).agg(F.min_by(primary, F.struct(*[(-q.cast("double")).alias(f"q{k}") for k, q in enumerate(quality)], F.col(primary))).alias(primary))


def backfilled(df: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """df with each named column set where its condition holds; all conditions see the rows as they were."""
    return df.withColumns({c: F.when(condition, value).otherwise(F.col(c)) for c, (condition, value) in rules.items()})


def measured(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, total (NULL as soon as one value is unknown), state (MEASURED or NOT_MEASURED) and `values`: the known values in order, each once with its count."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    known = F.col(value).isNotNull()
    unknown = F.sum(F.when(~known, F.col("__n")).otherwise(0))
    total = F.sum(F.when(known, F.col(value) * F.col("__n")))
    listed = F.array_sort(F.collect_list(F.when(known, F.struct(F.col(value).alias("value"), F.col("__n").alias("n")))))
    return counts.groupBy(*keys).agg(F.sum("__n").alias("n"), F.when(unknown == 0, total).alias("total"), F.when(unknown == 0, "MEASURED").otherwise("NOT_MEASURED").alias("state"), listed.alias("values"))


def golden_scores(cases: DataFrame, keys: list[str], passed: str, negative: str, leaked: str, elapsed: str) -> DataFrame:
    """keys, cases, pass rates of positive and of negative cases (null over none), leaks, and elapsed total, mean and maximum."""
    is_negative, ok = F.col(negative), F.col(passed).cast("int")
    rate = lambda of: ratio(F.sum(F.when(of, ok)), F.sum(of.cast("int")))
    return cases.groupBy(*keys).agg(
        F.count("*").alias("cases"), rate(~is_negative).alias("pass_rate"), rate(is_negative).alias("negative_pass_rate"), F.sum(F.col(leaked).cast("long")).alias("leaks"),
        F.sum(elapsed).alias("elapsed"), F.round(F.avg(elapsed), 4).alias("mean"), F.max(elapsed).alias("longest"),
    )


def findings(checks: list[tuple[str, str, str, DataFrame]]) -> DataFrame:
    """(section, code, severity, n) of checks that found rows: each (section, code, severity, the rows that break it; a row counts as often as its `__times` says, if there is such a column)."""
    told = [rows.agg((F.coalesce(F.sum("__times"), F.lit(0)) if "__times" in rows.columns else F.count("*")).alias("n")).select(F.lit(section).alias("section"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), "n") for section, code, severity, rows in checks]
    return reduce(DataFrame.unionByName, told).where("n > 0")


def page_scores(expected: DataFrame, got: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """keys, expected, found, exact, recall, fidelity: of a page's expected items how many were found, and how many of these with the expected value; null over none."""
    e, g = expected.select(*keys, item, F.col(value).alias("__e")), got.select(*keys, item, F.col(value).alias("__g")).dropDuplicates([*keys, item])
    met = e.join(g.withColumn("__hit", F.lit(True)), [*keys, item], "left")
    hit = F.coalesce("__hit", F.lit(False))
    sums = met.groupBy(*keys).agg(F.count("*").alias("expected"), F.sum(hit.cast("long")).alias("found"), F.sum((hit & F.col("__e").eqNullSafe(F.col("__g"))).cast("long")).alias("exact"))
    return sums.withColumns({"recall": ratio(F.col("found"), F.col("expected")), "fidelity": ratio(F.col("exact"), F.col("found"))})

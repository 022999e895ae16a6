"""Schema alignment, category codes, target encoding and imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import quantiles, running_sums


def expanding_target_encoding(df: DataFrame, category: str, y: str, smoothing: float = 20.0, rix: str = "rix", out: str = "te") -> DataFrame:
    """Mean of earlier rows of the same category, shrunk to the mean of all rows; a
    missing category, and a first row, get that mean. ``rix`` numbers the rows."""
    mean = df.agg(F.avg(y)).first()[0]  # one number
    g, s = F.lit(mean), F.lit(float(smoothing))
    unknown = df.where(F.col(category).isNull()).withColumn(out, g)
    seen = {"_sum": F.coalesce(F.col(y).cast("double"), F.lit(0.0)), "_count": F.col(y).isNotNull().cast("long")}
    known = running_sums(df.where(F.col(category).isNotNull()), category, rix, seen)
    te = F.when(F.col("_count") == 0, g).otherwise((F.col("_sum") + s * g) / (F.col("_count") + s))
    return known.withColumn(out, te).select(*df.columns, out).unionByName(unknown.select(*df.columns, out))


def category_stats(df: DataFrame, category: str, y: str) -> DataFrame:
    return df.where(F.col(category).isNotNull()).groupBy(category).agg(F.sum(y).alias("sum"), F.count(y).alias("count"))


def target_encoding(train: DataFrame, valid: DataFrame, category: str, y: str, smoothing: float = 10.0, out: str = "te") -> DataFrame:
    """Encoding of validation rows from training rows only; unseen categories get the
    training mean."""
    mean = train.agg(F.avg(y)).first()[0]  # one number
    g, s = F.lit(mean), F.lit(float(smoothing))
    stats = category_stats(train, category, y).select(category, ((F.col("sum") + s * g) / (F.col("count") + s)).alias("_te"))
    return valid.join(stats, category, "left").withColumn(out, F.coalesce("_te", g)).drop("_te")


def category_levels(df: DataFrame, column: str) -> DataFrame:
    """(level, code): sorted levels numbered from 0."""
    levels = df.where(F.col(column).isNotNull()).select(F.col(column).alias("level")).distinct()
    return levels.withColumn("code", (F.row_number().over(Window.orderBy("level")) - 1).cast("int"))


def encode_categories(df: DataFrame, levels: DataFrame, column: str, out: str) -> DataFrame:
    """Codes against training levels; missing and unseen are -1."""
    own = levels.withColumnRenamed("level", "_level").withColumnRenamed("code", "_code")
    return df.join(own, F.col(column) == F.col("_level"), "left").withColumn(out, F.coalesce("_code", F.lit(-1))).drop("_level", "_code")


def encode_target(df: DataFrame, levels: DataFrame, column: str, out: str) -> DataFrame:
    """As :func:`encode_categories`, but unseen classes are an error when run."""
    coded = encode_categories(df, levels, column, out)
    return coded.withColumn(out, F.when(F.col(out) < 0, F.raise_error(F.concat(F.lit("unseen class "), F.col(column).cast("string"))).cast("int")).otherwise(F.col(out)))


def unseen_audit(train: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """(column, extra_missing): share of rows whose level training lacks, at least 0."""
    long = lambda d: d.unpivot([], [F.col(c).cast("string").alias(c) for c in columns], "column", "level")
    levels = long(train).where("level IS NOT NULL").distinct().withColumn("_seen", F.lit(True))
    rows = long(other).join(levels, ["column", "level"], "left")
    lost = F.avg(F.coalesce("_seen", F.lit(False)).cast("int").cast("double"))
    own = F.avg(F.col("level").isNotNull().cast("int").cast("double"))
    return rows.groupBy("column").agg(F.round(F.greatest(own - lost, F.lit(0.0)), 4).alias("extra_missing"))


def fit_imputer(train: DataFrame, numeric: list[str], categorical: list[str]) -> dict[str, object]:
    """Exact medians and most frequent values (the least of equally frequent ones)."""
    out: dict[str, object] = {}
    for c in numeric:
        found = quantiles(train, c, [0.5]).first()
        out[c] = found.q0 if found else None
    for c in categorical:
        top = train.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(1).collect()
        out[c] = top[0][c] if top else None
    return out


def impute(df: DataFrame, values: dict[str, object], empty: object = None) -> DataFrame:
    """Fill by fitted values; ``empty`` stands for a column without any."""
    fill = {c: empty if v is None else v for c, v in values.items() if c in df.columns}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items() if v is not None})


def needs_imputation(df: DataFrame, columns: list[str]) -> bool:
    return any(df.agg(*(F.count_if(F.col(c).isNull()) > 0 for c in columns)).first()) if columns else False


def align_frame(reference: DataFrame, other: DataFrame, levels: dict[str, list] | None = None) -> tuple[DataFrame, list[tuple[str, str, str, str]]]:
    """``other`` with the columns, order, types and levels of ``reference``, and the
    changes as (column, issue, detail, severity)."""
    levels, changes = levels or {}, []
    theirs, exprs = dict(other.dtypes), []
    for f in reference.schema.fields:
        kind = f.dataType.simpleString()
        if f.name not in theirs:
            changes.append((f.name, "missing column", "filled with null", "ANOMALY"))
            col: Column = F.lit(None).cast(kind)
        elif theirs[f.name] != kind:
            changes.append((f.name, "type", f"{theirs[f.name]} to {kind}", "normal" if f.name in levels else "ANOMALY"))
            col = F.expr(f"try_cast(`{f.name}` AS {kind})")
        else:
            col = F.col(f.name)
        if f.name in levels:
            changes.append((f.name, "levels", f"{len(levels[f.name])} kept", "normal"))
            col = F.when(col.isin(levels[f.name]), col)
        exprs.append(col.alias(f.name))
    for c in theirs:
        if c not in reference.columns:
            changes.append((c, "extra column", "dropped", "ANOMALY"))
    if [c for c in other.columns if c in reference.columns] != [c for c in reference.columns if c in theirs]:
        changes.append(("*", "order", "as in the reference", "normal"))
    return other.select(*exprs), changes


def assert_same_schema(reference: DataFrame, other: DataFrame, levels: dict[str, list], other_levels: dict[str, list]) -> None:
    if reference.columns != other.columns:
        raise ValueError(f"columns differ: {sorted(set(reference.columns) ^ set(other.columns))}")
    if set(levels) != set(other_levels):
        raise ValueError(f"categorical columns differ: {sorted(set(levels) ^ set(other_levels))}")
    bad = [c for c in levels if list(levels[c]) != list(other_levels[c])]
    if bad:
        raise ValueError(f"levels differ: {bad}")


def diagnose_schema(frames: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(column, split, type or 'absent') wherever the splits disagree."""
    kinds = {k: dict(d.dtypes) for k, d in frames.items()}
    out = []
    for c in dict.fromkeys(c for d in frames.values() for c in d.columns):
        own = {k: t.get(c, "absent") for k, t in kinds.items()}
        if len(set(own.values())) > 1:
            out += [(c, k, v) for k, v in own.items()]
    return out


def retype_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rate-like categorical columns back to numbers."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in columns})

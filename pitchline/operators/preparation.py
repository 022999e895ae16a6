"""Relational preparation of match tables: targets, 90-minute scores, splits, columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rebuilt total -> its two halves.
HALVES = {
    "home_total_corners": ("home_1st_corners", "home_2nd_corners"),
    "away_total_corners": ("away_1st_corners", "away_2nd_corners"),
    "home_total_cards": ("home_1st_yellow_cards", "home_2nd_yellow_cards"),
    "away_total_cards": ("away_1st_yellow_cards", "away_2nd_yellow_cards"),
    "home_total_shots": ("home_1st_total_shots", "home_2nd_total_shots"),
    "away_total_shots": ("away_1st_total_shots", "away_2nd_total_shots"),
}
# A column whose name holds one of these is no feature.
LEAKY_PARTS = ("pct_goals_last_10", "pct_blocks", "tactics", "pen", "luck", "xi", "id")


def rebuild_totals(matches: DataFrame, halves: dict[str, tuple[str, str]] = HALVES) -> DataFrame:
    """Totals as the sum of two halves; a raw total of that name goes first, a missing
    half gives a missing total. Running it again changes nothing."""
    known = {t: h for t, h in halves.items() if set(h) <= set(matches.columns)}
    return matches.drop(*known).withColumns({t: F.col(a) + F.col(b) for t, (a, b) in known.items()})


def goals_in_90(events: DataFrame, shots: DataFrame) -> DataFrame:
    """(match_id, team_id, goals_90, goals): goals by team, those within 90 minutes too.

    A goal counts as within 90 if its minute is at most 90, or if it is past 90 only by
    its added time. Of goals of one match, team, player, minute and added time the first
    event stands. A missing minute is not within 90; a missing team is a group."""
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    goals = events.where("event_type = 'goal'").join(shots.select("event_id", "added_time"), "event_id", "left")
    goals = goals.withColumns({"minute": number("minute"), "added_time": number("added_time")})
    same = Window.partitionBy("match_id", "team_id", "player_id", "minute", "added_time").orderBy("event_id")
    goals = goals.withColumn("k", F.row_number().over(same)).where("k = 1")
    within = (F.col("minute") <= 90) | ((F.col("minute") > 90) & (F.col("minute") - F.col("added_time") == 90))
    return goals.groupBy("match_id", "team_id").agg(F.sum(F.coalesce(within, F.lit(False)).cast("long")).alias("goals_90"), F.count("event_id").alias("goals"))


def score_90(matches: DataFrame, events: DataFrame, shots: DataFrame) -> DataFrame:
    """Scores after 90 minutes from goal events, with flags.

    Adds home/away_et_goals, tiene_eventos (any event), eventos_cuadran (as many goals as the
    score says)
    and home/away_score_90 = max(score - extra-time goals, 0) where the match has events,
    else the raw score. Missing team keys match each other."""
    made = ["home_et_goals", "away_et_goals", "tiene_eventos", "eventos_cuadran", "home_score_90", "away_score_90"]
    out, counts = matches.drop(*made), goals_in_90(events, shots)
    for side in ("home", "away"):
        c = counts.select(F.col("match_id").alias("_m"), F.col("team_id").alias("_t"), F.col("goals_90").alias(f"_{side}_90"), F.col("goals").alias(f"_{side}_all"))
        out = out.join(c, (F.col("match_id") == F.col("_m")) & F.col(f"{side}_team_id").eqNullSafe(F.col("_t")), "left").drop("_m", "_t")
        out = out.fillna(0, [f"_{side}_90", f"_{side}_all"]).withColumn(f"{side}_et_goals", F.col(f"_{side}_all") - F.col(f"_{side}_90"))
    seen = events.select(F.col("match_id").alias("_m")).distinct().withColumn("_seen", F.lit(True))
    out = out.join(seen, F.col("match_id") == F.col("_m"), "left").withColumn("tiene_eventos", F.coalesce("_seen", F.lit(False)))
    match = (F.col("_home_all") == F.col("home_score")) & (F.col("_away_all") == F.col("away_score"))
    out = out.withColumn("eventos_cuadran", F.coalesce(match, F.lit(False)))
    for side in ("home", "away"):
        kept = F.greatest(F.col(f"{side}_score") - F.col(f"{side}_et_goals"), F.lit(0).cast("long"))
        out = out.withColumn(f"{side}_score_90", F.when(F.col("tiene_eventos"), kept).otherwise(F.col(f"{side}_score")))
    return out.select(*[c for c in matches.columns if c not in made], *made)


def clean_key_missing(df: DataFrame, keys: tuple[str, ...] = ("home_score", "away_score")) -> DataFrame:
    return df.na.drop(subset=list(keys))


def split_by_season(df: DataFrame, splits: dict[str, list[str]], season: str = "name", tournaments: list[str] | None = None) -> DataFrame:
    """One frame with a ``split`` column; rows of no split go. Filters reach the scan."""
    if tournaments is not None:
        df = df.where(F.col("tournament").isin(tournaments))
    split: Column | None = None
    for name, seasons in splits.items():
        split = (F.when if split is None else split.when)(F.col(season).isin(seasons), name)
    return df.where(F.col(season).isin([s for x in splits.values() for s in x])).withColumn("split", split)


def label_1x2(home: Column, away: Column) -> Column:
    """0 draw, 1 home, 2 away; missing scores fall to 2."""
    return F.when(home == away, 0).when(home > away, 1).otherwise(2)


@dataclass(frozen=True)
class ColumnPolicy:
    """Which columns are no features: named ones, and those whose name holds a part."""

    exclude: tuple[str, ...] = ()
    leaky: tuple[str, ...] = ()
    parts: tuple[str, ...] = LEAKY_PARTS
    targets: tuple[str, ...] = field(default=())

    def apply(self, columns: list[str], target: str | list[str]) -> tuple[list[str], list[str], list[str]]:
        """(excluded, leaky, targets), without repeats, in order."""
        targets = [target] if isinstance(target, str) else list(target)
        by_part = [c for c in columns if any(p in c for p in self.parts) and c not in targets]
        leaky = dict.fromkeys([*self.leaky, *by_part, *self.targets])
        return list(dict.fromkeys(self.exclude)), [c for c in leaky if c not in targets], targets


def low_cardinality(df: DataFrame, columns: list[str], below: int = 20) -> DataFrame:
    """(column, n_distinct, categorical) of each column, in one pass."""
    counts = df.agg(*(F.count_distinct(F.col(c)).alias(c) for c in columns))
    long = counts.unpivot([], columns, "column", "n_distinct")
    return long.withColumn("categorical", F.col("n_distinct") < below)


def prepare_xy(df: DataFrame, drop: list[str], target: str | list[str], category_map: dict[str, list] | None = None, always: tuple[str, ...] = ("tournament",), below: int = 20) -> tuple[DataFrame, dict[str, list]]:
    """Features and targets, and the levels of the categorical features. With a map from
    training the same columns are categorical and unseen levels become null."""
    targets = [target] if isinstance(target, str) else list(target)
    gone = {c for c in dict.fromkeys(drop) if c in df.columns} - set(targets)
    out = df.drop(*gone)
    names = [c for c in out.columns if c not in targets]
    if category_map is None:
        few = [r["column"] for r in low_cardinality(out, names, below).where("categorical").collect()] if names else []
        cats = [c for c in names if c in few or c in always]
        levels = out.agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in cats)).first() if cats else None  # under ``below`` levels, and the tournaments
        category_map = {c: list(levels[c]) for c in cats}
    seen = {c: F.when(F.col(c).isin(v), F.col(c)) if v else F.lit(None) for c, v in category_map.items() if c in out.columns}
    return out.withColumns(seen), category_map


def drop_temporal(df: DataFrame) -> DataFrame:
    return df.drop(*[n for n, t in df.dtypes if t in ("date", "timestamp", "timestamp_ntz")])

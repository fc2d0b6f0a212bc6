"""Registries of sources: which entries are refused, and why. Many registries may be judged at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corkboard.functions.storage import stored
from corkboard.functions.text import normal_path

# Kinds and modes of a source, characters and bytes of its name.
TYPES, MODES, MOST_NAME_BYTES = ["folder", "file", "git-worktree"], ["read_only", "proposable", "appliable"], 128
NAME = r"\A[A-Za-z0-9._-]+\z"


def judged(entries: DataFrame, types: list[str] | None = None, modes: list[str] | None = None, most_name_bytes: int = MOST_NAME_BYTES) -> DataFrame:
    """entries (registry, position, name, type, root, mode, include_paths: array, found: what there is at root, one of folder, file,
    link, or null) with `reason`, the first that holds: missing_key for a null name, type, root or mode; remote for one with
    `://`; bad_name, long_name; duplicate_name and name_collision for a name, or a name in another case, that an entry before has;
    unknown_type, unknown_mode; relative_root; root_is_link, root_missing, root_not_file, root_not_folder; no_allowlist for an
    appliable source without one, appliable_file; and overlapping_root where another entry of the registry that is sound so far
    has the same root, one above it or one below it; null for entries that stay.

    Roots that overlap are found by looking up each of the folders above a root, so the work grows with the depths of the roots;
    which others an entry overlaps is told by one of them and their number, so nested or equal roots make no pairs."""
    types, modes = types or TYPES, modes or MODES
    own = F.array(*[F.coalesce(c, F.lit("")) for c in ("name", "type", "root", "mode")])
    rows = stored(entries.withColumn("folded", F.lower("name")), "registry")
    first = rows.groupBy("registry", "folded").agg(F.min("position").alias("first"))
    named = rows.groupBy("registry", "name").agg(F.min("position").alias("first_same"))
    met = rows.join(first, ["registry", "folded"], "left").join(named, ["registry", "name"], "left")
    rules = {
        "missing_key": F.col("name").isNull() | F.col("type").isNull() | F.col("root").isNull() | F.col("mode").isNull(),
        "remote": F.exists(own, lambda v: v.contains("://")), "bad_name": ~F.col("name").rlike(NAME), "long_name": F.octet_length("name") > most_name_bytes,
        "duplicate_name": F.col("position") > F.col("first_same"), "name_collision": F.col("position") > F.col("first"),
        "unknown_type": ~F.col("type").isin(types), "unknown_mode": ~F.col("mode").isin(modes), "relative_root": ~F.col("root").startswith("/"),
        "root_is_link": F.col("found") == "link", "root_missing": F.col("found").isNull(), "root_not_file": (F.col("type") == "file") & (F.col("found") != "file"),
        "root_not_folder": (F.col("type") != "file") & (F.col("found") != "folder"),
        "no_allowlist": (F.col("mode") == "appliable") & (F.coalesce(F.size("include_paths"), F.lit(0)) <= 0), "appliable_file": (F.col("mode") == "appliable") & (F.col("type") == "file"),
    }
    met = met.withColumns({"reason": F.coalesce(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]), "at": F.concat(F.lit("/"), normal_path(F.col("root")))})
    met = stored(met.drop("first", "first_same", "folded"), "registry-judged")
    sound = met.filter("reason IS NULL").select("registry", "position", "name", "at")
    roots = sound.groupBy("registry", "at").agg(F.count("*").alias("n"), F.min("position").alias("lowest"), F.min(F.struct("position", "name")).alias("one"), F.max(F.struct("position", "name")).alias("other"))
    parts = F.split("at", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.when(n == 1, "/").otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    climbed = roots.filter("at <> '/'").select("registry", F.col("at").alias("below"), "n", "one", F.explode(above).alias("at"))
    nested = stored(climbed.join(roots.select("registry", "at", F.col("n").alias("n_above"), F.col("one").alias("one_above")), ["registry", "at"]), "nested-roots")
    up = nested.groupBy("registry", F.col("below").alias("at")).agg(F.sum("n_above").alias("n"), F.min("one_above").alias("one"))
    down = nested.groupBy("registry", "at").agg(F.sum("n").alias("n"), F.min("one").alias("one"))
    over = up.unionByName(down).groupBy("registry", "at").agg(F.sum("n").alias("around"), F.min("one").alias("near"))
    told = sound.join(roots.select("registry", "at", "n", "one", "other"), ["registry", "at"]).join(over, ["registry", "at"], "left")
    same = F.when(F.col("n") > 1, F.when(F.col("one.position") == F.col("position"), F.col("other")).otherwise(F.col("one")))
    told = told.select("registry", "position", (F.col("n") - 1 + F.coalesce("around", F.lit(0))).alias("overlaps"), F.coalesce(F.least(same, "near"), same, "near").alias("near")).filter("overlaps > 0")
    out = met.join(told, ["registry", "position"], "left")
    return out.select(*entries.columns, F.when(F.col("overlaps") > 0, "overlapping_root").otherwise(F.col("reason")).alias("reason"), F.coalesce("overlaps", F.lit(0)).alias("overlaps"), F.col("near.name").alias("overlaps_with"))

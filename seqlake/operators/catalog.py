"""File catalogues: names, times, species, resume, detections, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import settled

# Species groups of the published corpus layout.
TOOTHED = (
    "Sperm_Whale Killer_Whale Atlantic_Spotted_Dolphin Bottlenose_Dolphin Clymene_Dolphin Common_Dolphin Frasers_Dolphin "
    "Grampus_Rissos_Dolphin Pantropical_Spotted_Dolphin Rough-Toothed_Dolphin Spinner_Dolphin Striped_Dolphin White-beaked_Dolphin "
    "White-sided_Dolphin Long-Finned_Pilot_Whale Short-Finned_Pacific_Pilot_Whale False_Killer_Whale Melon_Headed_Whale Narwhal Beluga_White_Whale"
).split()
BALEEN = "Humpback_Whale Fin_Finback_Whale Bowhead_Whale Minke_Whale Northern_Right_Whale Southern_Right_Whale".split()
_SPECIES = {"dswp": "Sperm Whale", "esp_orcas": "Orca", "humpback_tsujii": "Humpback Whale", "right_whale": "Right Whale", "kw_pei": "Killer Whale", "mbari": "Unknown (hydrophone)", "dori_orca": "Orca", "dori_orca_full": "Orca"}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_time(name: Column) -> Column:
    """Recording time in a file name: the first ``_`` part that is one, written with or without century."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    full = F.transform(parts, lambda p: F.when(p.rlike(r"^\d{8}T\d{6}Z?$"), F.try_to_timestamp(F.regexp_replace(p, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")).when(p.rlike(r"^\d{12}Z?$"), F.try_to_timestamp(F.concat(F.lit("20"), F.regexp_replace(p, "Z$", "")), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")))
    return F.try_element_at(F.filter(full, lambda t: t.isNotNull()), F.lit(1))


def hour_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH")


def species(source: Column, path: Column) -> Column:
    """Species by source; by folder below ``audio`` or by file name where the source holds several."""
    out = None
    for name, value in _SPECIES.items():
        out = F.when(source == name, value) if out is None else out.when(source == name, value)
    folder = F.regexp_extract(path, r"^(?:.*?/)?audio/([^/]+)", 1)
    name = F.lower(file_name(path))
    sound = F.when(name.contains("sperm") | name.contains("yukusam"), "Sperm Whale").when(name.contains("srkw") | name.contains("orca"), "Orca").otherwise("Unknown (orcasound)")
    return out.when(source == "watkins", F.when(folder == "", "Unknown").otherwise(F.replace(folder, F.lit("_"), F.lit(" ")))).when(source == "orcasound", sound).otherwise("Unknown")


def group_members(files: DataFrame) -> DataFrame:
    """A row for each group a file belongs to: sperm, toothed, baleen. A file may be in several."""
    source, name = F.col("source"), F.lower(file_name(F.col("path")))
    folder = F.regexp_extract("path", r"^(?:.*?/)?audio/([^/]+)", 1)
    has = lambda *words: F.greatest(*[name.contains(w).cast("int") for w in (*words, words[0])]) == 1
    sperm = (source == "dswp") | ((source == "watkins") & (folder == "Sperm_Whale"))
    toothed = source.isin("dswp", "esp_orcas", "dori_orca", "kw_pei") | ((source == "watkins") & folder.isin(*TOOTHED)) | ((source == "orcasound") & has("sperm", "yukusam", "srkw", "orca"))
    baleen = source.isin("humpback_tsujii", "right_whale") | ((source == "watkins") & folder.isin(*BALEEN)) | ((source == "orcasound") & has("humpback"))
    groups = F.filter(F.array(F.when(sperm, "sperm"), F.when(toothed, "toothed"), F.when(baleen, "baleen")), lambda g: g.isNotNull())
    return files.select("*", F.explode(groups).alias("group_name"))


def listing(files: DataFrame, prefix: str, suffix: str = ".flac") -> DataFrame:
    """Non-empty files below a prefix with an ending."""
    return files.where(F.col("path").startswith(prefix) & F.col("path").endswith(suffix) & (F.col("length") > 0))


def in_hours(files: DataFrame, hours: DataFrame) -> DataFrame:
    """Files whose name's hour is among ``hours`` (hour); unreadable names go.

    The hour is settled: the join's filter on it would otherwise sink below
    whatever made the names distinct, and parse a name for each row there.
    """
    keyed = settled(files, "hour", hour_key(file_time(F.col("name"))))
    return keyed.join(hours.select("hour").distinct(), "hour", "left_semi").drop("hour")


def detection_hours(detections: DataFrame, least: float = 0.8) -> DataFrame:
    """Distinct hours with a proportion of ``least`` or more; rows that can't be read are left out."""
    ts = F.try_to_timestamp(F.regexp_replace(F.col("timestamp"), "[\"Z]", "")).cast("timestamp_ntz")
    p = F.expr("try_cast(proportion as double)")
    return detections.where(ts.isNotNull() & (p >= least)).select(hour_key(ts).alias("hour")).distinct()


def remaining(files: DataFrame, done: DataFrame, key: str = "name") -> DataFrame:
    """Files that the ledger doesn't name yet."""
    return files.join(done.select(key).distinct(), key, "left_anti")


def plan_grid(left: DataFrame, right: DataFrame, missing: DataFrame | None = None, keys: list[str] | None = None, most: int = 10_000) -> DataFrame:
    """Every pair with a dimension table of at most ``most`` rows, without the combinations in ``missing``."""
    if right.limit(most + 1).count() > most:
        raise ValueError(f"a grid's right side is a dimension table of at most {most} rows")
    grid = left.join(F.broadcast(right))
    return grid.join(missing, keys, "left_anti") if missing is not None else grid


def until_first_failure(grid: DataFrame, key: list[str], order: str, ok: str) -> DataFrame:
    """Rows of each key up to, and with, the first that fails."""
    from pyspark.sql import Window

    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return grid.withColumn("__ok", F.coalesce(F.min(F.col(ok).cast("int")).over(before), F.lit(1))).where("__ok = 1").drop("__ok")


def sampled(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, in the order of a seeded md5."""
    h = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")))
    return df.withColumn("__h", h).orderBy("__h", key).limit(n).drop("__h")

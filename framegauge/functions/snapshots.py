"""Saved snapshots of six versions, brought to the sixth; and messages of the bus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of version 6, the version from which a field is read, its value before (0 unless named), those
# that may be missing even then, and the other name that the number of dig upgrades had in version 1.
FIELDS = {
    "advance": 1, "ore": 1, "ingots": 1, "digRateUpgradeCount": 1, "pickDamageUpgradeCount": 5, "smelterUpgradeCount": 2, "carryCapacityUpgradeCount": 3,
    "crewSize": 4, "heapLoads": 4, "heapOre": 4, "haulSpeedUpgradeCount": 4, "grabSizeUpgradeCount": 6, "unloadSpeedUpgradeCount": 6, "pickupProgressMs": 4,
    "faceSwingProgress": 1, "smelterProgress": 1, "bagOre": 3, "bagLoads": 3, "haulRemainingMs": 3,
}
BEFORE = {"crewSize": 1.0}
OPTIONAL = ("grabSizeUpgradeCount", "unloadSpeedUpgradeCount")
ALIAS = ("upgradeCount", "digRateUpgradeCount", 1)
VERSION = 6


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def upcast(rows: DataFrame) -> DataFrame:
    """rows(schemaVersion, the fields, upgradeCount) as version 6, and reason: unknown_version or missing_<field>.

    A field must be a finite number from its version on (optional ones have their default otherwise); before, it has its
    default whatever the record says. Rejected records have null fields.
    """
    v = F.col("schemaVersion")
    out, rules = {}, [(F.coalesce(~v.between(1, VERSION), F.lit(True)), "unknown_version")]
    for field, since in FIELDS.items():
        told = _finite(F.col(field).cast("double"))
        if field == ALIAS[1]:
            told = F.when(v == ALIAS[2], _finite(F.col(ALIAS[0]).cast("double"))).otherwise(told)
        default = F.lit(BEFORE.get(field, 0.0))
        out[field] = F.when(v < since, default).otherwise(F.coalesce(told, default) if field in OPTIONAL else told)
        if field not in OPTIONAL:
            rules.append(((v >= since) & told.isNull(), f"missing_{field}"))
    reason = F.coalesce(*(F.when(r, F.lit(c)) for r, c in rules))
    others = [c for c in rows.columns if c not in FIELDS and c not in ("schemaVersion", ALIAS[0])]
    made = rows.withColumn("_reason", reason).withColumns({f"_{c}": e for c, e in out.items()})
    fine = F.col("_reason").isNull()
    return made.select(*others, F.when(fine, VERSION).alias("schemaVersion"), *(F.when(fine, F.col(f"_{c}")).alias(c) for c in FIELDS), F.col("_reason").alias("reason"))


def valid_messages(messages: DataFrame, types: Sequence[str], version: int, commands: DataFrame, catalogue: DataFrame) -> DataFrame:
    """messages(type, schemaVersion, command, upgrade) that are well formed.

    Types must be known and versions equal; a message of type `command` needs a name of commands(name), and one that
    buys (command `buyUpgrade`) an id of catalogue(id).
    """
    rows = messages.filter(F.col("type").isin(*types) & (F.col("schemaVersion") == version))
    rows = rows.join(commands.select(F.col("name").alias("command")).distinct().withColumn("_c", F.lit(True)), "command", "left")
    rows = rows.join(catalogue.select(F.col("id").alias("upgrade")).distinct().withColumn("_u", F.lit(True)), "upgrade", "left")
    fine = (F.col("type") != "command") | (F.col("_c").isNotNull() & ((F.col("command") != "buyUpgrade") | F.col("_u").isNotNull()))
    return rows.filter(fine).select(*messages.columns)

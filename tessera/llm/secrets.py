"""Secrets, by an incremental blob ledger.

Every version of a text is addressed by its SHA-256.  Only (blob, rule version) pairs that the
ledger lacks are scanned, each once; findings join back to every path that holds the blob.

Defined results: a null text is an empty text; empty texts have no findings; repeated rows and
equal texts under several paths share one scan and each get its findings; an empty table gives an
empty result; other columns are left aside.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from . import spans as S
from .store import ship, table

RULE_VERSION = 1
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "pem", "github", "slack", "google", "stripe", "jwt", "urlpass"]
ORDER = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(r"(?ai:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_GATES = ("passw", "secret", "token", "apikey", "api_key")
_RULES = [
    ("pem", "-----BEGIN", re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?")),
    ("github", "gh", re.compile(r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{60,})")),
    ("slack", "xox", re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("google", "AIza", re.compile(r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])")),
    ("stripe", "_live_", re.compile(r"(?<![A-Za-z0-9])[sr]k_live_[A-Za-z0-9]{20,}")),
    ("jwt", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}")),
    ("urlpass", "://", re.compile(r"(?<=://)[A-Za-z0-9._-]{1,64}:[^\s/:@]{4,128}@(?=[A-Za-z0-9])")),
]


def base(text: str) -> list[tuple[str, int, int]]:
    found = []
    low = text.lower()
    if any(g in low for g in _GATES):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def extra(text: str) -> list[tuple[str, int, int]]:
    return [(kind, *m.span()) for kind, gate, rule in _RULES if gate in text for m in rule.finditer(text)]


_FOUND = T.StructType([T.StructField("_blob", T.BinaryType()), *(T.StructField(f"n_{k}", T.LongType()) for k in BASE), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

_LEDGER = T.StructType([*_FOUND.fields, T.StructField("rule_version", T.IntegerType())])


def scan(versions: DataFrame, path: str, text: str = "text", ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of every row of ``versions``, and the ledger rows that this run adds.

    ``ledger`` holds ``_blob, rule_version`` and the findings of earlier runs; pass it with the new rows next time.
    """
    ship(versions.sparkSession)
    v = versions.select(F.col(path).alias("_path"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumns({"_blob": F.unhex(F.sha2("_text", 256)), "_at": F.xxhash64("_path")})
    unseen = v.groupBy("_blob").agg(F.min("_at").alias("_at"))  # one place of each blob to read it from
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == RULE_VERSION).select("_blob"), "_blob", "left_anti")
    # keyed by blob and place, so that a blob in a third of all rows is no hot key; rows that repeat both come down to one before they travel
    repeated = not v.groupBy("_blob", "_at").count().where("count > 1").isEmpty()
    places = v.select("_blob", "_at", "_text")
    todo = (places.dropDuplicates(["_blob", "_at"]) if repeated else places).join(unseen.hint("shuffle_hash"), ["_blob", "_at"], "left_semi")
    found = todo.select("_blob", "_text").mapInArrow(K.tidied(S.scanner(base, extra, BASE, ORDER, ["_blob"], "_text")), _FOUND)
    fresh = table(found.dropDuplicates(["_blob"]).withColumn("rule_version", F.lit(RULE_VERSION)), "secret-ledger")
    known = fresh if ledger is None else fresh.unionByName(ledger.where(F.col("rule_version") == RULE_VERSION).select(*fresh.columns))
    none = S.digest("")
    hits = known.where(F.col("spans") != "")  # most blobs have none: their rows needn't travel
    out = v.select("_path", "_blob").join(hits, "_blob", "left")
    return out.select(
        F.col("_path").alias(path),
        *(F.coalesce(F.col(f"n_{k}"), F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE),
        F.coalesce("base_sha256", F.lit(none)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    ), fresh


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger of earlier runs; None if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(_LEDGER).parquet(folder)


def scan_kept(versions: DataFrame, path: str, folder: str, text: str = "text") -> DataFrame:
    """``scan`` with the ledger in ``folder``: what earlier runs saw isn't scanned again, and what this run scans is added.

    Rows are appended after their scan is written whole, so a run that is lost adds nothing; a blob that two runs
    scan at once stands twice with equal findings, and one is read.
    """
    seen = read_ledger(versions.sparkSession, folder)
    found, fresh = scan(versions, path, text, None if seen is None else seen.dropDuplicates(["_blob", "rule_version"]))
    fresh.write.mode("append").parquet(folder)
    return found

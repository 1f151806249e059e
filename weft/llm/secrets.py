"""Secret scans over an incremental blob ledger.

Each version of a file (here: each row of ``documents``) is a blob, addressed by the SHA-256 of its
text. A ledger holds one row for every (blob, rule version) pair that has been scanned, with what was
found. A scan groups the versions by address, takes the pairs that the ledger lacks, scans each such
text once, appends to the ledger, and joins the findings back to all paths that hold the blob.

Addresses that the ledger holds drop out before texts move: a scan over known versions shuffles addresses
only. Of unseen blobs one text each is shuffled (copies collapse in the map-side aggregate). The join back
carries addresses and findings only; a blob that a third of all paths share is a skewed probe side of
a plain equi-join, which adaptive execution splits.

Defined results: a null text is an empty one and has no findings; repeated rows are paths of one
blob; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, pieces, shared_dir, table, texts, unused, written

RULE_VERSION = "2"
#: Kinds in the order that breaks ties between spans; the first three are the base.
KINDS = ("assign", "access", "hex", "private_key", "jwt", "forge_token", "chat_token", "url_login")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs of hex digits are maximal, so those of 16 and more are the long ones among the matches of [0-9a-f]+.
_HEX = re.compile(r"[0-9a-f]{16,}")
_MORE = (
    ("private_key", "-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x09-\x0D\x20]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", re.A)),
    ("jwt", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.A)),
    ("forge_token", "gh", re.compile(r"\bgh[oprsu]_[A-Za-z0-9]{36,}", re.A)),
    ("chat_token", "xox", re.compile(r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}", re.A)),
    ("url_login", "://", re.compile(r"\b[a-z][a-z0-9+]{1,15}://[^\x09-\x0D\x20:@/]{1,64}:[^\x09-\x0D\x20:@/]{3,64}@[A-Za-z0-9.-]+", re.A)),
)

FOUND = "blob binary, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_FOUND = pa.schema([("blob", pa.binary()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def find(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text as (start, kind's rank, end), sorted; offsets are code points."""
    out = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for kind, hint, rule in _MORE:
        if hint in text:
            rank = KINDS.index(kind)
            out += [(m.start(), rank, m.end()) for m in rule.finditer(text)]
    return sorted(out)


def told(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches):
    for batch in pieces(batches, "text"):
        rows = []
        for text in batch.column("text").to_pylist():
            spans = find(text)
            base = [s for s in spans if s[1] < 3]
            n = [sum(s[1] == k for s in base) for k in range(3)]
            rows.append((*n, hashlib.sha256(told(base).encode()).hexdigest(), told(spans)))
        cols = list(zip(*rows, strict=True))
        yield batch_of(_FOUND, {"blob": batch.column("blob"), **dict(zip(_FOUND.names[1:], cols, strict=True))})


def addressed(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("blob", F.unhex(F.sha2("text", 256)))


def scan_new(docs: DataFrame, ledger: DataFrame | None, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows for the (blob, rule version) pairs of ``docs`` that ``ledger`` lacks."""
    versions = addressed(docs)
    if ledger is not None:
        # Addresses first: texts whose blob the ledger has are never shuffled or sorted. What is unseen is written, so that its size is known to the join.
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob")
        unseen = written(versions.select("blob").distinct().join(seen, "blob", "left_anti"), f"{shared_dir(docs.sparkSession)}/unseen")
        if unseen.isEmpty():
            versions = versions.where(F.lit(False))
        else:
            versions = versions.join(unseen, "blob", "left_semi")
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    return blobs.select("blob", "text").mapInArrow(_scan, FOUND).withColumn("rule_version", F.lit(rule_version))


def scan(docs: DataFrame, ledger_path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings of every path of ``docs``. What is new is scanned and appended to the ledger at ``ledger_path``,
    a Parquet table; a second call over the same or overlapping versions scans only unseen blobs."""
    spark = docs.sparkSession
    ledger = read_ledger(spark, ledger_path)
    scan_new(docs, ledger, rule_version).write.mode("append").parquet(ledger_path)
    seen = read_ledger(spark, ledger_path).where(F.col("rule_version") == rule_version)
    # A task that ran twice in a failed append may have left a pair twice; equal pairs have equal findings.
    if ledger is not None:
        seen = seen.dropDuplicates(["blob"])
    paths = addressed(docs).select("doc_id", "blob")
    return paths.join(seen, "blob", "left").select("doc_id", *_FOUND.names[1:], "blob")


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(f"{FOUND}, rule_version string").parquet(path)


def redacted(docs: DataFrame, ledger_path: str, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and n_chars following; clean rows stay as they are.

    Only rows whose blob has spans pass through Python; overlapping spans are replaced as one."""
    blob, spans = unused(docs, "_blob", "_spans")
    found = scan(docs, ledger_path).where(F.col("spans") != "").select(F.col("blob").alias(blob), F.col("spans").alias(spans)).dropDuplicates([blob])
    names = docs.columns
    cut = F.pandas_udf(lambda t, s: t.combine(s, lambda x, y: cover(x, y, mark)), "string")
    both = docs.withColumn(blob, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).join(found, blob, "left")
    hit = F.col(spans).isNotNull()
    changed = both.where(hit).withColumn("text", cut("text", spans))
    if "n_chars" in names:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return both.where(~hit).select(*names).unionByName(changed.select(*names))


def cover(text: str, spans: str, mark: str) -> str:
    out, at = [], 0
    for a, b in sorted((int(x), int(y)) for _, x, y in (s.split(":") for s in spans.split(","))):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against a ledger that starts empty, kept in the shared folder."""
    return scan(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/ledger").drop("blob")

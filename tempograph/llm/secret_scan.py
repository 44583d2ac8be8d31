"""Secret scans over an incremental blob ledger.

Every version of every text is addressed by its content (a blob). The ledger holds the findings of each pair of
blob and rule version that was ever scanned. A scan takes the blobs that lack a pair, one carrier text each, scans
them under the rules that they lack, appends what it finds, and joins the findings back to all paths that hold the
blob. Each rule has a version of its own, so that a changed rule scans all blobs anew and the others none.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Kinds in the order in which spans of one start are listed: (kind, pattern, group, least length, how Arrow finds the texts that may have one).
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6, r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=]"""),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20, r"AKIA[A-Z0-9]{16}"),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24, r"[0-9a-f]{24}"),
)
#: Further public formats of credentials, added to the base kinds. A key without its END line ends with its last line of base64.
MORE = (
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"), 0, 0, r"eyJ[A-Za-z0-9_-]{8,}\."),
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\x20\t\r\n]*-----END [A-Z ]{0,40}PRIVATE KEY-----|(?:[\x20\t\r\n]{1,4}[A-Za-z0-9+/=]{40,})*)"), 0, 0, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    ("prefixed", re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"), 0, 0, r"(gh[pousr]_|xox[abprs]-|sk_live_)[A-Za-z0-9]"),
)
RULES = BASE + MORE
#: Of the scanner itself; a change scans all blobs under all rules anew.
VERSION = "2"
SPANS = "array<struct<kind:string,start:int,end:int>>"


def versions_of(rules: tuple = RULES) -> dict[str, str]:
    """Each rule's version by its kind: kind, digest, the scanner's own."""
    return {k: f"{k}:{sha256(repr((p.pattern, g, n)).encode()).hexdigest()[:12]}:{VERSION}" for k, p, g, n, _ in rules}


def three_parts(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the jwt rule in linear time: three runs of its letters with a dot between, from the first run's first eyJ on."""
    runs = [m.span() for m in re.finditer(r"[A-Za-z0-9_-]+", text, re.ASCII)]
    k = 0
    while k + 2 < len(runs):
        (start, end), (second, stop), (third, last) = runs[k : k + 3]
        if second == end + 1 and text[end] == "." and third == stop + 1 and text[stop] == "." and stop - second >= 8 and end - (at := text.find("eyJ", start, end)) >= 11 and at >= 0:
            yield at, last
            k += 3
        else:
            k += 1


def matches(text: str, kind: str, rule: re.Pattern, group: int, least: int) -> Iterator[tuple[int, int]]:
    """The places of one rule's matches, from left to right; one that is too short is dropped, and its text stays used."""
    if kind == "jwt":
        return three_parts(text)
    return (m.span() for m in rule.finditer(text) if len(m[group]) >= least)


def find(text: str, kinds: Iterable[tuple] = RULES) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by start, then kind as listed; code points, end exclusive. Time is linear in the text."""
    found = [(start, order, kind, end) for order, (kind, rule, group, least, _) in enumerate(kinds) for start, end in matches(text, kind, rule, group, least)]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def scanner(ids: dict[str, str]):
    """(blob, text, have) to (rules, blob, spans): under the rules whose ids are not in `have`; a linear-time search first tells which of them a text needs."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            likely = [pc.match_substring_regex(batch["text"], r[4]).to_numpy(zero_copy_only=False) for r in RULES]
            lack = [[k for k in ids if ids[k] not in have] for have in batch["have"].to_pylist()]
            spans: list[list] = [[]] * batch.num_rows
            for i in {int(i) for hit in likely for i in hit.nonzero()[0]}:
                spans[i] = [{"kind": k, "start": s, "end": e} for k, s, e in find(batch["text"][i].as_py(), [r for r, hit in zip(RULES, likely, strict=True) if hit[i] and r[0] in lack[i]])]
            yield pa.RecordBatch.from_arrays([pa.array([[ids[k] for k in own] for own in lack], pa.list_(pa.string())), batch["blob"], pa.array(spans, kind)], ["rules", "blob", "spans"])

    return scan


class BlobLedger:
    """Parquet rows (rules, blob, spans) under `path`, a folder that all executors share: what a blob was scanned under, and found."""

    SCHEMA = f"rules array<string>, blob binary, spans {SPANS}"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or common.new_path(spark, "ledger")

    def exists(self) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def rows(self) -> DataFrame:
        """All rows so far. A run that was repeated after a failure may have appended a pair twice; it counts once."""
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if self.exists() else self.spark.createDataFrame([], self.SCHEMA)

    def update(self, versions: DataFrame) -> DataFrame:
        """Scan the blobs of versions(id, text) under the rules under which this ledger has not seen them; (id, blob) of all versions.

        Null text is the empty blob; repeated rows are one blob; an empty table adds nothing.
        """
        ids = versions_of()
        present = F.array(*[F.lit(v) for v in ids.values()])
        paths = versions.select("id", F.unhex(F.sha2(common.text_of(versions), 256)).alias("blob"), common.text_of(versions).alias("text"))
        none = F.array().cast("array<string>")
        if self.exists():
            known = self.rows().groupBy("blob").agg(F.array_intersect(F.flatten(F.collect_list("rules")), present).alias("have"))
            unseen = common.distinct_contents(paths, "blob", known.where(F.size("have") == len(ids))).join(known, "blob", "left")
            unseen = unseen.select("blob", "text", F.coalesce("have", none).alias("have"))
        else:
            unseen = common.distinct_contents(paths, "blob", None).withColumn("have", none)
        unseen.mapInArrow(scanner(ids), self.SCHEMA).dropDuplicates(["blob"]).write.mode("append").parquet(self.path)
        return paths.select("id", "blob")

    def findings(self) -> DataFrame:
        """(blob, spans) under the present rules of the blobs with any, each once; spans by start, then kind as listed."""
        present = F.array(*[F.lit(v) for v in versions_of().values()])
        kinds, order = F.transform(F.array_intersect("rules", present), lambda r: F.substring_index(r, ":", 1)), F.array(*[F.lit(k) for k in versions_of()])
        own = self.rows().where(F.size("spans") > 0).select("blob", F.filter("spans", lambda s: F.array_contains(kinds, s["kind"])).alias("spans"))
        placed = F.transform(F.flatten(F.collect_list("spans")), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind")))
        listed = own.groupBy("blob").agg(F.sort_array(F.array_distinct(placed)).alias("spans")).where(F.size("spans") > 0)
        return listed.select("blob", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))

    def scan(self, versions: DataFrame) -> DataFrame:
        """(id, blob, spans) of versions(id, text), one row a version; null text: empty.

        Repeated rows give repeated rows; an empty table gives none; further columns are left out.
        """
        found = common.joined_back(self.update(versions), "blob", self.findings())
        return found.select("id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def written_spans(spans: str) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a row of documents, through a ledger that is new. Null text: empty, no spans; null and repeated ids stay; an empty table gives none; only doc_id and text are read."""
    docs = common.table(spark, sf_dir, "documents")
    found = BlobLedger(spark).scan(docs.select(F.col("doc_id").alias("id"), "text"))
    base = ", ".join(f"'{k}'" for k, *_ in BASE)
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k, *_ in BASE]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(written_spans(f"filter(spans, s -> s.kind in ({base}))"), 256).alias("base_sha256"), written_spans("spans").alias("spans"))


def redacted(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """The documents with each found span (overlapping ones as one) replaced by `mark` and n_chars to fit; all columns stay. Null text stays null."""
    spark = docs.sparkSession
    ledger = BlobLedger(spark)
    ledger.update(docs.select(F.col("doc_id").alias("id"), "text"))
    found = common.written(ledger.findings(), "secrets")  # its size is known then, and Spark broadcasts it if it is small
    schema = docs.schema

    @F.pandas_udf("string")
    def cover(texts, spans):
        return texts.combine(spans, lambda text, own: text if own is None or text is None else covered(text, [(s["start"], s["end"]) for s in own], mark))

    blob, spans = (common.free_name(docs, n) for n in ("blob", "spans"))
    joined = docs.withColumn(blob, F.unhex(F.sha2(common.text_of(docs), 256))).join(found.select(F.col("blob").alias(blob), F.col("spans").alias(spans)), blob, "left")
    clean = joined.where(F.col(spans).isNull()).select(docs.columns)
    hit = joined.where(F.col(spans).isNotNull()).withColumn("text", cover("text", spans))
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return clean.unionByName(hit.select(docs.columns))


def covered(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])

"""The engine: one object for detection, redaction, audit and restoration, and its SQL names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilum.functions.rules import chosen
from veilum.operators import audit, detect, dictionary, mapstore, placeholders, restore


class Engine:
    """``entries``: a dictionary; ``families``: the rule families in force (None: all)."""

    def __init__(self, entries: Sequence[dictionary.Entry] = (), families=None, heuristics: bool = True, key: str = "doc_id", text: str = "text"):
        chosen(families, heuristics)  # unknown families fail here
        self.entries, self.families, self.heuristics, self.key, self.text = list(entries), families, heuristics, key, text

    def detect(self, docs: DataFrame) -> DataFrame:
        """``docs`` with spans."""
        if not self.entries:
            return detect.with_spans(docs, self.text, None, self.families, self.heuristics)
        found = dictionary.with_hits(docs, self.entries, self.text)
        return detect.with_spans(found, self.text, "hits", self.families, self.heuristics).drop("hits")

    def anonymize(self, docs: DataFrame, tag: str | None = None) -> DataFrame:
        return placeholders.anonymize(self.detect(docs), self.text, tag)

    def check(self, docs: DataFrame) -> DataFrame:
        """key, sensitive, total, truncated, findings."""
        found = self.detect(docs).withColumn("f", audit.findings(F.col(self.text), F.col("spans")))
        return found.select(self.key, (F.col("f.total") > 0).alias("sensitive"), "f.total", "f.truncated", "f.findings")

    def audit(self, docs: DataFrame, reveal: bool = False) -> DataFrame:
        """key, verdict, placeholders, total, types, findings, near (without values unless ``reveal``)."""
        found = self.detect(docs)
        near = audit.near_misses(found, [(e.type, e.surface) for e in self.entries], self.key, self.text)
        fields = ["kind", "type", "line", "similarity", "token_masked", *(["token", "entity"] if reveal else [])]
        listed = near.groupBy(F.col(self.key).alias("__v_key")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("near"))
        joined = found.join(listed, F.col(self.key) == F.col("__v_key"), "left").drop("__v_key")
        n_near = F.coalesce(F.size("near"), F.lit(0))
        types = audit.types_of(F.col("spans"))
        out = joined.withColumn("f", audit.findings(F.col(self.text), F.col("spans"), audit.AUDIT_CAP))
        return out.select(self.key, audit.verdict(F.col("f.total"), F.when(n_near > 0, n_near).otherwise(0)).alias("verdict"), audit.placeholders_present(F.col(self.text)).alias("placeholders"), "f.total", types.alias("types"), "f.findings", F.coalesce("near", F.array().cast(joined.schema["near"].dataType)).alias("near"))

    def restore(self, docs: DataFrame) -> DataFrame:
        """``docs`` (redacted, entries) with restored and its verdict."""
        return restore.restored(docs)

    def folder(self, spark: SparkSession, root: str, maps: str | None = None, out: str | None = None, private: Sequence[str] = (), check: bool = False, dry_run: bool = False) -> str:
        """Redact a folder, or with ``dry_run`` say what would be written, or with ``check`` give verdicts; the report as JSON."""
        from veilum.plans import batch  # which uses this class

        private = [*private, *([maps] if maps else [])]
        if check:
            return batch.report(batch.verdicts(spark, self, root, private), root, check=True)
        if not dry_run and maps is None:
            raise ValueError("a store for the maps is needed")
        taken = mapstore.existing_tags(mapstore.read_maps(spark, maps)[0]) if maps and mapstore.exists(spark, maps) else None
        rows = batch.redactions(spark, self, root, out, private, taken).persist()
        try:
            if not dry_run:
                batch.write(rows, root, maps, out).count()
            return batch.report(rows, root, dry_run=dry_run, out=out)
        finally:
            rows.unpersist()

    def register(self, docs: DataFrame, prefix: str = "") -> None:
        """Temporary views spans, map_entries and redacted over ``docs``."""
        done = self.anonymize(docs)
        detect.exploded(done, self.key).createOrReplaceTempView(f"{prefix}spans")
        placeholders.map_entries(done, self.key).createOrReplaceTempView(f"{prefix}map_entries")
        done.select(self.key, "redacted").createOrReplaceTempView(f"{prefix}redacted")


#: Functions of SQL, in SQL.
FUNCTIONS = {
    "mask_value(v STRING) RETURNS STRING": "concat(substr(v, 1, 1), repeat('•', greatest(length(v) - 1, 0)))",
    "line_of(t STRING, at INT) RETURNS INT": "length(substr(t, 1, at)) - length(translate(substr(t, 1, at), '\\n', '')) + 1",
    "xml_protect(v STRING) RETURNS STRING": "replace(replace(replace(replace(replace(v, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\\'', '&apos;')",
    "base_name(p STRING) RETURNS STRING": "element_at(split(regexp_replace(replace(p, '\\\\', '/'), '/+$', ''), '/'), -1)",
    "tag_collision(n DOUBLE, width INT) RETURNS DOUBLE": "1 - exp(-n * (n - 1) / (2 * power(16, width)))",
    "is_placeholder(v STRING) RETURNS BOOLEAN": "v rlike '^\\\\[[A-Z][A-Z0-9_]*-[0-9]+(-[0-9a-f]{4,8})?\\\\]$'",
}


def register_functions(spark: SparkSession) -> None:
    """Create FUNCTIONS as temporary SQL functions."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

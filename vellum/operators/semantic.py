"""Semantic chunking: sections cut where neighbouring prose segments are least alike, within bounds of size.

Segments are ``source_id, section_no, seg_no, kind, text, n_tokens, embedding``. Similarities, thresholds and the merging of small chunks
are windows and aggregates; only the running size between cuts needs a scan, which holds one number a section. Embeddings are an
input: any table that has a vector a segment will do."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators import chunking

LEAST, MOST, SHARE = 100, 1200, 0.30
SECTION = ("source_id", "section_no")


def segment_table(docs: DataFrame, id_column: str, text: str = "text", most: int = MOST) -> DataFrame:
    """Segments of documents: prose by sentence, table rows, code whole; longer ones in pieces. ``embedding`` is still to be joined."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["id"], pdf["t"], strict=True):
                for s, (heading, body) in enumerate(chunking.sections(t or "")):
                    pieces = [(kind, p) for kind, x in chunking.segments(body) for p in chunking.split_long(kind, x, most)]
                    rows += [(i, s, k, heading, kind, p.replace("\x00", "\n").strip("\n"), chunking.n_tokens(p)) for k, (kind, p) in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["source_id", "section_no", "seg_no", "heading", "kind", "text", "n_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("t")).mapInPandas(run, f"source_id {kind}, section_no int, seg_no int, heading string, kind string, text string, n_tokens int")


def boundaries(segments: DataFrame, share: float = SHARE) -> DataFrame:
    """``segments`` with ``sim``, the cosine of each prose segment to the prose before it (1 elsewhere), and the section's
    ``threshold``: the ``share`` percentile (linear) of its similarities below 1, or -1 without any. Both have 6 digits."""
    w = Window.partitionBy(*SECTION).orderBy("seg_no")
    before = F.lag("embedding").over(w)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(before, before)) * F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    cos = F.when(norm >= 1e-16, dot(before, F.col("embedding")) / norm).otherwise(0.0)
    both = (F.col("kind") == "prose") & (F.lag("kind").over(w) == "prose")
    sim = segments.withColumn("sim", F.when(both & before.isNotNull() & F.col("embedding").isNotNull(), F.round(cos, 6)).otherwise(1.0))
    cut = F.percentile(F.when(F.col("sim") < 1, F.col("sim")), share).over(Window.partitionBy(*SECTION))
    return sim.withColumn("threshold", F.coalesce(F.round(cut, 6), F.lit(-1.0)))


def semantic_groups(segments: DataFrame, least: int = LEAST, most: int = MOST, share: float = SHARE) -> DataFrame:
    """``source_id, section_no, seg_no, chunk_no``: which chunk of its section a segment belongs to.

    A chunk ends before a segment less alike than the threshold, if it has ``least`` tokens, and before one that would take it over
    ``most``. What is then smaller than ``least`` joins the chunk before. Sections of up to two segments or ``least`` tokens stay whole."""
    section = Window.partitionBy(*SECTION)
    rows = boundaries(segments, share).withColumns({"whole": (F.count("*").over(section) <= 2) | (F.sum("n_tokens").over(section) <= least)})
    rows = rows.select(*SECTION, "seg_no", F.col("n_tokens").cast("long").alias("n_tokens"), (F.col("sim") < F.col("threshold")).alias("dips"), "whole")
    kind = rows.schema["source_id"].dataType.simpleString()

    def cut(batches):
        at, size, group = object(), 0, 0
        for batch in batches:
            groups = []
            for s, n, tokens, dips, whole in zip(*(batch.column(c).to_pylist() for c in ("source_id", "section_no", "n_tokens", "dips", "whole")), strict=True):
                if (s, n) != at:
                    at, size, group = (s, n), 0, 0
                elif not whole and ((dips and size >= least) or size + tokens > most):
                    size, group = 0, group + 1
                size += tokens
                groups.append(group)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*SECTION, "seg_no", "n_tokens")), pa.array(groups, pa.int32())], names=[*SECTION, "seg_no", "n_tokens", "g"])

    ordered = rows.repartition(*SECTION).sortWithinPartitions(*SECTION, "seg_no")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("section_no", "seg_no")}
    grouped = ordered.mapInArrow(cut, f"source_id {kind}, section_no {kinds['section_no']}, seg_no {kinds['seg_no']}, n_tokens long, g int")
    size = F.sum("n_tokens").over(Window.partitionBy(*SECTION, "g"))
    opens = ((F.col("g") > 0) & (size >= least) & (F.col("seg_no") == F.min("seg_no").over(Window.partitionBy(*SECTION, "g")))).cast("int")
    return grouped.withColumn("opens", opens).select(*SECTION, "seg_no", F.sum("opens").over(Window.partitionBy(*SECTION).orderBy("seg_no")).cast("int").alias("chunk_no"))


def semantic_chunks(segments: DataFrame, least: int = LEAST, most: int = MOST, share: float = SHARE) -> DataFrame:
    """``source_id, section_no, chunk_no, chunk_index, heading, chunk_text, chunk_type, n_tokens``: the chunks, numbered through each source.
    Prose follows prose after a space, all else on a new line."""
    keys = [*SECTION, "chunk_no"]
    rows = segments.join(semantic_groups(segments, least, most, share), [*SECTION, "seg_no"])
    parts = F.array_sort(F.collect_list(F.struct("seg_no", "kind", "text")))
    joined = F.aggregate("parts", F.struct(F.lit("").alias("t"), F.lit("").alias("k")), lambda a, s: F.struct(F.concat(a["t"], F.when(a["k"] == "", "").when((a["k"] == "prose") & (s["kind"] == "prose"), " ").otherwise("\n"), s["text"]).alias("t"), s["kind"].alias("k")))
    chunks = rows.groupBy(*keys).agg(parts.alias("parts"), F.first("heading").alias("heading"), F.sum("n_tokens").cast("long").alias("n_tokens"), F.collect_set("kind").alias("kinds"))
    kind = F.when(F.size("kinds") == 1, F.get("kinds", 0)).otherwise("mixed")
    index = (F.row_number().over(Window.partitionBy("source_id").orderBy("section_no", "chunk_no")) - 1).cast("int")
    return chunks.select(*keys, index.alias("chunk_index"), "heading", joined["t"].alias("chunk_text"), kind.alias("chunk_type"), "n_tokens")

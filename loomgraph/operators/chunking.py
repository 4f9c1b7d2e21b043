"""Documents to chunks with stable offsets: text[start:end] is always the chunk, in code points.

Documents have doc_id, text, source_type, locator; chunks add index, start, end
and fragment. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text


def documents(frame: DataFrame, source_type: str = "document", locator: str = "memory") -> DataFrame:
    """A frame with doc_id and text as documents; a locator of its own wins over locator/doc_id."""
    own = F.col("locator") if "locator" in frame.columns else F.concat(F.lit(f"{locator}/"), F.col("doc_id").cast("string"))
    kind = F.col("source_type") if "source_type" in frame.columns else F.lit(source_type)
    return frame.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), kind.alias("source_type"), own.alias("locator"))


def _finish(frame: DataFrame) -> DataFrame:
    span = F.concat_ws("", F.lit("chunk:"), F.col("index"), F.lit("@chars:"), F.col("start"), F.lit("-"), F.col("end"))
    return frame.select(*(c for c in ("doc_ord",) if c in frame.columns), "doc_id", "source_type", "locator", F.col("index").cast("int"), F.col("start").cast("int"), F.col("end").cast("int"), F.col("chunk").alias("text"), span.alias("fragment"))


def whole(docs: DataFrame) -> DataFrame:
    """One chunk a document, of an empty one too."""
    return _finish(docs.select(*(c for c in docs.columns if c != "text"), F.lit(0).alias("index"), F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("chunk")))


def fixed_windows(docs: DataFrame, window: int, overlap: int = 0) -> DataFrame:
    """Windows of so many characters; the last one ends with the text. An empty text has none."""
    if window < 1 or not 0 <= overlap < window:
        raise ValueError("window must be positive, and overlap less than it")
    step = window - overlap
    length = F.length("text")
    last = F.when(length <= window, 0).otherwise(F.ceil((length - window) / F.lit(step)).cast("int"))
    # one pass cuts the text into steps; a window is a few of them, so no window is looked for from the text's beginning
    steps, many = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), -(-window // step)
    pieces = text.let(steps, lambda p: F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.array_join(F.slice(p, i + 1, many), ""), 1, window)))
    cut = docs.where("text <> ''").select("*", F.posexplode(pieces).alias("index", "chunk"))
    start = F.col("index") * step
    return _finish(cut.withColumns({"start": start, "end": start + F.length("chunk")}))


def paragraphs(docs: DataFrame) -> DataFrame:
    """Stripped pieces between blank lines, blank ones left out of the count; offsets are into the whole text."""
    parts = docs.withColumn("parts", F.split("text", "\n\n", -1))
    ends = text.running(F.transform("parts", lambda p: F.length(p) + 2), lambda a, b: a + b)
    grown = F.zip_with("parts", ends, lambda p, end: F.struct((end - F.length(p) - 2).alias("base"), p.alias("piece")))
    kept = F.filter(grown, lambda x: text.strip(x["piece"]) != "")
    rows = parts.select(*(c for c in docs.columns if c != "text"), F.posexplode(kept).alias("index", "p"))
    bare = text.strip(F.col("p.piece"))
    lead = F.length("p.piece") - F.length(F.ltrim(F.col("p.piece"), F.lit(text.SPACES)))
    start = F.col("p.base") + lead
    return _finish(rows.withColumns({"start": start, "end": start + F.length(bare), "chunk": bare}))

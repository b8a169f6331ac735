"""Documents to deterministic, identified text windows (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofweave.functions import identity as ids
from proofweave.functions import text as tx
from proofweave.functions.identity import ChunkerConfig

WINDOWS_PER_PIECE = 64


def normalize_documents(documents: DataFrame, text_column: str = "text") -> DataFrame:
    """Add ``normalized``; blank documents are left out (see ``blank_documents``)."""
    written = documents.filter(~tx.is_blank(F.col(text_column)))
    return written.withColumn("normalized", tx.normalize_content(F.col(text_column)))


def blank_documents(documents: DataFrame, text_column: str = "text") -> DataFrame:
    """The rejected rows with a reason."""
    return documents.filter(tx.is_blank(F.col(text_column))).withColumn(
        "reason", F.lit("document content cannot be empty")
    )


def with_version_identity(documents: DataFrame) -> DataFrame:
    """Add ``version_hash`` and ``version_id`` from document, label and content."""
    return documents.withColumn(
        "version_hash",
        ids.version_hash(F.col("document_id"), F.col("version_label"), F.col("normalized")),
    ).withColumn(
        "version_id",
        ids.version_id(F.col("enterprise_id"), F.col("document_id"), F.col("version_hash")),
    )


def _windows(normalized: Column, size: Column, step: Column) -> Column:
    """Non-empty windows in order, as structs of offsets and stripped content.

    A substring scans its text from the start, so windows are cut from pieces
    of ``WINDOWS_PER_PIECE`` steps rather than from the whole document.
    """
    stride = step * WINDOWS_PER_PIECE

    def cut(base: Column, length: Column) -> Column:
        piece = F.substring(normalized, base + 1, stride + size)
        last = F.least(base + stride - step, length - 1)
        return F.struct(base.alias("base"), last.alias("last"), piece.alias("text"))

    def window(piece: Column, start: Column, length: Column) -> Column:
        content = F.substring(piece["text"], start - piece["base"] + 1, size)
        return F.struct(
            start.alias("start_offset"),
            F.least(start + size, length).alias("end_offset"),
            tx.strip(content).alias("content"),
        )

    def windows(length: Column) -> Column:
        bases = F.sequence(F.lit(0), length - 1, stride)
        return F.flatten(
            F.transform(
                F.transform(bases, lambda base: cut(base, length)),
                lambda piece: F.transform(
                    F.sequence(piece["base"], piece["last"], step),
                    lambda start: window(piece, start, length),
                ),
            )
        )

    found = tx.let(F.length(normalized), windows)
    return F.filter(found, lambda item: item["content"] != "")


def _has_own_sizes(frame: DataFrame) -> bool:
    return {"chunk_size", "chunk_overlap"} <= set(frame.columns)


def split_documents(
    normalized: DataFrame, config: ChunkerConfig = ChunkerConfig(), drop: tuple[str, ...] = ()
) -> DataFrame:
    """One row per window with ``ordinal``, offsets, ``locator`` and ``content``.

    Windows are cut inside the document's own row, so the dense ordinal needs
    neither a window function nor a shuffle. ``chunk_size``/``chunk_overlap``
    columns, when present, override the configured sizes per document.
    """
    if _has_own_sizes(normalized):
        size, overlap = F.col("chunk_size"), F.col("chunk_overlap")
    else:
        size, overlap = F.lit(config.size), F.lit(config.overlap)
    kept = [c for c in normalized.columns if c != "normalized" and c not in drop]
    windows = _windows(F.col("normalized"), size, size - overlap)
    return (
        normalized.select(*kept, F.posexplode(windows).alias("ordinal", "window"))
        .select(*kept, "ordinal", "window.start_offset", "window.end_offset", "window.content")
        .withColumn(
            "locator",
            F.format_string(
                "char:%d-%d:ordinal:%d",
                F.col("start_offset"),
                F.col("end_offset"),
                F.col("ordinal"),
            ),
        )
    )


def with_chunk_identity(chunks: DataFrame, config: ChunkerConfig = ChunkerConfig()) -> DataFrame:
    """Add ``chunk_id`` (hex) and ``chunker_config_hash`` (hex)."""
    if _has_own_sizes(chunks):
        config_hash = ids.config_hash(F.col("chunk_size"), F.col("chunk_overlap"), config)
    else:
        config_hash = F.lit(config.hash_hex)
    return chunks.withColumn("chunker_config_hash", config_hash).withColumn(
        "chunk_id",
        ids.chunk_id(
            F.col("enterprise_id"),
            F.col("version_hash"),
            F.col("locator"),
            F.col("content"),
            F.col("chunker_config_hash"),
        ),
    )


def chunk_versions(
    versions: DataFrame, config: ChunkerConfig = ChunkerConfig(), text_column: str = "text"
) -> DataFrame:
    """Document versions to identified chunks; the source text is not carried on."""
    identified = with_version_identity(normalize_documents(versions, text_column))
    return with_chunk_identity(split_documents(identified, config, drop=(text_column,)), config)


def expected_counts(normalized: DataFrame, config: ChunkerConfig = ChunkerConfig()) -> DataFrame:
    """Chunks each version must have, counted inside its own row."""
    if _has_own_sizes(normalized):
        size, overlap = F.col("chunk_size"), F.col("chunk_overlap")
    else:
        size, overlap = F.lit(config.size), F.lit(config.overlap)
    windows = _windows(F.col("normalized"), size, size - overlap)
    return normalized.select("version_id", F.size(windows).cast("long").alias("expected_chunks"))

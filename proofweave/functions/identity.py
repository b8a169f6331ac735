"""Content-derived identifiers built from JVM hash functions."""

from __future__ import annotations

import dataclasses
import hashlib
import json

from pyspark.sql import Column, functions as F

from proofweave import constants as K
from proofweave.functions import text as tx


@dataclasses.dataclass(frozen=True)
class ChunkerConfig:
    """Settings that take part in chunk identity."""

    size: int = K.CHUNK_SIZE
    overlap: int = K.CHUNK_OVERLAP
    name: str = K.CHUNKER_NAME
    version: str = K.CHUNKER_VERSION
    tokenizer: str = K.CHUNKER_TOKENIZER
    normalization: str = K.CHUNKER_NORMALIZATION
    separators: tuple[str, ...] = K.CHUNKER_SEPARATORS

    def __post_init__(self) -> None:
        problems = {
            "name and version must not be blank": not (self.name.strip() and self.version.strip()),
            f"size must be at least {K.MIN_CHUNK_SIZE}": self.size < K.MIN_CHUNK_SIZE,
            "overlap must be in [0, size)": not 0 <= self.overlap < self.size,
            "separators must be non-empty": not self.separators or not all(self.separators),
        }
        failed = [message for message, is_bad in problems.items() if is_bad]
        if failed:
            raise ValueError("; ".join(failed))

    @property
    def step(self) -> int:
        return self.size - self.overlap

    @property
    def hash_hex(self) -> str:
        settings = {
            "implementationVersion": self.version,
            "name": self.name,
            "normalization": self.normalization,
            "overlap": self.overlap,
            "separators": list(self.separators),
            "size": self.size,
            "tokenizer": self.tokenizer,
        }
        return hashlib.sha256(canonical_json(settings)).hexdigest()


def canonical_json(value: object) -> bytes:
    """Sorted, compact ASCII JSON of a driver-side constant."""
    return json.dumps(
        value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False
    ).encode("ascii")


def utf8(text: Column) -> Column:
    return text.cast("binary")


def length_delimited(*parts: Column) -> Column:
    """Concatenate binary parts, each led by its 8-byte big-endian length."""
    framed: list[Column] = []
    for part in parts:
        framed.append(F.unhex(F.lpad(F.hex(F.octet_length(part).cast("long")), 16, "0")))
        framed.append(part)
    return F.concat(*framed)


def uuid_bytes(uuid_text: Column) -> Column:
    return F.unhex(F.replace(uuid_text, F.lit("-"), F.lit("")))


def format_uuid(hex_text: Column) -> Column:
    """Render 32 hex digits in the 8-4-4-4-12 form."""
    bounds = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(hex_text, start, size) for start, size in bounds])


def uuid_from_text(text: Column) -> Column:
    """A UUID-shaped key derived from any natural key."""
    return format_uuid(F.md5(utf8(text)))


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 name-based (SHA-1) UUID."""
    digest = F.sha1(F.concat(uuid_bytes(F.lit(namespace)), utf8(name)))
    variant_digits = F.lit("89ab")
    variant_index = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4
    return format_uuid(
        F.concat(
            F.substring(digest, 1, 12),
            F.lit("5"),
            F.substring(digest, 14, 3),
            F.substring(variant_digits, variant_index + 1, F.lit(1)),
            F.substring(digest, 18, 15),
        )
    )


def version_hash(document_id: Column, label: Column, normalized: Column) -> Column:
    """Hex digest binding document, label and normalised content."""
    return F.sha2(length_delimited(uuid_bytes(document_id), utf8(label), utf8(normalized)), 256)


def version_id(enterprise_id: Column, document_id: Column, hash_hex: Column) -> Column:
    return uuid5(K.VERSION_NAMESPACE, F.concat_ws(":", enterprise_id, document_id, hash_hex))


def chunk_id(
    enterprise_id: Column, hash_hex: Column, locator: Column, content: Column, config_hash: Column
) -> Column:
    """Hex digest naming one chunk occurrence."""
    return F.sha2(
        length_delimited(
            uuid_bytes(enterprise_id),
            F.unhex(hash_hex),
            utf8(locator),
            utf8(content),
            F.unhex(config_hash),
        ),
        256,
    )


def source_fingerprint(uri: Column) -> Column:
    """Digest of the trimmed lower-case URI; null for a blank one."""
    cleaned = F.lower(tx.strip(uri))
    return F.when(cleaned != "", F.sha2(utf8(cleaned), 256))


def trace_identifier_hash(trace_id: Column) -> Column:
    return F.sha2(uuid_bytes(trace_id), 256)


def json_string(text: Column) -> Column:
    """A quoted JSON string with every non-ASCII character ``\\u``-escaped."""
    quoted = text
    # The backslash goes first so later escapes are not escaped again.
    for raw, escaped in (
        ("\\", r"\\"),
        ('"', r'\"'),
        ("\n", r"\n"),
        ("\r", r"\r"),
        ("\t", r"\t"),
        ("\b", r"\b"),
        ("\f", r"\f"),
    ):
        quoted = F.replace(quoted, F.lit(raw), F.lit(escaped))
    needs_escape = quoted.rlike(r"[^\x20-\x7E]")
    return F.concat(F.lit('"'), F.when(needs_escape, _escape_code_units(quoted)).otherwise(quoted), F.lit('"'))


def _escape_code_units(text: Column) -> Column:
    """Escape the UTF-16 code units outside printable ASCII."""
    runs = F.regexp_extract_all(text, F.lit(r"[\x20-\x7E]+|[^\x20-\x7E]"), F.lit(0))

    def escaped(character: Column) -> Column:
        units = F.lower(F.hex(F.encode(character, "UTF-16BE")))
        first = F.concat(F.lit("\\u"), F.substring(units, 1, 4))
        pair = F.concat(first, F.lit("\\u"), F.substring(units, 5, 4))
        return F.when(F.length(units) > 4, pair).otherwise(first)

    return F.array_join(
        F.transform(
            runs, lambda run: F.when(run.rlike(r"^[\x20-\x7E]"), run).otherwise(escaped(run))
        ),
        "",
    )


def json_object(**fields: Column) -> Column:
    """Canonical JSON object from already-rendered values, keys sorted."""
    body = [
        F.concat(F.lit(f'"{name}":'), value) for name, value in sorted(fields.items())
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *body), F.lit("}"))


def json_array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, json_string), ","), F.lit("]"))


def json_map(entries: Column) -> Column:
    """Canonical JSON object of a map of strings; null values are kept, a null map is empty."""
    rendered = F.transform(
        F.array_sort(F.map_entries(entries)),
        lambda item: F.concat(
            json_string(item["key"]),
            F.lit(":"),
            F.coalesce(json_string(item["value"]), F.lit("null")),
        ),
    )
    return F.concat(F.lit("{"), F.coalesce(F.array_join(rendered, ","), F.lit("")), F.lit("}"))


def config_hash(size: Column, overlap: Column, config: ChunkerConfig) -> Column:
    """Chunker configuration digest when sizes vary per row."""
    constants = {
        "implementationVersion": config.version,
        "name": config.name,
        "normalization": config.normalization,
        "separators": list(config.separators),
        "tokenizer": config.tokenizer,
    }
    fields = {name: F.lit(canonical_json(value).decode()) for name, value in constants.items()}
    document = json_object(
        **fields, size=size.cast("string"), overlap=overlap.cast("string")
    )
    return digest(document)


def digest(text: Column) -> Column:
    return F.sha2(utf8(text), 256)


def compact_key(key: Column) -> Column:
    """A text key as bytes, reversibly: whole lower-case hex digests take half their length."""
    is_hex = key.rlike("\\A([0-9a-f]{2})+\\z")
    return F.when(is_hex, F.concat(F.lit(b"\x00"), F.unhex(key))).otherwise(
        F.concat(F.lit(b"\x01"), key.cast("binary"))
    )


def full_key(compact: Column) -> Column:
    """The text of a ``compact_key``."""
    body = F.substring(compact, 2, 2**31 - 1)
    return F.when(F.substring(compact, 1, 1) == F.lit(b"\x00"), F.lower(F.hex(body))).otherwise(
        body.cast("string")
    )

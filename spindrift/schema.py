"""Tables, their domains and the constants that queries depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Domains and thresholds of the data model.
DOCUMENT_STATUS = ("uploaded", "processing", "review", "verified", "failed")
PAGE_STATUS = ("pending", "processing", "ready", "failed")
PAGE_REVIEW = ("unreviewed", "in_review", "verified")
LINE_REVIEW = ("accepted", "needs_review", "verified", "corrected")
ACTIONS = ("accept", "edit", "reject")
ENGINES = ("paddle", "tesseract", "consensus", "text_layer")
SOURCE_TYPES = ("modern_print", "historical_print", "handwritten", "palm_leaf", "inscription")
ENGRAVED = ("palm_leaf", "inscription")
DEFAULT_ROUTE = "modern_print"
EXTENSIONS = ("pdf", "jpg", "jpeg", "png", "tif", "tiff", "webp", "heic")
MAX_UPLOAD_BYTES = 500 * 1024 * 1024
GATE = 0.95
AUDIT_RATE = 0.02
SAMPLE_PAGES = 5
TEXT_LAYER_MIN = 0.95
REVIEW_BELOW = 0.8


TABLES: dict[str, str] = {
    "documents": "id string not null, filename string not null, original_path string not null, file_type string not null, language string not null, source_type string, source_confidence double, source_manual int, status string not null, page_count int, error string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "pages": "id bigint not null, document_id string not null, page_number int not null, image_path string, thumbnail_path string, width int, height int, extraction_method string, text_layer_score double, quality_json string, status string, review_status string, processed_at timestamp_ntz",
    "regions": "id bigint not null, page_id bigint not null, region_type string, x0 double, y0 double, x1 double, y1 double, reading_order int",
    "lines": "id bigint not null, page_id bigint not null, region_id bigint, line_order int, ocr_text string not null, confidence double, engine string, tesseract_checked int, x0 double, y0 double, x1 double, y1 double, review_status string, verified_text string, created_at timestamp_ntz",
    "candidates": "id bigint not null, line_id bigint not null, candidate_text string, score double, rank int, source string",
    "verifications": "id bigint not null, line_id bigint not null, action string, previous_text string, new_text string, reviewer string, created_at timestamp_ntz",
    "outputs": "id bigint not null, page_id bigint not null, line_id bigint, kind string, text string, model string, created_at timestamp_ntz",
    "jobs": "id string not null, document_id string not null, status string, total_pages int, done_pages int, current_step string, error string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "training_pairs": "id bigint not null, line_id bigint not null, crop_path string, text string, source_type string, language string, created_at timestamp_ntz",
    "page_embeddings": "page_id bigint not null, embedding_json string, model string, created_at timestamp_ntz",
}

#: Values that a column takes when a row doesn't give them.
DEFAULTS = {
    "documents": {"language": "ta", "status": "uploaded", "source_manual": 0, "page_count": 0},
    "pages": {"extraction_method": "pending", "status": "pending", "review_status": "unreviewed"},
    "regions": {"region_type": "text"},
    "lines": {"review_status": "accepted", "tesseract_checked": 0},
}

#: child table -> (its column, parent table, parent's column, what happens when the parent goes)
REFERENCES = (
    ("pages", "document_id", "documents", "id", "cascade"),
    ("jobs", "document_id", "documents", "id", "cascade"),
    ("regions", "page_id", "pages", "id", "cascade"),
    ("lines", "page_id", "pages", "id", "cascade"),
    ("outputs", "page_id", "pages", "id", "cascade"),
    ("page_embeddings", "page_id", "pages", "id", "cascade"),
    ("lines", "region_id", "regions", "id", "null"),
    ("candidates", "line_id", "lines", "id", "cascade"),
    ("verifications", "line_id", "lines", "id", "cascade"),
    ("outputs", "line_id", "lines", "id", "cascade"),
    ("training_pairs", "line_id", "lines", "id", "cascade"),
)


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the table's columns and types: missing ones get their default or null."""
    defaults = DEFAULTS.get(table, {})
    out = []
    for f in schema_of(table).fields:
        if f.name in df.columns:
            c = F.col(f.name).cast(f.dataType)
            out.append((F.coalesce(c, F.lit(defaults[f.name])) if f.name in defaults else c).alias(f.name))
        else:
            out.append(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name))
    return df.select(out)


def in_domain(column: str, domain: tuple[str, ...]):
    """The column, or an error that names the value when it's outside its domain."""
    c = F.col(column)
    return F.when(c.isin(*domain), c).otherwise(F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(c, F.lit("null")))))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; empty when the key is unique."""
    return df.groupBy(*keys).count().where("count > 1")

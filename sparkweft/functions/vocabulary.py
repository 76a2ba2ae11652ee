"""The closed vocabulary of the knowledge graph and the engine's error type."""

from __future__ import annotations

#: Entity types, relation types, source states, and error codes that callers may rely on.
ENTITY_TYPES = ["module", "file", "function", "class", "type", "concept", "config", "cli", "api", "external_dependency", "test"]
RELATION_TYPES = ["defines", "uses", "calls", "imports", "depends_on", "configures", "tests", "relates_to"]
SOURCE_STATES = ["pending", "chunked", "extracting", "extracted", "merged", "failed", "quarantined", "disabled", "deleted"]
DEFAULT_EXCLUDES = [".git", "node_modules", ".DS_Store", ".env", ".env.*", "*.pem", "*secret*", "*credential*", "*credentials*"]
DOC_EXTENSIONS = [".docx", ".pptx", ".xlsx", ".pdf"]
LEGACY_EXTENSIONS = [".doc", ".ppt", ".xls"]
IMAGE_MIME = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp", ".gif": "image/gif"}


class EngineError(Exception):
    """An error with a stable ``code`` such as NO_SEED, NOT_INDEXED, INVALID, KB_AMBIGUOUS or NOT_AUTHORIZED."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code

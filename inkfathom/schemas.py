"""Column layouts and defaults of the document index."""

from __future__ import annotations

from dataclasses import dataclass

CHUNKS = (
    "chunk_id string, strategy string, source string, title string, section string, ordinal long, char_start long, char_end long, "
    "text string, crosses_section boolean, cut_mid_sentence boolean"
)
EMBEDDINGS = "chunk_id string, strategy string, model string, dim int, vector array<float>"

#: White space as Unicode has it, for regular expressions of Java and Python alike.
WHITE = "\t-\r \u0085   -     　"
SECTION_JOIN = " > "


@dataclass(frozen=True)
class Defaults:
    """What commands and tools take when nothing is said."""

    url: str = "http://localhost:11434"
    model: str = "nomic-embed-text"
    document_prefix: str = "search_document: "
    query_prefix: str = "search_query: "
    batch: int = 32
    num_ctx: int = 2048
    dim: int = 768
    chunk_size: int = 1200
    overlap: int = 200
    max_section: int = 1500
    min_section: int = 200
    min_chars: int = 50_000
    top_k: int = 5
    candidate_top_k: int = 20
    threshold: float = 0.5


DEFAULTS = Defaults()

"""Options of ingest, from arguments or the environment, brought into their ranges."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from cairnkit.operators.chunk import BREAKPOINTS, SENTENCE


@dataclass(frozen=True)
class Options:
    embedding_mode: str = "sbert"
    embedding_model: str = "sentence-transformers/all-MiniLM-L6-v2"
    embedding_dim: int = 384
    chunk_strategy: str = "hybrid"
    chunk_max_tokens: int = 300
    chunk_overlap: int = 50
    dedup_strategy: str = "exact"
    dedup_minhash_threshold: float = 0.85
    dedup_minhash_perm: int = 128
    dedup_shingle_size: int = 5
    semantic_breakpoint_type: str = "percentile"
    semantic_breakpoint_amount: float = 90.0
    semantic_sentence_split_regex: str = SENTENCE
    pdf_header_min_line_len: int = 3
    pdf_header_max_line_len: int = 200
    pdf_header_repeat_ratio: float = 0.65
    preserve_indent: bool = False

    def checked(self) -> Options:
        """Values out of range go to the default or the nearest bound."""
        d = Options()
        return replace(
            self,
            embedding_dim=self.embedding_dim if self.embedding_dim > 0 else d.embedding_dim,
            chunk_max_tokens=self.chunk_max_tokens if self.chunk_max_tokens > 0 else d.chunk_max_tokens,
            chunk_overlap=max(0, self.chunk_overlap),
            dedup_minhash_threshold=min(1.0, max(0.0, self.dedup_minhash_threshold)),
            dedup_minhash_perm=max(16, self.dedup_minhash_perm),
            dedup_shingle_size=max(2, self.dedup_shingle_size),
            semantic_breakpoint_type=self.semantic_breakpoint_type if self.semantic_breakpoint_type in BREAKPOINTS else d.semantic_breakpoint_type,
            pdf_header_repeat_ratio=min(1.0, max(0.0, self.pdf_header_repeat_ratio)),
        )

    @staticmethod
    def from_env(env: Mapping[str, str] | None = None) -> Options:
        """The options that the environment names by upper-case field names; unreadable numbers are the default."""
        env = os.environ if env is None else env
        found = {}
        for f in fields(Options):
            raw = env.get(f.name.upper(), "").strip()
            if raw:
                kind = type(getattr(Options(), f.name))
                try:
                    found[f.name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
                except ValueError:
                    continue
        return Options(**found).checked()

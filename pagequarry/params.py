"""Parameters of ranking, with their defaults, and errors."""

from __future__ import annotations

from dataclasses import dataclass


class SearchError(Exception):
    """Base of what can go wrong in a search."""


class SourceError(SearchError):
    def __init__(self, reason: object) -> None:
        super().__init__(f"cannot read corpus file: {reason}")


class NoMarkdown(SearchError):
    def __init__(self, path: str) -> None:
        super().__init__(f"no .md file found under {path}")


class EmptyQuery(SearchError):
    def __init__(self) -> None:
        super().__init__("query contains no keyword")


class InvalidParam(SearchError):
    def __init__(self, name: str) -> None:
        super().__init__(f"{name} must be at least 1")


class TooLarge(SearchError):
    def __init__(self, name: str) -> None:
        super().__init__(f"{name} is too large")


# The defaults define the scores.
@dataclass(frozen=True)
class RankingParams:
    idf_floor: float = 0.25
    occ_cap: int = 20
    heading_bonus: float = 15.0
    page_bonus: float = 10.0
    all_in_headings_mult: float = 1.4
    phrase_bonus: float = 15.0
    len_norm_bytes: float = 6000.0
    whole_word_bonus: float = 3.0
    empty_body_factor: float = 0.2
    title_prefix_bonus: float = 25.0
    page_name_bonus: float = 10.0
    stem_query_bonus: float = 30.0
    stem_keyword_bonus: float = 10.0
    definition_bonus: float = 5.0
    max_sections_per_page: int = 2
    fold_diacritics: bool = False
    max_heading_level: int = 3

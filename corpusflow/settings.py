"""Settings of the jobs; every default can be replaced when a job is called."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class StatusRules:
    """Which status and state ids mean cancelled or active; anything else is a draft."""

    cancelled_status_ids: tuple[str, ...] = ("status-cancelled",)
    cancelled_state_ids: tuple[int, ...] = (5, 17, 21)
    active_state_ids: tuple[int, ...] = (6, 8, 11, 12, 13, 18, 19)


@dataclass(frozen=True)
class CardSections:
    """Where a card keeps what."""

    common: str = "Common"
    approval: str = "Approval"
    directions: str = "Directions"
    approvers: str = "Approvers"
    responsible: str = "Responsible"
    state_names: tuple[tuple[int, str], ...] = ()  # of approval states, in place of their own names


@dataclass(frozen=True)
class CoverageRules:
    """Facts of kinds ``(name, kind, fact, least)``, where ``*`` is any kind, and shares of files that a set should have."""

    facts: tuple[tuple[str, str, str, int], ...] = ()
    change: str = "отмен|измен|дополн"
    attachment: str = "приложени|дополнительн"
    images: tuple[str, ...] = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "gif")
    digital_share: float = 0.5
    scan_share: float = 0.1
    span_of_years: int = 1


@dataclass(frozen=True)
class MainCandidate:
    extension: str
    categories: tuple[str, ...] = ()

    @property
    def any_category(self) -> bool:
        return not self.categories


@dataclass(frozen=True)
class FileRules:
    """Which files of a record are indexed, and as what."""

    extensions: tuple[str, ...] = ("pdf", "docx", "xlsx", "pptx", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "gif")
    skip_prefixes: tuple[str, ...] = ("Для печати",)
    skip_categories: tuple[str, ...] = ("Подписи ЭП", "Получено из Диадока")
    main_candidates: tuple[MainCandidate, ...] = (
        MainCandidate("docx", ("Документ",)),
        MainCandidate("docx", ("Файлы для отправки по ЭДО",)),
        MainCandidate("pdf", ("Подписанные документы", "Документ")),
        MainCandidate("docx"),
        MainCandidate("pdf"),
    )
    main_text_categories: tuple[str, ...] = ("Документ", "Подписанные документы", "Файлы для отправки по ЭДО")
    appendix_categories: tuple[str, ...] = ("Приложение",)
    supplement_categories: tuple[str, ...] = ("Дополнительные сведения",)
    supplement_types: tuple[str, ...] = ("Order",)


@dataclass(frozen=True)
class SearchSettings:
    prefetch: int = 40
    candidates: int = 20
    top_k: int = 5
    max_top_k: int = 20
    rrf_k: int = 60
    default_statuses: tuple[str, ...] = ("active",)
    known_values_limit: int = 500
    dims: int = 8
    broadcast_queries: int = 20_000  # queries up to which their vectors are sent to every task
    broadcast_filters: int = 10_000  # distinct filters up to which they are sent to every task
    product_cells: int = 4_000_000  # numbers of one block of scores in a task


@dataclass(frozen=True)
class ChunkSettings:
    max_tokens: int = 512
    overlap_tokens: int = 64
    min_tokens: int = 24
    title_max_words: int = 8
    crumb_max_words: int = 12
    appendix_max_words: int = 12
    appendix_title_max_words: int = 20
    parent_max_tokens: int = 2048
    content_max_tokens: int = 4000
    content_max_sections: int = 40
    separator: str = " → "
    section_word: str = "Раздел"
    clause_word: str = "п."
    appendix_word: str = "Приложение"


@dataclass(frozen=True)
class GlossarySettings:
    """Headings of sections that define terms."""

    headings: tuple[str, ...] = (
        "термины и определения",
        "термины, определения и сокращения",
        "определения и сокращения",
        "сокращения",
        "используемые сокращения",
        "перечень сокращений",
        "основные понятия",
        "глоссарий",
    )
    term_max_words: int = 6
    definition_min_chars: int = 12
    definition_max_chars: int = 600
    max_entries: int = 60
    lookup_limit: int = 5
    ratio: float = 0.75
    least_stem: int = 5
    most_ending: int = 3


@dataclass(frozen=True)
class MemorySettings:
    recent_turns: int = 6
    trigger_chars: int = 6000
    answer_chars: int = 600


@dataclass(frozen=True)
class ExclusionRule:
    """A rule of the walk: explicit ids always apply, other criteria to seeds only if asked."""

    reason: str | None = None
    card_ids: tuple = ()
    type_names: tuple[str, ...] = ()
    doc_type_titles: tuple[str, ...] = ()
    field: str | None = None
    values: tuple[str, ...] = ()
    none_of: bool = False
    applies_to_seed: bool = False


@dataclass(frozen=True)
class WalkSettings:
    max_depth: int = 2
    max_docs: int = 500
    directions: tuple[str, ...] = ("outgoing", "incoming")
    rules: tuple[ExclusionRule, ...] = field(default_factory=tuple)

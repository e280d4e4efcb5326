"""Options of the cleaning job; plain driver-side values that become literals in the plan."""

from dataclasses import dataclass


@dataclass(frozen=True)
class CleanerConfig:
    preserve_links: bool = False
    max_length: int = 10000
    remove_quotes: bool = True
    preserve_tables: bool = True
    min_content_length: int = 50
    strip_only: bool = False
    """Use the plain tag stripper instead of the layout-aware HTML conversion."""

    @property
    def min_content(self) -> int:
        return self.min_content_length or 50

"""Where the listings come from.

The URL rules depend on one thing only, the domain of the marketplace.  It is a
parameter; host names and the name of the vendor link column follow from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from lotwise import fixed


@dataclass(frozen=True)
class Marketplace:
    """A marketplace domain with a dealer host and a search host."""

    domain: str = "marktplatz.example"

    @property
    def dealer_host(self) -> str:
        return f"home.{self.domain}"

    @property
    def search_host(self) -> str:
        return f"suchen.{self.domain}"

    @property
    def dealer_base(self) -> str:
        return f"https://{self.dealer_host}"

    @property
    def search_base(self) -> str:
        return f"https://{self.search_host}"

    @property
    def link_field(self) -> str:
        return f"{self.domain[:1].upper()}{self.domain[1:]}_Links"

    @property
    def vendor_fields(self) -> list[str]:
        """The 15 vendor columns in contract order."""
        return [*fixed.VENDOR_FIELDS_BEFORE_LINK, self.link_field, fixed.VENDOR_COUNT_FIELD]

    @property
    def home_title_markers(self) -> list[str]:
        return [self.domain, *fixed.HOME_TITLE_WORDS]


DEFAULT_SITE = Marketplace()

"""Declarative specs and schemas shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Union

# Names and codes that records, logs and configurations carry.
RESERVED_FIELDS = ("_id", "image_urls", "images", "_postinfo", "_spidertype", "_scrapedurl", "_spidername")
INVALID_KEY = "Invalid_Key_Selector"
XPATH, CSS, REGEX, WORDLIST = 0, 1, 2, 3
ACTION_VISIT, ACTION_CLICK = 1, 2
UNIQUE_HREF, UNIQUE_TEXT, UNIQUE_ONCLICK = 11, 12, 13
TABLE_VHEADERS, TABLE_HHEADERS = 1, 2
INPUT_TEXT, INPUT_SELECT = 1, 2
LOG_LABELS = {
    1: "Visit",
    2: "Form fill",
    3: "Select",
    4: "Click",
    5: "Scroll",
    6: "Download image",
    7: "Scrape table",
}
SAMPLE_ITEMS = 20
MISSING_PERCENT_LIMIT = 40
GROWTH_THRESHOLD = 50
DEFAULT_PARAMS = {"backend": "scrapy", "processor": "default", "delay_s": 1, "cookies": True, "images": True}

# One page's document tree, in document order: nodes[i].pre == i, so a parent is reached by index, and what
# lies below a node are the nodes up to nodes[i].last; selectors need no join and no shuffle.
NODE_FIELDS = {
    "pre": "int",
    "last": "int",
    "parent": "int",
    "depth": "int",
    "nth": "int",
    "nth_of_type": "int",
    "tag": "string",
    "id": "string",
    "classes": "array<string>",
    "attrs": "map<string,string>",
    "text": "string",
}
TEXT_TAG = "#text"
RAW_TEXT_TAG = "#raw"


@dataclass(frozen=True)
class FieldSelector:
    """A selector text and its kind: XPATH, CSS, REGEX or WORDLIST."""

    selector: str
    kind: int = XPATH


@dataclass(frozen=True)
class ImageSelector(FieldSelector):
    """Values go to ``image_urls`` whatever the field key."""


@dataclass(frozen=True)
class UrlSelector(FieldSelector):
    action: int = ACTION_VISIT
    unique_attr: int = UNIQUE_HREF


@dataclass(frozen=True)
class TableSelector(FieldSelector):
    table_type: int = TABLE_HHEADERS


@dataclass(frozen=True)
class ContentSelector:
    """Search for a REGEX or WORDLIST inside a region (or the whole document)."""

    selector: FieldSelector
    restrict: FieldSelector
    scope: str = "region"


@dataclass(frozen=True)
class KeyValueSelector:
    key: Union[str, FieldSelector]
    value: Union[FieldSelector, ContentSelector]


@dataclass(frozen=True)
class Merge:
    names: tuple[str, ...]
    output: str
    sep: str = ""


@dataclass(frozen=True)
class ItemSelector:
    selectors: tuple[KeyValueSelector, ...]
    post: tuple[Merge, ...] = ()


@dataclass(frozen=True)
class MainPage:
    """What a job does once it arrived: item links, item fields, listing links."""

    item_pages: UrlSelector | None = None
    items: ItemSelector | None = None
    similar_pages: UrlSelector | None = None
    similar_restrict: FieldSelector | None = None
    item_restrict: FieldSelector | None = None


@dataclass(frozen=True)
class FormField:
    name: str
    value: str
    kind: int = INPUT_TEXT


@dataclass(frozen=True)
class Url:
    url: str


@dataclass(frozen=True)
class Form:
    url: str
    fields: tuple[FormField, ...] = ()


@dataclass(frozen=True)
class JobPath:
    """Ordered steps of a job: URLs and forms, then a main page."""

    steps: tuple[Url | Form | MainPage, ...] = field(default_factory=tuple)

    def add(self, step: Url | Form | MainPage) -> "JobPath":
        return JobPath(self.steps + (step,))

    @property
    def start_url(self) -> str:
        return self.steps[0].url

    @property
    def main_page(self) -> MainPage | None:
        return next((s for s in reversed(self.steps) if isinstance(s, MainPage)), None)


@dataclass(frozen=True)
class Job:
    """A named path over a site, as the engine registers it."""

    job_id: int
    name: str
    path: JobPath
    kind: str = "scrapy"

"""What marks page objects and API clients, as far as callers may say otherwise."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

# Name endings, and types whose use marks a class.
UI_SUFFIXES = ("Page", "PageObject", "Screen", "Component")
API_SUFFIXES = ("Client", "Api", "Service", "Endpoint")
UI_MARKERS = ("IPage", "ILocator", "IWebDriver", "IWebElement", "By", "WebDriver", "RemoteWebDriver", "AppiumDriver", "IOSDriver", "AndroidDriver")
API_MARKERS = ("HttpClient", "HttpRequestMessage", "RestClient", "IRestClient", "RestRequest", "IRestRequest", "IFlurlClient", "IFlurlRequest", "WebApplicationFactory")


@dataclass(frozen=True)
class ClassifierOptions:
    ui_suffixes: tuple[str, ...] = UI_SUFFIXES
    api_suffixes: tuple[str, ...] = API_SUFFIXES
    ui_markers: tuple[str, ...] = UI_MARKERS
    api_markers: tuple[str, ...] = API_MARKERS

    def ending(self, which: str) -> str:
        """A regex of the names that end in one of the suffixes; of no suffixes, one that fits nothing."""
        suffixes = getattr(self, which)
        return f"(?:{'|'.join(map(re.escape, suffixes))})$" if suffixes else "(?!)"


def read_config(text: str) -> tuple[ClassifierOptions, list[str], list[str]]:
    """(options, include, exclude) of a configuration: a JSON object with the keys include, exclude and classifier, all optional.

    classifier has lists by the names of ClassifierOptions, which replace the defaults. Anything else is an error.
    """
    try:
        said = json.loads(text)
    except ValueError as e:
        raise ValueError(f"configuration isn't JSON: {e}") from None
    known = set(ClassifierOptions.__dataclass_fields__)
    lists = {"include": said.get("include", []), "exclude": said.get("exclude", []), **said.get("classifier", {})} if isinstance(said, dict) and isinstance(said.get("classifier", {}), dict) else None
    if lists is None or (odd := (set(said) - {"include", "exclude", "classifier"}) | (set(said.get("classifier", {})) - known)):
        raise ValueError("configuration has the keys include, exclude and classifier" + (f", not {', '.join(sorted(odd))}" if lists is not None else ""))
    for name, value in lists.items():
        if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
            raise ValueError(f"configuration: {name} must be a list of texts")
    options = replace(ClassifierOptions(), **{k: tuple(v) for k, v in lists.items() if k in known})
    return options, lists["include"], lists["exclude"]

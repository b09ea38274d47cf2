"""Errors of parsing, analysis, collections and schemas."""

from __future__ import annotations


class DocQueryError(Exception):
    """Base of all errors of this package."""


class ParseError(DocQueryError):
    """The text is no query: what was found, and where."""

    def __init__(self, message: str, text: str = "", start: int = 0, end: int = 0) -> None:
        super().__init__(f"{message} at {start}-{end}: {text!r}" if text else message)
        self.message, self.text, self.start, self.end = message, text, start, end


class AnalyzerError(DocQueryError):
    """The query is well-formed but does not fit the collections."""


class UnknownCollection(AnalyzerError):
    def __init__(self, name: str) -> None:
        super().__init__(f"unknown collection {name!r}")
        self.name = name


class UnknownColumn(AnalyzerError):
    def __init__(self, name: str, candidates: list[str] | None = None) -> None:
        super().__init__(f"unknown column {name!r}" + (f", candidates: {', '.join(candidates)}" if candidates else ""))
        self.name, self.candidates = name, candidates or []


class AmbiguousColumn(AnalyzerError):
    def __init__(self, name: str, matches: list[str]) -> None:
        super().__init__(f"ambiguous column {name!r}: {', '.join(matches)}")
        self.name, self.matches = name, matches


class NotACollection(AnalyzerError):
    pass


class FunctionNotFound(AnalyzerError):
    pass


class FunctionArgMismatch(AnalyzerError):
    pass


class NonConstInConstFold(AnalyzerError):
    """Kept for callers that name it: constants are folded by Catalyst here, so nothing raises it."""


class InvalidLikePattern(AnalyzerError):
    pass


class InvalidParameterValue(AnalyzerError):
    pass


class Other(AnalyzerError):
    pass


class CollectionError(DocQueryError):
    """A document or identifier that a collection cannot take."""


class DuplicateId(CollectionError):
    pass


class InvalidDocument(CollectionError):
    pass


class LoadError(DocQueryError):
    """A file or value that cannot be loaded."""


class SchemaError(DocQueryError):
    """A compact schema that is not valid or does not fit its collection."""


class ReferenceError_(DocQueryError):
    """A reference between collections that cannot be made."""

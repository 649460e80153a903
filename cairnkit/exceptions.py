"""Errors of text processing."""


class TextProcessingError(Exception):
    """Root of the errors below."""


class UnsupportedFileTypeError(TextProcessingError):
    """No loader knows the file's extension."""


class DocumentLoadError(TextProcessingError):
    """A file is missing or can't be read."""


class ChunkingError(TextProcessingError):
    """A chunking option is wrong, or nothing is left to chunk."""


class EncodingError(TextProcessingError):
    """No such encoder, or it failed."""

"""Errors that stop a plan. Problems of single rows are rows of a report instead."""


class SedimentError(Exception):
    """Base of all errors here."""


class ConfigError(SedimentError):
    """A setting or URI that can't be used."""


class ChunkNotFound(SedimentError):
    """A file or chunk that the store doesn't hold."""


class ChecksumMismatch(SedimentError):
    """Bytes that don't have the hash they are filed under."""


class StoreCorrupted(SedimentError):
    """A delta chain that is too long, circular or without its base."""


class PackFormatError(SedimentError):
    """A pack file that can't be read."""

"""Errors of the file formats and commands."""


class StrandforgeError(Exception):
    """Any error of this package."""


class InvalidExtension(StrandforgeError, ValueError):
    """A file name without an extension of its format."""


class InvalidInput(StrandforgeError, ValueError):
    """Arguments or contents that make no sense."""


class MalformedFile(StrandforgeError, ValueError):
    """A file that breaks its format."""

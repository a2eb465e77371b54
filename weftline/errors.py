"""Errors that the operators raise."""


class NotFound(LookupError):
    """No row has the id."""


class UnknownEdgeLinks(ValueError):
    """An edge names a link that is not stored."""


class UnknownEdgeSource(ValueError):
    """An edge leaves a vertex that is not there."""


class InvalidDestination(ValueError):
    """A message goes to a vertex that is not there."""


class MissingLinkId(ValueError):
    """A document has no link id."""


class InvalidRange(ValueError):
    """A key range is empty, reversed or asked for a part it does not have."""


class NoPartition(RuntimeError):
    """A process does not know its part of the key space yet; its work can wait."""

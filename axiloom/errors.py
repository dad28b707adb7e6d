"""Errors of evaluation."""


class NodeValueNotFound(KeyError):
    """A node has no value in a result."""


class FunctionNotFound(KeyError):
    """A formula calls a function that was not given."""


class UnsupportedNodeType(TypeError):
    """A node of a kind that nothing evaluates."""


class UnsupportedOperation(ValueError):
    """An operation that is not defined for its arguments."""


class PlaceholderValueNotProvided(ValueError):
    """A placeholder has neither a value nor a default."""

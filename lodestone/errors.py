"""Refusals: what the engine will not answer, by name."""


class Refused(ValueError):
    """A shape that is not supported; the message names the reason."""


class SchemaError(Refused):
    """A table definition that cannot stand."""


class NoSuchColumn(Refused):
    pass


class TypeMismatch(Refused):
    """Values of two types are compared or joined."""


class DecimalScale(Refused):
    """Arithmetic that would leave a decimal's scale."""


class NotSummable(Refused):
    pass


class InvalidCursor(Refused):
    pass


class InListTooLarge(Refused):
    pass


class Forbidden(Refused):
    """The caller may not do this."""


class ColumnsWithheld(Forbidden):
    pass


class TenantRequired(Forbidden):
    pass


class WriteError(ValueError):
    """A write that was checked and not made."""


class DuplicateKey(WriteError):
    pass


class RowNotFound(WriteError):
    pass


class CheckFailed(WriteError):
    pass


class ForeignKeyFailed(WriteError):
    pass


class Conflict(WriteError):
    """Someone else has written meanwhile."""

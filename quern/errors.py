"""One hierarchy for everything that can go wrong."""

from __future__ import annotations


class QuernError(Exception):
    """Base of all errors of this library."""


class QueryError(QuernError):
    """The query was built wrongly."""


class TypeConversionError(QuernError):
    """A value can't be brought to the asked type."""


class ServerError(QuernError):
    """The query could not be executed."""

    def __init__(self, message: str, sql: str | None = None, sqlstate: str | None = None):
        super().__init__(message if sql is None else f"{message}\n{sql}")
        self.sql, self.sqlstate = sql, sqlstate


class TableDoesNotExist(ServerError):
    pass


class AmbiguousIdentifier(ServerError):
    pass


class ConstraintViolation(ServerError):
    """Data would break a constraint of a table."""

    def __init__(self, message: str, constraint: str | None = None):
        super().__init__(message)
        self.constraint = constraint


class NotNullViolation(ConstraintViolation):
    pass


class UniqueViolation(ConstraintViolation):
    pass


class ForeignKeyViolation(ConstraintViolation):
    pass


class SerializationFailure(ServerError):
    """Another change came first; the same work may succeed again."""


class DeadlockDetected(SerializationFailure):
    pass


class LockTimeout(ServerError):
    """A lock was not to be had in time."""


class TransactionError(QuernError):
    """A transaction is used in a way that its state does not allow."""


class TransactionFailed(TransactionError):
    """A statement inside a transaction failed; only a rollback is left."""


class LockedResult(QuernError):
    """The result is already being read."""


class InvalidDataAccess(QuernError):
    """A column or row that is not there was asked for."""


def translated(error: Exception, sql: str | None = None) -> ServerError:
    """A Spark error as one of ours."""
    state = error.getSqlState() if hasattr(error, "getSqlState") else None
    kind = _BY_STATE.get(state or "", ServerError)
    return kind(str(error).split("\n\n")[0], sql, state)


#: States of the SQL standard and of Spark.
_BY_STATE = {
    "42P01": TableDoesNotExist, "42702": AmbiguousIdentifier, "42704": AmbiguousIdentifier,
    "40001": SerializationFailure, "40P01": DeadlockDetected, "55P03": LockTimeout,
}

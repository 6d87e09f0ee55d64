"""Exceptions of the public API."""


class LedgerError(Exception):
    """Base of all errors raised here."""


class NotInitialized(LedgerError):
    """No ledger at the path."""


class AlreadyInitialized(LedgerError):
    """A ledger is there already."""


class NotFound(LedgerError):
    """A record that was named does not exist."""


class AuthorNotFound(NotFound):
    """An author reference resolves to nobody."""


class SectionNotFound(NotFound):
    """No section has the hash or path."""


class InvalidRecord(LedgerError):
    """A record, hash or argument is malformed."""


class SourceStackError(LedgerError):
    """A source was popped that is not on the stack, or none is active."""


class StagedData(LedgerError):
    """Batches wait to be compacted."""


class StorageError(LedgerError):
    """A table could not be read or replaced."""


class NotRevoked(LedgerError):
    """An operation needs the author to be revoked first."""

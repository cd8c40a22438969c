"""The five failure classes a run can end with, under one base."""


class PactError(Exception):
    """Base of every failure this package reports."""

    @property
    def kind(self) -> str:
        return type(self).__name__

    def result_message(self) -> str:
        """Message for the result record, led by the class name."""
        return f"{self.kind}: {self}"


class ContractError(PactError):
    """The contract itself is invalid."""


class ReadError(PactError):
    """A read is undeclared, or its query does not resolve."""


class ScriptError(PactError):
    """User code raised, or returned something that is not a dataframe."""


class ConformError(PactError):
    """The produced table does not have the declared shape or values."""


class LoadError(PactError):
    """A source file could not be parsed, or the target could not be written."""

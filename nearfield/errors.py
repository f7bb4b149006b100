"""Errors, each with the HTTP-like ``code`` that a service would answer with."""

from __future__ import annotations


class NearfieldError(Exception):
    code = 500

    def payload(self) -> dict:
        return {"error": {"code": self.code, "kind": type(self).__name__, "message": str(self)}}


class InvalidParameter(NearfieldError, ValueError):
    code = 400


class DimensionMismatch(InvalidParameter):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"expected {expected} dimensions, got {actual}")
        self.expected, self.actual = expected, actual


class FilterSyntaxError(InvalidParameter):
    pass


class NumericError(InvalidParameter):
    pass


class InsufficientTrainingData(InvalidParameter):
    def __init__(self, needed: int, got: int):
        super().__init__(f"training needs {needed} vectors, got {got}")
        self.needed, self.got = needed, got


class EmptyIndex(InvalidParameter):
    pass


class Forbidden(NearfieldError):
    code = 403


class NotFound(NearfieldError, KeyError):
    code = 404

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else "not found"


class Conflict(NearfieldError):
    code = 409


class DuplicateId(Conflict):
    pass


class TooLarge(NearfieldError):
    code = 413


class Corrupted(NearfieldError):
    code = 500

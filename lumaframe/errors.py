"""Errors raised while a plan is built. Failures of single rows are null values with an error column instead."""


class ParameterError(ValueError):
    """A parameter is out of its range."""


class FormatError(ValueError):
    """A pixel format doesn't suit the operator, or a conversion doesn't exist."""


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ParameterError(message)

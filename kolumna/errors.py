"""Errors that the engine raises."""


class EngineError(Exception):
    """Anything wrong with a statement or its data."""


class ParseError(EngineError):
    """The text is no statement of the language."""


class BindError(EngineError):
    """The statement does not fit the tables: names, types, keys."""


class ConstraintError(EngineError):
    """Rows break a primary key or a length limit; nothing was written."""

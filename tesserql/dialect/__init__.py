"""Query text of the dialect."""

from tesserql.dialect.database import ConstraintError, Database
from tesserql.dialect.parser import DialectError, Unsupported
from tesserql.dialect.translate import Dialect

__all__ = ["ConstraintError", "Database", "Dialect", "DialectError", "Unsupported"]

"""Row expressions: a small typed language over change events, compiled to Spark columns."""

from fluxloom.expressions.compiler import Scope, compile_column, compile_predicate
from fluxloom.expressions.parser import ExpressionError, parse

__all__ = ["ExpressionError", "Scope", "compile_column", "compile_predicate", "parse"]

"""Union-find grouping: the library's connected components."""

from gridloom.operators.components import components, contract, roots

__all__ = ["components", "contract", "roots"]

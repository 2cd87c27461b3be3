from orderloom.sinks.warehouse import LoadError, Warehouse

__all__ = ["LoadError", "Warehouse"]

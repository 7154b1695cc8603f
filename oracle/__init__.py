from oracle.answers import ORACLE

__all__ = ["ORACLE"]

"""Plain helpers that the tests share."""

from test_ops import near_plain

__all__ = ["near_plain", "plain"]


def plain(rows):
    """Rows as sorted lists, numbers as floats to six figures."""

    def one(x):
        if x is None or isinstance(x, bool | str):
            return str(x)
        return f"{float(x):.6g}"

    return sorted(tuple(map(one, r)) for r in rows)

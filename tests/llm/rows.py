"""Rows that operators must survive."""

LONG = " ".join(f"word{i}" for i in range(30_000))
PROSE = "The quick brown fox jumps over the lazy dog and runs into the green forest near the old river bank today"


def edge_rows():
    """nulls in every column, empty and blank texts, very long texts, equal rows, ties"""
    return [
        (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, None, "en", "b"), (4, "", None, None),
        (5, " \t\n ", "en", "b"), (6, LONG, "en", "c"), (7, LONG, "en", "c"), (None, PROSE, None, None), (None, None, None, None),
        (8, "x", "fr", "b"), (9, "###", "fr", "b"), (10, PROSE + " again", "en", "a"),
    ]

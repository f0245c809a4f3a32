"""Rows of all kinds that operators must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHES = "print component_id words n b src size start row kept score copies rows rank place shard slot taken word ids at x".split()


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(("the", "of", "and", "river", "stone", "light", "carry", "house", "Öl", "naïve", "x1", "don't")) + r.choice(("", "", ".", ",")) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Texts of all kinds: null, blank, very long, alike, with odd characters; null ids and sources."""
    r = random.Random(4)
    rows = [(i, prose(r, r.randint(1, 200)), r.choice(("en", "de", None)), r.choice(("a", "b", "c", None)), 9) for i in range(60)]
    long = prose(r, 30_000)
    same = prose(r, 80)
    rows += [(100, None, "en", "a", None), (101, "", "en", "a", 0), (102, " \t\n\x0b\x0c\r ", None, None, 3), (103, long, "en", "a", len(long)), (104, "x" * 20_000, "en", "b", 1)]
    rows += [(105, same, "en", "a", 1), (105, same, "en", "a", 1), (106, same, "en", "b", 1), (107, same + " new", "en", "b", 1), (None, same, "en", None, None), (None, None, None, None, None)]
    rows += [(108, "漢字 🙂 é \x1c   <|endoftext|> ***", "en", "a", 1), (109, "line\nline\n\nline\r\n# a | b", "de", "b", 1)]
    return rows

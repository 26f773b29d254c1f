from __future__ import annotations

WORDS = [a + b + c for a in ("ba", "ke", "li", "mo", "nu", "ra", "se") for b in ("dan", "fel", "gor", "tis", "pul") for c in ("a", "en", "o")]


def prose(rng, n: int) -> str:
    """``n`` made-up words."""
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))

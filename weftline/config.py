"""Settings of the linkage engine as frozen values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pass:
    """One blocking pass: its name, its bit in a pair's mask, and how many candidate records a key may have."""

    name: str
    bit: int
    cap: int


@dataclass(frozen=True)
class Linkage:
    """Fixed values of the linkage semantics: passes and caps, rare tokens, cuts, grids."""

    passes: tuple[Pass, ...] = (Pass("name_exact", 1, 300), Pass("num_name", 2, 50), Pass("num_addr", 4, 50), Pass("name_pair", 8, 50), Pass("name_prefix", 16, 50))
    tfidf_bit: int = 32
    rare_name: int = 2
    rare_addr: int = 2
    rare_pair: int = 3
    rare_letters: int = 3
    rare_records: int = 2
    tfidf_top: int = 20
    tfidf_cosine: float = 0.3
    top_k: int = 50
    beta: float = 0.5
    thresholds: tuple[float, ...] = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
    relatives: tuple[float, ...] = (0.0, 0.3, 0.6)
    alphas: tuple[float, ...] = (0.0, 0.05, 0.1, 0.2)
    floors: tuple[float, ...] = (0.02, 0.05, 0.1)
    folds: int = 10
    validation_fold: int = 0
    uncertain: tuple[float, float] = field(default=(0.02, 0.999))


DEFAULT = Linkage()

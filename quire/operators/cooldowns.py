"""How long a provider's key rests after each answer: an ordered fold over a key's answers."""

from __future__ import annotations

import math

from quire.operators.folds import Fold

# Fixed values, in milliseconds: the first wait, the longest, the wait for a spent quota, the least for a window of tokens.
BASE, MOST, QUOTA, LEAST = 2_000, 300_000, 3_600_000, 1_000
# How often a wait doubles at most.
DOUBLINGS = {"rate_limit": 8, "server": 6}


def _guess(outcome: str, failures: int, draw: float | None) -> int:
    """The wait without any word of the server, spread by 25 % either way; `draw` is from 0 to 1, null in the middle."""
    spread = 0.75 + 0.5 * (0.5 if draw is None else draw)
    if outcome == "quota":
        return math.floor(QUOTA * spread + 0.5)
    doubled = BASE * 2 ** min(DOUBLINGS[outcome], failures - 1)
    if outcome == "server":
        return min(MOST, math.floor(doubled * spread + 0.5))
    return math.floor(min(MOST, doubled) * spread + 0.5)


def _told(outcome: str, wait: int, at: int, retry_after: int | None, resets_at: int | None, tokens_reset_at: int | None) -> int:
    """The wait after the server's own deadlines: one to retry after is never shortened, a window of tokens shortens a guess, and a
    spent quota lasts until its window ends."""
    if outcome == "server":
        return wait
    if retry_after is not None and retry_after > 0:
        wait = max(wait, retry_after)
    elif outcome == "rate_limit" and tokens_reset_at:
        wait = min(wait, max(tokens_reset_at - at, LEAST))
    return max(wait, resets_at - at) if outcome == "quota" and resets_at else wait


def cooldowns() -> Fold:
    """`until`, `reason`, `failures` of a key after each outcome at `at`; times in milliseconds.

    ok ends a rest and forgets failures; invalid ends it and keeps them; rate_limit, quota and server begin one, in place of any that
    runs. Other outcomes, null too, change nothing. Without a rest `until` is 0 and `reason` null.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        failures, until, reason = state
        at, outcome, retry_after, resets_at, tokens_reset_at, draw = row
        if outcome in ("ok", "invalid"):
            failures, until, reason = 0 if outcome == "ok" else failures, 0, None
        elif outcome in ("rate_limit", "quota", "server") and at is not None:
            failures, reason = failures + 1, outcome
            until = at + _told(outcome, _guess(outcome, failures, draw), at, retry_after, resets_at, tokens_reset_at)
        return (failures, until, reason), (until, reason, failures)

    takes = ("at", "outcome", "retry_after", "resets_at", "tokens_reset_at", "draw")
    return Fold(takes, "failures long, until long, reason string", (0, 0, None), "until long, reason string, failures long", step)

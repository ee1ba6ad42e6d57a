"""The state machine of a job, as a fold over its events."""

from __future__ import annotations

from quire.operators.folds import Fold

# State, event, next state. RESUME goes back to where the job was paused.
TABLE = (
    ("IDLE", "START", "PREFLIGHT"),
    ("PREFLIGHT", "PRECHECK_OK", "READY"),
    ("PREFLIGHT", "PRECHECK_FAIL", "FAILED"),
    ("PREFLIGHT", "PAUSE", "PAUSED"),
    ("PREFLIGHT", "CANCEL", "CANCELLED"),
    ("READY", "PARSE", "PARSING"),
    ("READY", "PAUSE", "PAUSED"),
    ("READY", "CANCEL", "CANCELLED"),
    ("READY", "RESET", "IDLE"),
    ("PARSING", "NEED_OCR", "OCR"),
    ("PARSING", "PARSE_OK", "TRANSLATING"),
    ("PARSING", "PARSE_FAIL", "FAILED"),
    ("PARSING", "PAUSE", "PAUSED"),
    ("PARSING", "CANCEL", "CANCELLED"),
    ("OCR", "OCR_DONE", "TRANSLATING"),
    ("OCR", "OCR_FAIL", "FAILED"),
    ("OCR", "PAUSE", "PAUSED"),
    ("OCR", "CANCEL", "CANCELLED"),
    ("TRANSLATING", "TRANSLATE_OK", "REVIEWING"),
    ("TRANSLATING", "TRANSLATE_FAIL", "FAILED"),
    ("TRANSLATING", "RATE_LIMIT", "WAITING_RATE_LIMIT"),
    ("TRANSLATING", "PAUSE", "PAUSED"),
    ("TRANSLATING", "CANCEL", "CANCELLED"),
    ("WAITING_RATE_LIMIT", "RETRY", "TRANSLATING"),
    ("WAITING_RATE_LIMIT", "TRANSLATE_OK", "REVIEWING"),
    ("WAITING_RATE_LIMIT", "TRANSLATE_FAIL", "FAILED"),
    ("WAITING_RATE_LIMIT", "PAUSE", "PAUSED"),
    ("WAITING_RATE_LIMIT", "CANCEL", "CANCELLED"),
    ("REVIEWING", "APPROVE", "LAYOUTING"),
    ("REVIEWING", "REVISE", "TRANSLATING"),
    ("REVIEWING", "PAUSE", "PAUSED"),
    ("REVIEWING", "CANCEL", "CANCELLED"),
    ("LAYOUTING", "LAYOUT_OK", "EXPORT_READY"),
    ("LAYOUTING", "LAYOUT_FAIL", "FAILED"),
    ("LAYOUTING", "PAUSE", "PAUSED"),
    ("LAYOUTING", "CANCEL", "CANCELLED"),
    ("EXPORT_READY", "RESET", "IDLE"),
    ("PAUSED", "RESUME", "*"),
    ("PAUSED", "CANCEL", "CANCELLED"),
    ("PAUSED", "RESET", "IDLE"),
    ("FAILED", "RETRY", "PREFLIGHT"),
    ("FAILED", "CANCEL", "CANCELLED"),
    ("FAILED", "RESET", "IDLE"),
    ("CANCELLED", "RESET", "IDLE"),
)
NEXT = {(a, e): b for a, e, b in TABLE}
TERMINAL = ("EXPORT_READY", "CANCELLED", "FAILED")

# The reason of a failure that names none.
FAILURES = {
    ("PREFLIGHT", "PRECHECK_FAIL"): "PDF_CORRUPTED", ("PARSING", "PARSE_FAIL"): "PDF_CORRUPTED", ("OCR", "OCR_FAIL"): "OCR_FAILED",
    ("TRANSLATING", "TRANSLATE_FAIL"): "BAD_JSON_RESPONSE", ("WAITING_RATE_LIMIT", "TRANSLATE_FAIL"): "QUOTA_EXHAUSTED", ("LAYOUTING", "LAYOUT_FAIL"): "EXPORT_FONT_MISSING",
}

TAKES = ("event", "at_ms", "has_text_layer", "needs_ocr", "retry_budget", "rate_limit_until", "failure_code")
STATE = "state string, text_layer boolean, ocr boolean, retries long, until long, revisions long, paused string, failure string"
START = ("IDLE", True, False, 3, 0, 0, None, None)


def available(state: str) -> list[str]:
    return [e for s, e in NEXT if s == state]


def _refusal(state: str, event: str, at: int, text_layer: bool, ocr: bool, retries: int, until: int, paused: str | None) -> str | None:
    """Why an event doesn't apply; null if it does."""
    match state, event:
        case key if key not in NEXT:
            return "INVALID_STATE_TRANSITION"
        case "PARSING", "PARSE_OK" if not text_layer or ocr:
            return "NO_TEXT_LAYER"
        case "WAITING_RATE_LIMIT", "RETRY" if at < until:
            return "QUOTA_EXHAUSTED"
        case ("FAILED", "RETRY") if retries <= 0:
            return "INVALID_STATE_TRANSITION"
        case ("PAUSED", "RESUME") if not paused or paused == "PAUSED":
            return "INVALID_STATE_TRANSITION"
    return None


def step(before: tuple, row: tuple) -> tuple[tuple, tuple]:
    """Values that come with an event are null where it has none; they count after its guards."""
    state, text_layer, ocr, retries, until, revisions, paused, failure = before
    event, at, new_layer, new_ocr, new_retries, new_until, code = row
    reason = _refusal(state, event, at or 0, text_layer, ocr, retries, until, paused)
    if reason:
        return before, (False, state, state, reason)
    to = NEXT[state, event]
    to = paused if to == "*" else to
    if event == "RESET":
        paused, failure, until, ocr, revisions = None, None, 0, False, 0
    elif event == "START":
        paused, failure = None, None
    elif (state, event) in FAILURES:
        failure = code or FAILURES[state, event]
    elif event == "RATE_LIMIT":
        until = new_until if new_until is not None else (at or 0) + 30_000
    elif event == "RESUME":
        until, paused = 0, None
    elif event == "PAUSE":
        paused = state
    elif (state, event) == ("PAUSED", "CANCEL"):
        paused = None
    elif (state, event) == ("FAILED", "RETRY"):
        retries, failure = retries - 1, None
    elif event in ("NEED_OCR", "OCR_DONE"):
        ocr = event == "NEED_OCR"
    revisions += event == "REVISE"
    given = lambda new, old: old if new is None else new
    after = (to, given(new_layer, text_layer), given(new_ocr, ocr), given(new_retries, retries), until, revisions, paused, failure)
    return after, (True, state, to, None)


FSM = Fold(TAKES, STATE, START, "ok boolean, from_state string, to_state string, reason string", step)

"""Classes of responses, errors and outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold import schemas as S


def live_status(code: Column) -> Column:
    """First rule that fits: 2xx alive (204 too), 403 and 429 restricted, terminal codes, other 500 to 504."""
    return (
        F.when(code.between(200, 299), S.ALIVE)
        .when(code.isin(403, 429), S.RESTRICTED)
        .when(code.isin(*S.TERMINAL_CODES), S.GONE)
        .when(code.between(500, 504), S.SERVER_ERROR)
        .otherwise(S.OTHER)
    )


def live_error(status: Column) -> Column:
    return F.when(status == S.RESTRICTED, "client_error").when(status == S.SERVER_ERROR, "server_error").otherwise("")


def is_terminal_capture(status: Column) -> Column:
    """Whether a capture's status, a text, is a terminal code (204 among them); false for what is no number."""
    return F.coalesce(F.trim(status).try_cast("int").isin(*S.TERMINAL_CODES), F.lit(False))


def archive_error(code: Column) -> Column:
    """The error of an archive's answer; null if it is one to parse, and 404 is an empty one."""
    return F.when(code == 404, None).when(code == 429, "rate_limited").when(code.between(500, 504), "server_error").when(code >= 400, "client_error")


# Attempts, first delay and longest delay in seconds by error class.
RETRY_POLICY: dict[str, tuple[int, float, float]] = {
    "timeout": (4, 2, 30),
    "connection_error": (4, 2, 30),
    "rate_limited": (5, 10, 300),
    "server_error": (5, 5, 120),
    "dns_failure": (3, 30, 600),
    "client_error": (1, 0, 0),
    "not_found": (1, 0, 0),
    "malformed_response": (1, 0, 0),
}
DEFAULT_POLICY = (2, 5, 60)


def _policy(error: Column, i: int) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in RETRY_POLICY.items() for x in (k, float(v[i]))))
    return F.coalesce(F.try_element_at(table, F.coalesce(error, F.lit(""))), F.lit(float(DEFAULT_POLICY[i])))


def should_retry(error: Column, attempts: Column) -> Column:
    return attempts < _policy(error, 0)


def longest_delay(error: Column, attempt: Column) -> Column:
    """The bound that a random delay stays under: doubling with each attempt."""
    return F.least(_policy(error, 2), _policy(error, 1) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))))


def failure_status(witness: Column, error: Column) -> Column:
    """A live failure of the net is evidence; any other failure leaves the matter open."""
    return F.when((witness == S.LIVE) & error.isin("dns_failure", "connection_error", "timeout"), S.GONE).otherwise(S.UNRESOLVED)


# Of the limiter and of sizing.
SPEEDUP, FRACTION_OF_TIMEOUT, MOST_THREADS = 4, 0.5, 128


def witness_slots(rps: Column, timeout: Column) -> Column:
    """Requests of a witness that may be open at once: its fastest rate times half its timeout, 2 to 128."""
    need = F.ceil(rps * SPEEDUP * F.greatest(F.lit(1.0), timeout * FRACTION_OF_TIMEOUT))
    return F.greatest(F.lit(2), F.least(F.lit(MOST_THREADS), need)).cast("int")

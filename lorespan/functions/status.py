"""Positional status strings: slot k is the k-th character from the right; missing slots are 'n'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespan.functions.text import col

EMBEDDING, GENERATE_PROBLEM, SYNC = 1, 2, 3
PENDING, STARTED, SUCCESS, FAILURE, REVOKE, REVOKED, IGNORED = "0", "1", "2", "3", "4", "5", "n"
SLOTS = 3


def padded(status: Column | str) -> Column:
    """Null counts as no task at all; longer strings keep their length."""
    status = F.coalesce(col(status), F.lit(""))
    return F.lpad(status, F.greatest(F.length(status), F.lit(SLOTS)), IGNORED)


def state(status: Column | str, slot: int) -> Column:
    return F.substring(F.reverse(padded(status)), slot, 1)


def with_state(status: Column | str, slot: int, new: str) -> Column:
    """The status with one slot set and all others as they were."""
    r = F.reverse(padded(status))
    return F.reverse(F.concat(F.substring(r, F.lit(1), F.lit(slot - 1)), F.lit(new), F.substring(r, F.lit(slot + 1), F.length(r))))


def all_done(status: Column | str) -> Column:
    return padded(status).rlike("^[2n]*$")


def recovered(status: Column | str) -> Column:
    """After a crash nothing is running: pending, started and revoking tasks have failed."""
    return F.translate(padded(status), PENDING + STARTED + REVOKE, FAILURE * 3)


def finalized(status: Column | str, slot: int, any_failure: Column) -> Column:
    """A task's last state: revoking becomes revoked, a failure below fails it, anything else succeeds."""
    out = padded(status)
    return F.when(state(out, slot) == REVOKE, with_state(out, slot, REVOKED)).when(any_failure, with_state(out, slot, FAILURE)).otherwise(with_state(out, slot, SUCCESS))

"""Identity: the string rule, deterministic job and run ids (UUID version 5) and canonical UUIDs, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The URL namespace of RFC 4122 and the names that ids are derived from.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
JOB_NAME, RUN_NAME = "astro.classification.job.v1", "classification-run-v1"
NIL = "00000000-0000-0000-0000-000000000000"


def good_string(s: Column) -> Column:
    """Not empty, no Unicode white space at either end, no NUL. Null is not good."""
    edge = s.rlike(r"^(?U:\s)") | s.rlike(r"(?U:\s)\z")
    return F.coalesce((F.length(s) > 0) & ~edge & (F.instr(s, "\0") == 0), F.lit(False))


def _prefixed(s: Column) -> Column:
    """Four bytes of length, then the UTF-8 bytes."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(s).cast("long")), 8, "0")), s.cast("binary"))


def _uuid5(namespace: Column, name: Column) -> Column:
    h = F.sha1(F.concat(namespace, name))
    # version 5 in digit 13; variant 10 in the top bits of digit 17, whose low bits stay: 0, 4, 8, c become 8 and so on
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.overlay(F.regexp_replace(h, "^(.{8})(.{4}).(.{3})(.{4})(.{12}).*$", "$1-$2-5$3-$4-$5"), variant, 20)


def job_id(object_id: Column, revision: Column, bundle: Column, mode: Column) -> Column:
    """Null where an input breaks its rule; equal inputs always give the same id."""
    name = F.concat(
        _prefixed(F.lit(JOB_NAME)),
        _prefixed(object_id),
        F.unhex(F.lpad(F.hex(revision.cast("long")), 16, "0")),
        _prefixed(bundle),
        F.unhex(F.lpad(F.hex(mode.cast("long")), 2, "0")),
    )
    fine = good_string(object_id) & good_string(bundle) & (revision > 0) & mode.isin(1, 2, 3)
    return F.when(fine, _uuid5(F.unhex(F.lit(URL_NAMESPACE)), name))


def canonical_uuid(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z") & (s != NIL), F.lit(False))


def run_id(job: Column) -> Column:
    """Null where the job id is no canonical UUID."""
    return F.when(canonical_uuid(job), _uuid5(F.unhex(F.replace(job, F.lit("-"), F.lit(""))), F.lit(RUN_NAME).cast("binary")))

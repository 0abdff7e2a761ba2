"""Plan-level helpers: intermediate tables and iteration."""

from ledgerloom.plans.scratch import materialize, release, scratch_root

__all__ = ["materialize", "release", "scratch_root"]

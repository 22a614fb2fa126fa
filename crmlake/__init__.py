"""crmlake: CRM and training-centre analytics as Spark DataFrame jobs.

Operators are plain ``DataFrame -> DataFrame`` functions parameterised by column
names (``crmlake.functions``, ``crmlake.operators``); named reports are thin
compositions of them (``crmlake.plans``). Every result is a lazy DataFrame that
Catalyst plans and executors run; no rows are collected to the driver (the only
values read back are single scalars: the current maximum key before an append
and the active-admin counts of the delete guard).
"""

from crmlake.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]

"""ledgerline: multichannel commerce analytics as Spark DataFrame jobs.

Order feeds, stock sheets and cost lists are normalised into one order-line
table; sales, stock, margin and claims reports are plain DataFrame plans over
it.  Every operator takes and returns DataFrames; nothing is collected.
"""

from ledgerline.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
